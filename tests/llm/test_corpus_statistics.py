"""Resampling, fingerprints and collocations against plain-Python versions, on tables with all odd cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quantloom.llm import collocations, fingerprints, resampling, vocabulary
from tests.conftest import SMALL, same
from tests.llm.test_operators import empty, texts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_with_odd_columns(spark, rows):
    """The rows with columns whose names clash with those inside the operators."""
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return frame.withColumns({c: F.lit(c) for c in ("row", "tie", "a", "b", "n", "word", "weight", "buckets", "score", "key", "place")}).repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(i, t, rng.choice(["en", "en", "de", None, ""])) for i, t in texts(3)]
    line = "the quick brown Fox jumps, over the quick brown fox; The quick"
    out += [(9000 + k, f"{line} {'x' * (k % 7)}\n{line}", rng.choice(["en", "en", None])) for k in range(60)]
    return [*out, (out[0][0], out[0][1], out[0][2]), (None, line, "en"), (None, "a b c " * 30, None), (77, "long " * 60_000, "en")]


# --- importance resampling -------------------------------------------------------------------------------------


def plain_features(text, shortest, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    grams = [" ".join(words[k : k + n]) for n in range(shortest, longest + 1) for k in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(g.encode()) for g in grams]


def plain_resample(docs, target, shortest, longest, buckets, seed, percent, min_words):
    counted = [(i, *plain_features(t, shortest, longest)) for i, t in docs]
    s = Counter(h % buckets for _, _, f in counted for h in f)
    t = Counter(h % buckets for x in target for h in plain_features(x, shortest, longest)[1])
    total_s, total_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * total_s / ((s[b] + 1.0) * total_t)))
    out = []
    for i, n, f in counted:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(x % buckets) for x in f)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((x for x in out if x[1] >= min_words), key=lambda x: (-x[4], math.inf if x[0] is None else x[0]))
    for k, x in enumerate(able[: percent * len(able) // 100]):
        x[5] = k + 1
    return out


@pytest.mark.parametrize(("shortest", "longest", "buckets"), [(1, 1, 10_000), (1, 3, 70_000), (2, 4, 50)])
def test_op11_equals_plain_python(spark, rows, shortest, longest, buckets):
    target = ["The quick brown fox", None, "", "té Lo jumps over", rows[3][1]]
    found = resampling.resample(docs_with_odd_columns(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"), shortest, longest, buckets, 7, 30, 5)
    key = lambda x: (x[0] is None, x[0] or 0, x[1:5], x[5] or 0)
    got = sorted((tuple(r) for r in found.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=key)
    want = sorted((tuple(x) for x in plain_resample([(i, t) for i, t, _ in rows], target, shortest, longest, buckets, 7, 30, 5)), key=key)
    # Of rows that are equal in id and score either may have the better rank.
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert sorted(x[5] for x in got if x[5]) == sorted(x[5] for x in want if x[5]) and {x for x in got if x[0] not in (None, rows[0][0])} == {x for x in want if x[0] not in (None, rows[0][0])}


def test_op11_equals_sql_and_empty_tables(spark, oracle):
    same(resampling.op11_importance_resampling(spark, SMALL), *oracle(resampling.OP11_SQL))
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert resampling.resample(empty(spark), some).count() == 0
    assert [tuple(r)[1:4] for r in resampling.resample(some, empty(spark)).collect()] == [(3, 3, 3 * math.floor(1000 * math.log(10003 / 20000)))]


def test_op11_suffix_array_runs_are_the_repeated_ngrams():
    rng = np.random.default_rng(2)
    lengths = [0, 1, 2, 40, 7, 0, 150]
    ids = rng.integers(0, 4, sum(lengths))
    left = np.concatenate([np.arange(n, 0, -1) for n in lengths])
    ends = np.cumsum(lengths)
    for n, places, starts in vocabulary.ngram_runs(ids, left, 1, 5):
        want = Counter(tuple(ids[i : i + n]) for i in range(len(ids)) if i + n <= ends[np.searchsorted(ends, i, side="right")])
        runs = np.split(places, starts[1:])
        assert {tuple(ids[r[0] : r[0] + n]): len(r) for r in runs if len(r)} == want
        assert all(tuple(ids[p : p + n]) == tuple(ids[r[0] : r[0] + n]) for r in runs for p in r)


# --- fingerprints ----------------------------------------------------------------------------------------------


def spark_hash(values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else v.encode(), seed & (1 << 64) - 1)
    return seed


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    terms = [words[k : k + 5] for k in range(max(len(words) - 4, 1))] if words else []
    halves = [(h, xxhash.xxh64_intdigest(h.to_bytes(8, "little"), 42)) for h in map(spark_hash, terms)]
    bits = [[sum(h[k] >> j & 1 for h in halves) * 2 > len(halves) for j in range(64)] for k in (0, 1)]
    return "".join(f"{sum(1 << j for j in range(64) if b[j]):016x}" for b in bits)


def test_op12_equals_plain_python(spark, rows, monkeypatch):
    """Ranges of some kilobytes and chunks of two, so that every row is near an edge."""
    rows = [r for r in rows if r[0] != 77] + [(77, "long " * 3000, "en")]
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 3000)
    monkeypatch.setattr(fingerprints, "CHUNK", 2)
    docs = docs_with_odd_columns(spark, rows)
    got = fingerprints.edited_fingerprints(docs).collect()
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    order = sorted(((i, t or "") for i, t, _ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), signed(spark_hash([r[1]]))))
    prints = {t: plain_fingerprint(t) for _, t in order}
    like = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128
    near = lambda a: sum((int(a, 16) ^ int(prints[t], 16)).bit_count() <= 6 for _, t in order) - 1
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        new = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), prints[t], plain_fingerprint(new), like(prints[t], plain_fingerprint(new)), like(prints[t], prints[after]), near(prints[t])))
    key = lambda r: (r[0] is None, *r[1:3], r[0] or 0, r[3:])
    assert sorted((tuple(r)[:8] for r in got), key=key) == sorted(want, key=key)
    least = defaultdict(list)
    for r in got:
        least[r.fingerprint].append(r.doc_id)
    assert all(r.class_id == min((i for i in least[r.fingerprint] if i is not None), default=None) for r in got)


def test_op12_radius_tables_find_all(spark):
    rng = random.Random(8)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    centres, seen = [rng.getrandbits(128) for _ in range(5)], {}
    for c in centres:
        for _ in range(60):
            x = c
            for _ in range(rng.randrange(9)):
                x ^= 1 << rng.randrange(128)
            seen[x] = rng.randint(1, 4)
    rows = [(signed(x & (1 << 64) - 1), signed(x >> 64), n) for x, n in seen.items()]
    for radius in (1, 3, 6):
        got = {(r.a, r.b): r.n_near for r in fingerprints.within_radius(spark.createDataFrame(rows, "a long, b long, n long"), radius).collect()}
        want = {x: sum(n for y, n in seen.items() if 0 < (x ^ y).bit_count() <= radius) for x in seen}
        assert got == {(signed(x & (1 << 64) - 1), signed(x >> 64)): n for x, n in want.items() if n}


def test_op12_edited_texts_stand_out_and_empty_tables(spark):
    assert fingerprints.edited_fingerprints(empty(spark)).count() == 0
    one = fingerprints.edited_fingerprints(spark.createDataFrame([(5, None)], "doc_id long, text string")).collect()[0]
    assert (one.n_chars, one.near_edited, one.near_next, one.n_near, one.fingerprint) == (0, 1.0, 1.0, 0, "0" * 32)
    got = fingerprints.op12_simhash(spark, SMALL).collect()
    assert sum(r.near_edited > r.near_next for r in got) >= 0.97 * len(got)


# --- collocations ----------------------------------------------------------------------------------------------


def plain_collocations(rows, min_count, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {g: a for g, a in counts.items() if a >= min_count}
        rows = []
        for g, a in often.items():
            longer = [b for h, b in often.items() if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))]
            if len(g) > 1 and not any(100 * b >= 80 * a for b in longer):
                score, k = min((2_000_000 * a // (counts[g[:k]] + counts[g[k:]]), k) for k in range(1, len(g)))
                rows.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        out += [(lang, place + 1, p.decode(), -a, l, r, n[lang], -s) for place, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("min_count", "top"), [(3, 2000), (2, 5), (40, 2000)])
def test_op13_equals_plain_python(spark, rows, monkeypatch, min_count, top):
    """Many blocks and buckets."""
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(collocations, "BUCKET_BYTES", 9000)
    rows = [r for r in rows if r[0] != 77] + [(77, "long, " * 3000 + "w " * 2000, "en")]
    got = collocations.collocations(docs_with_odd_columns(spark, rows), min_count=min_count, top=top)
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(rows, min_count, top)


def test_op13_equals_sql_and_empty_tables(spark, oracle):
    same(collocations.op13_phrase_collocations(spark, SMALL), *oracle(collocations.OP13_SQL))
    assert collocations.collocations(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_op13_counts_beyond_64_bits_are_exact(spark):
    big = 4_000_000_000_000_000_003
    cut = collocations.weakest_cut(F.col("n"), F.array(F.col("l")), F.array(F.col("r")))
    row = spark.createDataFrame([(big, big + 11, big + 5)], "n long, l long, r long").select(cut.alias("x")).first().x
    assert row.score == 2_000_000 * big // (2 * big + 16)
