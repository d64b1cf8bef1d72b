"""Phrase collocation mining by hierarchical pair naming.

1. Blocks of text hold their words as keys of 64 bits. A block sends each of its distinct keys once, with its count, to the
   key's bucket; buckets add up what all blocks sent and answer each block with the names of those of its keys that are
   frequent, dense numbers that all blocks share. So a word or phrase that a third of all documents have costs an entry a block.
2. Each level replaces two adjacent frequent (k-1)-grams by the name of their pair, a k-gram; every k-gram of `min_count`
   occurrences is such a pair. One block a name, the first that has it, hands the name's two parents on to a catalog.
3. The parents are pointers: a phrase's text, the counts of both sides of each of its cuts, and the longer phrases that
   contain it are joins of one level of the catalog with the next.

Words are told apart by 64-bit hashes, all else is exact. Null texts have no words, null languages are one of their own by
name; repeated rows count as often as they occur; without frequent phrases there are no rows. A block has one language and
some megabytes of text, or one longer document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm import shared, tally
from quantloom.llm.text import fold_case, mix, multipliers, text_bytes
from quantloom.llm.vocabulary import word_ids

SHORTEST, LONGEST, MIN_COUNT, COVERED, TOP = 2, 4, 30, 80, 2000
NO_LANG = "und"
#: Text of a block, and text for whose keys a bucket answers, in bytes.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20
#: Parts of a language that are ranked by themselves before all of it.
PARTS = 64
_PIECE_ENDS = np.isin(np.arange(256), list(b".,;:!?\n\v\f\r"))
_STATE = "blk long, lang string, n_words long, units binary, words array<string>, places binary, adjacent binary, named array<struct<key:long,left:long,right:long,n:long,word:string>>"
_SENT = "bucket int, blk long, lefts binary, rights binary, counts binary"
_ANSWER = "bucket int, blk long, often binary, names binary, own binary, totals binary"
_KINDS = {
    "blk": pa.int64(), "lang": pa.string(), "n_words": pa.int64(), "units": pa.binary(), "words": pa.list_(pa.string()), "places": pa.binary(), "adjacent": pa.binary(),
    "named": pa.list_(pa.struct([("key", pa.int64()), ("left", pa.int64()), ("right", pa.int64()), ("n", pa.int64()), ("word", pa.string())])),
}


def _squeezed(x: np.ndarray) -> bytes:
    """Planes of small numbers, packed by entropy: about half of what is stored and shuffled is saved."""
    return zstandard.ZstdCompressor(level=1).compress(tally.planes(x))


def _opened(b: bytes, dtype: str) -> np.ndarray:
    return tally.from_planes(zstandard.ZstdDecompressor().decompress(b), dtype)


def _steps(x: np.ndarray) -> bytes:
    """Sorted numbers by what each adds to the one before."""
    return _squeezed(np.diff(x, prepend=x.dtype.type(0)))


def _from_steps(b: bytes, dtype: str = "u8") -> np.ndarray:
    return np.cumsum(_opened(b, dtype), dtype=dtype)


@dataclass
class Grams:
    """A block's frequent k-grams in text order: distinct names (or hashes of words) in order, each place's name, and whether the next place is the next k-gram of the text."""

    units: np.ndarray
    places: np.ndarray
    adjacent: np.ndarray

    def packed(self) -> dict[str, bytes]:
        return {"units": _squeezed(self.units), "places": _squeezed(self.places.astype(np.uint32)), "adjacent": _squeezed(self.adjacent.astype(np.uint8))}

    @staticmethod
    def of(units: bytes, places: bytes, adjacent: bytes) -> Grams:
        return Grams(_opened(units, "u8"), _opened(places, "u4").astype(np.int64), _opened(adjacent, "u1").astype(bool))

    def pairs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places at which names of level k start, and a local number for each such name: words are names of level 1, pairs those of others."""
        if k == 1:
            return np.arange(len(self.places)), self.places
        at = np.flatnonzero(self.adjacent)
        return at, self.places[at] * len(self.units) + self.places[at + 1]

    def parents(self, local: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The two units of local numbers; words have themselves and 0."""
        if k == 1 or not len(local):
            return self.units[local], np.zeros(len(local), np.uint64)
        return self.units[local // len(self.units)], self.units[local % len(self.units)]

    def dealt(self, k: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The block's different local numbers of level k by bucket, then by parents: numbers, counts, both parents, and where each bucket begins."""
        local, counts = np.unique(self.pairs(k)[1], return_counts=True)  # units are in order, so parents are too
        left, right = self.parents(local, k)
        a, b = multipliers(2)
        bucket = ((mix(left * a + right * b) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        return local[order], counts[order], left[order], right[order], np.searchsorted(bucket[order], np.arange(buckets + 1))

    def named(self, k: int, known: np.ndarray, names: np.ndarray) -> Grams:
        """Places of frequent names of level k (their local numbers and names), and those alone that have a neighbour."""
        at, local = self.pairs(k)
        order = np.argsort(known)
        frequent, where = tally.found(local, known[order])
        at, name = at[frequent], names[order][where[frequent]] if len(order) else names[:0]
        follows = np.r_[(at[1:] == at[:-1] + 1) & self.adjacent[at[:-1]], False] if len(at) else np.zeros(0, bool)
        keep = follows | np.r_[False, follows[:-1]] if len(at) else follows
        units, places = np.unique(name[keep], return_inverse=True)
        return Grams(units, places, follows[keep])


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows of about BLOCK_BYTES of text."""
    held, size = [], 0
    for batch in batches:
        offsets, at = text_bytes(batch["text"])[1], 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES - size, side="right")) - 1)
            held.append(batch.slice(at, to - at))
            size += int(offsets[to] - offsets[at])
            if size >= BLOCK_BYTES:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            at = to
    if held:
        yield pa.Table.from_batches(held)


def _row(blk: int, lang: str, n_words: int, grams: Grams, words: list[str] | None, named: list[dict]) -> pa.Table:
    row = {"blk": blk, "lang": lang, "n_words": n_words, "words": words, "named": named} | grams.packed()
    return pa.table({c: pa.array([row[c]], t) for c, t in _KINDS.items()})


def _words_of(lang: str, texts: pa.ChunkedArray) -> tuple[Grams, list[str]]:
    data, offsets = text_bytes(texts)
    data = fold_case(data)
    ends = _PIECE_ENDS[data]
    w = word_ids(data, offsets, ~(ends | (data == 32) | (data == 9)))
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    hashes = np.array([xxhash.xxh3_64_intdigest(x, seed) for x in w.words.to_pylist()], np.uint64)
    units, first, place = np.unique(hashes, return_index=True, return_inverse=True)
    if not len(w.starts):
        return Grams(units, place, np.zeros(0, bool)), []
    # Pieces and texts in one number that never falls: places of equal numbers are in one piece.
    piece = np.cumsum(ends)[w.starts] + np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    words = w.words.take(pa.array(first)).cast(pa.large_string()).to_pylist()
    return Grams(units, place[w.ids], np.r_[piece[1:] == piece[:-1], False]), words


def _word_blocks(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """A state row for each block and language; blocks lie within the scan's partitions, so no text is shuffled."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blk = TaskContext.get().partitionId() << 32
        for table in _blocks_of(batches):
            for name in pc.unique(table["lang"]).to_pylist():
                grams, words = _words_of(name, table["text"].filter(pc.equal(table["lang"], name)))
                yield from _row(blk, name, len(grams.places), grams, words, []).to_batches()
                blk += 1

    return docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(f"`{text}`").alias("text")).mapInArrow(f, _STATE)


def _deal(state: DataFrame, k: int, buckets: int) -> DataFrame:
    """(bucket, blk, lefts, rights, counts): each block's distinct keys of level k, by their parents, and their counts."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                _, counts, left, right, cuts = Grams.of(r["units"], r["places"], r["adjacent"]).dealt(k, buckets)
                full = np.flatnonzero(np.diff(cuts))
                cut = lambda x, to: pa.array([to(x[cuts[i] : cuts[i + 1]]) for i in full], pa.binary())  # noqa: E731, B023
                yield pa.record_batch([pa.array(full, pa.int32()), pa.array(np.full(len(full), r["blk"]), pa.int64()), cut(left, _steps), cut(right, _squeezed), cut(counts.astype(np.uint32), _squeezed)], names=["bucket", "blk", "lefts", "rights", "counts"])

    return state.select("blk", "units", "places", "adjacent").mapInArrow(f, _SENT)


def _frequent(sent: DataFrame, buckets: int, min_count: int) -> DataFrame:
    """For each bucket and block which of the block's keys all blocks together have often enough.

    Keys are not sent back: `often` has a bit for each in the order in which they came. `names` are the numbers of the frequent
    ones among the bucket's, `own` has a bit for those of which the block is the first to have them, `totals` their counts.
    """

    def resolve(table: pa.Table) -> pa.Table:
        lefts, rights, counts = ([f(b) for b in table[c].to_pylist()] for c, f in (("lefts", _from_steps), ("rights", lambda b: _opened(b, "u8")), ("counts", lambda b: _opened(b, "u4"))))
        sizes = [len(x) for x in lefts]
        left, right, n = np.concatenate(lefts), np.concatenate(rights), np.concatenate(counts).astype(np.int64)
        order = np.lexsort((np.repeat(table["blk"].to_numpy(), sizes), right, left))
        a, b = left[order], right[order]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        total = np.add.reduceat(n[order], first)
        frequent = total >= min_count
        many = np.diff(np.r_[first, len(a)])
        often, name, own = np.zeros(len(a), bool), np.zeros(len(a), np.uint32), np.zeros(len(a), np.uint64)
        often[order], name[order] = np.repeat(frequent, many), np.repeat((np.cumsum(frequent) - frequent).astype(np.uint32), many)
        own[order[first]] = np.where(frequent, total, 0)
        rows: dict[str, list] = {"often": [], "names": [], "own": [], "totals": []}
        ends = np.cumsum(sizes)
        for at, to in zip(ends - sizes, ends, strict=True):
            here = often[at:to]
            mine = own[at:to][here]
            for c, x in (("often", np.packbits(here).tobytes()), ("names", _steps(name[at:to][here])), ("own", np.packbits(mine > 0).tobytes()), ("totals", _squeezed(mine[mine > 0]))):
                rows[c].append(x)
        return pa.table({"bucket": table["bucket"], "blk": table["blk"]} | {c: pa.array(x, pa.binary()) for c, x in rows.items()})

    return sent.groupBy("bucket").applyInArrow(resolve, _ANSWER)


def _next_level(state: DataFrame, frequent: DataFrame, k: int, buckets: int, last: bool) -> DataFrame:
    """States of the names of level k; `named` has those that this block hands on."""

    def step(mine: pa.Table, answers: pa.Table) -> pa.Table:
        r = mine.to_pylist()[0]  # a block is a row
        grams = Grams.of(r["units"], r["places"], r["adjacent"])
        local, _, left, right, cuts = grams.dealt(k, buckets)
        known, names, own, totals = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for x in answers.to_pylist():
            at = cuts[x["bucket"]]
            often = at + np.flatnonzero(np.unpackbits(np.frombuffer(x["often"], np.uint8), count=cuts[x["bucket"] + 1] - at))
            # Names are dense: the key's number among the bucket's frequent ones, and the bucket.
            number = _from_steps(x["names"], "u4").astype(np.uint64) * np.uint64(buckets) + np.uint64(x["bucket"])
            first = np.flatnonzero(np.unpackbits(np.frombuffer(x["own"], np.uint8), count=len(often)))
            own.append(sum(map(len, known)) + first)
            known.append(often)
            names.append(number)
            totals.append(_opened(x["totals"], "u8"))
        known, names, own, totals = np.concatenate(known), np.concatenate(names), np.concatenate(own), np.concatenate(totals)
        mine_first = known[own]
        words = [r["words"][i] for i in local[mine_first].tolist()] if k == 1 else [None] * len(own)
        numbers = [x.view(np.int64).tolist() for x in (names[own], left[mine_first], right[mine_first], totals)]
        named = [dict(zip(("key", "left", "right", "n", "word"), x, strict=True)) for x in zip(*numbers, words, strict=True)]
        new = Grams(names[:0], local[:0], np.zeros(0, bool)) if last else grams.named(k, local[known], names)
        return _row(r["blk"], r["lang"], 0, new, None, named)

    return state.groupBy("blk").cogroup(frequent.groupBy("blk")).applyInArrow(step, _STATE)


def phrase_catalog(docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT, text: str = "text", lang: str = "lang") -> tuple[list[DataFrame], DataFrame]:
    """Stored catalogs of the frequent phrases of 1, 2... `longest` words, and words by language (lang, n).

    A catalog has lang, key, left, right (the parents' keys), phrase, last (its last word), n, and the counts of its first
    1, 2... words in `starts` and of what follows those in `ends`.
    """
    buckets = tally.parts(tally.text_size(docs, f"`{text}`"), BUCKET_BYTES)
    state = shared.stored(_word_blocks(docs, text, lang), "words")
    totals = shared.stored(state.groupBy("lang").agg(F.sum("n_words").alias("n")), "totals")
    levels: list[DataFrame] = []
    for k in range(1, longest + 1):
        after = shared.stored(_next_level(state, _frequent(_deal(state, k, buckets), buckets, min_count), k, buckets, k == longest), f"level{k}")
        names = after.select("lang", F.explode("named").alias("x")).select("lang", "x.*")
        if k == 1:
            empty = F.array().cast("array<bigint>")
            level = names.select("lang", "key", "left", "right", F.col("word").alias("phrase"), F.col("word").alias("last"), "n", empty.alias("starts"), empty.alias("ends"))
        else:
            before = levels[-1]
            a = before.select(F.col("key").alias("left"), F.col("phrase").alias("head"), F.concat("starts", F.array("n")).alias("starts"))
            b = before.select(F.col("key").alias("right"), "last", F.concat(F.array("n"), "ends").alias("ends"))
            level = names.join(a, "left").join(b, "right").select("lang", "key", "left", "right", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "n", "starts", "ends")
        levels.append(shared.stored(level, f"catalog{k}"))
        shared.discard(state)
        state = after
    shared.discard(state)
    return levels, totals


def weakest_cut(n: Column, starts: Column, ends: Column) -> Column:
    """(score, k, l, r) of the cut of the lowest score, 2,000,000 n / (l + r) rounded down; the first of equal ones.

    Products are decimals of 38 digits, so that counts of any size are exact.
    """

    def cut(k: Column) -> Column:
        left, right = F.get(starts, k), F.get(ends, k)
        whole = F.floor(F.call_function("div", n.cast("decimal(20,0)") * F.lit(2_000_000).cast("decimal(7,0)"), left.cast("decimal(20,0)") + right.cast("decimal(20,0)")))
        return F.struct(whole.cast("long").alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))

    return F.array_min(F.transform(F.sequence(F.lit(0), F.size(starts) - 1), cut))


def collocations(docs: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, min_count: int = MIN_COUNT, covered: int = COVERED, top: int | None = TOP, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases, `top` of them or all.

    A phrase goes if a longer frequent one contains it and has `covered` percent of its count; one longer by a word
    decides, since it has at least the count of any longer still.
    """
    levels, totals = phrase_catalog(docs, longest, min_count, text, lang)
    kept = []
    for k in range(shortest, longest + 1):
        level = levels[k - 1].withColumn("cut", weakest_cut(F.col("n"), F.col("starts"), F.col("ends")))
        if k < longest:
            over = levels[k].select(F.explode(F.array("left", "right")).alias("key"), F.col("n").alias("over")).groupBy("key").agg(F.max("over").alias("over"))
            level = level.join(over, "key", "left").filter(F.coalesce(F.col("over"), F.lit(0)) * 100 < F.col("n") * covered).drop("over")
        kept.append(level.select("lang", "phrase", F.col("n").alias("a"), "cut.l", "cut.r", "cut.score"))
    out = kept[0]
    for x in kept[1:]:
        out = out.unionByName(x)
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    if top is not None:  # first the best of each part of a language, which may have most of all phrases
        part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
        out = out.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    if top is not None:
        out = out.filter(F.col("rank") <= top)
    return out.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS p, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
totals AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
grams AS (
  SELECT lang, k, w[i:i + k - 1] AS g
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, range(1, 5) t(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, array_to_string(g, ' ') AS phrase, any_value(g) AS g, count(*)::HUGEINT AS a FROM grams GROUP BY ALL HAVING count(*) >= 30),
cuts AS (
  SELECT lang, k, phrase, a, g, c, array_to_string(g[1:c], ' ') AS head, array_to_string(g[c + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS c FROM f WHERE k >= 2)),
cut_scores AS (
  SELECT x.lang, x.k, x.phrase, x.a, c, h.a AS l, t.a AS r, (2000000 * x.a) // (h.a + t.a) AS score
  FROM cuts x JOIN f h ON h.lang = x.lang AND h.phrase = x.head JOIN f t ON t.lang = x.lang AND t.phrase = x.tail),
best AS (SELECT * FROM cut_scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inner_phrases AS (
  SELECT lang, array_to_string(g[i:i + j - 1], ' ') AS phrase, max(a) AS over
  FROM (SELECT lang, g, a, j, unnest(range(1, k - j + 2)) AS i FROM (SELECT lang, g, a, k, unnest(range(2, k)) AS j FROM f WHERE k >= 3)) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inner_phrases i USING (lang, phrase) WHERE i.over IS NULL OR 100 * i.over < 80 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
