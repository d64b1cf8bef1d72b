"""Winning brokers and situations against plain Python."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from quantloom.operators import dna, registry
from quantloom.plans import winners
from tests.conftest import SMALL


def plain_warping(a, b):
    table = np.full((len(a) + 1, len(b) + 1), np.inf)
    table[0, 0] = 0
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = abs(x - y) + min(table[i, j + 1], table[i + 1, j], table[i, j])
    return table[-1, -1] / max(len(a), len(b))


def shape(x):
    x = np.asarray(x, float)
    return np.zeros(len(x)) if x.std() < 1e-8 else (x - x.mean()) / x.std()


def plain_match(samples, today, bars, k, threshold):
    """A loop over codes and samples."""
    prices = {}
    for r in sorted(bars, key=lambda r: (r.code, r.date)):
        prices.setdefault(r.code, ([], []))
        prices[r.code][0].append(r.date)
        prices[r.code][1].append(r.close)
    out = {}
    for q in today:
        cosine = lambda s: float(np.dot(q.vector, s.vector) / ((np.linalg.norm(q.vector) or 1) * (np.linalg.norm(s.vector) or 1)))  # noqa: B023, E731
        near = sorted(((-round(cosine(s), 6), s.code, s.date, s) for s in samples), key=lambda x: x[:3])[:k]
        near = [(-c, s) for c, _, _, s in near if c < 0]
        if not near:
            continue
        votes = Counter(s.cluster for _, s in near)
        cluster = max(votes, key=lambda c: (votes[c], -min(i for i, (_, s) in enumerate(near) if s.cluster == c)))
        likeness, failed = np.mean([c for c, _ in near]), np.mean([s.label == "loser" for _, s in near])
        final, long, short = likeness, [], []
        ours = prices[q.code][1][-60:]
        if round(likeness, 9) >= threshold:
            for _, s in near if len(ours) == 60 else ():
                at = prices[s.code][0].index(s.date)
                theirs = prices[s.code][1][max(0, at - 60) : at]
                if len(theirs) >= 20:
                    n = len(theirs)
                    long.append(plain_warping(shape(ours)[-n:], shape(theirs)))
                    short.append(plain_warping(shape(ours[-20:]), shape(theirs[-20:])))
            final = 0.7 * likeness + 0.3 * (1 / (1 + np.mean(long)) if long and np.mean(long) > 0 else 1)
            if long and np.mean(long) < 1 and np.mean(short) < 1:
                final = min(1, 1.5 * final)
        mean = lambda x: float(np.mean(x)) if x else None
        out[q.code] = (len(near), cluster, likeness, failed, bool(failed >= 0.6), bool(round(likeness, 9) >= threshold), mean(long), mean(short), bool(long) and np.mean(long) < 1 and np.mean(short) < 1, final)
    return out


@pytest.mark.parametrize("threshold", [0.3, 0.45, 0.99])
def test_dna_match_equals_a_plain_version(spark, threshold):
    samples, today, bars = winners.dna_inputs(spark, SMALL)
    got = {r.code: tuple(r)[1:] for r in dna.match(samples, today, bars, threshold=threshold).collect()}
    want = plain_match(samples.collect(), today.collect(), bars.collect(), 5, threshold)
    assert got.keys() == want.keys() and len(got) == 10
    for code, row in want.items():
        assert all(g == pytest.approx(w, abs=1e-9) if isinstance(w, float) else g == w for g, w in zip(got[code], row, strict=True)), (code, got[code], row)


def test_dna_match_of_short_and_flat_series(spark):
    pairs = [(1, 1, [1.0] * 60, [2.0] * 60), (1, 2, [float(k) for k in range(60)], [float(k * k) for k in range(25)]), (1, 3, [1.0, 2.0] * 30, [1.0] * 19), (2, 1, [1.0, 2.0] * 29, [1.0, 2.0] * 30)]
    got = {(r.query, r.place): (r.dtw_60, r.dtw_20) for r in dna.shape_distances(spark.createDataFrame(pairs, "query long, place int, ours array<double>, theirs array<double>")).collect()}
    ours, theirs = pairs[1][2:]
    assert got[1, 1] == (0.0, 0.0) and got[1, 3] == got[2, 1] == (None, None)
    assert got[1, 2] == pytest.approx((plain_warping(shape(ours)[-25:], shape(theirs)), plain_warping(shape(ours[-20:]), shape(theirs[-20:]))), abs=1e-12)
    empty = spark.createDataFrame([], "query long, place int, ours array<double>, theirs array<double>")
    assert dna.shape_distances(empty).count() == 0


def test_resampled_sums_are_those_of_uniform_numbers(spark):
    """Draws as matrices against the same numbers row by row, at the steps and beyond a chunk; a task that keeps few brokers loses none."""
    from pyspark.sql import functions as F

    steps = np.unique(np.concatenate([registry._STEPS + k for k in (-1, 0, 1)]))
    steps = steps[steps < registry._PRIME]
    assert registry._weights(steps[:, None])[:, 0].tolist() == [sum(x / float(registry._PRIME) >= p for p in registry.POISSON) for x in steps.tolist()]
    bought = spark.range(300).select((F.col("id") % 3).alias("broker"), (F.col("id") * 977).alias("code"), F.date_add(F.lit("1999-01-31").cast("date"), (F.col("id") * 13).cast("int")).alias("date"), ((F.col("id") * 37 % 101 - 50) / 40).alias("ret"))
    u = registry.uniform("broker", "code", F.unix_date("date").cast("long"), F.col("draw").cast("long"))
    rows = bought.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(40)))).withColumn("w", sum((F.when(u >= p, 1).otherwise(0) for p in registry.POISSON), F.lit(0)))
    won = F.col("ret") > 0
    each = rows.groupBy("broker", "draw").agg(F.sum("w"), F.sum(F.when(won, F.col("w")).otherwise(0)), F.sum(F.when(won, F.col("ret") * F.col("w")).otherwise(0.0)), F.sum(F.when(won, 0.0).otherwise(F.col("ret") * F.col("w"))))
    want = np.zeros((3, 4, 40))
    for broker, draw, *sums in each.collect():
        want[broker, :, draw - 1] = sums
    starts = bought.select("broker", registry._start(F.col("broker"), F.col("code"), F.unix_date("date").cast("long")).alias("start"), "ret").toPandas()
    for broker, own in starts.groupby("broker"):
        assert np.allclose(registry.resampled(own["start"].to_numpy(), own["ret"].to_numpy(), 40), want[broker], rtol=1e-12, atol=1e-9)
    whole = registry.intervals(bought.coalesce(1), 40).collect()
    kept, registry.KEPT = registry.KEPT, 1
    try:
        few = registry.intervals(bought.coalesce(1), 40).collect()
    finally:
        registry.KEPT = kept
    assert sorted((r[0], round(r[1], 9), round(r[2], 9)) for r in whole) == sorted((r[0], round(r[1], 9), round(r[2], 9)) for r in few)


def test_ties_of_cases_go_to_the_least_code(spark):
    """More equal cases than are kept: codes are copies of each other, as in SQL the least ones count."""
    import datetime as dt

    from quantloom.operators import dual

    day = lambda i: (dt.date(2020, 1, 1) + dt.timedelta(i), (dt.date(2020, 1, 1) - dt.date(1970, 1, 1)).days + i)
    rows = [(code, *day(i), 0, 0.0, 0.0, [1.0, 2.0], [1.0, 2.0]) for code in range(400, 0, -1) for i in (0, 40)]
    frame = spark.createDataFrame(rows, "code long, date date, day int, regime int, growth double, polarity double, raw array<double>, augmented array<double>")
    found = dual.cases(frame, frame.filter("code = 400 AND date = '2020-02-10'"), k=3).collect()
    assert sorted((r["search"], r["place"], r["code"]) for r in found) == sorted((s, n + 1, n + 1) for s in ("raw", "augmented") for n in range(3))
    near = spark.createDataFrame([(i, [1.0, 1.0 if i < 300 else -1.0]) for i in range(599, -1, -1)], "id long, v array<double>")
    from quantloom.operators.similarity import nearest_vectors

    assert sorted((r["place"], r["id"]) for r in nearest_vectors(near, near.filter("id = 1"), 4, "id", "v").collect()) == [(1, 0), (2, 2), (3, 3), (4, 4)]


@pytest.mark.parametrize(("queries", "rows", "width", "copies", "k"), [(300, 9000, 45, 0, 5), (300, 5000, 8, 3000, 7), (600, 4200, 64, 2000, 10), (50, 3, 4, 0, 5)])
def test_best_pairs_equal_all_products(monkeypatch, queries, rows, width, copies, k):
    """Against all products in double; few of the pairs are worked out in double, however many rows are copies."""
    from quantloom.operators import similarity

    rng = np.random.default_rng(rows)
    x, keys = rng.normal(size=(rows, width)), rng.permutation(rows)
    x[:copies], x[-1] = x[0], 0
    y, ids = (x[:queries], keys[:queries]) if queries < rows else (rng.normal(size=(queries, width)), -1 - np.arange(queries))
    unit = lambda v: v / np.where((n := np.linalg.norm(v, axis=1, keepdims=True)) == 0, 1, n)
    x, y = unit(x), unit(y)
    exact, plain = [], np.einsum
    monkeypatch.setattr(similarity.np, "einsum", lambda f, a, b: exact.append(len(a)) or plain(f, a, b))
    got = sorted(zip(*(v.tolist() for v in similarity.best_pairs(ids, keys, y, x, k)), strict=True))
    all_pairs = np.round(y @ x.T, 6)
    want = []
    for q in range(queries):
        order = sorted((-s, key, j) for j, (s, key) in enumerate(zip(all_pairs[q].tolist(), keys.tolist(), strict=True)) if s > 0 and key != ids[q])
        want += [(q, j, -s) for s, _, j in order[:k]]
    assert got == sorted(want)
    assert rows < 100 or sum(exact) < queries * rows / 20


def test_dna_match_reads_its_situations_from_one_table(spark):
    """The matrix and the days that count are not worked out again by each reader of samples and today's codes."""
    samples, today, _ = winners.dna_inputs(spark, SMALL)
    files = samples.inputFiles()
    assert files and files == today.inputFiles() and all("dna_situations" in f for f in files)
    assert today.count() == today.select("code").distinct().count() == 10
