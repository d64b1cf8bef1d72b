"""Importance resampling towards a target: documents are drawn in proportion to how much likelier their n-grams are in the target.

1. Features: each batch of texts gets word ids and a suffix array of them. Runs of common prefixes (LCP) are the distinct
   n-grams; each is hashed once a run, and its bucket goes back to all of the run's occurrences. A document's buckets are
   stored, two bytes an occurrence.
2. Counts: each task adds up its buckets, the sums of all tasks give each bucket's gain. Tables of `buckets` entries, a
   parameter, are all that reaches the driver.
3. Scores: a document's gains are added up; noise of a Gumbel distribution, fixed by seed and id, makes the highest scores a
   draw without replacement. Ranks come from a sort by ranges and the ranges' sizes, in no single task.

Rows are judged one by one, repeated ids and texts too; a null text has no words, a null id the noise of an empty one and the
last place among ties. Without target or documents every gain comes from the smoothing alone. Ties of score go to the smaller
id, ties of both to either row. One document's features are one task's work, however long it is.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm import shared
from quantloom.llm.text import chunks, text_bytes
from quantloom.llm.vocabulary import folded_word_ids, ngram_runs

BUCKETS, SEED, PERCENT, MIN_WORDS = 10_000, 2024, 10, 20
#: Bytes of text of which a suffix array is made at once.
CHUNK_BYTES = 4 << 20


def _dtype(buckets: int) -> str:
    return "u2" if buckets <= 1 << 16 else "u4"


def occurrence_buckets(data: np.ndarray, offsets: np.ndarray, shortest: int, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features of some texts, text by text; each text's first feature (n + 1 indexes) and number of words."""
    w = folded_word_ids(data, offsets)
    n_words = np.diff(w.first)
    left = np.repeat(w.first[1:], n_words) - np.arange(len(w.ids))
    words = w.words.to_pylist()
    doc = np.repeat(np.arange(len(n_words)), n_words)
    docs, found = [], []
    for n, places, starts in ngram_runs(w.ids, left, shortest, longest):
        firsts = places[starts]
        grams = np.stack([w.ids[firsts + k] for k in range(n)], axis=1).tolist() if len(firsts) else []
        hashed = np.array([zlib.crc32(b" ".join([words[i] for i in g])) % buckets for g in grams], _dtype(buckets))
        docs.append(doc[places])
        found.append(np.repeat(hashed, np.diff(np.r_[starts, len(places)])))
    docs, found = np.concatenate(docs), np.concatenate(found)
    order = np.argsort(docs, kind="stable")
    return found[order], np.searchsorted(docs[order], np.arange(len(n_words) + 1)), n_words


def features(docs: DataFrame, shortest: int, longest: int, buckets: int, doc_id: str | None = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features and the features' buckets as little-endian numbers, one row for each of `docs`."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch["text"])
            for first, part, own in chunks(data, offsets, CHUNK_BYTES):
                found, at, n_words = occurrence_buckets(part, own, shortest, longest, buckets)
                size = found.itemsize
                raw = pa.Array.from_buffers(pa.large_binary(), len(n_words), [None, pa.py_buffer(at.astype(np.int64) * size), pa.py_buffer(np.ascontiguousarray(found))])
                yield pa.record_batch(
                    [batch["doc_id"].slice(first, len(n_words)), pa.array(n_words, pa.int64()), pa.array(np.diff(at), pa.int64()), raw.cast(pa.binary())],
                    names=["doc_id", "n_words", "n_features", "buckets"],
                )

    ids = F.col(f"`{doc_id}`").cast("long") if doc_id else F.lit(None).cast("long")
    return docs.select(ids.alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(f, "doc_id long, n_words long, n_features long, buckets binary")


def bucket_counts(found: DataFrame, buckets: int) -> np.ndarray:
    """Occurrences in each bucket: `buckets` numbers, whatever the input."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for b in batch["buckets"]:
                total += np.bincount(np.frombuffer(b.as_buffer(), _dtype(buckets)), minlength=buckets)
        full = np.flatnonzero(total)
        yield pa.record_batch([pa.array(full, pa.int64()), pa.array(total[full])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in found.select("buckets").mapInArrow(f, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier each bucket is in the target, each count smoothed by one."""
    n = len(source)
    total_source, total_target = float(source.sum()) + n, float(target.sum()) + n
    return np.floor(1000 * np.log((target + 1.0) * total_source / ((source + 1.0) * total_target))).astype(np.int64)


def scored(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """`found` with weight, the sum of its features' gains, in place of the buckets."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = [int(gain[np.frombuffer(b.as_buffer(), _dtype(len(gain)))].sum()) for b in batch["buckets"]]
            yield pa.record_batch([batch["doc_id"], batch["n_words"], batch["n_features"], pa.array(weight, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return found.mapInArrow(f, "doc_id long, n_words long, n_features long, weight long")


def gumbel(seed: int, doc_id: Column) -> Column:
    """Thousandths of a Gumbel variable that seed and id fix."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(df: DataFrame, *order: Column) -> tuple[DataFrame, int]:
    """`df` with the place of each row in the given order, from 1, as `place`; and the number of rows.

    Rows are dealt by ranges of the order and numbered within each; sizes of the ranges, one number a partition, are all
    that the driver sees. Rows equal in all of the order may take several ranges, as their row number of the stored table
    deals them out.
    """
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = shared.stored(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    dealt = shared.stored(rows.repartitionByRange(n, *order, "_row").withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = {r["_range"]: r["count"] for r in dealt.groupBy("_range").count().collect()}
    before, total = {}, 0
    for k in sorted(sizes):
        before[k], total = total, total + sizes[k]
    offsets = spark.createDataFrame(list(before.items()) or [(0, 0)], "_range int, _before long")  # a row a partition
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order, "_row"))
    return dealt.withColumn("_place", place).join(F.broadcast(offsets), "_range").withColumn("place", F.col("_place") + F.col("_before")).drop("_row", "_range", "_place", "_before"), total


def resample(
    docs: DataFrame,
    target: DataFrame,
    shortest: int = 1,
    longest: int = 1,
    buckets: int = BUCKETS,
    seed: int = SEED,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of `docs`; rank is null for rows that are not drawn.

    Drawn are `percent` of the rows with `min_words` words, rounded down. Other columns of `docs` do not matter.
    """
    found = shared.stored(features(docs, shortest, longest, buckets, doc_id, text), "features")
    gain = gains(bucket_counts(found, buckets), bucket_counts(features(target, shortest, longest, buckets, None, target_text), buckets))
    scores = shared.stored(scored(found, gain).withColumn("score", F.col("weight") + gumbel(seed, F.col("doc_id"))), "scores")
    shared.discard(found)
    places, n = ranked(scores.filter(F.col("n_words") >= min_words), F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    drawn = math.floor(percent * n / 100) if isinstance(percent, float) else percent * n // 100
    ranks = places.withColumn("rank", F.when(F.col("place") <= drawn, F.col("place").cast("long"))).drop("place")
    return ranks.unionByName(scores.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    out = resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 is built up from its polynomial, byte by byte.
OP11_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT i AS byte, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT byte, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY byte) AS t FROM steps WHERE k = 8),
dw AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
bw AS (
  SELECT unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS w FROM benchmark),
d AS (SELECT r, unnest(words) AS w FROM dw),
v AS (SELECT w FROM d UNION SELECT w FROM bw),
hexes AS (SELECT w, hex(encode(w)) AS x FROM v),
hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(x) + 1, 2), lambda i: ('0x' || x[i:i + 1])::BIGINT)),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM hexes, crc),
s AS (SELECT bucket, count(*) AS n FROM d JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN hashed USING (w) GROUP BY bucket),
tot AS (SELECT (SELECT count(*) FROM d)::DOUBLE AS s, (SELECT count(*) FROM bw)::DOUBLE AS t),
g AS (
  SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (tot.s + 10000) / ((s.n + 1)::DOUBLE * (tot.t + 10000))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), tot),
sums AS (SELECT r, sum(gain)::BIGINT AS weight FROM d JOIN hashed USING (w) JOIN g USING (bucket) GROUP BY r),
scores AS (
  SELECT r, doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM dw LEFT JOIN sums USING (r)),
places AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scores WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scores LEFT JOIN places USING (r)
"""
