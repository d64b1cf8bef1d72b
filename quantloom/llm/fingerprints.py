"""SimHash fingerprints of documents, their likeness, and a search for all fingerprints within a Hamming radius.

1. Fingerprint: the terms of a text are its runs of five words (fewer words are one term). Each occurrence of a term votes
   on 128 signed bits with the term's hash, so a term weighs as much as it occurs; a bit is set where more than half agree.
   Votes of two bits at a time are added up in one long, which makes 64 sums a text and one row a text to shuffle.
2. Search: 128 bits are cut into `radius` + 2 blocks. Of fingerprints within the radius at least two blocks are equal, so
   each pair meets in the table of a pair of blocks, and in the first such table only it counts. Equal fingerprints are one
   entry with their number of documents; a table's hot keys are cut into chunks of a bounded size, and an entry meets
   chunks, not pairs.
3. Order: what follows a document in order of ids is found within ranges of ids; each range borrows the first row of the
   next, so no task needs more than a range.

All is DataFrame expressions. Null texts are empty; texts without words have the fingerprint of no votes, all zeros, and so
are alike. Case matters not for A-Z. Rows that repeat an id follow each other in order of their texts' hashes; rows without
an id come last. An only row is followed by itself.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm import shared, tally
from quantloom.llm.url_filter import LOWER, UPPER

SHINGLE, BITS, RADIUS = 5, 128, 6
#: Fingerprints of a chunk of one table's key.
CHUNK = 512
#: Text of a range of ids in bytes, and the most ranges there are.
RANGE_BYTES, MAX_RANGES = 1 << 20, 1 << 15
_LANES = 0x0000000100000001


def words(text: Column) -> Column:
    """Runs of characters other than space and 0x09-0x0D, A-Z in lower case."""
    lower = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(lower, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")


def term_hashes(words: Column, shingle: int = SHINGLE) -> Column:
    """A hash for each run of `shingle` words; fewer words are one run, no words none."""
    last = F.greatest(F.size(words) - shingle, F.lit(0))
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(shingle))))
    return F.when(F.size(words) > 0, each).otherwise(F.array().cast("array<bigint>"))


def fingerprints(texts: DataFrame, *keys: str, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """`keys` and the fingerprint (a, b: long) of each row of `texts`; the keys tell the rows apart."""
    split = texts.select(*keys, words(F.coalesce(F.col(text), F.lit(""))).alias("_w"))
    # Arrays are columns before they are exploded: a generator with a lambda inside would not be compiled.
    votes = split.select(*keys, term_hashes(F.col("_w"), shingle).alias("_h")).select(*keys, F.explode_outer("_h").alias("_0")).withColumn("_1", F.when(F.col("_0").isNotNull(), F.xxhash64("_0")))
    sums = [F.sum(F.shiftrightunsigned(f"_{k}", j).bitwiseAND(F.lit(_LANES).cast("long"))).alias(f"_{k}_{j}") for k in (0, 1) for j in range(32)]
    counted = votes.groupBy(*keys).agg(F.count("_0").alias("_n"), *sums)

    def half(k: int) -> Column:
        out = F.lit(0).cast("long")
        for j in range(32):
            both = F.coalesce(F.col(f"_{k}_{j}"), F.lit(0).cast("long"))
            for lane, bit in ((both.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), j), (F.shiftrightunsigned(both, 32), j + 32)):
                out = out.bitwiseOR(F.when(lane * 2 > F.col("_n"), F.lit(_signed(1 << bit)).cast("long")).otherwise(F.lit(0).cast("long")))
        return out

    return counted.select(*keys, half(0).alias("a"), half(1).alias("b"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def distance(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Bits in which the fingerprints (a, b) and (c, d) differ."""
    return F.bit_count(a.bitwiseXOR(c)) + F.bit_count(b.bitwiseXOR(d))


def likeness(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The share of equal bits: 1 for equal fingerprints, about a half for unrelated texts."""
    return F.lit(1.0) - distance(a, b, c, d) / F.lit(float(BITS))


def as_text(a: Column, b: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def _masks(radius: int) -> list[tuple[tuple[int, int], list[tuple[int, int]]]]:
    """For each table the mask of its two blocks, as two longs, and those of earlier blocks, which a pair of its own has unequal."""
    n = radius + 2
    cuts = [k * BITS // n for k in range(n + 1)]
    blocks = [((1 << cuts[k + 1]) - (1 << cuts[k])) for k in range(n)]
    halves = lambda x: (_signed(x & (1 << 64) - 1), _signed(x >> 64))
    return [(halves(blocks[i] | blocks[j]), [halves(blocks[k]) for k in range(j) if k != i]) for i, j in combinations(range(n), 2)]


def within_radius(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """For the different fingerprints (a, b, n documents): a, b, n_near, the documents of all others within the radius; those without any are left out."""
    long = lambda x: F.lit(x).cast("long")
    pair = lambda m: F.struct(long(m[0]).alias("a"), long(m[1]).alias("b"))
    masks = _masks(radius)
    tables = F.array(*(F.struct(F.lit(t).alias("t"), pair(m).alias("mask")) for t, (m, _) in enumerate(masks)))
    key = F.xxhash64("x.t", F.col("a").bitwiseAND(F.col("x.mask.a")), F.col("b").bitwiseAND(F.col("x.mask.b")))
    keyed = prints.select("a", "b", "n", F.explode(tables).alias("x")).select("a", "b", "n", F.col("x.t").alias("t"), key.alias("key"))
    met = shared.stored(keyed.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("size > 1"), "met")
    chunk = F.pmod(F.xxhash64("a", "b", "t"), F.ceil(F.col("size") / CHUNK))
    chunks = shared.stored(met.groupBy("key", chunk.alias("chunk")).agg(F.collect_list(F.struct("a", "b", "n", "t")).alias("others")), "chunks")
    earlier = F.array(*(F.array(*(pair(m) for m in e)) if e else F.array().cast("array<struct<a:bigint,b:bigint>>") for _, e in masks))

    def counts(x: Column) -> Column:
        a, b = x["a"].bitwiseXOR(F.col("a")), x["b"].bitwiseXOR(F.col("b"))
        near = (F.bit_count(a) + F.bit_count(b)).between(1, radius) & (x["t"] == F.col("t"))
        return near & F.forall(F.get(earlier, F.col("t")), lambda m: (a.bitwiseAND(m["a"]) != 0) | (b.bitwiseAND(m["b"]) != 0))

    found = F.aggregate(F.filter("others", counts), F.lit(0).cast("long"), lambda total, x: total + x["n"])
    return met.join(chunks, "key").select("a", "b", found.alias("found")).groupBy("a", "b").agg(F.sum("found").alias("n_near")).filter("n_near > 0")


def with_next(df: DataFrame, value: str, size: int, doc_id: str = "doc_id", tie: str = "tie") -> DataFrame:
    """`df` with next_<value>, the value of the row that follows in descending order of ids, and then of `tie`; the first row follows the last.

    `size` is the number of bytes of all rows, by which ranges are cut.
    """
    n = min(MAX_RANGES, tally.parts(size, RANGE_BYTES))
    cuts = (df.agg(F.percentile_approx(doc_id, [k / n for k in range(1, n)], 4 * n)).first()[0] if n > 1 else None) or []
    steps = [1 << k for k in reversed(range(max(1, len(cuts)).bit_length()))]
    limits = F.lit(sorted(cuts)).cast("array<bigint>") if cuts else F.array().cast("array<bigint>")
    # A binary search: how many limits are not above the id.
    search = F.aggregate(F.lit(steps).cast("array<int>"), F.lit(0), lambda at, s: F.when((at + s <= len(cuts)) & (F.get(limits, at + s - 1) <= F.col(doc_id)), at + s).otherwise(at))
    # Descending order of ids without an overflow; rows without an id come last, in the lowest range.
    order = {"_null": F.col(doc_id).isNull(), "_down": F.coalesce(F.bitwise_not(doc_id), F.lit(0).cast("long"))}
    ranged = df.withColumns(order | {"_range": F.when(F.col(doc_id).isNull(), F.lit(0)).otherwise(search)})
    by = ["_null", "_down", tie]
    firsts = {r["_range"]: r["first"] for r in ranged.groupBy("_range").agg(F.min(F.struct(*by)).alias("first")).collect()}  # a row a range
    down = sorted(firsts, reverse=True)
    lent = [(to, *firsts[of]) for to, of in zip(down, [*down[1:], *down[:1]], strict=True)]
    lending = df.sparkSession.createDataFrame(lent, f"_to int, _null boolean, _down long, {tie} long")
    borrowed = ranged.select(*by, value).join(F.broadcast(lending), by).dropDuplicates(["_to"])
    rest = [c for c in ranged.columns if c not in ("_range", *by, value)]
    both = ranged.withColumn("_lent", F.lit(False)).unionByName(borrowed.select(F.col("_to").alias("_range"), *by, value, F.lit(True).alias("_lent"), *(F.lit(None).cast(df.schema[c].dataType).alias(c) for c in rest)))
    following = F.lead(value).over(Window.partitionBy("_range").orderBy("_lent", *by))
    return both.withColumn(f"next_{value}", following).filter(~F.col("_lent")).drop("_lent", "_null", "_down", "_range")


def edited(text: Column, following: Column) -> Column:
    """`text` with the last third of its characters, rounded down, replaced by as many first ones of another, or all it has."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - third), F.substring(following, F.lit(1), third))


def edited_fingerprints(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each of `docs`: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near, class_id.

    n_near is the number of other documents within the radius, copies too; class_id is the least id of those of equal fingerprint.
    """
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    pairs = with_next(own, "text", tally.text_size(own))
    # A row's number holds within the task that counts its terms, and no longer than until they are added up.
    rows = pairs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "tie", F.length("text").cast("long").alias("n_chars"), "text", edited(F.col("text"), F.col("next_text")).alias("new"))
    both = F.array(F.struct(F.lit(False).alias("is_new"), F.lit("").alias("sha"), F.col("text").alias("text")), F.struct(F.lit(True).alias("is_new"), F.sha2(F.col("new").cast("binary"), 256).alias("sha"), F.col("new").alias("text")))
    keys = ["row", "doc_id", "tie", "n_chars", "is_new", "sha"]
    texts = rows.select("row", "doc_id", "tie", "n_chars", F.explode(both).alias("x")).select("row", "doc_id", "tie", "n_chars", "x.*")
    prints = fingerprints(texts, *keys, shingle=shingle)
    one = lambda c, new: F.max(F.when(F.col("is_new") == new, F.col(c))).alias(f"new_{c}" if new else c)
    one_row = shared.stored(prints.groupBy("row", "doc_id", "tie", "n_chars").agg(one("sha", True), *(one(c, new) for new in (False, True) for c in ("a", "b"))), "prints")
    row = one_row.select("doc_id", "tie", "n_chars", "new_sha", F.struct("a", "b").alias("own"), F.struct(F.col("new_a").alias("a"), F.col("new_b").alias("b")).alias("new"))
    after = shared.stored(with_next(row, "own", 256 * one_row.count()), "after")
    kinds = shared.stored(one_row.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("class_id")), "kinds")
    near = shared.stored(kinds.join(within_radius(kinds.select("a", "b", "n"), radius), ["a", "b"], "left").select("a", "b", "class_id", (F.col("n") - 1 + F.coalesce("n_near", F.lit(0))).alias("n_near")), "near")
    x = lambda c: (F.col(f"{c}.a"), F.col(f"{c}.b"))
    out = after.withColumns({"a": F.col("own.a"), "b": F.col("own.b")}).join(near, ["a", "b"])
    return out.select(
        "doc_id", "n_chars", F.col("new_sha").alias("edited_sha256"), as_text(*x("own")).alias("fingerprint"), as_text(*x("new")).alias("edited_fingerprint"),
        likeness(*x("own"), *x("new")).alias("near_edited"), likeness(*x("own"), *x("next_own")).alias("near_next"), "n_near", "class_id",
    )


def op12_simhash(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
