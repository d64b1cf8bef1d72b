"""Benchmark decontamination with a distributed positional index.

1. The terms of the test items are inverted: a posting is a document, a term and a position, stored once. All that
   follows reads postings, never texts.
2. Each item window is looked up by its rarest term, the anchor. Its list is intersected with those of the rarest
   neighbours, so that few of its places are left.
3. For these places the lists of all neighbours are intersected, shifted by their offsets: a window of neighbours in
   place is a phrase, enough neighbours anywhere around are a proximity match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm import shared
from quantloom.llm.url_filter import LOWER, UPPER

WIDTH = 10
#: Tables of at most so many bytes are broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: Percent of an anchor's neighbours that a proximity match has around it.
PROXIMITY = 80
#: Term number of the entry at a document's end, which has its number of words for a position.
_END = -1
#: Positions of a bucket in which places and postings meet.
_BUCKET = 16


def item_words(text: Column) -> Column:
    """Lower-cases A-Z; words are runs of 0-9, a-z and characters beyond ASCII. Null has none."""
    text = F.coalesce(text, F.lit(""))
    lower = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), lambda w: w != "")


def _small(df: DataFrame, size: Column | int = 64) -> DataFrame:
    """A stored table with a broadcast hint, if its rows, of `size` bytes each, are few enough for that."""
    row = F.lit(size).cast("long") if isinstance(size, int) else size + 32
    return F.broadcast(df) if (df.agg(F.sum(row)).first()[0] or 0) <= BROADCAST_BYTES else df.hint("merge")


def vocabulary(items: DataFrame) -> DataFrame:
    """Stored (word, term): a number for each word of the items' `words`, and the entry for a document's end."""
    terms = items.select(F.explode("words").alias("word")).distinct().withColumn("term", F.monotonically_increasing_id())
    return shared.stored(terms.union(items.sparkSession.createDataFrame([("", _END)], terms.schema)), "vocabulary")


def positional_index(docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored postings (doc, term, pos) of the terms, doc being (id, text_hash), and an entry at each document's end."""
    doc = F.struct(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("text_hash"))
    # Words are a column before they are exploded: a generator with a lambda inside would not be compiled.
    words = docs.select(doc.alias("doc"), F.concat(item_words(F.col(f"`{text}`")), F.array(F.lit(""))).alias("words")).select("doc", F.posexplode("words").alias("pos", "word"))
    return shared.stored(words.join(_small(terms, F.octet_length("word")), "word").select("doc", "term", "pos"), "postings")


def anchors(items: DataFrame, terms: DataFrame, index: DataFrame, width: int = WIDTH, percent: int = PROXIMITY) -> tuple[DataFrame, DataFrame]:
    """Stored (anchor, term, size, neighbours, lists), the places of item windows' rarest terms, and stored (anchor, item).

    `neighbours` are the terms around the place with their offsets; `size` is the number of words of a window. Of any
    window at the place, and of any proximity match, one of the terms in `lists` stands around it.
    """
    counted = index.filter(F.col("term") != _END).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    placed = items.select("row", F.posexplode("words").alias("at", "word")).join(terms, "word").join(counted, "term", "left")
    each = F.struct("at", "term", F.coalesce("n", F.lit(0)).alias("n"))
    rows = placed.groupBy("row").agg(F.sort_array(F.collect_list(each)).alias("terms")).join(items.select("row", "item_id"), "row")
    size = F.least(F.size("terms"), F.lit(width))
    # Of each window the rarest term, and the rarest of the others.
    two = F.transform(F.sequence(F.lit(1), F.size("terms") - size + 1), lambda i: F.slice(F.sort_array(F.transform(F.slice("terms", i, size), lambda x: F.struct(x["n"], x["at"], x["term"]))), 1, 2))
    rows = rows.select("row", "item_id", "terms", size.alias("size"), F.explode(F.array_distinct(two)).alias("two")).filter(F.col("two")[0]["n"] > 0)
    second = F.collect_set(F.get("two", F.lit(1))["term"])
    rows = rows.groupBy("row", F.col("two")[0]["at"].alias("at")).agg(*(F.first(c).alias(c) for c in ("item_id", "terms", "size")), second.alias("second"))
    around = F.filter("terms", lambda x: (F.abs(x["at"] - F.col("at")) < width) & (x["at"] != F.col("at")))
    near = F.transform(around, lambda x: F.struct((x["at"] - F.col("at")).alias("offset"), x["term"], x["n"]))
    rows = rows.select("item_id", "size", "second", F.get("terms", F.col("at"))["term"].alias("term"), near.alias("near"))
    # A proximity match lacks a share of the distinct terms at most, so it has one of so many of them.
    distinct = F.sort_array(F.array_distinct(F.transform("near", lambda x: F.struct(x["n"], x["term"]))))
    lacking = F.floor(F.size(distinct) * (100 - percent) / 100).cast("int") + 1
    lists = F.array_union("second", F.transform(F.slice(distinct, 1, lacking), lambda x: x["term"]))
    plain = F.transform("near", lambda x: F.struct(x["offset"].alias("offset"), x["term"].alias("term")))
    rows = rows.select("item_id", "term", "size", plain.alias("neighbours"), lists.alias("lists"))
    named = shared.stored(rows.withColumn("anchor", F.xxhash64("term", "size", "neighbours")), "named")
    at = named.groupBy("anchor").agg(*(F.first(c).alias(c) for c in ("term", "size", "neighbours")), F.array_distinct(F.flatten(F.collect_set("lists"))).alias("lists"))
    return shared.stored(at, "anchors"), shared.stored(named.select("anchor", F.col("item_id").cast("string").alias("item")).distinct(), "anchored")


def _buckets(df: DataFrame, width: int) -> DataFrame:
    """A row for each bucket whose places `pos` may be near."""
    low, high = (F.floor((F.col("pos") + d) / _BUCKET).cast("int") for d in (1 - width, width - 1))
    return df.withColumn("bucket", F.explode(F.sequence(low, high)))


def find_matches(index: DataFrame, at: DataFrame, width: int = WIDTH, percent: int = PROXIMITY) -> DataFrame:
    """(doc, anchor, start, end, phrase, near): `phrase` where whole windows of an item stand in a row, from start to end;
    `near` where at least `percent` of an anchor's distinct neighbours stand around it, in any order."""
    key, close = ["doc", "anchor", "bucket"], (F.abs(F.col("pos") - F.col("at")) < width) & (F.col("pos") != F.col("at"))
    places = index.join(_small(at.select("anchor", "term")), "term").select("doc", "anchor", F.col("pos").alias("at"), F.floor(F.col("pos") / _BUCKET).cast("int").alias("bucket"))
    lists = at.select("anchor", F.explode("lists").alias("term"))
    around = _buckets(index.join(_small(lists), "term").select("doc", "anchor", "pos"), width)
    alone = places.join(_small(at.filter(F.size("neighbours") == 0).select("anchor")), "anchor", "left_semi").select(*key, "at")
    left = shared.stored(places.join(around.select(*key, "pos"), [*(places[c] == around[c] for c in key), close], "left_semi").select(*key, "at").union(alone).distinct(), "places")
    neighbours = left.join(_small(at.select("anchor", "neighbours", "size"), F.size("neighbours") * 16), "anchor").select("doc", "anchor", "at", "size", F.explode_outer("neighbours").alias("x"))
    wanted = neighbours.select("doc", "anchor", "at", "size", F.col("x.offset").alias("offset"), F.col("x.term").alias("term")).withColumn("bucket", F.floor(F.col("at") / _BUCKET).cast("int"))
    docs = shared.stored(left.select("doc").distinct(), "met")
    there = _buckets(index.join(_small(docs), "doc", "left_semi"), width)
    own = ["doc", "term", "bucket"]
    met = wanted.hint("merge").join(there, own).filter(close)
    exact = F.collect_set(F.when(F.col("pos") == F.col("at") + F.col("offset"), F.col("offset")))
    found = met.groupBy("doc", "anchor", "at").agg(exact.alias("exact"), F.size(F.collect_set("term")).alias("present"))
    lonely = alone.select("doc", "anchor", "at", F.array().cast("array<int>").alias("exact"), F.lit(0).alias("present"))
    sized = at.select("anchor", "size", F.size(F.array_distinct(F.transform("neighbours", lambda x: x["term"]))).alias("all"))
    found = found.union(lonely).join(_small(sized), "anchor")
    row = lambda sign: F.array_min(F.filter(F.sequence(F.lit(1), F.lit(width)), lambda k: ~F.array_contains("exact", k * sign))) - 1
    found = found.withColumns({"l": row(-1), "r": row(1), "near": (F.col("all") > 0) & (F.col("present") * 100 >= F.col("all") * percent)}).withColumn("phrase", F.col("l") + F.col("r") + 1 >= F.col("size"))
    return found.filter("phrase OR near").select("doc", "anchor", (F.col("at") - F.col("l")).alias("start"), (F.col("at") + F.col("r") + 1).alias("end"), "phrase", "near")


def _covered(spans: Column) -> Column:
    """Places in the union of (start, end) spans sorted by start."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["end"]), F.lit(0))).alias("n"), F.greatest(a["end"], s["end"]).alias("end"))
    return F.aggregate(spans, zero, step, lambda a: a["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, percent: int = PROXIMITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, n_words, n_hit (words in an occurrence of an item window), n_items and items (of such windows, ids
    as sorted strings), n_near and near_items (of proximity matches: a window's rarest term with at least `percent` of the
    distinct words that the item has less than `width` words from it, all less than `width` words away, in any order).

    `benchmark` has item_id and text. A row for each row of `docs`, also where ids repeat or are null. Null and empty texts have no words
    and no hits; items without words match nothing, items of one word have no proximity matches; items of a null id hit
    words but are not listed. Repeated items count once an id. Ties between rarest terms go to the first. An empty table
    of documents gives no rows, an empty benchmark no hits. Other columns do not matter.
    """
    items = shared.stored(benchmark.select("item_id", item_words(F.col("text")).alias("words")).filter(F.size("words") > 0).withColumn("row", F.monotonically_increasing_id()), "items")
    terms = vocabulary(items)
    index = positional_index(docs, terms, doc_id, text)
    at, anchored = anchors(items, terms, index, width, percent)
    matches = shared.stored(find_matches(index, at, width, percent), "matches")
    spans = matches.filter("phrase").groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans")).select("doc", _covered(F.col("spans")).alias("n_hit"))
    named = matches.groupBy("doc", "anchor").agg(F.bool_or("phrase").alias("phrase"), F.bool_or("near").alias("near")).join(_small(anchored, F.coalesce(F.octet_length("item"), F.lit(0))), "anchor")
    ids = lambda kind: F.sort_array(F.collect_set(F.when(F.col(kind), F.col("item"))))
    hits = named.groupBy("doc").agg(ids("phrase").alias("items"), ids("near").alias("near_items")).join(spans, "doc", "left")
    out = index.filter(F.col("term") == _END).select("doc", F.col("pos").cast("long").alias("n_words")).join(hits, "doc", "left")
    none = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    return out.select(
        F.col("doc.id").alias("doc_id"),
        F.col("doc.text_hash").alias("text_hash"),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(none("items")).cast("long").alias("n_items"),
        none("items").alias("items"),
        F.size(none("near_items")).cast("long").alias("n_near"),
        none("near_items").alias("near_items"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of `docs`, with their own columns only, that have no word in an occurrence of an item window.

    Rows of null or empty texts stay; rows that share an id are judged each by their own text; an empty benchmark keeps all.
    """
    hit = contamination(docs, benchmark, width).filter(F.col("n_hit") > 0).select(F.col("doc_id").alias("_hit_doc"), F.col("text_hash").alias("_hit_text")).distinct()
    own = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["_hit_doc"]) & (own == hit["_hit_text"]), "left_anti")


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    """Exact hits of all `documents` in all of `benchmark`, and the items with proximity matches (n_near, near_sha256)."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    sha = lambda c: F.sha2(F.array_join(c, ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", sha("items").alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near", sha("near_items").alias("near_sha256"))


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM benchmark),
bw AS (
  SELECT item_id, len(words) AS width, array_to_string(words, ' ') AS w FROM b WHERE len(words) BETWEEN 1 AND 9
  UNION ALL
  SELECT item_id, 10, array_to_string(words[k:k + 9], ' ') FROM (SELECT item_id, words, unnest(range(1, len(words) - 8)) AS k FROM b WHERE len(words) >= 10)),
widths AS (SELECT DISTINCT width FROM bw),
dw AS (
  SELECT r, width, k, array_to_string(words[k:k + width - 1], ' ') AS w
  FROM (SELECT r, words, width, unnest(range(1, len(words) - width + 2)) AS k FROM d, widths WHERE len(words) >= width)),
hit AS (SELECT r, k, dw.width, item_id FROM dw JOIN bw ON dw.w = bw.w AND dw.width = bw.width),
covered AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(k, k + width)) AS j FROM hit) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r),
t AS (SELECT r, unnest(words) AS w, unnest(range(len(words))) AS pos FROM d),
n AS (SELECT w, count(*) AS n FROM t GROUP BY w),
i AS (SELECT row_number() OVER () AS i, item_id, words FROM b WHERE len(words) > 0),
it AS (SELECT i, w, o, coalesce(n, 0) AS n FROM (SELECT i, unnest(words) AS w, unnest(range(len(words))) AS o FROM i) LEFT JOIN n USING (w)),
iw AS (SELECT i, least(len(words), 10) AS size, unnest(range(len(words) - least(len(words), 10) + 1)) AS s FROM i),
a AS (SELECT DISTINCT i, o FROM (SELECT iw.i, s, first(o ORDER BY n, o) AS o, min(n) AS n FROM iw JOIN it ON it.i = iw.i AND it.o >= s AND it.o < s + size GROUP BY ALL) WHERE n > 0),
an AS (SELECT DISTINCT a.i, a.o, it.w FROM a JOIN it ON it.i = a.i AND it.o <> a.o AND abs(it.o - a.o) < 10),
m AS (SELECT i, o, count(*) AS m FROM an GROUP BY i, o),
c AS (SELECT a.i, a.o, t.r, t.pos FROM a JOIN it ON it.i = a.i AND it.o = a.o JOIN t ON t.w = it.w),
near AS (SELECT c.i, c.o, c.r, c.pos, count(DISTINCT an.w) AS k FROM c JOIN an ON an.i = c.i AND an.o = c.o JOIN t ON t.r = c.r AND t.w = an.w AND t.pos <> c.pos AND abs(t.pos - c.pos) < 10 GROUP BY ALL),
nears AS (SELECT r, count(*) AS n_near, string_agg(item_id, ',' ORDER BY item_id) AS near_ids
  FROM (SELECT DISTINCT r, item_id FROM near JOIN m USING (i, o) JOIN i USING (i) WHERE 100 * k >= 80 * m) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(n_near, 0)::BIGINT AS n_near, sha256(coalesce(near_ids, '')) AS near_sha256
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r) LEFT JOIN nears USING (r)
"""
