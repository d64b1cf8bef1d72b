"""N-gram Jaccard join: the documents whose sets of word n-grams overlap in a given share of their union.

The documents by n-grams incidence matrix is held in row blocks, and its product with itself is computed only where
bounds from the sizes allow an entry that matters:

1. Columns are counted. A document's partner has nearly all of its n-grams, so a document with too many n-grams that
   no other one has has no partner. Blocks send hashed columns once each and get back how frequent each is.
2. Of two linked documents each has a common n-gram among its rarest few, their number given by its size. Only these
   columns propose pairs, and only pairs of sizes that fit.
3. In a column, a few documents are paired with all others; once linked, documents of one component need not be paired
   any more, so a group of copies costs its size, not its square. The rest is paired with more documents each round,
   until every pair of a column is in one component or has been judged.
4. The product is computed in blocks: the rows of a proposed pair meet once for each block of columns, each meeting adds
   the columns that they share there, and the sum over all blocks is the overlap. Pairs below what their sizes ask for go.

Documents of equal sets are one row of the matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm import shared, tally
from quantloom.llm.components import components
from quantloom.llm.text import chunks, mix, multipliers, split_words, text_bytes

WIDTH, PERCENT = 5, 80
#: Comparisons left in all columns from which on every row leads its own part, so that one more round is enough.
ALL_PAIRS = 4_000_000
#: Bits of a column within its bucket; buckets hold a bounded number of columns, so collisions do not grow.
_LOW = np.uint64(40)
_LOW_MASK = np.uint64((1 << 40) - 1)


def _sets(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted n-gram hashes of all documents of a block, and n + 1 offsets."""
    data, offsets = text_bytes(table["text"])
    keys, sizes = [np.zeros(0, np.uint64)], []
    for _, part, offs in chunks(data, offsets):
        w = split_words(part, offs, lower=True)
        grams = w.window_hashes(width)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            n = b - a
            if n >= width:
                own = np.unique(grams[a : b - width + 1])
            elif n:
                own = mix((w.hashes[a:b] * multipliers(n)).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
            else:
                own = keys[0]
            keys.append(own)
            sizes.append(len(own))
    return np.concatenate(keys), np.r_[0, np.cumsum(sizes)].astype(np.int64)


def _columns(keys: np.ndarray, buckets: int) -> np.ndarray:
    """A column's bucket and its hash in the bucket."""
    return ((keys >> _LOW) % np.uint64(buckets)) << _LOW | (keys & _LOW_MASK)


def _planes(columns: np.ndarray) -> bytes:
    return np.ascontiguousarray(columns.view(np.uint8).reshape(-1, 8)[:, :5].T).tobytes()


def _from_planes(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(b, np.uint8).reshape(5, -1).T
    return out.view(np.uint64).reshape(-1)


def _send(buckets: int, width: int):
    """Each column of a block once, by bucket, with its number of documents in the block (255 at most)."""

    def send(table: pa.Table) -> pa.Table:
        columns, n = np.unique(_columns(_sets(table, width)[0], buckets), return_counts=True)
        cuts = np.searchsorted(columns, np.arange(buckets + 1, dtype=np.uint64) << _LOW)
        full = np.flatnonzero(np.diff(cuts))
        n = np.minimum(n, 255).astype(np.uint8)
        spans = [(cuts[i], cuts[i + 1]) for i in full]
        return pa.table(
            {
                "bucket": pa.array(full, pa.int32()),
                "blk": pa.array(np.full(len(full), table["blk"][0].as_py()), pa.int32()),
                "columns": pa.array([_planes(columns[a:b]) for a, b in spans], pa.binary()),
                "n": pa.array([n[a:b].tobytes() for a, b in spans], pa.binary()),
            }
        )

    return send


def _frequencies(table: pa.Table) -> pa.Table:
    """For each block the frequency class of its columns, in their order: 0 for one document, else the logarithm of the number."""
    columns = [_from_planes(x) for x in table["columns"].to_pylist()]
    n = np.frombuffer(b"".join(table["n"].to_pylist()), np.uint8)
    _, at = np.unique(np.concatenate(columns), return_inverse=True)
    total = np.bincount(at, weights=n)
    classes = np.where(total > 1, np.floor(np.log2(total)) + 1, 0).astype(np.uint8)[at]
    cuts = np.cumsum([0, *map(len, columns)])
    return pa.table({"blk": table["blk"], "bucket": table["bucket"], "classes": pa.array([classes[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})


_ROWS = "doc_id long, n long, shared long, set_id binary, ngrams binary, rare array<long>, rest array<long>"


def _rows(buckets: int, width: int, percent: int):
    """A block's rows; set_id, n-grams and rarest shared columns only where enough n-grams are shared for a partner."""

    def judge(table: pa.Table, answers: pa.Table) -> pa.Table:
        keys, offsets = _sets(table, width)
        columns = _columns(keys, buckets)
        known = np.unique(columns)
        answers = answers.sort_by("bucket")
        classes = np.frombuffer(b"".join(answers["classes"].to_pylist()), np.uint8)[np.searchsorted(known, columns)] if len(known) else np.zeros(0, np.uint8)
        ids, grams, rare, rest, shared_ = [], [], [], [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            n, cls = b - a, classes[a:b]
            shared_.append(int(np.count_nonzero(cls)))
            if not n or 100 * np.count_nonzero(cls) < percent * n:
                ids.append(None), grams.append(None), rare.append(None), rest.append(None)
                continue
            own, col = keys[a:b], columns[a:b]
            order = np.lexsort((own, col, cls))[: n + (-percent * n // 100) + 1]
            ids.append(np.array([mix(own).sum(dtype=np.uint64), mix(own ^ np.uint64(n + 1)).sum(dtype=np.uint64)]).tobytes())
            grams.append(own.tobytes())
            at = np.flatnonzero(cls[order] > 0)
            some, first = np.unique(col[order[at]], return_index=True)
            rare.append(some.astype(np.int64))
            rest.append(n - at[first])
        return pa.table(
            {"doc_id": table["doc_id"], "n": pa.array(np.diff(offsets), pa.int64()), "shared": pa.array(shared_, pa.int64()), "set_id": pa.array(ids, pa.binary()), "ngrams": pa.array(grams, pa.binary()), "rare": pa.array(rare, pa.list_(pa.int64())), "rest": pa.array(rest, pa.list_(pa.int64()))}
        )

    return judge


#: Columns of a row in a block of the product, about: what bounds the rows that meet, however long a document is.
BLOCK_COLUMNS = 4096


def _blocks(nodes: DataFrame) -> DataFrame:
    """Stored (node, size, cols_block, cols): the incidence matrix in blocks of columns, by hash; blocks without columns are left out."""
    most = nodes.agg(F.max("n")).first()[0] or 1
    bits = max(0, (int(most) // BLOCK_COLUMNS).bit_length())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, size, grams in zip(batch["node"].to_pylist(), batch["n"].to_pylist(), batch["ngrams"].to_pylist(), strict=True):
                cols = np.frombuffer(grams, np.uint64)
                edges = np.searchsorted(cols, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(1, np.int64)
                ends = np.r_[edges[1:], len(cols)]
                full = np.flatnonzero(ends > edges)
                yield pa.RecordBatch.from_pydict(
                    {"node": pa.array([node] * len(full), pa.int64()), "size": pa.array([size] * len(full), pa.int64()), "cols_block": pa.array(full, pa.int32()), "cols": pa.array([cols[edges[i] : ends[i]].view(np.int64) for i in full], pa.list_(pa.int64()))}
                )

    return shared.stored(nodes.select("node", "n", "ngrams").mapInArrow(cut, "node long, size long, cols_block int, cols array<long>"), "matrix")


def _linked(pairs: DataFrame, matrix: DataFrame, percent: int) -> DataFrame:
    """The pairs of rows whose overlap, added up over the blocks of columns, is large enough for their sizes."""
    side = lambda end, name: matrix.select(F.col("node").alias(end), F.col("size").alias(f"n_{end}"), "cols_block", F.col("cols").alias(name))
    met = pairs.join(side("a", "left"), "a").join(side("b", "right"), ["b", "cols_block"])
    shares = met.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("size"), F.size(F.array_intersect("left", "right")).alias("common"))
    product = shares.groupBy("a", "b").agg(F.first("size").alias("size"), F.sum("common").alias("common"))
    return product.filter(F.col("common") * (100 + percent) >= F.col("size") * percent).select("a", "b")


def _distinct_columns(entries: DataFrame) -> DataFrame:
    """Without columns of one row, and with one column of those that have the very same rows, with the largest caps of them."""
    marks = entries.groupBy("col").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node").bitwiseAND(F.lit((1 << 40) - 1))).alias("s"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("x")).filter("n > 1")
    # Stored, so that the join has a shuffle on either side, of which Spark can split the part of a hot column.
    kept = shared.stored(marks.withColumn("kept", F.min("col").over(Window.partitionBy("n", "s", "x"))).select("col", "kept"), "kept")
    return entries.hint("merge").join(kept, "col").groupBy(F.col("kept").alias("col"), "node").agg(F.first("n").alias("n"), F.first("shared").alias("shared"), F.max("cap").alias("cap"))


def _components(nodes: DataFrame, percent: int) -> DataFrame | None:
    """(node, comp) of the nodes that have a link."""
    # What two rows have in common is at most what either shares with any, and what is left of either from their first
    # common column on, in the order of columns. From this cap follows how large a partner may be.
    placed = nodes.select(F.explode(F.arrays_zip("rare", "rest")).alias("x"), "node", "n", "shared")
    entries = _distinct_columns(placed.select(F.col("x.rare").alias("col"), "node", "n", "shared", F.least("shared", "x.rest").alias("cap")))
    most = F.floor(F.col("cap") * (100 + percent) / percent) - F.col("n")
    matrix = _blocks(nodes)
    links = judged = comps = None
    leaders, turn = 1, 0
    while True:
        entries = shared.stored(entries.withColumn("comp", F.col("node")) if comps is None else entries.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "columns")
        open_ = entries.groupBy("col").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("least")).filter("lo <> hi").select("col", "least")
        open_ = shared.stored(open_, "open")
        entries = shared.stored(entries.hint("merge").join(open_, "col").filter(most >= F.col("least")).drop("least"), "columns")
        work = entries.groupBy("col").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0]
        if not work:
            return comps
        if work <= ALL_PAIRS:
            leaders = 1 << 20
        # The rows that share most of their n-grams lead: copies with few changes, to which most others are linked.
        rank = F.struct((-F.col("shared") / F.col("n")).alias("rank"), F.xxhash64("node").alias("tie"), F.col("node").alias("of"), F.col("n").alias("n_of"), F.col("cap").alias("cap_of"), F.col("comp").alias("comp_of"))
        part = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(leaders))
        lead = shared.stored(entries.groupBy("col", part.alias("part")).agg(F.min(rank).alias("x")).select("col", "x.of", "x.n_of", "x.cap_of", "x.comp_of"), "leaders")
        fits = (F.col("comp") != F.col("comp_of")) & (F.least("n", "n_of") * 100 >= F.greatest("n", "n_of") * percent) & (F.least("cap", "cap_of") * (100 + percent) >= (F.col("n") + F.col("n_of")) * percent)
        pairs = entries.hint("merge").join(lead, "col").filter(fits).select(F.least("node", "of").alias("a"), F.greatest("node", "of").alias("b")).distinct()
        if judged is not None:
            pairs = pairs.join(judged, ["a", "b"], "left_anti")
        pairs = shared.stored(pairs, "pairs")
        entries = entries.join(lead.select("col", F.col("of").alias("node")), ["col", "node"], "left_anti").drop("comp")
        if not pairs.isEmpty():
            judged = pairs if judged is None else judged.union(pairs)
            found = shared.stored(_linked(pairs, matrix, percent), "links")
            if not found.isEmpty():
                links = found if links is None else links.union(found)
                comps = components(links)
        leaders, turn = leaders * 8, turn + 1


def near_duplicates(
    docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text", block_bytes: int = tally.BLOCK_BYTES, bucket_bytes: int = tally.BUCKET_BYTES
) -> DataFrame:
    """doc_id, n_shingles and component_id, one row for each row of `docs`.

    A-Z is lower-cased; words are runs of characters other than white space below 0x21. A document's set has its distinct runs of `width`
    words, or all its words as one if they are fewer. Two documents link when 100 * intersection >= `percent` * union;
    component_id is the least doc_id that links reach. Null, empty and blank texts have no shingles and link with nothing.
    Rows of equal sets, repeated ids among them, are linked; a null id has the component of its links, or null.
    Other columns do not matter; an empty table gives no rows.
    """
    size = tally.text_size(docs, text)
    blocks, buckets = tally.into_blocks(docs, tally.parts(size, block_bytes), doc_id, text), tally.parts(size, bucket_bytes)
    sent = tally.per_block(blocks, _send(buckets, width), "bucket int, blk int, columns binary, n binary")
    classes = sent.groupBy("bucket").applyInArrow(_frequencies, "blk int, bucket int, classes binary")
    rows = shared.stored(tally.per_block_with(blocks, classes, _rows(buckets, width, percent), _ROWS), "rows")
    members = rows.filter(F.col("set_id").isNotNull())
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(int(tally.NO_ID))).alias("doc_id"), "n", "shared", "ngrams", "rare", "rest")).alias("x")
    nodes = members.groupBy("set_id").agg(first).select("set_id", "x.*").withColumn("node", F.monotonically_increasing_id())
    nodes = shared.stored(nodes, "nodes")
    comps = _components(nodes, percent)
    named = nodes.select("set_id", "node", "doc_id")
    if comps is None:
        classes = named.select("set_id", F.col("doc_id").alias("component_id"))
    else:
        named = named.join(comps, "node", "left").select("set_id", "doc_id", F.coalesce("comp", "node").alias("comp"))
        least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
        classes = named.join(least, "comp").select("set_id", "component_id")
    classes = classes.withColumn("component_id", F.when(F.col("component_id") != int(tally.NO_ID), F.col("component_id")))
    # Rows without a set never meet a class, so they go round the join.
    found = members.select("set_id", "doc_id", "n").join(classes, "set_id").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.filter(F.col("set_id").isNull()).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.unionByName(alone)


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs` whose doc_id is the least of its component: one document of each group, and all that have no link.

    An id is one document: its rows stay or go together, whatever their texts, and go if any of them links to a smaller id.
    Rows of a null id stay, as do null and empty texts.
    """
    found = near_duplicates(docs, width, percent)
    linked = found.filter(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(linked, "doc_id", "left_anti").select(docs.columns)


def op5_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles and component_id of all `documents`; null texts have no shingles and link with nothing."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
