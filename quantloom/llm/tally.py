"""Counting of very many hashed keys with little shuffle.

Documents are dealt to blocks by a hash of their id. A block sends each of its distinct keys once, whatever the
number of its rows that have it, packed by bucket of the key; a bucket joins what all blocks sent for a key and
answers the blocks. So a key that a third of all documents has costs one entry a block, and no group of rows that
share a key ever meets in one task. Blocks and buckets grow in number, not in size, with the input.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text of a block and text a bucket answers for, in bytes: what bounds a task's memory.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 16 << 20
#: Documents of an unknown (null) id sort after all others.
NO_ID = np.iinfo(np.int64).max


def text_size(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def parts(size: int, each: int) -> int:
    return max(1, -(-size // each))


def into_blocks(docs: DataFrame, n: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(blk, doc_id, text); rows that share an id, too, are spread by their text."""
    return docs.select(
        F.pmod(F.xxhash64(F.col(doc_id), F.octet_length(text)), F.lit(n)).cast("int").alias("blk"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")
    )


def doc_ids(table: pa.Table) -> np.ndarray:
    return table["doc_id"].combine_chunks().fill_null(int(NO_ID)).to_numpy(zero_copy_only=False).astype(np.int64)


def planes(x: np.ndarray) -> bytes:
    """All first bytes, then all second bytes...: the equal high bytes of small numbers compress away in the shuffle."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def from_planes(b: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(dtype).reshape(-1)


def pack(blk: int, buckets: int, keys: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """Rows (bucket, blk, keys, c0, c1...) of sorted keys and columns beside them."""
    bucket = ((keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(cuts))
    out = {"bucket": pa.array(full, pa.int32()), "blk": pa.array(np.full(len(full), blk), pa.int32())}
    for name, x in zip(["keys", *(f"c{i}" for i in range(len(columns)))], [keys, *columns], strict=True):
        x = x[order]
        out[name] = pa.array([planes(x[cuts[i] : cuts[i + 1]]) for i in full], pa.binary())
    return pa.table(out)


def unpack(table: pa.Table, **dtypes: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """The row number of each entry, and the columns joined over all rows."""
    cols = [[from_planes(b, t) for b in table[c].to_pylist()] for c, t in dtypes.items()]
    rows = np.repeat(np.arange(table.num_rows), [len(x) for x in cols[0]])
    return rows, [np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(cols, dtypes.values(), strict=True)]


def answer(blks: np.ndarray, keys: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """Rows (blk, keys, c0...) of entries for several blocks."""
    order = np.argsort(blks, kind="stable")
    ids, at = np.unique(blks[order], return_index=True)
    cuts = [*at.tolist(), len(order)]
    out = {"blk": pa.array(ids, pa.int32())}
    for name, x in zip(["keys", *(f"c{i}" for i in range(len(columns)))], [keys, *columns], strict=True):
        x = x[order]
        out[name] = pa.array([planes(x[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
    return pa.table(out)


def found(needles: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each needle whether it is among the sorted keys, and where."""
    if not len(keys):
        return np.zeros(len(needles), bool), np.zeros(len(needles), np.int64)
    at = np.minimum(np.searchsorted(keys, needles), len(keys) - 1)
    return keys[at] == needles, at


def sorted_answer(table: pa.Table, **dtypes: str) -> list[np.ndarray]:
    """What all buckets answered to one block, by key."""
    _, cols = unpack(table, **dtypes)
    order = np.argsort(cols[0], kind="stable")
    return [x[order] for x in cols]


def recurring(sent: DataFrame) -> DataFrame:
    """(blk, keys): those of a block's keys that have a weight of two or more over all blocks; c0 is a block's own weight."""

    def resolve(table: pa.Table) -> pa.Table:
        rows, (keys, weight) = unpack(table, keys="u8", c0="u1")
        order = np.argsort(keys, kind="stable")
        keys, weight, rows = keys[order], weight[order], rows[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        total = np.repeat(np.add.reduceat(weight.astype(np.int64), first), np.diff(np.r_[first, len(keys)]))
        keep = total >= 2
        return answer(table["blk"].to_numpy()[rows[keep]], keys[keep])

    return sent.groupBy("bucket").applyInArrow(resolve, "blk int, keys binary")


def per_block(blocks: DataFrame, f: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    return blocks.groupBy("blk").applyInArrow(f, schema)


def per_block_with(blocks: DataFrame, answers: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    return blocks.groupBy("blk").cogroup(answers.groupBy("blk")).applyInArrow(f, schema)


def weights(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, each with its number of entries, 2 at most."""
    keys, n = np.unique(keys, return_counts=True)
    return keys, np.minimum(n, 2).astype(np.uint8)
