"""Best-fit packing of tokenized documents into sequences of a fixed capacity.

Which lengths go together depends on how many pieces there are of each length, and on nothing else. So the plan is made
from the histogram of lengths, which has at most as many entries as the capacity, however large the corpus: pieces above
a third of the capacity are matched greedily, two a sequence at most; shorter ones fill the tightest gap left. The plan
says for each length which ranks go to which sequences; each piece finds its own place from its length and rank.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm import shared
from quantloom.llm.text import chunks, fold_case, is_space, text_bytes

CAPACITY = 2048
#: Words whose ids a worker keeps; when full, it starts anew. Words tokenized at once.
KEPT_WORDS, BATCH_WORDS = 400_000, 4_000


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Ids of many texts at once, as the tokenizer gives them for each text.

    For a tokenizer that drops white space and cuts between letters and punctuation before anything else: then a text's
    ids are those of its parts, and each different part is tokenized once. Texts with the string of a special token,
    which could cross parts, are tokenized whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are what runs side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.ids, self.ends = array("I"), array("q", [0])

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = ~is_space(data)
        letter = (data - np.uint8(97)) < 26
        mark = inside & ~letter & (data < 128) & ~((data - np.uint8(48)) < 10) & (data != 39)
        edge = np.empty(len(data) + 1, bool)
        edge[1:-1] = (inside[1:] != inside[:-1]) | (letter[1:] & mark[:-1]) | (mark[1:] & letter[:-1])
        edge[0] = edge[-1] = True
        edge[offsets] = True
        at = np.flatnonzero(edge)
        runs = inside[at[:-1]] if len(data) else np.zeros(0, bool)
        return at[:-1][runs], at[1:][runs]

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and n + 1 offsets of the texts in them."""
        n = len(offsets) - 1
        data = fold_case(data)
        starts, ends = self._parts(data, offsets)
        step = np.zeros(len(data) + 1, np.int32)
        step[starts] += 1
        step[ends] -= 1
        packed = data[np.cumsum(step[:-1]) > 0]
        cuts = np.r_[0, np.cumsum(ends - starts)].astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(packed)]).dictionary_encode()
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if len(self.slots) + len(words) > KEPT_WORDS:
            self._clear()
        new = [w for w in words if w not in self.slots]
        for at in range(0, len(new), BATCH_WORDS):
            some = new[at : at + BATCH_WORDS]
            for word, ids in zip(some, self._encode([w.decode() for w in some]), strict=True):
                self.slots[word] = len(self.slots)
                self.ids.extend(ids)
                self.ends.append(len(self.ids))
        slots = np.array([self.slots[w] for w in words], np.int64)[codes]
        ends = np.array(self.ends)
        each = ends[slots + 1] - ends[slots]
        to = np.r_[0, np.cumsum(each)]
        ids = np.array(self.ids, np.uint32)[np.repeat(ends[slots] - to[:-1], each) + np.arange(to[-1])]
        bounds = to[np.searchsorted(starts, offsets)]
        raw = data.tobytes()
        if any(s in raw for s in self.special):
            texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            parts = [self._encode([t.decode()])[0] if any(s in t for s in self.special) else ids[bounds[i] : bounds[i + 1]] for i, t in enumerate(texts)]
            ids = np.concatenate([np.array(p, np.uint32) for p in parts])
            bounds = np.r_[0, np.cumsum([len(p) for p in parts])]
        assert len(bounds) == n + 1
        return ids, bounds


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"
_TOKENIZERS: dict[str, WordTokenizer] = {}


def _cut(path: str, capacity: int):
    """Pieces of documents; `place` numbers the pieces of one length in one partition."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = WordTokenizer(path)
        tokens, part, seen = _TOKENIZERS[path], TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            doc_ids = batch["doc_id"].to_pylist()
            data, offsets = text_bytes(batch["text"])
            for first, here, offs in chunks(data, offsets, 1 << 20):
                ids, bounds = tokens(here, offs)
                out: list[tuple] = []
                for d, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    own = np.append(ids[a:b], np.uint32(0)).astype("<u4")
                    for k, at in enumerate(range(0, len(own), capacity)):
                        x = own[at : at + capacity]
                        out.append((doc_ids[first + d], k, at, len(x), zlib.crc32(x.tobytes()), part, int(seen[len(x)])))
                        seen[len(x)] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=[x.split()[0] for x in _PIECES.split(", ")])

    return pieces


_TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())


@dataclass
class Bins:
    """`n` sequences filled alike: slots of (length, how many in a row), and the gap left in each."""

    n: int
    gap: int
    slots: tuple[tuple[int, int], ...]


def match_and_fit(counts: dict[int, int], capacity: int) -> list[Bins]:
    """Sequences for `counts` pieces of each length."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    done: list[Bins] = []
    large = capacity // 3 + 1
    for length in range(capacity, large - 1, -1):
        while left[length]:
            fits = np.flatnonzero(left[large : min(capacity - length, length) + 1])
            partner = int(fits[-1]) + large if len(fits) else 0
            if partner == length and left[length] == 1:
                partner = int(fits[-2]) + large if len(fits) > 1 else 0
            n = int(left[length] // 2) if partner == length else int(min(left[length], left[partner])) if partner else int(left[length])
            left[length] -= n
            if partner:
                left[partner] -= n
            done.append(Bins(n, capacity - length - partner, ((length, 1), (partner, 1)) if partner else ((length, 1),)))
    gaps: dict[int, list[Bins]] = {}
    for b in done:
        gaps.setdefault(b.gap, []).append(b)
    for length in range(large - 1, 0, -1):
        while left[length]:
            gap = min((g for g in gaps if g >= length), default=None)
            if gap is None:
                gap, bins = capacity, Bins(int(-(-left[length] // (capacity // length))), capacity, ())
            else:
                bins = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
            each = int(min(gap // length, left[length]))
            n = int(min(bins.n, left[length] // each))
            left[length] -= n * each
            rest = gap - each * length
            gaps.setdefault(rest, []).append(Bins(n, rest, (*bins.slots, (length, each))))
            if bins.n > n:
                if bins.slots:
                    gaps.setdefault(gap, []).append(Bins(bins.n - n, gap, bins.slots))
    return [b for group in gaps.values() for b in group]


def runs(plan: list[Bins]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset, in a row), sorted: where the ranks of each length go."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for b in plan:
        at = 0
        for length, each in b.slots:
            out.append((length, used.get(length, 0), sequence, at, each))
            used[length] = used.get(length, 0) + b.n * each
            at += length * each
        sequence += b.n
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def _places(table: np.ndarray):
    """Sequence and offset of each piece, by its length and rank."""
    keys = table[:, 0] << 48 | table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            _, first, sequence, offset, each = table[np.searchsorted(keys, length << 48 | rank, side="right") - 1].T
            more = rank - first
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(sequence + more // each), pa.array(offset + more % each * length)], names=[*names, "sequence_id", "offset"])

    return place


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and the id 0; null and empty texts are that id alone. Only documents above the capacity are
    cut. Sequences are filled from offset 0 without gaps. Rows that share an id, and null ids, are documents of their
    own; an empty table gives no rows. Other columns do not matter.
    """
    taken = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = shared.stored(taken.mapInArrow(_cut(tokenizer or tokenizer_file(), capacity), _PIECES), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranked = pieces.join(counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("before")), ["length", "part"])
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = runs(match_and_fit(histogram, capacity))
    rows = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank"))
    return rows.mapInArrow(_places(table), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
