"""Repeated-phrase automata: removal of word windows that an earlier document has, by sharded Aho-Corasick automata.

1. Propose: every window of `width` words picks its least `gram`-word sequence by hash (its anchor), so equal windows
   pick equal anchors. Anchors that occur in two documents are counted by tally.recurring().
2. Confirm: windows of recurring anchors are counted in the same way, with the smallest and largest document id.
3. Locate: runs of confirmed windows that share their first document are passages. Each block compiles its passages into
   automata over word codes, a bounded number of words each, and streams all its documents through each; an occurrence
   in a document after the passage's first is removed. Shards follow the blocks of documents, so no automaton has to hold
   the phrases of the whole corpus and no document has to pass through all automata.

Single windows as the automata's phrases, each from one of a block's documents, would leave all locating to the automata;
they have 13 nodes a word in place of one and took over six times the CPU seconds.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm import tally
from quantloom.llm.text import Words, chunks, split_words, text_bytes, window_minima

WIDTH, GRAM = 13, 4
#: Words of the passages of one automaton, at which it is closed: some tens of bytes of memory each.
SHARD = 1_000_000


def _anchors(w: Words, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words at which windows start, and each window's anchor: its word and its hash."""
    starts = np.flatnonzero(w.windows(width))
    grams = w.window_hashes(gram)
    at = window_minima(grams[: max(0, len(grams) - gram + 1)], width - gram + 1)[starts] if len(starts) else starts
    return starts, at, grams[at] if len(starts) else np.zeros(0, np.uint64)


def _propose(buckets: int, width: int, gram: int):
    def send(table: pa.Table) -> pa.Table:
        data, offsets = text_bytes(table["text"])
        found = []
        for _, part, offs in chunks(data, offsets):
            w = split_words(part, offs)
            _, at, keys = _anchors(w, width, gram)
            new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else at
            docs, keys = np.searchsorted(w.first, at[new], side="right"), keys[new]
            order = np.lexsort((keys, docs))
            docs, keys = docs[order], keys[order]
            found.append(keys[np.r_[True, (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])]] if len(keys) else keys)
        keys, weight = tally.weights(np.concatenate(found))
        return tally.pack(table["blk"][0].as_py(), buckets, keys, weight)

    return send


def _confirm(buckets: int, width: int, gram: int):
    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows or not answers.num_rows:
            return tally.pack(0, buckets, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        (known,) = tally.sorted_answer(answers, keys="u8")
        ids, (data, offsets) = tally.doc_ids(table), text_bytes(table["text"])
        keys, docs = [], []
        for first, part, offs in chunks(data, offsets):
            w = split_words(part, offs)
            starts, _, anchors = _anchors(w, width, gram)
            starts = starts[tally.found(anchors, known)[0]]
            keys.append(w.window_hashes(width)[starts])
            docs.append(ids[first + np.searchsorted(w.first, starts, side="right") - 1])
        keys, docs = np.concatenate(keys), np.concatenate(docs)
        order = np.lexsort((docs, keys))
        keys, docs = keys[order], docs[order]
        new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else keys.astype(np.int64)
        last = np.r_[new[1:], len(keys)] - 1 if len(keys) else new
        return tally.pack(table["blk"][0].as_py(), buckets, keys[new], docs[new], docs[last] - docs[new])

    return send


def _first_documents(table: pa.Table) -> pa.Table:
    """For each block those of its windows that one of its documents has after the first of all documents, with that first."""
    rows, (keys, low, span) = tally.unpack(table, keys="u8", c0="i8", c1="i8")
    order = np.argsort(keys, kind="stable")
    keys, low, high, rows = keys[order], low[order], (low + span)[order], rows[order]
    cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else rows
    first = np.repeat(np.minimum.reduceat(low, cut), np.diff(np.r_[cut, len(keys)])) if len(keys) else low
    keep = high > first
    return tally.answer(table["blk"].to_numpy()[rows[keep]], keys[keep], first[keep])


def _locate(width: int):
    def cover(table: pa.Table, answers: pa.Table) -> pa.Table:
        ids, (data, offsets) = tally.doc_ids(table), text_bytes(table["text"])
        known, firsts = tally.sorted_answer(answers, keys="u8", c0="i8")
        kept_text, n_words, n_removed = [], [], []
        parts = [(first, split_words(part, offs)) for first, part, offs in chunks(data, offsets)]
        gone = [np.zeros(len(w.starts) + 1, np.int32) for _, w in parts]
        if len(known):
            codes = _codes([w for _, w in parts])
            passages, size = {}, 0
            for k, ((first, w), c) in enumerate(zip(parts, codes, strict=True)):
                for s, e, of in _passages(w, ids[first:], known, firsts, width):
                    size += 0 if c[s:e] in passages else e - s
                    passages[c[s:e]] = (of, e - s)
                if size >= SHARD or k == len(parts) - 1:
                    _locate_all(passages, parts, codes, ids, gone, width)
                    passages, size = {}, 0
        for (_, w), removed in zip(parts, gone, strict=True):
            out = np.cumsum(removed[:-1]) > 0
            for s, e in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
                kept = np.flatnonzero(~out[s:e]) + s
                n_words.append(e - s)
                n_removed.append(e - s - len(kept))
                kept_text.append(_joined(w, kept) if len(kept) else "")
        return pa.table({"doc_id": table["doc_id"], "text": pa.array(kept_text, pa.string()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64())})

    return cover


def _passages(w: Words, ids: np.ndarray, known: np.ndarray, firsts: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Confirmed passages: maximal runs of windows that all have the same earlier document. First word, end, that document."""
    starts = np.flatnonzero(w.windows(width))
    hit, at = tally.found(w.window_hashes(width)[starts], known)
    starts, of = starts[hit], firsts[at[hit]]
    later = of < ids[np.searchsorted(w.first, starts, side="right") - 1]
    starts, of = starts[later], of[later]
    if not len(starts):
        return []
    cut = np.flatnonzero(np.r_[True, (np.diff(starts) != 1) | (np.diff(of) != 0), True])
    return list(zip(starts[cut[:-1]].tolist(), (starts[cut[1:] - 1] + width).tolist(), of[cut[:-1]].tolist(), strict=True))


def _locate_all(passages: dict[tuple, tuple[int, int]], parts: list, codes: list[tuple], ids: np.ndarray, gone: list[np.ndarray], width: int) -> None:
    """Streams all documents through one automaton; marks its occurrences in later documents in `gone`."""
    if not passages:
        return
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for passage, value in passages.items():
        automaton.add_word(passage, value)
    automaton.make_automaton()
    for (first, w), c, removed in zip(parts, codes, gone, strict=True):
        for d, (s, e) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
            if e - s >= width:
                own = ids[first + d]
                ends = [(end + 1, size) for end, (of, size) in automaton.iter(c[s:e]) if of < own]
                if ends:
                    at, size = np.array(ends).T
                    np.add.at(removed, at + s - size, 1)
                    np.add.at(removed, at + s, -1)


def _joined(w: Words, kept: np.ndarray) -> str:
    """Some words joined by one space."""
    starts, ends = w.starts[kept], w.ends[kept]
    size = ends - starts + 1
    to = np.cumsum(size) - size
    out = np.full(int(size.sum()), 32, np.uint8)
    fill = np.arange(len(out)) - np.repeat(to, size)
    body = fill < np.repeat(size - 1, size)
    out[body] = w.data[(np.repeat(starts, size) + fill)[body]]
    return out[:-1].tobytes().decode()


def _codes(parts: list[Words]) -> list[tuple]:
    """Each part's words as a tuple of numbers, equal for equal words of the block."""
    spans = np.concatenate([w.ends - w.starts for w in parts])
    packed = np.concatenate([w.data[_inside(w)] for w in parts])
    offsets = np.r_[0, np.cumsum(spans)].astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(spans), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
    codes = words.dictionary_encode().indices.to_numpy() + 1
    cuts = np.cumsum([0, *(len(w.starts) for w in parts)])
    return [tuple(codes[a:b].tolist()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _inside(w: Words) -> np.ndarray:
    step = np.zeros(len(w.data) + 1, np.int8)
    step[w.starts] += 1
    step[w.ends] -= 1
    return np.cumsum(step[:-1], dtype=np.int8).astype(bool)


def remove_repeated_phrases(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, block_bytes: int = tally.BLOCK_BYTES, bucket_bytes: int = tally.BUCKET_BYTES) -> DataFrame:
    """Each document without the words that lie in a window of `width` words which a document of a smaller id has, too.

    Takes doc_id and text of `docs`; returns doc_id, text (kept words joined by one space), n_words and n_removed,
    one row for each row. Null, empty and blank texts have no words and give "". Documents shorter than a window keep
    all words. Rows that share an id never remove each other's words; a null id counts as larger than any other. Other
    columns do not matter; an empty table gives no rows. A text is one task's work as a whole, however long. `block_bytes`
    and `bucket_bytes` change where the work is done, not the result.
    """
    size = tally.text_size(docs)
    blocks, buckets = tally.into_blocks(docs, tally.parts(size, block_bytes)), tally.parts(size, bucket_bytes)
    sent = tally.per_block(blocks, _propose(buckets, width, gram), "bucket int, blk int, keys binary, c0 binary")
    windows = tally.per_block_with(blocks, tally.recurring(sent), _confirm(buckets, width, gram), "bucket int, blk int, keys binary, c0 binary, c1 binary")
    confirmed = windows.groupBy("bucket").applyInArrow(_first_documents, "blk int, keys binary, c0 binary")
    return tally.per_block_with(blocks, confirmed, _locate(width), "doc_id long, text string, n_words long, n_removed long")


def op4_repeated_phrases(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of all `documents`; null texts read as empty ones."""
    out = remove_repeated_phrases(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
