"""Removal of byte strings that occur earlier, by sorted suffixes.

Only suffixes at anchors are sorted. Each window of `width` bytes picks the least `gram`-byte sequence in it (its
anchor), so equal windows pick equal anchors, and an anchor stands for a short run of windows, its own stretch.

1. Anchors that occur once are out (tally.recurring()).
2. Of equal stretches all but the first are removed whole; copies of documents and passages end here. Stretches meet by
   their own hash, and an anchor's numbers of stretches are summed, so an anchor of any frequency costs an entry a block.
3. The first stretches of an anchor that has several different ones go to a bucket of the anchor. The bucket sorts
   the suffixes from the anchor on, and the reversed prefixes before it, by deep-shallow sorting. Two windows at the
   same distance from their anchor are equal if both common prefixes reach far enough, so the two orders and their
   common prefixes give the classes of equal windows; all but the first of a class are removed.
4. An anchor with more than HOT different stretches (a line that many documents have between different text) would make
   a group that grows with the input. Its windows are dealt one by one instead, by their hash, each once a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm import tally
from quantloom.llm.suffixes import sort_suffixes
from quantloom.llm.text import chunks, mix, multipliers, text_bytes, window_minima

WIDTH, GRAM = 100, 24
#: Different stretches of an anchor up to which one task sorts them.
HOT = 4096
_M = multipliers(64)
#: What becomes of a block's stretches, or windows, of a class: all removed, or all but the block's first.
_ALL, _REST = 0, 1
#: What an anchor's first stretches need: nothing (there is one), sorting, or dealing by window.
_ONE, _SORT, _DEAL = 0, 1, 2


def _eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each byte on as one number."""
    x = data.astype(np.uint64)
    x = x[:-1] | (x[1:] << np.uint64(8))
    x = x[:-2] | (x[2:] << np.uint64(16))
    return x[:-4] | (x[4:] << np.uint64(32))


class Stretches:
    """Anchors of some documents: document, anchor's byte, first and last window start, hash of the anchor and of the stretch."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int, gram: int):
        n = len(data)
        if n < width:
            self.doc = self.at = self.low = self.high = np.zeros(0, np.int64)
            self.anchor = self.stretch = np.zeros(0, np.uint64)
            return
        eights = _eights(data)
        grams = np.zeros(n - gram + 1, np.uint64)
        for j, o in enumerate([*range(0, gram - 8, 8), gram - 8]):
            grams += eights[o : o + len(grams)] * _M[j]
        grams = mix(grams)
        least = window_minima(grams, width - gram + 1)
        firsts = offsets[:-1][offsets[:-1] < len(least)]
        change = np.ones(len(least), bool)
        change[1:] = least[1:] != least[:-1]
        change[firsts] = True
        low = np.flatnonzero(change)
        high = np.r_[low[1:], len(least)] - 1
        doc = np.searchsorted(offsets, low, side="right") - 1
        high = np.minimum(high, offsets[doc + 1] - width)
        keep = high >= low
        self.doc, self.low, self.high = doc[keep], low[keep], high[keep]
        self.at = least[self.low]
        self.anchor = grams[self.at]
        ends = [self._hash(eights, p, width) * _M[40 + k] for k, p in enumerate((self.low, self.high))]
        shape = (self.at - self.low).astype(np.uint64) * _M[44] + (self.high - self.at + width).astype(np.uint64) * _M[45]
        self.stretch = mix(ends[0] + ends[1] + shape + self.anchor)

    @staticmethod
    def _hash(eights: np.ndarray, p: np.ndarray, width: int) -> np.ndarray:
        h = np.zeros(len(p), np.uint64)
        for j, o in enumerate([*range(0, width - 8, 8), width - 8]):
            h += mix(eights[p + o] * _M[j % 32] + np.uint64(j))
        return mix(h)


def _stretches(table: pa.Table, width: int, gram: int):
    data, offsets = text_bytes(table["text"])
    for first, part, offs in chunks(data, offsets, 1 << 16):
        yield first, part, offs, Stretches(part, offs, width, gram)


def _anchors(buckets: int, width: int, gram: int):
    def send(table: pa.Table) -> pa.Table:
        keys, weight = tally.weights(np.concatenate([s.anchor for *_, s in _stretches(table, width, gram)]))
        return tally.pack(table["blk"][0].as_py(), buckets, keys, weight)

    return send


def _heads(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal sorted keys begin."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)


def _classes(buckets: int, width: int, gram: int):
    """Kind 0, by stretch: each class of equal stretches of a block once; c0 document and c1 byte of the block's first.
    Kind 1, by anchor: c0 number of the block's different stretches, c1 least and c2 greatest hash of them."""

    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        anchor, stretch, doc, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if table.num_rows and answers.num_rows:
            (known,) = tally.sorted_answer(answers, keys="u8")
            ids = tally.doc_ids(table)
            for first, _, offs, s in _stretches(table, width, gram):
                hit, _ = tally.found(s.anchor, known)
                anchor.append(s.anchor[hit])
                stretch.append(s.stretch[hit])
                doc.append(ids[first + s.doc[hit]])
                at.append((s.at - offs[s.doc])[hit])
        anchor, stretch, doc, at = map(np.concatenate, (anchor, stretch, doc, at))
        order = np.lexsort((at, doc, stretch))
        order = order[_heads(stretch[order])]
        blk = table["blk"][0].as_py() if table.num_rows else 0
        by_stretch = tally.pack(blk, buckets, stretch[order], doc[order], at[order])
        order = order[np.lexsort((stretch[order], anchor[order]))]
        head = _heads(anchor[order])
        last = np.r_[head[1:], len(order)] - 1 if len(head) else head
        by_anchor = tally.pack(blk, buckets, anchor[order][head], last - head + 1, stretch[order][head].view(np.int64), stretch[order][last].view(np.int64))
        by_stretch = by_stretch.append_column("c2", pa.nulls(by_stretch.num_rows, pa.binary()))
        kinds = [x.append_column("kind", pa.array(np.full(x.num_rows, k), pa.int8())) for k, x in enumerate((by_stretch, by_anchor))]
        return pa.concat_tables(kinds)

    return send


def _first_stretches(table: pa.Table) -> pa.Table:
    """For each block and stretch whether the block's first of it is the first of all."""
    blks = table["blk"].to_numpy()
    rows, (stretch, doc, at) = tally.unpack(table, keys="u8", c0="i8", c1="i8")
    order = np.lexsort((blks[rows], at, doc, stretch))
    what = np.full(len(order), _ALL, np.uint8)
    what[order[_heads(stretch[order])]] = _REST
    return tally.answer(blks[rows], stretch, what)


def _sizes(hot: int):
    """For each block and anchor what its first stretches need."""

    def resolve(table: pa.Table) -> pa.Table:
        rows, (anchor, n, lo, hi) = tally.unpack(table, keys="u8", c0="i8", c1="i8", c2="i8")
        order = np.argsort(anchor, kind="stable")
        anchor, n, lo, hi, rows = anchor[order], n[order], lo[order].view(np.uint64), hi[order].view(np.uint64), rows[order]
        head = _heads(anchor)
        if len(head):
            total, several = np.add.reduceat(n, head), np.minimum.reduceat(lo, head) < np.maximum.reduceat(hi, head)
            need = np.repeat(np.where(several, np.where(total > hot, _DEAL, _SORT), _ONE), np.diff(np.r_[head, len(anchor)])).astype(np.uint8)
        else:
            need = np.zeros(0, np.uint8)
        return tally.answer(table["blk"].to_numpy()[rows], anchor, need)

    return resolve


def _resolve(hot: int):
    sizes = _sizes(hot)

    def resolve(table: pa.Table) -> pa.Table:
        kind = table["kind"].to_numpy()
        parts = [f(table.filter(pa.array(kind == k))) for k, f in enumerate((_first_stretches, sizes)) if (kind == k).any()]
        parts = [x.append_column("kind", pa.array(np.full(x.num_rows, k), pa.int8())) for k, x in zip(sorted(set(kind.tolist())), parts, strict=True)]
        return pa.concat_tables(parts)

    return resolve


def _answers(table: pa.Table, *kinds: int, **dtypes: str) -> list[list[np.ndarray]]:
    """What was answered to a block, by kind."""
    kind = table["kind"].to_numpy() if table.num_rows else np.zeros(0, np.int8)
    return [tally.sorted_answer(table.filter(pa.array(kind == k)), **dtypes) for k in kinds]


def _judge(table: pa.Table, answers: pa.Table, width: int, gram: int):
    """For each part: first row, bytes, offsets, stretches, those removed whole, those to sort, those to deal, their documents."""
    (known, what), (anchors, needs) = _answers(answers, 0, 1, keys="u8", c0="u1")
    ids = tally.doc_ids(table)
    parts = list(_stretches(table, width, gram))
    place = np.concatenate([tally.found(s.stretch, known)[1] for *_, s in parts] or [np.zeros(0, np.int64)])
    hit = np.concatenate([tally.found(s.stretch, known)[0] for *_, s in parts] or [np.zeros(0, bool)])
    doc = np.concatenate([ids[f + s.doc] for f, _, _, s in parts] or [place])
    row = np.concatenate([f + s.doc for f, _, _, s in parts] or [place])
    at = np.concatenate([s.at - o[s.doc] for _, _, o, s in parts] or [place])
    order = np.lexsort((row, at, doc, np.where(hit, place, -1)))
    lead = np.zeros(len(order), bool)
    lead[order[_heads(np.where(hit, place, -1)[order])]] = True
    state = what[place] if len(known) else np.zeros(len(place), np.uint8)
    whole = hit & ((state == _ALL) | ~lead)
    first = hit & (state == _REST) & lead
    need = np.concatenate([needs[tally.found(s.anchor, anchors)[1]] if len(needs) else np.zeros(len(s.anchor), np.uint8) for *_, s in parts] or [state])
    cuts = np.cumsum([0, *(len(s.at) for *_, s in parts)])
    sort, deal = first & (need == _SORT), first & (need == _DEAL)
    return [(f, p, o, s, whole[a:b], sort[a:b], deal[a:b], doc[a:b]) for (f, p, o, s), a, b in zip(parts, cuts[:-1], cuts[1:], strict=True)]


def _dealt(judged: list, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows of stretches to deal: hash, document, first byte in it, row in the block."""
    out = [[np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    for f, part, offs, s, _, _, deal, doc in judged:
        sel = np.flatnonzero(deal)
        if len(sel):
            n = s.high[sel] - s.low[sel] + 1
            start = np.repeat(s.low[sel], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            own = np.repeat(s.doc[sel], n)
            for x, y in zip(out, (Stretches._hash(_eights(part), start, width), np.repeat(doc[sel], n), start - offs[own], f + own), strict=True):
                x.append(y)
    return tuple(np.concatenate(x) for x in out)


_SENT = "bucket int, blk int, keys binary, c0 binary, c1 binary, c2 binary, c3 binary, c4 binary, left array<binary>, right array<binary>, kind byte"


def _ordered(table: pa.Table) -> pa.Table:
    """A block's rows in an order that does not hang on how they were fetched; rows are named by their place in it."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _contexts(buckets: int, width: int, gram: int):
    """Kind 0: the stretches to sort; c0 document, c1 anchor's byte in it, c2 and c3 windows before it (from, to), c4 row in the block.
    Kind 1, by window: the block's first of each window to deal; c0 document and c1 byte in it."""

    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        got = [[] for _ in range(8)]
        table = _ordered(table)
        judged = _judge(table, answers, width, gram) if table.num_rows else []
        for f, part, offs, s, _, compare, _, doc in judged:
            raw, sel = part.tobytes(), np.flatnonzero(compare)
            for out, x in zip(got, (s.anchor[sel], doc[sel], (s.at - offs[s.doc])[sel], (s.at - s.low)[sel], (s.at - s.high)[sel], (f + s.doc)[sel]), strict=False):
                out.append(x)
            for lo, at, hi in zip(s.low[sel].tolist(), s.at[sel].tolist(), s.high[sel].tolist(), strict=True):
                got[6].append(raw[lo:at][::-1])
                got[7].append(raw[at : hi + width])
        cols = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in got[:6]]
        out = tally.pack(table["blk"][0].as_py() if table.num_rows else 0, buckets, cols[0], *(x.astype(np.int64) for x in cols[1:]))
        bucket = ((cols[0] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.r_[out["bucket"].to_numpy(), buckets]) if out.num_rows else [0]
        for name, texts in (("left", got[6]), ("right", got[7])):
            lists = [[texts[i] for i in order[a:b].tolist()] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            out = out.append_column(name, pa.array(lists, pa.list_(pa.binary())))
        window, doc, start, row = _dealt(judged, width)
        order = np.lexsort((row, start, doc, window))
        order = order[_heads(window[order])]
        dealt = tally.pack(table["blk"][0].as_py() if table.num_rows else 0, buckets, window[order], doc[order], start[order])
        out, dealt = (x.append_column("kind", pa.array(np.full(x.num_rows, k), pa.int8())) for k, x in enumerate((out, dealt)))
        return pa.concat_tables([out, dealt], promote_options="default").select([x.split()[0] for x in _SENT.split(", ")])

    return send


def _runs(lcp: np.ndarray, order: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """For each text and depth a number that is equal for texts whose common prefix has that depth: (texts, depths)."""
    out = np.empty((len(order), len(depth)), np.int32)
    for k, d in enumerate(depth.tolist()):
        out[order, k] = np.cumsum(lcp < d)
    return out


def _equal_windows(width: int, gram: int):
    """Kind 2: window starts that equal an earlier one; keys row, c0 from, c1 to (bytes of the document, a covered run).
    Kind 3: for each block and dealt window whether the block's first of it is the first of all."""

    def sort(table: pa.Table) -> pa.Table:
        rows, (anchor, doc, at, far, near, own) = tally.unpack(table, keys="u8", c0="i8", c1="i8", c2="i8", c3="i8", c4="i8")
        left = [x for row in table["left"].to_pylist() for x in row]
        right = [x for row in table["right"].to_pylist() for x in row]
        hit_row, hit_start = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        order = np.argsort(anchor, kind="stable")
        groups = np.empty(len(anchor), np.int64)
        groups[order] = np.cumsum(np.r_[True, np.diff(anchor[order]) != 0]) if len(order) else order
        if len(anchor):
            by_left, left_lcp = sort_suffixes(left, groups)
            by_right, right_lcp = sort_suffixes(right, groups)
            rank = np.empty(len(anchor), np.int64)
            rank[np.lexsort((own, rows, at, doc))] = np.arange(len(anchor))
            for before in range(width - gram + 1):
                here = np.flatnonzero((near <= before) & (before <= far))
                if len(here) < 2:
                    continue
                l = _runs(left_lcp, by_left, np.array([before]))[:, 0] if before else groups
                r = _runs(right_lcp, by_right, np.array([width - before]))[:, 0]
                key = l[here].astype(np.int64) << 32 | r[here]
                by = np.lexsort((rank[here], key))
                key = key[by]
                again = here[by[1:][key[1:] == key[:-1]]]
                hit_row.append(again)
                hit_start.append(at[again] - before)
        hit_row, start = np.concatenate(hit_row), np.concatenate(hit_start)
        by = np.lexsort((start, hit_row))
        hit_row, start = hit_row[by], start[by]
        new = np.flatnonzero(np.r_[True, (np.diff(hit_row) != 0) | (np.diff(start) > 1)]) if len(by) else by
        last = np.r_[new[1:], len(by)] - 1 if len(by) else new
        i = hit_row[new]
        return tally.answer(table["blk"].to_numpy()[rows[i]], own[i].astype(np.uint64), start[new], start[last] + width)

    def resolve(table: pa.Table) -> pa.Table:
        kind, out = table["kind"].to_numpy(), []
        if (kind == 0).any():
            runs = sort(table.filter(pa.array(kind == 0)))
            out.append(runs.append_column("kind", pa.array(np.full(runs.num_rows, 2), pa.int8())))
        if (kind == 1).any():
            dealt = _first_stretches(table.filter(pa.array(kind == 1)))
            out.append(dealt.append_column("c1", pa.nulls(dealt.num_rows, pa.binary())).append_column("kind", pa.array(np.full(dealt.num_rows, 3), pa.int8())).select(["blk", "keys", "c0", "c1", "kind"]))
        return pa.concat_tables([x.select(["blk", "keys", "c0", "c1", "kind"]) for x in out])

    return resolve


def _cut(width: int, gram: int):
    def cover(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = _ordered(table)
        data, offsets = text_bytes(table["text"])
        gone = np.zeros(len(data) + 1, np.int32)

        def mark(start: np.ndarray, end: np.ndarray) -> None:
            np.add.at(gone, start, 1)
            np.add.at(gone, end, -1)

        judged = _judge(table, answers, width, gram)
        for f, _, _, s, removed, _, _, _ in judged:
            mark(s.low[removed] + offsets[f], s.high[removed] + width + offsets[f])
        kind = answers["kind"].to_numpy() if answers.num_rows else np.zeros(0, np.int8)
        if (kind == 2).any():
            row, start, end = tally.sorted_answer(answers.filter(pa.array(kind == 2)), keys="u8", c0="i8", c1="i8")
            base = offsets[row.astype(np.int64)]
            mark(base + start, base + end)
        if (kind == 3).any():
            known, what = tally.sorted_answer(answers.filter(pa.array(kind == 3)), keys="u8", c0="u1")
            window, doc, start, row = _dealt(judged, width)
            order = np.lexsort((row, start, doc, window))
            window, start, row = window[order], start[order], row[order]
            again = np.ones(len(window), bool)
            again[_heads(window)] = False
            again |= what[tally.found(window, known)[1]] == _ALL
            mark(offsets[row[again]] + start[again], offsets[row[again]] + start[again] + width)
        out = np.cumsum(gone[:-1]) > 0
        kept, n, removed, spans = [], [], [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            o = out[a:b]
            kept.append(data[a:b][~o].tobytes())
            n.append(b - a)
            removed.append(int(o.sum()))
            spans.append(int(o[0]) + int((o[1:] & ~o[:-1]).sum()) if b > a else 0)
        return pa.table({"doc_id": table["doc_id"], "kept": pa.array(kept, pa.binary()), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64())})

    return cover


def remove_repeated_bytes(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT, block_bytes: int = tally.BLOCK_BYTES, bucket_bytes: int = tally.BUCKET_BYTES) -> DataFrame:
    """Each document without the bytes covered by a string of `width` bytes that also starts earlier.

    Earlier: in a document of a smaller id, or before it in the same one; overlaps count. Takes doc_id and text of
    `docs`; returns doc_id, kept (binary: UTF-8 bytes, which a cut may leave invalid as text), n_bytes, n_removed and
    n_spans, one row for each row. Null and empty texts have no bytes. Of rows that share an id, any one order holds
    among equal places; a null id counts as larger than any other. Other columns do not matter; an empty table gives no
    rows. A text is one task's work as a whole, however long. `hot`, `block_bytes` and `bucket_bytes` change where the
    work is done, not the result.
    """
    size = tally.text_size(docs)
    blocks, buckets = tally.into_blocks(docs, tally.parts(size, block_bytes)), tally.parts(size, bucket_bytes)
    sent = tally.per_block(blocks, _anchors(buckets, width, gram), "bucket int, blk int, keys binary, c0 binary")
    classes = tally.per_block_with(blocks, tally.recurring(sent), _classes(buckets, width, gram), "bucket int, blk int, keys binary, c0 binary, c1 binary, c2 binary, kind byte")
    whole = classes.groupBy("bucket").applyInArrow(_resolve(hot), "blk int, keys binary, c0 binary, kind byte")
    contexts = tally.per_block_with(blocks, whole, _contexts(buckets, width, gram), _SENT)
    runs = contexts.groupBy("bucket").applyInArrow(_equal_windows(width, gram), "blk int, keys binary, c0 binary, c1 binary, kind byte")
    answers = whole.withColumn("c1", F.lit(None).cast("binary")).select("blk", "keys", "c0", "c1", "kind").union(runs.select("blk", "keys", "c0", "c1", "kind"))
    return tally.per_block_with(blocks, answers, _cut(width, gram), "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def op9_repeated_bytes(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of all `documents`; null texts read as empty ones."""
    out = remove_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
