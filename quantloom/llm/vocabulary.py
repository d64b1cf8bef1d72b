"""Words of a batch of texts as dense ids, exact ones: a local dictionary, never a hash, tells words apart."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from quantloom.llm.text import fold_case


@dataclass
class WordIds:
    """The id of each word, the distinct words by id, each word's first byte and each text's first word (n + 1 indexes)."""

    ids: np.ndarray
    words: pa.Array
    starts: np.ndarray
    first: np.ndarray


def ascii_word(data: np.ndarray) -> np.ndarray:
    """True at 0-9, a-z and bytes beyond ASCII, in data whose A-Z are folded."""
    return (data >= 128) | ((data - np.uint8(97)) < 26) | ((data - np.uint8(48)) < 10)


def word_ids(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> WordIds:
    """Words are maximal runs of bytes `inside` within a text."""
    edge = np.empty(len(data) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[0] = edge[-1] = True
    edge[offsets] = True
    at = np.flatnonzero(edge)
    runs = inside[at[:-1]] if len(data) else np.zeros(0, bool)
    starts, ends = at[:-1][runs], at[1:][runs]
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=bounds[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[inside])]).dictionary_encode()
    return WordIds(words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary, starts, np.searchsorted(starts, offsets))


def folded_word_ids(data: np.ndarray, offsets: np.ndarray) -> WordIds:
    """A-Z is lower-cased; words are runs of 0-9, a-z and characters beyond ASCII."""
    data = fold_case(data)
    return word_ids(data, offsets, ascii_word(data))


def suffix_array(ids: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of the ids, each ending with its text (`left` ids are left of it), in order of their first `depth` ids at least.

    Prefix doubling: the order by h ids and the ranks h places on give the order by 2h; what a text does not have ranks first.
    """
    order = np.argsort(ids, kind="stable")
    rank, h = ids, 1
    while h < depth:
        second = np.zeros(len(ids), np.int64)
        inside = np.flatnonzero(left > h)
        second[inside] = rank[inside + h] + 1
        key = rank * (int(second.max(initial=0)) + 1) + second
        order = np.argsort(key, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.cumsum(np.r_[False, key[order[1:]] != key[order[:-1]]]) if len(ids) else order
        h *= 2
    return order


def common_prefixes(ids: np.ndarray, left: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each place of the suffix array how many ids its suffix shares with the one before, `depth` at most."""
    out = np.zeros(len(order), np.int64)
    at = np.arange(1, len(order))
    for k in range(depth):
        a, b = order[at - 1], order[at]
        at = at[(left[a] > k) & (left[b] > k)]
        at = at[ids[order[at - 1] + k] == ids[order[at] + k]]
        out[at] += 1
    return out


def ngram_runs(ids: np.ndarray, left: np.ndarray, shortest: int, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each n the runs of equal n-grams along the suffix array: n, occurrences run by run, and the runs' first places."""
    order = suffix_array(ids, left, longest)
    shared = common_prefixes(ids, left, order, longest)
    for n in range(shortest, longest + 1):
        long_enough = left[order] >= n
        # A suffix too short for n ids is no occurrence and never lies between two that share n of them.
        places, starts = order[long_enough], (shared < n)[long_enough]
        yield n, places, np.flatnonzero(starts)
