"""Deep-shallow sorting of suffixes: multikey quicksort to a shallow depth, then blind tries for the deep groups."""

from __future__ import annotations

import numpy as np

#: Bytes that one round of the shallow sort compares, and the depth at which blind tries take over.
STEP, SHALLOW = 8, 24


def padded(texts: list[bytes], width: int) -> np.ndarray:
    """Texts as rows of a matrix, filled up with zero bytes; lengths are kept apart."""
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in texts), np.uint8).reshape(len(texts), width)


def _shallow(rows: np.ndarray, groups: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort with characters of STEP bytes: an order of the rows, and a group number for each place in it.

    In each round every group of several rows is parted by the character of its middle row into smaller, equal and
    larger ones; equal ones go on with their next character, until `depth` bytes are equal. All groups are parted at once.
    """
    order = np.argsort(groups, kind="stable")
    ranked, n = groups[order], len(order)
    words = np.ascontiguousarray(rows[:, :depth]).view(">u8").astype(np.uint64)
    begin = np.maximum.accumulate(np.where(np.r_[True, ranked[1:] != ranked[:-1]], np.arange(n), 0))
    level = np.zeros(n, np.int64)
    while True:
        several = np.zeros(n, bool)
        several[1:] = begin[1:] == begin[:-1]
        several[:-1] |= several[1:]
        at = np.flatnonzero(several & (level < words.shape[1]))
        if not len(at):
            return order, np.cumsum(begin == np.arange(n))
        key = words[order[at], level[at]]
        first = np.flatnonzero(np.r_[True, np.diff(begin[at]) != 0])
        size = np.diff(np.r_[first, len(at)])
        pivot = np.repeat(key[first + size // 2], size)
        to = np.empty(len(at), np.int64)
        start = begin[at].copy()
        fresh = begin[at].copy()
        for part in (key < pivot, key == pivot, key > pivot):
            before = np.cumsum(part)
            rank = before - np.repeat(before[first] - part[first], size) - 1
            to[part], fresh[part] = (start + rank)[part], start[part]
            start = start + np.repeat(np.add.reduceat(part, first, dtype=np.int64), size)
        moved, deeper = order[at], level[at] + (key == pivot)
        order[to], begin[to], level[to] = moved, fresh, deeper


def _differ(a: bytes, b: bytes, start: int) -> int:
    """The first byte from `start` on at which two texts differ, or the length of the shorter one."""
    n = min(len(a), len(b))
    if a[start:n] == b[start:n]:
        return n
    step = 64
    while a[start : start + step] == b[start : start + step]:
        start += step
    while a[start] == b[start]:
        start += 1
    return start


class _Node:
    __slots__ = ("children", "depth", "leaf")

    def __init__(self, depth: int, leaf: int):
        self.depth, self.leaf, self.children = depth, leaf, {}


class BlindTrie:
    """A trie that keeps only branching bytes and depths: one blind descent and one comparison place a text."""

    def __init__(self, texts: list[bytes]):
        self.texts, self.same = texts, {}
        self.root: _Node | None = None

    def add(self, i: int, start: int) -> None:
        if self.root is None:
            self.root = _Node(len(self.texts[i]), i)
            self.same[i] = [i]
            return
        text, node, path = self.texts[i], self.root, []
        while node.children:
            path.append(node)
            byte = text[node.depth] if node.depth < len(text) else -1
            node = node.children.get(byte) or next(iter(node.children.values()))
        other = self.texts[node.leaf]
        at = _differ(text, other, start)
        if at == len(text) == len(other):
            self.same[node.leaf].append(i)
            return
        self.same[i] = [i]
        path.append(node)
        k = next((k for k, x in enumerate(path) if x.depth >= at), len(path) - 1)
        below, leaf = path[k], _Node(len(text), i)
        if below.children and below.depth == at:
            below.children[text[at] if at < len(text) else -1] = leaf
            return
        joint = _Node(at, -1)
        joint.children[other[at] if at < len(other) else -1] = below
        joint.children[text[at] if at < len(text) else -1] = leaf
        if k:
            above = path[k - 1]
            above.children[next(b for b, x in above.children.items() if x is below)] = joint
        else:
            self.root = joint

    def walk(self) -> list[tuple[int, int]]:
        """(text, common prefix with the one before), in order."""
        out: list[tuple[int, int]] = []
        stack: list[tuple[_Node, int]] = [(self.root, 0)] if self.root else []
        while stack:
            node, lcp = stack.pop()
            if not node.children:
                length = len(self.texts[node.leaf])
                out += [(i, length if k else lcp) for k, i in enumerate(self.same[node.leaf])]
            else:
                ordered = sorted(node.children.items())
                stack += [(child, node.depth if k else lcp) for k, (_, child) in reversed(list(enumerate(ordered)))]
        return out


def sort_suffixes(texts: list[bytes], groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the texts within their groups, and each one's common prefix with the one before it (-1: another group).

    The prefixes of two texts that stand in either order are found exactly, to the length of the shorter one.
    """
    n = len(texts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = padded([x[:SHALLOW] for x in texts], SHALLOW)
    length = np.array([len(x) for x in texts])
    order, group = _shallow(rows, groups, SHALLOW)
    lcp = np.full(n, -1, np.int64)
    a, b = order[:-1], order[1:]
    near = groups[a] == groups[b]
    differ = rows[a] != rows[b]
    shallow = np.where(differ.any(axis=1), differ.argmax(axis=1), SHALLOW)
    lcp[1:][near] = np.minimum(shallow, np.minimum(length[a], length[b]))[near]
    cut = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if e - s > 1:
            trie = BlindTrie(texts)
            for i in order[s:e].tolist():
                trie.add(i, 0 if len(texts[i]) < SHALLOW else SHALLOW)
            walked = trie.walk()
            order[s:e] = [i for i, _ in walked]
            lcp[s + 1 : e] = [x for _, x in walked[1:]]
            if s and lcp[s] >= 0:
                first, before = texts[order[s]], texts[order[s - 1]]
                lcp[s] = _differ(first, before, 0)
    for s in cut[1:-1].tolist():
        if lcp[s] >= 0:
            lcp[s] = _differ(texts[order[s]], texts[order[s - 1]], 0)
    return order, lcp
