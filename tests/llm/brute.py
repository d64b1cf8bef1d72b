"""The same results in plain Python, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = r"[^\x20\x09-\x0D]+"


def words(text: str | None) -> list[str]:
    return re.findall(SPACE, text or "")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def phrases(rows, width=13):
    """doc_id: words, words removed, hash of what is left."""
    first: dict[tuple, int] = {}
    docs = [(i, words(t)) for i, t in rows]
    for i, w in docs:
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            first[g] = min(first.get(g, i), i)
    out = {}
    for i, w in docs:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def repeated_bytes(rows, width=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        x = (t or "").encode()
        gone = bytearray(len(x))
        for k in range(len(x) - width + 1):
            g = x[k : k + width]
            if g in seen:
                gone[k : k + width] = b"\1" * width
            seen.add(g)
        out[i] = (len(x), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(c for c, g in zip(x, gone, strict=True) if not g)))
    return out


def components(rows, width=5, percent=80):
    sets = {}
    for i, t in rows:
        w = words((t or "").translate(FOLD))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def contamination(rows, items, width=10):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = defaultdict(set)
    for item, t in items:
        w = re.findall(pattern, (t or "").translate(FOLD))
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[k : k + width])].add(str(item))
    sizes = {len(x) for x in windows}
    out = []
    for i, t in rows:
        w = re.findall(pattern, (t or "").translate(FOLD))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if of := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= of
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def quality(text):
    w = words(text)
    text = text or ""
    lines = [x for x in text.split("\n") if words(x)]
    windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
    n_dup = len(lines) - len(set(lines))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), n_dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def personal(text):
    """Base spans (start, rank, kind, end)."""
    text = text or ""
    kinds = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    out = []
    for rank, (kind, pattern) in enumerate(kinds):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(d))]
            luhn = sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0
            if (kind == "ip" and any(int(p) > 255 for p in m[0].split("."))) or (kind == "card" and not (14 <= len(d) <= 19 and luhn)) or (kind == "phone" and not 10 <= len(d) <= 15):
                continue
            out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def templates(leaf, depth, similarity, need, levels=2):
    """line: places of its template's constants, for the lines of a leaf with their numbers of documents."""
    found, branches = {}, [(leaf, levels)]
    while branches:
        lines, level = branches.pop()
        votes, total = Counter(), sum(lines.values())
        for line, n in lines.items():
            votes.update({(p, t): n for p, t in enumerate(line) if p >= depth})
        forms, support, below = {}, Counter(), defaultdict(dict)
        for line, n in lines.items():
            form = tuple((p, t) for p, t in enumerate(line) if p >= depth and votes[p, t] >= need)
            if len(form) >= (len(line) - depth) * similarity:
                forms[line] = form
                support[form] += n
        for line, form in forms.items():
            if support[form] >= need:
                found[line] = form
            elif best := max(((votes[p, t], p, t) for p, t in form if votes[p, t] < total), default=None):
                below[best][line] = lines[line]
        branches += [(x, level - 1) for x in below.values() if level]
    own = set(found.values())
    for line in set(leaf) - set(found):
        fits = [f for f in own if all(line[p] == t for p, t in f)]
        if fits:
            found[line] = max(fits, key=lambda f: (len(f), [p for p, _ in f]))
    return found


def lines(rows, depth=3, similarity=0.6, min_tokens=4, min_docs=5, long_docs=2, keep_copies=False, copy_share=0.8):
    """(doc_id, text): lines, those of recurring templates, lines dropped, the document it copies, hash of the text left."""
    need = lambda n: min(long_docs, min_docs) if n > 50 else min_docs
    parsed, chars, leaves = [], {}, defaultdict(lambda: defaultdict(set))
    for i, t in dict.fromkeys(rows):
        chars[i, t] = sum(map(len, words(t)))
        for k, line in enumerate((t or "").split("\n")):
            tokens = tuple("<*>" if re.search("[0-9]", w) else w for w in words(line))
            if len(tokens) >= min_tokens:
                parsed.append(((i, t), k, sum(map(len, words(line))), tokens))
                leaves[len(tokens), tokens[:depth]][tokens].add((i, t))
    of = {}
    for (n, start), variants in leaves.items():
        if len(variants) == 1:
            of |= {line: line for line in variants}
        else:
            of |= {line: (n, start, form) for line, form in templates({x: len(d) for x, d in variants.items()}, depth, similarity, need(n)).items()}
    docs, first = defaultdict(set), {}
    for d, k, _, tokens in parsed:
        if tokens in of:
            key = of[tokens]
            docs[key].add(d)
            place = (d[0] is None, d[0] or 0, k)
            first[key] = min(first.get(key, (place, d, k)), (place, d, k), key=lambda x: x[0])
    recurring, gone, shares = Counter(), defaultdict(set), defaultdict(Counter)
    for d, k, size, tokens in parsed:
        key = of.get(tokens)
        if key is not None and len(docs[key]) >= need(len(tokens)):
            recurring[d] += 1
            shares[d][first[key][1]] += size
            if first[key][1:] != (d, k):
                gone[d].add(k)
    out = {}
    for d in chars:
        origin = max((o[0] for o, n in shares[d].items() if o != d and n >= chars[d] * copy_share), default=None)
        drop = set() if keep_copies and origin is not None else gone[d]
        each = [] if d[1] is None else d[1].split("\n")
        out[d] = (len(each), recurring[d], len(drop), origin, sha("\n".join(x for k, x in enumerate(each) if k not in drop)))
    return out
