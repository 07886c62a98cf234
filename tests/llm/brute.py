"""Plain versions of the operators, a document at a time."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def order(row):
    return (row[0] is None, row[0] or 0, (row[1] or "").encode() if row[1] is not None else b"\xff" * 8)


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = [0] * len(w)
    for i in range(len(w) - 4):
        if windows[tuple(w[i : i + 5])] > 1:
            inside[i : i + 5] = [1] * 5
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    failed = len(w) < 10 or 100 * sum(inside) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, sum(inside), failed


def repeats(rows, n=20):
    """(doc_id, n_words, n_removed, text) of rows in order."""
    seen, out = set(), []
    for row in sorted(rows, key=order):
        w = WORD.findall(row[1] or "")
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            if key in seen:
                gone[i : i + n] = [True] * n
            seen.add(key)
        out.append((row[0], len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def simhash(text):
    w = [x.encode() for x in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def classes(points, radius=2):
    """Each of distinct points with the least index that links reach."""
    root = list(range(len(points)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(points):
        for j in range(i):
            if (a ^ points[j]).bit_count() <= radius:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(points))]


def edits(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        c = [i]
        for j, y in enumerate(b, 1):
            c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
        p = c
    return p[-1]


def near_lines(rows, limit=2, least=20):
    """(doc_id, text, n_lines, n_removed) of rows in order."""
    seen, out = [], []
    for row in sorted(rows, key=order):
        if row[1] is None:
            out.append((row[0], None, 0, 0))
            continue
        lines, gone = row[1].split("\n"), []
        for line in lines:
            near = len(line) >= least and any(x == line or (abs(len(x) - len(line)) <= limit and edits(x, line) <= limit) for x in seen)
            gone.append(near)
            if len(line) >= least and line not in seen:
                seen.append(line)
        out.append((row[0], "\n".join(x for x, g in zip(lines, gone, strict=True) if not g), len(lines), sum(gone)))
    return out


def phrases(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    wanted = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}
    found = [(i, k) for k, p in wanted.items() for i in range(len(w)) if w[i : i + len(p)] == p]
    places = [i for i, _ in found]
    return len(w), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({k for _, k in found}))


def targets(sizes, weights=(5, 2, 1)):
    names = sorted(x for x in sizes if x is not None) + [x for x in sizes if x is None]
    w, total, full = {x: weights[i % 3] for i, x in enumerate(names)}, sum(sizes.values()), set()
    while True:
        free = sum(w[x] for x in names if x not in full)
        level = (total - 3 * sum(sizes[x] for x in full)) / free if free else 0
        now = {x for x in names if level * w[x] > 3 * sizes[x]}
        if now <= full:
            return {x: 3.0 * sizes[x] if x in full else level * w[x] for x in names}
        full |= now


def digest(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()
