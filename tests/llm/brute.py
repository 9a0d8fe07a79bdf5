"""Brute-force versions of the operators, over lists of (doc_id, text)."""

import hashlib
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def letters(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def substring_dedup(docs, window=20):
    seen, out = set(), {}
    for d, t in sorted(set(docs), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        w = plain(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[d, t] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def decontaminate(docs, items, window=10):
    runs = {}
    for item, t in items:
        w = letters(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if n else ():
            runs.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = {}
    for d, t in docs:
        w, hit, found = letters(t), set(), set()
        for n in {len(k) for k in runs}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in runs:
                    hit |= set(range(i, i + n))
                    found |= runs[k]
        out[d, t] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def jaccard(docs, width=3, percent=90):
    sets = {}
    for d, t in docs:
        w = [x for x in plain((t or "").translate(LOWER))]
        sets[d] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def quality(text):
    w = plain(text)
    runs = {}
    for i in range(len(w) - 7):
        runs.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {p for at in runs.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if plain(line):
            dup += line in lines
            lines.add(line)
    n = len(w)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n)


def phrases(text, wanted):
    w = letters(text)
    hits = []
    for p, label in wanted.items():
        q = p.split()
        hits += [(i, label) for i in range(len(w) - len(q) + 1) if w[i : i + len(q)] == q]
    at = [i for i, _ in hits]
    return (len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits})))


def repeats(docs, window=20):
    """Maximal stretches of words each of whose windows starts earlier, too."""
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        w = plain(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if (k := tuple(w[i : i + window])) in seen:
                gone |= set(range(i, i + window))
            seen.add(k)
        out[d] = [(a, next(b for b in range(a, len(w) + 1) if b not in gone)) for a in sorted(gone) if a - 1 not in gone]
    return out
