"""Plain versions of the operators, one document or one table at a time."""

from __future__ import annotations

import collections
import hashlib
import re

import numpy as np
import xxhash

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def split_words(text):
    return [w for w in SPACE.split(text or "") if w]


def exact(rows):
    """Multiset of (doc_id, keep_id, group_size, kept, sha)."""
    groups = collections.defaultdict(list)
    for n, (i, t) in enumerate(rows):
        groups[SPACE.sub(" ", t or "")].append((i is None, i, n))
    out = []
    for text, members in groups.items():
        first = min(members, key=lambda m: (m[0], m[1] or 0, m[2]))
        out += [(m[1], first[1], len(members), m == first, sha(text)) for m in members]
    return out


def simhash(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = split_words(low)
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def classes(prints, bits=2):
    """Class number of every fingerprint."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= bits:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def near(rows):
    prints = [simhash(t) for _, t in rows]
    root = classes(prints)
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [(i, f"{p:016x}", least.get(r)) for (i, _), p, r in zip(rows, prints, root, strict=True)]


def removed(rows, window, as_words):
    """(doc_id, size, removed, spans, digest of the rest) of the repeated-window operators."""
    seqs = [split_words(t) if as_words else (t or "").encode() for _, t in rows]
    cut = lambda x, i: tuple(x[i : i + window]) if as_words else x[i : i + window]
    seen = collections.Counter(cut(x, i) for x in seqs for i in range(len(x) - window + 1))
    out = []
    for (doc, _), x in zip(rows, seqs, strict=True):
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - window + 1):
            if seen[cut(x, i)] > 1:
                gone[i : i + window] = True
        rest = " ".join(w for w, g in zip(x, gone, strict=True) if not g) if as_words else bytes(b for b, g in zip(x, gone, strict=True) if not g)
        spans = sum(bool(g) and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(x), int(gone.sum()), spans, sha(rest)))
    return out


def shingle_words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def shingles(text, size=5):
    w = shingle_words(text)
    return {" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def word_runs(text, size):
    w = shingle_words(text)
    return {" ".join(w[i : i + size]) for i in range(len(w) - size + 1)}


def contaminated(rows, items, threshold=0.8):
    found = {}
    for i, t in rows:
        for item, text in items:
            wanted = shingles(text)
            own = word_runs(t, min(5, len(shingle_words(text)) or 5))
            if wanted and len(own & wanted) / len(wanted) >= threshold:
                value = (len(own & wanted) / len(wanted), len(own & wanted), len(wanted))
                found[i, item] = max(value, found.get((i, item), value))
    return [(i, item, n, k, c) for (i, item), (c, k, n) in found.items()]


def secrets(text):
    t = text or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(spans)


def viterbi(unit, pieces):
    """Ids of the best path; ties go to the longer last piece."""
    table = {p: (i, s) for p, i, s in pieces.rows}
    best, back = [0.0] + [None] * len(unit), [None] * (len(unit) + 1)
    for e in range(1, len(unit) + 1):
        for size in range(1, min(pieces.longest, e) + 1):
            edge = table.get(unit[e - size : e], (-1, pieces.lowest) if size == 1 else None)
            if edge and (best[e] is None or best[e - size] + edge[1] >= best[e]):
                best[e], back[e] = best[e - size] + edge[1], (size, edge[0])
    out, e = [], len(unit)
    while e:
        size, i = back[e]
        out = ([i] if i >= 0 else [pieces.byte_ids[b] for b in unit[e - 1].encode()]) + out
        e -= size
    return out
