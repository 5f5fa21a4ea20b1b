"""Plain versions of the operators, for small inputs."""

import hashlib
import re


def union_find(n, pairs):
    p = list(range(n))

    def find(a):
        while p[a] != a:
            p[a] = p[p[a]]
            a = p[a]
        return a

    for a, b in pairs:
        x, y = find(a), find(b)
        p[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def shingle_groups(rows, n=3, num=90, den=100):
    """{doc_id: (set size, component)}"""
    rows = sorted(rows)
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    pairs = []
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                pairs.append((j, i))
    root = union_find(len(rows), pairs)
    return {d: (len(s), rows[r][0]) for (d, _), s, r in zip(rows, sets, root)}


def repeated_bytes(rows, span=100):
    """{doc_id: (bytes, removed, spans, sha256 of the rest)}"""
    first, out = {}, {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        for i in range(len(b) - span + 1):
            first.setdefault(b[i : i + span], (d, i))
    for d, t in rows:
        b = (t or "").encode()
        m = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if first[b[i : i + span]] != (d, i):
                m[i : i + span] = b"\1" * span
        spans = sum(1 for i in range(len(m)) if m[i] and (i == 0 or not m[i - 1]))
        out[d] = (len(b), sum(m), spans, hashlib.sha256(bytes(c for c, x in zip(b, m) if not x)).hexdigest())
    return out


def removed_lines(rows, least=0.8, k=10):
    """{(doc_id, line)} that an exact fuzzy deduplication removes"""
    places = {}
    for d, t in rows:
        for i, x in enumerate((t or "").split("\n") if t is not None else []):
            if x.strip(" \t\r"):
                places.setdefault(x.strip(" \t\r"), []).append((d, i))
    names = list(places)
    sets = [{x[j : j + k] for j in range(len(x) - k + 1)} if len(x) >= k else {x} for x in names]
    pairs = [(b, a) for a in range(len(names)) for b in range(a) if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    groups = {}
    for n, r in zip(names, union_find(len(names), pairs)):
        groups.setdefault(r, []).extend(places[n])
    return {p for g in groups.values() for p in g if p != min(g)}
