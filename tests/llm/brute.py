"""Plain versions of operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def decontamination(rows, items, size=8, items_from=2):
    """rows of (doc_id, text), items of (item_id, text)."""
    windows = defaultdict(set)
    for i, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add("null" if i is None else str(i))
    lengths = {len(k) for k in windows}
    out = []
    for doc_id, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if m := windows.get(tuple(w[k : k + n])):
                    found |= m
                    hit.update(range(k, k + n))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= items_from))
    return out


def removal(rows, length=400, words=None):
    """rows of (doc_id, text) to (doc_id, n_bytes, n_removed, n_spans, kept). Runs of up to so many words stay if they have fewer
    than 400 bytes."""
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[k : k + length] for b in raw for k in range(len(b) - length + 1))
    out = []
    for (doc_id, _), b in zip(rows, raw, strict=True):
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        for run in re.finditer(b"\1+", bytes(gone)) if words is not None else ():
            if len(run[0]) < 400 and len(b[run.start() : run.end()].split()) <= words:
                gone[run.start() : run.end()] = bytes(len(run[0]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((doc_id, len(b), len(b) - len(kept), len(re.findall(b"\1+", bytes(gone))), kept))
    return out


def shingles(text, size=5):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if x]
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def near_duplicates(rows):
    """rows of (doc_id, text), doc_ids unique, to {doc_id: (n_shingles, component_id)}."""
    rows = sorted(rows)
    sets = [shingles(t) for _, t in rows]
    parent, where = list(range(len(rows))), defaultdict(list)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in where[g]).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for g in s:
            where[g].append(i)
    return {rows[i][0]: (len(sets[i]), rows[find(i)][0]) for i in range(len(rows))}
