"""Word shingles of whole texts as 64-bit hashes, and their MinHash signatures; numpy over batches."""

from __future__ import annotations

import numpy as np

#: Bytes that are hashed in one step; a step ends between two words.
STEP = 1 << 19

_B = np.uint64(0x9E3779B97F4A7C15)
_SEED = np.random.default_rng(20240101)
_PLACE = _SEED.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that leaves no structure."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1024), _B)]), dtype=np.uint64)
    return _powers


def _word_hashes(data: np.ndarray, blank: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of the words that begin at starts; each ends before a blank, the next start or the end."""
    if not len(starts):
        return np.empty(0, np.uint64)
    size = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, size)
    values = (data[starts[0] :].astype(np.uint64) + np.uint64(1)) * powers(int(size.max()) + 1)[place]
    values[blank[starts[0] :]] = 0
    return mix(np.add.reduceat(values, starts - starts[0]))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words [^ \\t-\\r]+ of each text, A-Z lower-cased, and the offsets of the texts' words."""
    data = _LOWER[data]
    blank = _BLANK[data]
    first = np.ones(len(data), bool)
    first[1:] = blank[:-1]
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    first &= ~blank
    starts = np.flatnonzero(first)
    counts = np.searchsorted(starts, offsets)
    parts, k = [], 0
    while k < len(starts):
        e = max(k + 1, int(np.searchsorted(starts, starts[k] + STEP)))
        end = starts[e] if e < len(starts) else len(data)
        parts.append(_word_hashes(data[starts[k] : end], blank[starts[k] : end], starts[k:e] - starts[k]))
        k = e
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), counts


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of size words. Fewer words give one shingle of them all, none
    give none."""
    w, bounds = words(data, offsets)
    n = len(w) - size + 1
    every = np.zeros(max(n, 0), np.uint64)
    for i in range(size if n > 0 else 0):
        every += w[i : i + n] * _PLACE[i]
    every = mix(every)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            s = np.sort(every[a : b - size + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif b > a:
            out.append(mix((w[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + _PLACE[40 + b - a : 41 + b - a]))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], values: int, seed: int = 7) -> np.ndarray:
    """(sets, values) of 32-bit minimal hashes; all ones for an empty set."""
    rng = np.random.default_rng(seed)
    factor = rng.integers(1, 2**63, values, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    turn = rng.integers(0, 2**63, values, dtype=np.uint64)
    out = np.full((len(sets), values), 0xFFFFFFFF, np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(full):
        end, held = at, 0
        while end < len(full) and (end == at or held + len(sets[full[end]]) <= 1 << 16):
            held += len(sets[full[end]])
            end += 1
        rows = full[at:end]
        h = np.concatenate([sets[i] for i in rows])
        starts = np.cumsum([0, *(len(sets[i]) for i in rows[:-1])])
        for k in range(values):
            out[rows, k] = np.minimum.reduceat((h ^ turn[k]) * factor[k], starts) >> np.uint64(32)
        at = end
    return out
