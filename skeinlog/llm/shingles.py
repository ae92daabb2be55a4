"""Word shingles of whole texts as 64-bit hashes, without a Python step per word.

Words are runs of anything but ASCII white space; only A-Z are folded.  A word's hash is a polynomial over
its bytes modulo 2**64, taken for all words at once from running sums; a shingle's hash mixes the hashes
of its words.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE, _CHUNK = 0x9E3779B97F4A7C15 | 1, 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = np.asarray(x, _U)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, _U)
    out[1:] = _U(base)
    return np.multiply.accumulate(out)


_tables: dict = {}


def _made() -> dict:
    if not _tables:
        low = np.arange(256, dtype=np.uint8)
        low[65:91] += 32
        _tables["code"] = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))[low]
        space = np.zeros(256, bool)
        space[[32, *range(9, 14)]] = True
        _tables["space"] = space
        _tables["up"] = _powers(_BASE, _CHUNK)
        _tables["down"] = _powers(pow(_BASE, -1, 1 << 64), _CHUNK)
    return _tables


def _word_hashes(x: np.ndarray) -> np.ndarray:
    t = _made()
    if not len(x):
        return np.zeros(0, _U)
    gap = np.empty(len(x) + 2, bool)
    gap[0] = gap[-1] = True
    gap[1:-1] = t["space"][x]
    start = np.flatnonzero(~gap[1:-1] & gap[:-2])
    if not len(start):
        return np.zeros(0, _U)
    stop = np.flatnonzero(~gap[1:-1] & gap[2:])
    if len(x) <= _CHUNK:
        sums = np.cumsum(t["code"][x] * t["up"][: len(x)], dtype=_U)
        before = np.where(start > 0, sums[start - 1], _U(0))
        return mix((sums[stop] - before) * t["down"][start] + (stop - start).astype(_U))
    out = []  # a word longer than a chunk, with what stands around it
    for s, e in zip(start.tolist(), stop.tolist(), strict=True):
        h = 0
        for at in range(s, e + 1, _CHUNK):
            part = x[at : min(e + 1, at + _CHUNK)]
            h = (h * pow(_BASE, -_CHUNK, 1 << 64) + int(np.sum(t["code"][part] * t["up"][: len(part)], dtype=_U))) % (1 << 64)
        out.append(mix(np.array([(h + e - s) % (1 << 64)], _U))[0])
    return np.array(out, _U)


def word_hashes(text: str) -> np.ndarray:
    """Hashes of all words of a text, in order; long texts in pieces that end at white space."""
    x = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    if len(x) <= _CHUNK:
        return _word_hashes(x)
    blanks = np.flatnonzero(_made()["space"][x])
    parts, at = [], 0
    while at < len(x):
        end = len(x)
        if end - at > _CHUNK:
            i = np.searchsorted(blanks, at + _CHUNK, "right") - 1
            if i < 0 or blanks[i] <= at:  # one word fills the chunk
                i = np.searchsorted(blanks, at + 1)
            end = int(blanks[i]) + 1 if i < len(blanks) else len(x)
        parts.append(_word_hashes(x[at:end]))
        at = end
    return np.concatenate(parts)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; shorter texts have one, of all their words."""
    w = word_hashes(text or "")
    n = len(w)
    if not n:
        return w
    with np.errstate(over="ignore"):
        if n < width:
            h = np.zeros(1, _U) + _U(n)
            for x in w:
                h = mix(h * _U(_BASE) + x)
            return h
        h = np.zeros(n - width + 1, _U) + _U(width)
        for k in range(width):
            h = mix(h * _U(_BASE) + w[k : n - width + 1 + k])
    return np.unique(h)
