"""Sets of word shingles as sorted 64-bit hashes, many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Words in a shingle.
WIDTH = 5
#: Bytes of text that are hashed together; a longer text goes in slabs of that size.
SLAB = 1 << 20

_U = np.uint64
_RNG = np.random.default_rng(20_240_611)
_BYTE = _RNG.integers(1, 2**63, 256).astype(_U) * _U(2) + _U(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_STEP = 0x9E3779B97F4A7C15
_PLACE = _RNG.integers(1, 2**63, 64).astype(_U) * _U(2) + _U(1)
_POWERS: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLAB + 1)
        up = np.full(size, _U(_STEP))
        down = np.full(size, _U(pow(_STEP, -1, 1 << 64)))
        up[0] = down[0] = _U(1)
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0][:n], _POWERS[1][:n]


def _words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and the place where it starts; texts begin at ``starts``."""
    if not len(data):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    gap = _GAP[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[starts] = True
    fresh[-1] = True
    first = ~gap
    first[1:] &= gap[:-1] | fresh[1:-1]
    last = ~gap
    last[:-1] &= gap[1:] | fresh[1:-1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * up[:-1], out=sums[1:])
    return mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(_U)), a


def _long_words(data: np.ndarray) -> np.ndarray:
    """Word hashes of one long text, slab by slab; slabs end before a gap."""
    out, at = [], 0
    while at < len(data):
        end = min(at + SLAB, len(data))
        if end < len(data):
            gaps = np.flatnonzero(_GAP[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # one word longer than a slab: up to its end
                step = SLAB
                while end < len(data) and not _GAP[data[end - 1]]:
                    more = np.flatnonzero(_GAP[data[end:end + step]])
                    end = end + int(more[0]) + 1 if len(more) else min(end + step, len(data))
        out.append(_words(data[at:end], np.zeros(1, np.int64))[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, _U)


def _set(words: np.ndarray, width: int) -> np.ndarray:
    n = len(words)
    if n == 0:
        return words
    k = min(n, width)
    total = np.full(n - k + 1, _U(k))
    for i in range(k):
        total += words[i:n - k + 1 + i] * _PLACE[i]
    return np.unique(mixed(total))


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles. A text of fewer words is
    one shingle; one without words, or missing, has none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(int(np.searchsorted(offsets, offsets[i] + SLAB, side="right")) - 1, i + 1)
        if j == i + 1 and offsets[j] - offsets[i] > SLAB:
            yield _set(_long_words(data[offsets[i]:offsets[j]]), width)
        else:
            base = offsets[i]
            words, at = _words(data[base:offsets[j]], offsets[i:j] - base)
            cuts = np.searchsorted(at, offsets[i:j + 1] - base)
            for a, b in zip(cuts[:-1], cuts[1:]):
                yield _set(words[a:b], width)
        i = j


def key_of(members: np.ndarray) -> int:
    """One number for a whole set, as a signed long."""
    with np.errstate(over="ignore"):
        total = mixed(members ^ _U(_STEP)).sum(dtype=_U) + _U(len(members))
    return int(mixed(np.array([total], _U)).view(np.int64)[0])
