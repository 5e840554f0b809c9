"""Vectorised word and shingle hashes over Arrow buffers (numpy inside tasks).

Words are runs of characters other than space and tab to carriage return, with
A-Z lower-cased. A word's 64-bit hash sums a random value per byte times a
power per place and is then mixed; a shingle's hash mixes those of its words.
Long batches are cut at a fixed number of bytes, long texts at white space, so
memory stays a small multiple of the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of the splitmix64 generator."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _stream(seed: int, n: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=_U) + _U(seed)) * _U(0x9E3779B97F4A7C15)) | _U(1)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = _stream(1, 256)
_BYTE[65:91] = _BYTE[97:123]
_FACTOR = _stream(1000, 64)
_POWER = np.ones(1, _U)


def _powers(n: int) -> np.ndarray:
    global _POWER
    if len(_POWER) < n:
        _POWER = np.cumprod(np.concatenate([np.ones(1, _U), np.full(2 * n, _U(0xD6E8FEB86659FD93))]))
    return _POWER


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words in a byte array."""
    solid = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(solid, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, _U), start
    size = end - start
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    h = np.add.reduceat(_BYTE[data[solid]] * _powers(int(size.max()))[place], first)
    return mix(h + size.astype(_U) * _U(0xA24BAED4963EE407)), start


def word_hashes(text: bytes) -> np.ndarray:
    """Word hashes of one text, cut at white space into pieces of about ``CHUNK`` bytes."""
    data, parts, at = np.frombuffer(text, np.uint8), [], 0
    while at < len(data):
        cut = at + CHUNK
        while cut < len(data):
            gap = np.flatnonzero(_SPACE[data[cut:cut + CHUNK]])
            cut += int(gap[0]) if len(gap) else CHUNK
            if len(gap):
                break
        parts.append(_words(data[at:cut])[0])
        at = cut
    return np.concatenate(parts) if parts else np.empty(0, _U)


def _shingles(words: np.ndarray, gram: int) -> np.ndarray:
    n = len(words) - gram + 1
    s = words[:n] * _FACTOR[0]
    for j in range(1, gram):
        s = s + words[j:n + j] * _FACTOR[j]
    return mix(s)


def _set_of(words: np.ndarray, gram: int) -> np.ndarray:
    if 0 < len(words) < gram:  # the whole short sequence is one shingle, apart from all others
        k = len(words)
        return mix((words * _FACTOR[:k]).sum(keepdims=True, dtype=_U) + _FACTOR[32 + k:33 + k])
    return np.unique(_shingles(words, gram)) if len(words) else words


def shingle_sets(texts: pa.Array, gram: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text (empty without words)."""
    texts = texts.cast(pa.binary())
    group: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        lengths = np.array([len(t) + 1 for t in group])
        begin = np.cumsum(lengths) - lengths
        h, start = _words(np.frombuffer(b"\n".join(group), np.uint8))
        count = np.bincount(np.searchsorted(begin, start, "right") - 1, minlength=len(group))
        off = np.cumsum(count) - count
        every = _shingles(h, gram) if len(h) >= gram else h
        for o, c in zip(off.tolist(), count.tolist()):
            yield np.unique(every[o:o + c - gram + 1]) if c >= gram else _set_of(h[o:o + c], gram)

    for value in texts:
        t = value.as_py() or b""
        if group and size + len(t) > CHUNK:
            yield from flush()
            group, size = [], 0
        if len(t) > CHUNK:
            yield _set_of(word_hashes(t), gram)
            continue
        group.append(t)
        size += len(t)
    if group:
        yield from flush()
