"""Word shingles of whole texts, hashed in numpy for many texts at once."""

from __future__ import annotations

import numpy as np

#: Bytes of text hashed at once; bounds the arrays whatever the batch holds.
CHUNK_BYTES = 1 << 20

_P = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(0, n - 1), _P, np.uint64), dtype=np.uint64)])


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of every word `[^\\x20\\x09-\\x0D]+` of ``data``."""
    buf = np.frombuffer(data, np.uint8)
    inside = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    before = np.concatenate([[False], inside[:-1]])
    first = np.flatnonzero(inside & ~before)
    if not len(first):
        return np.zeros(0, np.uint64), first
    chars = np.flatnonzero(inside)
    at = np.searchsorted(chars, first)
    length = np.diff(np.append(at, len(chars)))
    place = np.arange(len(chars)) - np.repeat(at, length)
    value = (buf[chars].astype(np.uint64) + np.uint64(1)) * _powers(int(length.max()))[place]
    return mix(np.add.reduceat(value, at) + length.astype(np.uint64)), first


def _sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    sizes = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(sizes)
    word, first = _words(b" ".join(texts) + b" ")
    cut = np.searchsorted(first, np.concatenate([[0], ends]))
    factor = mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    total = np.zeros(max(0, len(word) - n + 1), np.uint64)
    for k in range(n):
        total += word[k:len(word) - n + 1 + k] * factor[k]
    total = mix(total)
    out = []
    for a, z in zip(cut[:-1], cut[1:]):
        if z - a >= n:
            out.append(np.unique(total[a:z - n + 1]))
        elif z > a:  # fewer words: the whole sequence is one shingle
            short = word[a:z]
            out.append(mix((short * factor[:z - a]).sum(keepdims=True) + np.uint64(z - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts, n: int):
    """Yields the sorted distinct 64-bit shingle hashes of each text, letters
    A-Z lower-cased; a null or empty text has none."""
    held, size = [], 0
    for t in texts:
        data = t.encode("utf-8", "surrogatepass").lower() if isinstance(t, str) else b""
        if held and size + len(data) > CHUNK_BYTES:
            yield from _sets(held, n)
            held, size = [], 0
        held.append(data)
        size += len(data)
    if held:
        yield from _sets(held, n)
