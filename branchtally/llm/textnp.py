"""Words of texts as 64-bit hashes, in numpy, for work inside Arrow batches.

A word's hash is a polynomial over its bytes, read off one running sum over the buffer, then
mixed with its length. Buffers are cut at separators, so temporary arrays stay small whatever
the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of a slice; a longer single word makes a longer slice.
SLICE = 1 << 18
#: Bytes of texts that are hashed together.
GROUP = 1 << 21

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0x1000000000000B3)

#: Bytes that belong to words: all but white space; or lower-cased ASCII letters, digits and non-ASCII.
NOT_SPACE = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
ALNUM = np.array([b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 for b in range(256)])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, SLICE + 1)
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps))
        return cls.up, cls.down


def hash_words(data: bytes, keep: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(start of each word, its hash, hashes of its first ``p`` bytes for each of ``prefixes``)."""
    buffer = np.frombuffer(data, np.uint8)
    starts, hashes, heads = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [[np.zeros(0, np.uint64)] for _ in prefixes]
    low = 0
    while low < len(buffer):
        high = _cut(buffer, keep, low)
        x = buffer[low:high]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], keep[x], [False])).view(np.int8)))
        if len(edges):
            begin, end = edges[0::2], edges[1::2]
            up, down = _Powers.upto(len(x) + 1)
            sums = np.zeros(len(x) + 1, np.uint64)
            np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[: len(x)], out=sums[1:])
            at, back = sums[begin], down[begin]
            starts.append(begin + low)
            hashes.append(mix((sums[end] - at) * back + (end - begin).astype(np.uint64) * _STEP))
            for p, out in zip(prefixes, heads, strict=True):
                stop = np.minimum(begin + p, end)
                out.append(mix((sums[stop] - at) * back + np.uint64(p) * _STEP))
        low = high
    return np.concatenate(starts), np.concatenate(hashes), [np.concatenate(h) for h in heads]


def _cut(buffer: np.ndarray, keep: np.ndarray, low: int) -> int:
    """The end of a slice that begins at ``low``: after a separator, or the end of the buffer."""
    high = low + SLICE
    if high >= len(buffer):
        return len(buffer)
    back = np.flatnonzero(~keep[buffer[low:high]])
    if len(back):
        return low + int(back[-1]) + 1
    while high < len(buffer) and keep[buffer[high]]:
        high += 1
    return high


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` neighbouring words, in order."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for i in range(1, k):
        h = h * _BASE + words[i : i + n]
    return mix(h)


def whole(words: np.ndarray) -> np.ndarray:
    """A hash of the whole sequence as one."""
    return shingles(words, len(words)) + np.uint64(len(words)) if len(words) else words


def grouped(texts: pa.Array, lower: bool = True) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(first row, end row, joined bytes, start of each text) of groups of whole texts."""
    part: list[bytes] = []
    first, size = 0, 0
    for i, text in enumerate(texts.cast(pa.binary()) if pa.types.is_string(texts.type) else texts.cast(pa.large_binary())):
        raw = text.as_py() or b""
        if part and size + len(raw) > GROUP:
            yield first, i, *_joined(part, lower)
            part, first, size = [], i, 0
        part.append(raw)
        size += len(raw) + 1
    if part:
        yield first, first + len(part), *_joined(part, lower)


def _joined(part: list[bytes], lower: bool) -> tuple[bytes, np.ndarray]:
    data = b"\n".join(part)
    starts = np.cumsum([0, *(len(raw) + 1 for raw in part[:-1])])
    return data.lower() if lower else data, starts


def words_by_text(texts: pa.Array, keep: np.ndarray) -> Iterator[np.ndarray]:
    """The word hashes of each text, in order."""
    for first, end, data, starts in grouped(texts):
        at, hashes, _ = hash_words(data, keep)
        cuts = np.searchsorted(at, starts[1:])
        yield from np.split(hashes, cuts) if end - first > 1 else [hashes]


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))
