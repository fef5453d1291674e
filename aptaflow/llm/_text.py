"""Words and shingles of many texts as 64-bit hashes, computed on whole Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Bytes of text hashed at once; a longer word is hashed whole.
WINDOW = 1 << 20
#: Bytes of texts whose words are held at once; a longer text is held whole.
PORTION = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def _tables() -> tuple[np.ndarray, np.ndarray]:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    values[65:91] = values[97:123]  # A-Z as a-z
    space = np.zeros(256, bool)
    space[list(SPACES)] = True
    return values, space


_VALUES, _SPACE = _tables()
_BASE = np.uint64(0x9E3779B97F4A7C17)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n."""
    size = max(WINDOW + 1, 1 << (n - 1).bit_length())
    if size > WINDOW + 1:
        return _make_powers(size)
    if size not in _POWERS:
        _POWERS[size] = _make_powers(size)
    return _POWERS[size]


def _make_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for x in (_BASE, _BACK):
        p = np.full(n, x, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _hash_window(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the words in data; a word also begins at each of breaks."""
    space = _SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    ends = ~space
    ends[:-1] &= space[1:]
    at = breaks[(breaks > 0) & (breaks < len(data))]
    begins[at] |= ~space[at]
    ends[at - 1] |= ~space[at - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[: len(data)], out=total[1:])
    return starts, mix((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(np.uint64))


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, first word of each text and the end) of the texts; null texts have no words.

    Words are runs of other characters than space, tab, line feed, vertical tab, form feed and carriage return; A-Z count as
    a-z.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    if texts.offset:
        texts = pa.concat_arrays([texts])
    n = len(texts)
    if not n or texts.buffers()[2] is None:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)
    first, last = int(offsets[0]), int(offsets[-1])
    starts, hashes = [], []
    while first < last:
        stop = min(last, first + WINDOW)
        while stop < last:  # cut at a space or between texts
            gaps = np.flatnonzero(_SPACE[data[first:stop]])
            edge = offsets[np.searchsorted(offsets, stop, "right") - 1]
            cut = max(first + int(gaps[-1]) + 1 if len(gaps) else first, int(edge))
            if cut > first:
                stop = cut
                break
            stop = min(last, stop + WINDOW)
        inside = offsets[np.searchsorted(offsets, first) : np.searchsorted(offsets, stop, "right")]
        s, h = _hash_window(data[first:stop], np.unique(inside - first))
        starts.append(s + first)
        hashes.append(h)
        first = stop
    starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.searchsorted(starts, offsets).astype(np.int64)


def portions(texts: pa.Array, most: int | None = None) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts of PORTION bytes at most, or of one text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + (most or PORTION), "right")))
        yield start, stop
        start = stop


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each word on; the last k - 1 are left out."""
    out = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
    for j in range(k):
        out = mix(out + hashes[j : j + len(out)] + np.uint64(j))
    return out


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text its distinct k-word shingles, sorted; a text of fewer words is one shingle, one without words none."""
    for start, stop in portions(texts):
        h, first = words(texts.slice(start, stop - start))
        every = shingles(h, k)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(every[a : b - k + 1])
            elif b > a:
                yield shingles(h[a:b], b - a) ^ np.uint64(b - a)
            else:
                yield np.zeros(0, np.uint64)
