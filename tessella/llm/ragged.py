"""Vectorised text primitives over Arrow string buffers.

A batch of texts is one byte array plus document offsets; words, hashes and shingles are
numpy arrays over it, so no Python object is made per word. Hashing goes in blocks of BLOCK
bytes, or of one span if it is longer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20

U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (murmur3)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


_SHINGLE_BASE = U64(0x9FB21C651E98DF25)
#: key of the span hash
_KEY = U64(0x2545F4914F6CDD1D)
_STEP = U64(0x9E3779B97F4A7C15)
#: which bytes of an eight-byte load belong to a span of so many bytes
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def separators(spec: bytes | range | list[int]) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(spec)] = True
    return t


#: ASCII white space, the complement of the word pattern [^\x20\x09-\x0D]+
SPACES = separators(b" \t\n\x0b\x0c\r")
#: all ASCII but digits and lower-case letters (texts are lower-cased first)
NOT_ALNUM = separators([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and document offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    d = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def spans(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words per document) of maximal runs of bytes outside sep."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets) - 1, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    word = ~sep[data]
    before = np.empty(n, bool)
    before[0] = True
    np.logical_not(word[:-1], out=before[1:])
    starts = np.flatnonzero(word & (before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = True
    np.logical_not(word[1:], out=after[:-1])
    ends = np.flatnonzero(word & (after | edge[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes, independent of where the span stands.

    The sum, over a span's eight-byte pieces, of the piece mixed with a key of its place. No polynomial: strings with
    a regular structure don't collide but by chance.
    """
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        stop = int(ends[i:j].max())
        padded = np.zeros(stop - base + 8, np.uint8)
        padded[:-8] = data[base:stop]
        loads = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        s = starts[i:j] - base
        size = ends[i:j] - starts[i:j]
        h = mix64((loads[s] & _MASKS[np.minimum(size, 8)]) ^ _KEY)
        long = np.flatnonzero(size > 8)
        if len(long):
            pieces = (size[long] + 7) // 8 - 1
            last = np.cumsum(pieces)
            first = last - pieces
            place = np.arange(1, last[-1] + 1) - np.repeat(first, pieces)
            left = np.repeat(size[long], pieces) - 8 * place
            piece = loads[np.repeat(s[long], pieces) + 8 * place] & _MASKS[np.minimum(left, 8)]
            key = mix64(place.astype(U64) * _STEP + _KEY)
            h[long] += np.add.reduceat(mix64((piece ^ key) * (key | U64(1))), first)
        out[i:j] = mix64(h + size.astype(U64) * _STEP)
        i = j
    return out


def prefix_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """hashes() of the spans, and of their first n bytes for each n of lengths (of the whole span if it is shorter)."""
    return [hashes(data, starts, cut) for cut in (ends, *(np.minimum(starts + n, ends) for n in lengths))]


def windows(h: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k consecutive word hashes from each position on, and whether all k are of one document."""
    n = len(h)
    out = np.zeros(n, U64)
    for j in range(min(k, n)):
        out[: n - j] = out[: n - j] * _SHINGLE_BASE + h[j:]
    left = np.repeat(np.cumsum(counts), counts) - np.arange(n)
    return mix64(out), left >= k


def shingle_sets(h: np.ndarray, counts: np.ndarray, k: int) -> list[np.ndarray]:
    """Per document the sorted distinct k-word shingles; fewer than k words count as one shingle, none as no shingle."""
    g, whole = windows(h, counts, k)
    ends = np.cumsum(counts)
    sets = []
    for e, c in zip(ends.tolist(), counts.tolist()):
        b = e - c
        if c >= k:
            s = np.sort(g[b : e - k + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            sets.append(s[keep])
        elif c:
            x = U64(c)
            for w in h[b:e]:
                x = _short(x, w)
            sets.append(mix64(np.array([x], U64)))
        else:
            sets.append(np.zeros(0, U64))
    return sets


def _short(x: np.uint64, w: np.uint64) -> np.uint64:
    return U64((int(x) * int(_SHINGLE_BASE) + int(w) + 1) & 0xFFFFFFFFFFFFFFFF)
