"""Words and word hashes of many texts at once, as numpy arrays.

A word is a maximal run of bytes other than space and 0x09-0x0D (UTF-8 never
uses these inside a character), so words equal the pattern
``[^\\x20\\x09-\\x0D]+`` over code points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
M1, M2, M3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the n + 1 offsets (null: empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary()).fill_null(b"")
    off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * M2
    x = (x ^ (x >> U(27))) * M3
    return x ^ (x >> U(31))


def spans(sep: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs outside ``sep`` (a run never crosses a
    text's end), and per text the index of its first run (n + 1 entries)."""
    n = len(sep)
    inside = ~sep
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    first = inside.copy()
    first[1:] &= sep[:-1] | cut[1:n]
    last = inside.copy()
    last[:-1] &= sep[1:] | cut[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hash of each byte span, eight bytes a step."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded[:8].view(U), (len(buf) + 1,), (1,))
    left = (ends - starts).astype(np.int64)
    h = mix(left.astype(U) * M1 + U(seed))
    at, idx = starts.copy(), None
    while True:
        take = np.minimum(left, 8)
        v = eight[at] & (~U(0) >> ((8 - take) * 8).astype(U))
        if idx is None:
            h = mix((h ^ v) * M1 + M2)
        else:
            h[idx] = mix((h[idx] ^ v) * M1 + M2)
        more = np.flatnonzero(left > 8)
        if not len(more):
            return h
        idx = more if idx is None else idx[more]
        at, left = at[more] + 8, left[more] - 8


def join_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the sequence a then b, from the hashes of both."""
    return mix(a * M1 + (b ^ M3))


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive entries of ``h`` (by start);
    the caller drops runs that cross a text's end."""
    if len(h) < width:
        return np.zeros(0, U)
    out, done, part, size = None, 0, h, 1
    left = width
    while left:
        if left & 1:
            out = part if out is None else join_hash(out[: len(h) - done - size + 1], part[done:][: len(h) - done - size + 1])
            done += size
        left >>= 1
        if left:
            part = join_hash(part[:-size], part[size:])
            size *= 2
    return out[: len(h) - width + 1]


def window_starts(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of texts with words first[i]..first[i+1]: all window starts, and the
    number of windows of each text."""
    n = np.maximum(np.diff(first) - width + 1, 0)
    return ranges(first[:-1], n), n


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (n[0] of them), start[1], ..."""
    total = int(n.sum())
    if not total:
        return np.zeros(0, np.int64)
    skip = np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    return skip + np.arange(total)
