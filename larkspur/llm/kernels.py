"""Numpy kernels over Arrow text: words, hashes and window sums of whole batches at once.

A text column is handled as one run of UTF-8 bytes with offsets, so that the work per row is vectorised.
All hashes are fixed functions (no per-process seeds): any executor gives the same value.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240613))
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
P1, P2 = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
Q1, Q2 = U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
#: Words are runs of bytes other than these: space, tab, line feed, vertical tab, form feed, carriage return.
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    key = int(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[key] = have
    return have[:n]


def inverse(base: np.uint64) -> np.uint64:
    return U(pow(int(base), -1, 2**64))


P1I, P2I = inverse(P1), inverse(P2)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64 bits that spreads each input bit over the output."""
    x = x + U((seed * 0x9E3779B97F4A7C15 + 0x7F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def column(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (rows + 1) of a text or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    big = pa.large_binary()
    arr = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    arr = arr.cast(big) if not pa.types.is_large_binary(arr.type) else arr
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[off[0] : off[-1]] if len(off) else data, off - off[0] if len(off) else np.zeros(1, np.int64)


def slices(off: np.ndarray, limit: int = 1 << 20):
    """Row ranges of at most `limit` bytes, or of one row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j
        i = j


def words(data: np.ndarray, off: np.ndarray, table: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and the index of each row's first word (rows + 1)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    w = table[data]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, ~w[:-1]
    starts = np.flatnonzero(w & (before | cut[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, ~w[1:]
    ends = np.flatnonzero(w & (after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def prefix_sums(data: np.ndarray, base: np.uint64) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * powers(base, len(data)), out=out[1:])
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = P1) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    inv = P1I if base == P1 else P2I if base == P2 else inverse(base)
    sums = prefix_sums(data, base)
    return mix((sums[ends] - sums[starts]) * powers(inv, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(h: np.ndarray, k: int, base: np.uint64 = Q1) -> np.ndarray:
    """For each i the hash of h[i:i+k]; k - 1 values fewer than h."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, size, part, scale = np.zeros(n, np.uint64), 0, 1, h, base
    mult = 1
    while True:
        if k & size:
            out = out * U(pow(int(base), size, 2**64)) + part[done : done + n]
            done += size
        if size * 2 > k:
            break
        part = part[:-size] * U(pow(int(base), size, 2**64)) + part[size:]
        size *= 2
    return mix(out, k)


def row_of(first: np.ndarray, n: int) -> np.ndarray:
    """The row of each of n items, given the index of each row's first item (rows + 1)."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first)) if n else np.zeros(0, np.int64)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[0], starts[0]+1, ... of all spans, one after another."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(at - starts, lengths)


def pack(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def sha256_hex(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()
