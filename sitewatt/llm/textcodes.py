"""Vectorised text codes for Arrow batches: bytes, words, rolling hashes, window minimisers.

Everything works on one *chunk*: the texts of a few rows laid end to end as one
``uint8`` array with row offsets. Chunks are cut by bytes, so memory does not
depend on how many rows a batch holds; one very long text is one chunk.

Hashes are polynomial prefix hashes modulo 2**64 over randomised byte codes:
``P[i]`` covers the first ``i`` symbols, so the hash of any range costs one
subtraction and one multiplication with the inverse power of its start.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

LONG = 64
CHUNK_BYTES = 1 << 15  # keeps the arrays of a chunk in the processor cache
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_table(n: int, which: int) -> np.ndarray:
    """base**i (which 0) or base**-i (which 1) for i < n, grown by doubling."""
    t = _powers[which]
    base = (_BASE, _INVERSE)[which]
    while len(t) < n:
        step = np.uint64(pow(base, len(t), 1 << 64))
        t = np.concatenate([t, t * step])
    _powers[which] = t
    return t[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the output (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES):
    """Cut a string column into ``(first row, data, offsets)``; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    if n == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        own = offsets[first:last + 1]
        yield first, data[own[0]:own[-1]], own - own[0]
        first = last


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """P with P[0] = 0 and P[i+1] = P[i] + codes[i] * base**i."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * _power_table(len(codes), 0), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of the ranges [start, end); ranges of other lengths differ too."""
    inverse = _power_table(len(prefix), 1)
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


def byte_codes(data: np.ndarray) -> np.ndarray:
    return _CODES[data]


def words(data: np.ndarray, offsets: np.ndarray):
    """Words (runs of non-spaces, never across rows): starts, ends, words before each row."""
    gap = SPACES[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.ones(len(data), bool)
    before[1:] = gap[:-1]
    starts = np.flatnonzero(~gap & (before | edge[:-1]))
    after = np.ones(len(data), bool)
    after[:-1] = gap[1:]
    ends = np.flatnonzero(~gap & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges of any length.

    A polynomial modulo a power of two can be forced to collide by strings of some
    hundred characters whatever its base, so ranges beyond LONG take a keyed digest.
    """
    out = range_hash(prefix_hash(byte_codes(data)), starts, ends)
    far = np.flatnonzero(ends - starts > LONG)
    if len(far):
        raw = data.tobytes()
        digest = [hashlib.blake2b(raw[s:e], digest_size=8, key=b"long").digest() for s, e in zip(starts[far].tolist(), ends[far].tolist())]
        out[far] = np.frombuffer(b"".join(digest), "<u8")
    return out


def lower_ascii(data: np.ndarray) -> np.ndarray:
    upper = (data >= 65) & (data <= 90)
    return data + (upper * np.uint8(32)).astype(np.uint8)


def gram_hashes(prefix: np.ndarray, k: int) -> np.ndarray:
    """Mixed hashes of all ranges [i, i + k)."""
    return mix((prefix[k:] - prefix[:-k]) * _power_table(len(prefix), 1)[:len(prefix) - k] + np.uint64(k))


def minimisers(grams: np.ndarray, count: int) -> np.ndarray:
    """For each i the position of the leftmost least of grams[i:i + count]."""
    low = grams & np.uint64(0xFFFFFFFF80000000)  # 33 bits of hash, then the position
    low |= np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span * 2 <= count:  # least of each run of `span`, by doubling
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if count > span:
        low = np.minimum(low[:len(low) - (count - span)], low[count - span:])
    return (low & np.uint64(0x7FFFFFFF)).astype(np.int64)


def units(prefix: np.ndarray, offsets: np.ndarray, window: int, k: int):
    """All windows of ``window`` symbols inside rows, grouped by their minimiser.

    A window's minimiser is its leftmost ``k``-symbol string of least hash: it
    depends on the window alone, so equal windows have equal minimisers wherever
    they stand. Consecutive windows with the same minimiser position form a unit.
    Returns row, start of the first window, number of windows, distance from there
    to the minimiser, hash of the minimiser and hash of the unit's symbols
    [start, start + windows - 1 + window).
    """
    n = len(prefix) - 1
    if n < window:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    grams = gram_hashes(prefix, k)
    where = minimisers(grams, window - k + 1)
    lengths = np.diff(offsets)
    ok = lengths >= window
    first, past = offsets[:-1][ok], offsets[1:][ok] - window + 1  # windows of each row
    new = np.empty(len(where), bool)
    new[:1] = True
    np.not_equal(where[1:], where[:-1], out=new[1:])
    new[first] = True
    new[past[past < len(new)]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(where))
    rows = np.searchsorted(offsets, starts, "right") - 1
    inside = starts + window <= offsets[rows + 1]
    starts, ends, rows = starts[inside], ends[inside], rows[inside]
    return (rows, starts - offsets[rows], ends - starts, where[starts] - starts, grams[where[starts]],
            range_hash(prefix, starts, ends - 1 + window))


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))
