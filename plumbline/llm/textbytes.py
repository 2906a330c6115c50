"""Vectorised byte work on Arrow string columns: no Python string is made for a word, line or window.

Texts are taken as their UTF-8 bytes. What tells texts apart is hashed without linear structure: ranges of bytes eight at a time, each eight through a bit mixer (``range_digests``; ranges of over ``LONG`` bytes
by BLAKE2b), windows of one length likewise (``gram_digests``), and sequences of hashes by a polynomial modulo the prime 2**61 - 1 (``Sums``). The polynomial modulo 2**64 (``prefix_sums``, ``range_hash``), under which
strings in Thue-Morse order collide whatever the base, is for buckets only, where a collision changes no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher of 64 bits (xor-shift-multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    up, down = np.full(size, BASE), np.full(size, inverse)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(1 << max(12, int(n).bit_length()))
    return up[: n + 1], down[: n + 1]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """H with H[e] - H[s] the polynomial of values[s:e], still scaled by the s-th power."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums) - 1)
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


#: Bytes up to which a range is hashed eight bytes at a time.
LONG = 64
_HEADS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_TIMES = mix(np.arange(1, 65, dtype=np.uint64) * BASE) | np.uint64(1)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number; zeros after the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, np.dtype("<u8"), padded, 0, (1,))


def range_digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit digests of byte ranges."""
    size = end - start
    out = mix(size.astype(np.uint64) * BASE + np.uint64(1))
    view = eights(data)
    left = np.flatnonzero((size > 0) & (size <= LONG))
    at, rest = start[left], size[left]
    while len(left):
        out[left] = mix(out[left] ^ mix((view[at] & _HEADS[np.minimum(rest, 8)]) + BASE))
        on = rest > 8
        left, at, rest = left[on], at[on] + 8, rest[on] - 8
    long = np.flatnonzero(size > LONG)
    if len(long):
        raw = memoryview(np.ascontiguousarray(data))
        out[long] = np.frombuffer(b"".join(hashlib.blake2b(raw[s:e], digest_size=8).digest() for s, e in zip(start[long].tolist(), end[long].tolist(), strict=True)), "<u8")
    return out


def mixed_eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, mixed: what windows of several lengths share."""
    return mix(eights(data) + BASE)


def gram_digests(data: np.ndarray, gram: int, whole: np.ndarray | None = None) -> np.ndarray:
    """64-bit digests of all windows of ``gram`` bytes. ``whole``: ``mixed_eights`` of the data, if it is there already."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, gram, np.uint64) * BASE
    if gram < 8:
        return mix(out + mix((eights(data)[:n] & _HEADS[gram]) + BASE) * _TIMES[0])
    whole = mixed_eights(data) if whole is None else whole
    # eights side by side, and for what is left over one more that ends with the window
    for k, at in enumerate([*range(0, gram - 7, 8), *([gram - 8] if gram % 8 else [])]):
        out += whole[at : at + n] * _TIMES[k]
    return mix(out)


#: A prime, and the base of polynomials modulo it.
PRIME = np.uint64((1 << 61) - 1)
BASE61 = 0x123456789ABCDE7 % int(PRIME)
_30, _31 = np.uint64((1 << 30) - 1), np.uint64((1 << 31) - 1)


def _reduced(x: np.ndarray) -> np.ndarray:
    """Modulo the prime, below 2**61."""
    x = (x & PRIME) + (x >> np.uint64(61))
    return np.where(x >= PRIME, x - PRIME, x)


def times61(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product modulo the prime, of numbers below it: in halves of 31 bits."""
    a1, a0, b1, b0 = a >> np.uint64(31), a & _31, b >> np.uint64(31), b & _31
    middle = a1 * b0 + a0 * b1
    return _reduced((a1 * b1 << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & _30) << np.uint64(31)) + a0 * b0)


@lru_cache(maxsize=2)
def _powers61(bits: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE61, pow(BASE61, -1, int(PRIME))):
        p = np.ones(1, np.uint64)
        for k in range(bits):
            p = np.concatenate([p, times61(p, np.full(len(p), pow(base, 1 << k, int(PRIME)), np.uint64))])
        out.append(p)
    return out[0], out[1]


class Sums:
    """Prefix sums of the polynomial of a sequence of 64-bit hashes modulo the prime: the hash of any range is a difference and a product."""

    def __init__(self, values: np.ndarray):
        self.up, self.down = _powers61(max(12, int(len(values)).bit_length()))
        terms = times61(_reduced(values), self.up[: len(values)])
        self.at = np.zeros(len(values) + 1, np.uint64)
        low, high = np.cumsum(terms & _31), _reduced(np.cumsum(terms >> np.uint64(31)))  # halves, so that no sum overflows
        self.at[1:] = _reduced(_reduced(low) + times61(high, np.full(1, 1 << 31, np.uint64)))

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The range as a part of the whole polynomial, not shifted to its start."""
        return _reduced(self.at[end] + PRIME - self.at[start])

    def shifted(self, x: np.ndarray, places: np.ndarray) -> np.ndarray:
        return times61(x, self.down[places])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.shifted(self.raw(start, end), start) + (end - start).astype(np.uint64) * BASE)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0): runs of whole texts of about ``most`` bytes."""
    data, at = buffers(column)
    row, rows = 0, len(at) - 1
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        stop = min(stop, rows)
        yield row, stop, data[at[row] : at[stop]], at[row : stop + 1] - at[row]
        row = stop
    pa.default_memory_pool().release_unused()  # workers live on: what a batch needed goes back


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each maximal run without ASCII white space; no run crosses texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edges = at[:-1][at[:-1] < at[1:]]
    first[edges] = solid[edges]
    ends = at[1:][at[:-1] < at[1:]] - 1
    last[ends] = solid[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    return range_digests(LOWER[data] if lower else data, start, end)


def shingles(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` lower-cased words and the text number of each; a text of fewer words,
    but at least one, gives its whole sequence as one."""
    start, end, text = word_bounds(data, at)
    words = word_hashes(data, start, end)
    counts = np.bincount(text, minlength=len(at) - 1)
    seeds = mix(np.arange(1, width + 1, dtype=np.uint64) * BASE)
    if len(words) >= width:
        whole = text[: len(words) - width + 1] == text[width - 1 :]
        h = np.zeros(len(whole), np.uint64)
        for k in range(width):
            h += words[k : k + len(whole)] * (seeds[k] | np.uint64(1))
            if k + 1 < width:
                h ^= h >> np.uint64(29)
        h, own = mix(h[whole]), text[: len(whole)][whole]
    else:
        h, own = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    few = np.flatnonzero((counts > 0) & (counts < width))
    if len(few):
        firsts = np.concatenate([[0], np.cumsum(counts)])[few]
        short = np.array([mix(np.array([np.sum(words[f : f + counts[t]] * seeds[: counts[t]], dtype=np.uint64) + np.uint64(counts[t])]))[0] for f, t in zip(firsts, few, strict=True)], np.uint64)
        h, own = np.concatenate([h, short]), np.concatenate([own, few])
        order = np.argsort(own, kind="stable")
        h, own = h[order], own[order]
    return h, own


def distinct_per_text(h: np.ndarray, own: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, joined, and their offsets."""
    edges = np.searchsorted(own, np.arange(texts + 1))
    sets = [np.unique(h[edges[i] : edges[i + 1]]) for i in range(texts)]
    at = np.zeros(texts + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=at[1:])
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), at


def take_rows(batch: pa.RecordBatch, name: str, start: int, stop: int) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name)).slice(start, stop - start)
