"""Vectorised text kernels that run inside Spark tasks on one Arrow batch at a time.

Everything works on the UTF-8 bytes of a batch laid end to end, so that no Python code runs per word or
per character. Sums and products of uint64 wrap, which makes them arithmetic modulo 2**64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: ASCII white space: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Start values and odd multipliers of the two independent hashes.
SEEDS = (U64(0x243F6A8885A308D3), U64(0x13198A2E03707344))
BASES = (U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93))
#: Words of more bytes are hashed one by one.
LONG_WORD = 64


def slices(batch: pa.RecordBatch, column: str, target_bytes: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about target_bytes of text (one row at least)."""
    if batch.num_rows == 0:
        return
    _, offsets = text_bytes(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offsets, offsets[first] + target_bytes, side="right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column and the offset of each (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def load8(raw: np.ndarray, n: int, at: int = 0, kind: str = "<u8") -> np.ndarray:
    """The 8 bytes from each of n places on as an integer; raw must reach 7 bytes beyond the last."""
    return np.ndarray((n,), kind, raw.data, at, (1,))


def padded(raw: np.ndarray) -> np.ndarray:
    """The bytes with eight zeros behind them, so that eight can be read from any place."""
    return np.concatenate([raw, np.zeros(8, np.uint8)])


#: Keep the first 0 to 8 bytes of a little-endian integer.
FIRST_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def word_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of raw[start:end] for each range, whatever its place.

    Eight bytes at a time pass through a mixer that is not linear, so that no pattern of letters cancels out. Words of
    eight bytes or fewer differ in their hash if they have one length.
    """
    n = ends - starts
    data = padded(raw)
    eight = load8(data, len(data) - 7)
    seed = mix(n.astype(np.uint64) ^ SEEDS[which])
    h = mix((eight[starts] & FIRST_BYTES[np.minimum(n, 8)]) ^ seed)
    more = np.flatnonzero(n > 8)
    long = more[n[more] > LONG_WORD]
    at = 8
    while len(more := more[(n[more] > at) & (n[more] <= LONG_WORD)]):
        left = np.minimum(n[more] - at, 8)
        h[more] = mix((h[more] * BASES[which]) ^ (eight[starts[more] + at] & FIRST_BYTES[left]))
        at += 8
    for i in long.tolist():
        digest = hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=16).digest()
        h[i] = int.from_bytes(digest[8 * which : 8 * which + 8], "little")
    return h


def same_bytes(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether a[at:at + n] and b[bt:bt + n] are equal, for each place."""
    a, b = padded(a), padded(b)
    x, y = load8(a, len(a) - 7), load8(b, len(b) - 7)
    same = np.ones(len(n), bool)
    live, done = np.flatnonzero(n > 0), 0
    while len(live := live[(n[live] > done) & (n[live] <= LONG_WORD) & same[live]]):
        keep = FIRST_BYTES[np.minimum(n[live] - done, 8)]
        same[live] = ((x[at[live] + done] ^ y[bt[live] + done]) & keep) == 0
        done += 8
    for i in np.flatnonzero(n > LONG_WORD).tolist():
        same[i] = np.array_equal(a[at[i] : at[i] + n[i]], b[bt[i] : bt[i] + n[i]])
    return same


def joined_hash(left: np.ndarray, right: np.ndarray, which: int) -> np.ndarray:
    return mix((left * BASES[which]) ^ (right + SEEDS[which]))


def window_hash(values: np.ndarray, at: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of values[i:i + size] for each i of `at`: hashes of 1, 2, 4, ... values joined in pairs."""
    if len(at) == 0:
        return np.zeros(0, np.uint64)
    power, width, out, done = values, 1, None, 0
    while True:
        if size & width:
            part = power[at + done] if out is not None or size != width else power[at]
            out = part if out is None else joined_hash(out, part, which)
            done += width
        if 2 * width > size:
            break
        power, width = joined_hash(power[: len(power) - width], power[width:], which), 2 * width
    return mix(out ^ U64(size))


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every white-space delimited word, and the number of words before each text."""
    n = len(raw)
    if n == 0:
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(offsets), np.int64)
    inside = ~SPACE[raw]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    closes = np.zeros(n + 1, bool)
    closes[1:n] = inside[:-1] & ~inside[1:]
    closes[n] = inside[-1]
    cut = offsets[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < n)])
    both = cut[inside[cut] & inside[cut - 1]]  # a word ends a text and another begins the next
    opens[both] = True
    closes[both] = True
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes), np.searchsorted(starts, offsets)


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 0x41) & (raw <= 0x5A), raw | 0x20, raw)


def windows(first: np.ndarray, size: int) -> np.ndarray:
    """Index of the first word of every window of `size` words that lies inside one text."""
    n = int(first[-1])
    if n < size:
        return np.zeros(0, np.int64)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)  # words from here to the end of the text
    return np.flatnonzero(left >= size)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(before, lengths) + np.repeat(starts, lengths)


def covered(starts: np.ndarray, lengths: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n places are covered by the given ranges."""
    edge = np.zeros(n + 1, np.int32)
    edge += np.bincount(starts, minlength=n + 1)[: n + 1].astype(np.int32)
    edge -= np.bincount(np.minimum(starts + lengths, n), minlength=n + 1)[: n + 1].astype(np.int32)
    return np.cumsum(edge)[:n] > 0
