"""Text as numpy arrays: words, hashes and runs of whole Arrow batches at once, without Python objects for each word."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Text is worked on in chunks of about so many bytes; one longer document is one chunk.
CHUNK_BYTES = 2 << 20


def _odd(seed: int) -> int:
    x = (seed * 0x9E3779B97F4A7C15 + 0xD1B54A32D192ED03) & (2**64 - 1)
    x ^= x >> 29
    x = (x * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    return (x ^ (x >> 32)) | 1


BASE = _odd(1)
BASE_INV = pow(BASE, -1, 2**64)
#: A random 64-bit value for each byte, so that the word hash is no plain polynomial of the bytes.
BYTE_VALUE = np.array([_odd(1000 + i) for i in range(256)], dtype=U64)
WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), base, dtype=U64)
        step[0] = 1
        have = _powers[base] = np.cumprod(step, dtype=U64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Gives memory that is free in this worker back, so that workers of earlier stages don't hold it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def chunks(batches, columns: int = 2, size: int = CHUNK_BYTES) -> Iterator[tuple]:
    """Of record batches whose last column is text: the leading columns' slices, bytes and offsets, about ``size`` bytes at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = text_buffers(batch.column(columns - 1))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
            end = min(end, batch.num_rows)
            lead = [batch.column(i).slice(at, end - at) for i in range(columns - 1)]
            yield (*lead, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
            at = end
    release()


def grouped(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each key that occurs, in order, with its places."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))) if len(keys) else np.zeros(1, np.int64)
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        yield int(keys[a]), order[a:b]


def ids_of(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).to_numpy(zero_copy_only=False).astype(np.int64)


def split_words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the index of its first word (one more entry at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separators[data]
    first = np.empty(n, bool)
    first[0], first[1:] = True, ~inside[:-1]
    last = np.empty(n, bool)
    last[-1], last[:-1] = True, ~inside[1:]
    edges = offsets[1:-1]
    first[edges[edges < n]] = True
    last[edges[edges > 0] - 1] = True
    starts, ends = np.flatnonzero(inside & first), np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from running sums modulo 2**64."""
    n = len(data)
    sums = np.zeros(n + 1, U64)
    np.cumsum(BYTE_VALUE[data] * powers(BASE, n), out=sums[1:], dtype=U64)
    return mix((sums[ends] - sums[starts]) * powers(BASE_INV, n + 1)[starts])


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive entries, by doubling; entry i starts at i."""
    if len(words) < k:
        return np.zeros(0, U64)
    total, have, at, out = words, 1, 0, None
    rest = k
    step = U64(_odd(77))
    while rest:
        if rest & 1:
            part = total[at : len(words) - k + 1 + at]
            out = part.copy() if out is None else mix(out * step + part)
            at += have
        rest >>= 1
        if rest:
            total = mix(total[:-have] * step + total[have:] + U64(have))
            have *= 2
    return mix(out + U64(k))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive entries, by doubling."""
    have = 1
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if have < w else x


def inside_runs(first: np.ndarray, k: int) -> np.ndarray:
    """Of the positions 0..first[-1]-k: does a window of k from here stay in its document? first: document starts and the end."""
    total = int(first[-1])
    if total < k:
        return np.zeros(0, bool)
    ok = np.ones(total - k + 1, bool)
    for shift in range(1, k):
        edge = first[1:-1] - shift
        ok[edge[(edge >= 0) & (edge < len(ok))]] = False
    return ok


def shingle_sets(words: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """For each document its sorted distinct k-word shingle hashes; a shorter document is one shingle, an empty one has none."""
    grams = gram_hashes(words, k)
    none = np.zeros(0, U64)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            x = np.sort(grams[a : b - k + 1])
            out.append(x if len(x) < 2 else x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif b > a:
            out.append(gram_hashes(words[a:b], b - a) ^ U64(_odd(b - a)))
        else:
            out.append(none)
    return out


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8, and the documents' offsets among them."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    return points, lead[offsets]
