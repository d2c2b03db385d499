"""Byte-pair merging of many short words at once: all words of one length are a matrix, each round merges the best pair of each row."""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import cache

import numpy as np

from ammlytics.llm import _arrays as A

U64 = np.uint64
NONE = np.int32(2**31 - 1)
#: Longer words are merged one by one, with a heap.
WIDE = 48


class PairTable:
    """(left id, right id) -> (rank, merged id), for ids below 65536, as an open-addressing table."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        self.pairs = pairs
        keys = np.array([a << 16 | b for a, b in pairs], np.uint32)
        bits = max(10, int(len(keys) * 6).bit_length())
        self.shift, best = np.uint32(32 - bits), None
        for seed in range(12):
            mul = np.uint32(A._odd(seed) & 0xFFFFFFFF | 1)
            slots: dict[int, int] = {}
            most = 0
            for i, s in enumerate(((keys * mul) >> self.shift).tolist()):
                d = 0
                while (s + d) in slots:
                    d += 1
                slots[s + d] = i
                most = max(most, d)
            if best is None or most < best[0]:
                best = most, mul, slots
        self.depth, self.mul, slots = best
        size = (1 << bits) + self.depth + 1
        self.key = np.full(size, 0xFFFFFFFF, np.uint32)
        self.rank = np.full(size, NONE, np.int32)
        self.into = np.zeros(size, np.int32)
        values = list(pairs.values())
        for s, i in slots.items():
            self.key[s], self.rank[s], self.into[s] = keys[i], values[i][0], values[i][1]

    def slot(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slots of pairs; the last slot (of no key) where there is none."""
        key = left.astype(np.uint32) << np.uint32(16) | right.astype(np.uint32)
        at = ((key * self.mul) >> self.shift).astype(np.int64)
        found = np.where(self.key[at] == key, at, -1)
        for d in range(1, self.depth + 1):
            open_ = np.flatnonzero(found < 0)
            if not len(open_):
                break
            there = at[open_] + d
            hit = self.key[there] == key[open_]
            found[open_[hit]] = there[hit]
        found[found < 0] = len(self.key) - 1
        return found


def merge_one(symbols: list[int], table: PairTable, skip=None, made=None) -> list[int]:
    """One word by an agenda (heap) of candidate merges, best rank first, leftmost among equals. skip(start, middle, end, into) drops one, made is told of each merge."""
    n = len(symbols)
    sym, left, right, end = list(symbols), list(range(-1, n - 1)), list(range(1, n + 1)), list(range(1, n + 1))
    heap: list[tuple] = []

    def offer(i):
        j = right[i]
        if j < n and (got := table.pairs.get((sym[i], sym[j]))) and not (skip and skip(i, j, end[j], got[1])):
            heapq.heappush(heap, (got[0], i, j, end[j], got[1], sym[i], sym[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, j, stop, into, a, b = heapq.heappop(heap)
        if sym[i] != a or sym[j] != b or right[i] != j or end[j] != stop:
            continue
        if made:
            made(i, j, stop, into)
        sym[i], sym[j], end[i] = into, -1, stop
        right[i] = right[j]
        if right[j] < n:
            left[right[j]] = i
        if left[i] >= 0:
            offer(left[i])
        offer(i)
    out, i = [], 0
    while i < n:
        out.append(sym[i])
        i = right[i]
    return out


def merge_many(symbols: np.ndarray, first: np.ndarray, table: PairTable, dropped=None, made=None) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all words, flat, and their offsets. symbols[first[i]:first[i+1]] is word i.

    dropped(rows, start, middle, end, into) -> bool array tells which candidate merges are never made; it has to depend on nothing
    but its arguments, so that the order of work doesn't matter. made(rows, start, middle, end, into) is told of the merges that are made.
    """
    spans = dropped is not None or made is not None
    lengths = np.diff(first)
    out_len = lengths.copy()
    done: list[tuple[np.ndarray, np.ndarray]] = []
    single: list[tuple[int, list[int]]] = []
    for i in np.flatnonzero(lengths > WIDE).tolist():
        skip = None
        if dropped is not None:
            skip = lambda s, m, e, into, i=i: bool(dropped(np.array([i]), np.array([s]), np.array([m]), np.array([e]), np.array([into]))[0])
        tokens = merge_one(symbols[first[i] : first[i + 1]].tolist(), table, skip, made and (lambda s, m, e, into, i=i: made(np.array([i]), np.array([s]), np.array([m]), np.array([e]), np.array([into]))))
        single.append((i, tokens))
        out_len[i] = len(tokens)

    def ranks(rows, sym, ends, p):
        """Rank of the pair at p (and p + 1) of each row."""
        i = np.arange(len(rows))
        slot = table.slot(sym[i, p], sym[i, p + 1])
        rank = table.rank[slot]
        if dropped is not None:
            ok = np.flatnonzero(rank != NONE)
            start = np.where(p[ok] > 0, ends[ok, p[ok] - 1], 0)
            gone = dropped(rows[ok], start, ends[ok, p[ok]], ends[ok, p[ok] + 1], table.into[slot[ok]])
            rank = rank.copy()
            rank[ok[gone]] = NONE
        return rank

    carry = None
    by_length = np.argsort(lengths, kind="stable")
    edges = np.searchsorted(lengths[by_length], np.arange(WIDE + 2))
    for size in range(WIDE, 1, -1):
        rows = by_length[edges[size] : edges[size + 1]]
        if len(rows):
            sym = symbols[first[rows][:, None] + np.arange(size)].astype(np.int32)
            ends = np.broadcast_to(np.arange(1, size + 1, dtype=np.int32), sym.shape) if spans else None
            rank = np.empty((len(rows), size - 1), np.int32)
            for p in range(size - 1):
                rank[:, p] = ranks(rows, sym, ends, np.full(len(rows), p))
            if carry is not None:
                rows = np.concatenate((carry[0], rows))
                sym, rank = np.concatenate((carry[1], sym)), np.concatenate((carry[2], rank))
                ends = np.concatenate((carry[3], ends)) if spans else None
        elif carry is not None:
            rows, sym, rank, ends = carry
        else:
            continue
        best = rank.argmin(1)
        i = np.arange(len(rows))
        live = rank[i, best] != NONE
        if not live.all():
            done.append((rows[~live], sym[~live]))
            rows, sym, rank, best = rows[live], sym[live], rank[live], best[live]
            ends = ends[live] if ends is not None else None
            i = np.arange(len(rows))
        if not len(rows):
            carry = None
            continue
        into = table.into[table.slot(sym[i, best], sym[i, best + 1])]
        if made is not None:
            made(rows, np.where(best > 0, ends[i, best - 1], 0), ends[i, best], ends[i, best + 1], into)
        sym[i, best] = into
        keep = np.ones(sym.shape, bool)
        keep[i, best + 1] = False
        sym = sym[keep].reshape(len(rows), size - 1)
        if ends is not None:
            keep = np.ones(ends.shape, bool)
            keep[i, best] = False
            ends = ends[keep].reshape(len(rows), size - 1)
        keep = np.ones(rank.shape, bool)
        keep[i, best] = False
        rank = rank[keep].reshape(len(rows), size - 2)
        out_len[rows] = size - 1
        if size > 2:
            has = best > 0
            p = best[has] - 1
            rank[i[has], p] = ranks(rows[has], sym[has], ends[has] if ends is not None else None, p)
            has = best < size - 2
            p = best[has]
            rank[i[has], p] = ranks(rows[has], sym[has], ends[has] if ends is not None else None, p)
        carry = rows, sym, rank, ends
    if carry is not None:
        done.append((carry[0], carry[1]))
    one = np.flatnonzero(lengths == 1)
    if len(one):
        done.append((one, symbols[first[one]][:, None]))
    offsets = np.concatenate(([0], np.cumsum(out_len)))
    flat = np.zeros(offsets[-1], np.int32)
    for rows, sym in done:
        flat[offsets[rows][:, None] + np.arange(sym.shape[1])] = sym
    for i, tokens in single:
        flat[offsets[i] : offsets[i + 1]] = tokens
    return flat, offsets


def expand(flat: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a ragged table: the rows ``which`` one after another, and where each begins."""
    length = np.diff(offsets)[which]
    begin = np.concatenate(([0], np.cumsum(length)))
    return flat[np.repeat(offsets[which] - begin[:-1], length) + np.arange(begin[-1])], begin


# Byte-level vocabularies ------------------------------------------------------------------------------------------------------

#: Classes of code points in the pattern of the byte-level vocabulary.
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0


@cache
def point_classes() -> np.ndarray:
    kind = np.zeros(0x110000, np.uint8)
    for p in range(0x110000):
        c = unicodedata.category(chr(p))[0]
        if c == "L":
            kind[p] = LETTER
        elif c == "N":
            kind[p] = NUMBER
    for a, b in ((0x9, 0xD), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        kind[a : b + 1] = SPACE
    return kind


def pre_tokens(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts (among code points) of the pieces that ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` finds, document by document."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = point_classes()[points]
    start = np.empty(n, bool)
    start[0] = True
    start[1:] = kind[1:] != kind[:-1]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    start |= border[:n]
    # white space before something else in the same document: its last character stands alone, or, a blank, goes with what follows
    run = np.flatnonzero(start[1:] & (kind[:-1] == SPACE) & ~border[1:n]) if n > 1 else np.zeros(0, np.int64)
    start[run] = True
    blank = run[points[run] == 32]
    start[blank + 1] = False
    # contractions: a quote that begins a piece of its own, and letters after it
    quote = np.flatnonzero((points == 39) & start)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~border[quote + 1]]
    padded = np.concatenate((points, np.zeros(2, points.dtype)))
    inside = quote + 2 < n
    third = np.where(inside & ~border[np.minimum(quote + 2, n)], padded[quote + 2], 0)
    second = points[quote + 1]
    one = (second == 115) | (second == 116) | (second == 109) | (second == 100)
    two = ((second == 114) & (third == 101)) | ((second == 118) & (third == 101)) | ((second == 108) & (third == 108))
    for hit, size in ((one, 2), (two, 3)):
        at = quote[hit]
        start[at + 1] = False
        after = at + size
        after = after[after < n]
        start[after[(kind[after] == LETTER)]] = True
    return np.flatnonzero(start)


class ByteLevel:
    """Ids of a byte-level vocabulary file (vocab and merges), for whole chunks of text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.byte_id = np.array([vocab[shown[b]] for b in range(256)], np.int32)
        pairs = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.table = PairTable(pairs)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, flat, and each document's offset."""
        points, at = A.code_points(data, offsets)
        starts = pre_tokens(points, at)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        begin = lead[starts] if len(starts) else np.zeros(0, np.int64)
        end = np.append(begin[1:], len(data)) if len(begin) else begin
        hashes = A.span_hashes(data, begin, end) if len(begin) else np.zeros(0, U64)
        _, pick, which = np.unique(hashes, return_index=True, return_inverse=True)
        size = (end - begin)[pick]
        first = np.concatenate(([0], np.cumsum(size)))
        source = np.repeat(begin[pick] - first[:-1], size) + np.arange(first[-1])
        flat, off = merge_many(self.byte_id[data[source]], first, self.table)
        ids, place = expand(flat, off, which)
        return ids, place[np.searchsorted(begin, offsets)]


@cache
def byte_level(path: str) -> ByteLevel:
    return ByteLevel(path)
