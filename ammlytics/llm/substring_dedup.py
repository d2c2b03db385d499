"""Exact substring deduplication by super-k-mer partitioning.

A window is ``size`` consecutive words of one document. A word goes if a window that covers it has the same words as a window that
starts earlier (smaller doc_id, or the same document and an earlier place). All windows are judged on the input.

Method. The minimiser of a window is the smallest hash among its runs of ``minimiser`` words, the leftmost of equal ones; consecutive
windows that share one occurrence of it are a super-k-mer. Equal windows have equal minimisers, so:

1. each task sends its distinct minimisers, packed, to their buckets; those that occur once in all documents end here (their windows
   are unique), and occurrences of the others are reported back to their documents;
2. those super-k-mers travel as packed strings of their words to the bucket of their minimiser. A task sends a string once, with its
   first place, and reports its other places itself. In a bucket, equal strings are settled as wholes; what differs is cut into
   windows, and sorting their words finds all but the first of each;
3. documents get their repeated places and drop the covered words.

Comparison of windows is by their words; hashes only say where they meet. A minimiser that is everywhere costs a bucket a few
strings for each task that has it, however many documents hold it.

Rows. Null or blank text: no words, nothing removed. Fewer than ``size`` words: nothing removed. Repeated rows (same doc_id and text)
are one document: neither removes from the other. Null doc_id: returned, nothing removed, not compared.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ammlytics.llm import _arrays as A
from ammlytics.llm._spark import bucket_count, dealt, packed, text_bytes, texts, unpacked, written

U64 = np.uint64
#: Super-k-mers and bytes of strings that a task holds before it sends them, and text that it works on at a time: these bound its memory.
FLUSH, FLUSH_BYTES, CHUNK_BYTES = 1_000_000, 24 << 20, 1 << 20
#: Bytes of text that a bucket stands for, about, however large the table is.
BUCKET_BYTES = 40 << 20
_PLACES = "doc_id long, starts binary, counts binary"
_PLACES_SCHEMA = pa.schema([("doc_id", pa.int64()), ("starts", pa.binary()), ("counts", pa.binary())])


def sliding_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """Place of the leftmost smallest of each w consecutive entries."""
    at, have = np.arange(len(x)), 1
    best = x

    def pair(shift):
        left, right = slice(0, len(best) - shift), slice(shift, len(best))
        first = best[left] <= best[right]
        return np.where(first, best[left], best[right]), np.where(first, at[left], at[right])

    while have * 2 <= w:
        best, at = pair(have)
        have *= 2
    if have < w:
        best, at = pair(w - have)
    return at


def super_kmers(starts, ends, first, data, size, m):
    """Owner, first window (word in its document), number of windows and minimiser hash of all super-k-mers of a chunk."""
    none = np.zeros(0, np.int64)
    if len(starts) < size:
        return none, none, none, np.zeros(0, U64)
    grams = A.gram_hashes(A.span_hashes(data, starts, ends), m)
    at = sliding_argmin(grams, size - m + 1)
    valid = np.flatnonzero(A.inside_runs(first, size))
    if not len(valid):
        return none, none, none, np.zeros(0, U64)
    at = at[valid]
    new = np.ones(len(valid), bool)
    new[1:] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1] + 1)
    begin = np.flatnonzero(new)
    owner = np.searchsorted(first, valid[begin], side="right") - 1
    return owner, valid[begin] - first[owner], np.diff(np.append(begin, len(valid))), grams[at[begin]]


def _grouped(ids: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Places as a row for each document."""
    order = np.lexsort((starts, ids))
    ids, starts, counts = ids[order], starts[order].astype(np.uint32), counts[order].astype(np.uint32)
    edge = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1], [True]))) if len(ids) else np.zeros(1, np.int64)
    cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(ids[edge[:-1]]), cut(starts), cut(counts)], schema=_PLACES_SCHEMA)


_SENT = pa.schema([("dest", pa.int32()), ("ids", pa.binary()), ("starts", pa.binary()), ("counts", pa.binary())])


def _sent(ids: np.ndarray, starts: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Places packed by the bucket of their document: a row for each bucket, however many documents."""
    dest = (A.mix(ids.view(U64)) % U64(buckets)).astype(np.int32)
    order = np.lexsort((starts, ids, dest))
    ids, starts, counts, dest = ids[order], starts[order].astype(np.uint32), counts[order].astype(np.uint32), dest[order]
    edge = np.flatnonzero(np.concatenate(([True], dest[1:] != dest[:-1], [True]))) if len(ids) else np.zeros(1, np.int64)
    cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(dest[edge[:-1]]), cut(ids), cut(starts), cut(counts)], schema=_SENT)


def _gathered(batches):
    """All places of the documents of a partition, a row for each document."""
    held = []
    for batch in batches:
        held.append([np.frombuffer(A.text_buffers(batch.column(i))[0], t).copy() for i, t in ((1, np.int64), (2, np.uint32), (3, np.uint32))])
    if held:
        whole = _grouped(*(np.concatenate(x) for x in zip(*held, strict=True)))
        for at in range(0, whole.num_rows, 1000):
            yield whole.slice(at, 1000)


def _minimisers(size: int, m: int, buckets: int):
    """Packed by bucket: minimisers seen once in a task with their places; those seen more often (no places: those are in own)."""
    schema = pa.schema([("bucket", pa.int32()), ("once", pa.binary()), ("ids", pa.binary()), ("starts", pa.binary()), ("often", pa.binary()), ("own_ids", pa.binary()), ("own_starts", pa.binary())])

    def run(batches):
        held, total = [], 0

        def out():
            ids, starts, mins = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(mins, kind="stable")
            ids, starts, mins = ids[order], starts[order], mins[order]
            edge = np.flatnonzero(np.concatenate(([True], mins[1:] != mins[:-1], [True])))
            many = np.repeat(np.diff(edge) > 1, np.diff(edge))
            often = mins[edge[:-1]][np.diff(edge) > 1]
            own_ids, own_starts = ids[many], starts[many]
            ids, starts, mins = ids[~many], starts[~many], mins[~many]
            b1, b2 = (mins % U64(buckets)).astype(np.int32), (often % U64(buckets)).astype(np.int32)
            o1 = np.lexsort((starts, ids, b1))
            ids, starts, mins, b1 = ids[o1], starts[o1], mins[o1], b1[o1]
            o2 = np.argsort(b2, kind="stable")
            often, b2 = often[o2], b2[o2]
            present = np.unique(np.concatenate((b1, b2)))
            e1, e2 = (np.stack([np.searchsorted(b, present), np.searchsorted(b, present, side="right")], 1) for b in (b1, b2))
            e3 = np.linspace(0, len(own_ids), len(present) + 1).astype(np.int64)
            rows = [[], [], [], [], [], [], []]
            for x, b in enumerate(present.tolist()):
                (i, j), (k, n), (p, q) = e1[x], e2[x], e3[x : x + 2]
                for row, v in zip(rows, (b, mins[i:j].tobytes(), ids[i:j].tobytes(), starts[i:j].astype(np.uint32).tobytes(), often[k:n].tobytes(), own_ids[p:q].tobytes(), own_starts[p:q].astype(np.uint32).tobytes()), strict=True):
                    row.append(v)
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, schema, strict=True)], schema=schema)

        for ids, data, offsets in A.chunks(batches, 2, CHUNK_BYTES):
            starts, ends, first = A.split_words(data, offsets)
            owner, begin, _, mins = super_kmers(starts, ends, first, data, size, m)
            if len(owner):
                held.append((A.ids_of(ids)[owner], begin, mins))
                total += len(owner)
            if total > FLUSH:
                yield out()
                held, total = [], 0
        if held:
            yield out()

    return run


def _shared_minimisers(buckets: int):
    """Of a bucket: places of all minimisers that occur at least twice."""

    def run(batches):
        held: dict[int, list] = {}
        places = []
        for batch in batches:
            for b, once, ids, starts, often, own_ids, own_starts in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                held.setdefault(b, []).append((np.frombuffer(once, U64), np.frombuffer(ids, np.int64), np.frombuffer(starts, np.uint32), np.frombuffer(often, U64)))
                if own_ids:
                    places.append((np.frombuffer(own_ids, np.int64), np.frombuffer(own_starts, np.uint32)))
        for b in list(held):
            once, ids, starts, often = (np.concatenate(x) for x in zip(*held.pop(b), strict=True))
            value, count = np.unique(np.concatenate((once, often, often)), return_counts=True)
            value = value[count > 1]
            if len(value):
                at = np.searchsorted(value, once)
                at[at == len(value)] = 0
                hit = value[at] == once
                places.append((ids[hit], starts[hit]))
        if places:
            ids, starts = (np.concatenate(x) for x in zip(*places, strict=True))
            yield _sent(ids, starts, np.ones(len(ids), np.uint32), buckets)

    return run


def _flat(pieces: list, dtype=np.uint32) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, dtype) for x in pieces]) if pieces else np.zeros(0, dtype)


def _strings(size: int, m: int, buckets: int):
    """Super-k-mers at the reported places as packed strings, each string of a task once; its other places as repeated ones."""
    schema = pa.schema([("bucket", pa.int32()), ("body", pa.binary()), ("ids", pa.binary()), ("starts_", pa.binary()), ("mins", pa.binary()), *_PLACES_SCHEMA])

    def run(batches):
        seen: dict[bytes, tuple] = {}
        again, settled, volume = [], [], 0
        turn = 0

        def out():
            by: dict[int, list] = {}
            for string, (i, s, v) in seen.items():
                by.setdefault(v % buckets, []).append((string, i, s, v))
            press = zstandard.ZstdCompressor(level=1).compress
            rows = [(b, press(b"\n".join(x[0] for x in mine)), *(np.array([x[j] for x in mine], t).tobytes() for j, t in ((1, np.int64), (2, np.uint32), (3, U64)))) for b, mine in sorted(by.items())]
            none = pa.nulls(len(rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=False)] + [none.cast(f.type) for f in _PLACES_SCHEMA], schema=schema)

        def repeats():
            nonlocal turn
            g = _grouped(*(np.concatenate(x) for x in zip(*settled, strict=True)))
            settled.clear()
            turn += 1
            lead = [pa.array((np.arange(g.num_rows) + turn) % buckets, pa.int32())] + [pa.nulls(g.num_rows).cast(pa.binary())] * 4
            return pa.RecordBatch.from_arrays(lead + g.columns, schema=schema)

        for ids, pieces, data, offsets in A.chunks(unpacked(batches, 3), 3, CHUNK_BYTES):
            starts, ends, first = A.split_words(data, offsets)
            owner, begin, count, mins = super_kmers(starts, ends, first, data, size, m)
            wanted = [_flat(x) for x in pieces.to_pylist()]
            key = owner.astype(U64) << U64(32) | begin.astype(U64)
            want = np.concatenate([U64(i << 32) | x.astype(U64) for i, x in enumerate(wanted)]) if wanted else np.zeros(0, U64)
            hit = np.isin(key, want)
            raw = data.tobytes()
            known = A.ids_of(ids).tolist()
            a = first[owner[hit]] + begin[hit]
            b = a + count[hit] + size - 2
            for o, s, n, v, x, y in zip(owner[hit].tolist(), begin[hit].tolist(), count[hit].tolist(), mins[hit].tolist(), starts[a].tolist(), ends[b].tolist(), strict=True):
                string = b" ".join(raw[x:y].split())
                i = known[o]
                have = seen.get(string)
                if have is None:
                    seen[string] = (i, s, v)
                    volume += len(string) + 150
                elif (i, s) < have[:2]:
                    seen[string] = (i, s, v)
                    again.append((*have[:2], n))
                elif (i, s) > have[:2]:
                    again.append((i, s, n))
            if len(again) > 100_000:
                settled.append(tuple(np.array(x, np.int64) for x in zip(*again, strict=True)))
                again.clear()
                if len(settled) > 12:  # else all of a task's places of a document go as one row
                    yield repeats()
            if volume > FLUSH_BYTES:
                yield from out()
                seen.clear()
                volume = 0
        if again:
            settled.append(tuple(np.array(x, np.int64) for x in zip(*again, strict=True)))
        if settled:
            yield repeats()
        if seen:
            yield from out()

    return run


def settle_equal(strings: list[tuple[bytes, int, int]], size: int, found: list) -> list[tuple[bytes, int, int]]:
    """Of super-k-mers (words, doc_id, start): one of each, at its first place; all windows of the others go to found."""
    strings.sort()
    different = []
    for x in strings:  # equal strings stand together, the first place first
        if different and different[-1][0] == x[0]:
            if different[-1][1:] != x[1:]:
                found.append((x[1], x[2], x[0].count(b" ") + 2 - size))
        else:
            different.append(x)
    return different


def repeated_windows(strings: list[tuple[bytes, int, int]], size: int, found: list) -> None:
    """Of different super-k-mers: places (doc_id, start, 1) of all windows but the first of each. Sorted by hash, compared by words."""
    parts, at = [], 0
    while at < len(strings):
        end, volume = at, 0
        while end < len(strings) and (volume < CHUNK_BYTES or end == at):
            volume += len(strings[end][0])
            end += 1
        data = np.frombuffer(b"".join([x[0] for x in strings[at:end]]), np.uint8)
        bounds = np.concatenate(([0], np.cumsum([len(x[0]) for x in strings[at:end]])))
        starts, ends, first = A.split_words(data, bounds)
        ok = np.flatnonzero(A.inside_runs(first, size))
        own = np.searchsorted(first, ok, side="right") - 1
        hashes = A.gram_hashes(A.span_hashes(data, starts, ends), size)[ok]
        parts.append((hashes, own + at, (ok - first[own]).astype(np.int32), (starts[ok] - bounds[own]).astype(np.int32), (ends[ok + size - 1] - bounds[own]).astype(np.int32)))
        at = end
    hashes, own, shift, left, right = (np.concatenate(x) for x in zip(*parts, strict=True))
    ids = np.array([x[1] for x in strings], np.int64)[own]
    places = np.array([x[2] for x in strings], np.int64)[own] + shift
    order = np.lexsort((places, ids, hashes))
    same = hashes[order[1:]] == hashes[order[:-1]]
    in_group = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))
    group, words = None, {}
    for k in order[in_group].tolist():
        if hashes[k] != group:
            group, words = hashes[k], {}
        w = strings[own[k]][0][left[k] : right[k]]
        place = int(ids[k]), int(places[k])
        if words.setdefault(w, place) != place:
            found.append((*place, 1))


def _judge(size: int, buckets: int):
    """Of a bucket's packed strings: repeated places. Rows that already are places go along."""

    def run(batches):
        held: dict[int, list] = {}
        known = []
        for batch in batches:
            places = batch.filter(batch.column(5).is_valid())
            for i, starts, counts in zip(*(places.column(j).to_pylist() for j in (5, 6, 7)), strict=True):
                begin = np.frombuffer(starts, np.uint32)
                known.append((np.full(len(begin), i, np.int64), begin, np.frombuffer(counts, np.uint32)))
            rows = batch.filter(batch.column(1).is_valid())
            for b, *row in zip(*(rows.column(i).to_pylist() for i in range(5)), strict=True):
                held.setdefault(b, []).append(row)
        for b in list(held):
            by: dict[int, list] = {}
            press = zstandard.ZstdDecompressor().decompress
            for body, ids, starts, mins in held.pop(b):
                for string, i, s, v in zip(press(body).split(b"\n"), np.frombuffer(ids, np.int64).tolist(), np.frombuffer(starts, np.uint32).tolist(), np.frombuffer(mins, U64).tolist(), strict=True):
                    by.setdefault(v, []).append((string, i, s))
            found, pool, volume = [], [], 0
            for strings in by.values():
                if len(strings) > 1 and len(different := settle_equal(strings, size, found)) > 1:
                    pool += different
                    volume += sum(len(x[0]) for x in different)
                if volume > CHUNK_BYTES:
                    repeated_windows(pool, size, found)
                    pool, volume = [], 0
            if pool:
                repeated_windows(pool, size, found)
            if found:
                known.append(tuple(np.array(x, np.int64) for x in zip(*found, strict=True)))
        if known:
            yield _sent(*(np.concatenate(x) for x in zip(*known, strict=True)), buckets)
        A.release()

    return run


def _cut(size: int, layout: bool, carry: int):
    """Texts without the words that the windows at the given places cover. Columns: doc_id, starts, counts, those to carry, body."""

    def run(batches):
        for batch in unpacked(batches, 4 + carry):
            rows = []
            for begins, counts, body in zip(*(batch.column(j).to_pylist() for j in (1, 2, 3 + carry)), strict=True):
                words = (body or b"").split()
                if not begins:
                    kept = (body or b"") if layout else b" ".join(words)
                    rows.append((len(words), 0, None if body is None and layout else kept.decode()))
                    continue
                begin, count = _flat(begins).astype(np.int64), _flat(counts).astype(np.int64)
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + count + size - 1, -1)
                keep = np.cumsum(edge[:-1]) == 0
                if layout:  # a word goes with the white space after it
                    data = np.frombuffer(body, np.uint8)
                    starts, _, _ = A.split_words(data, np.array([0, len(data)]))
                    spans = np.append(starts, len(data)).tolist()
                    kept = body[: spans[0]] + b"".join(body[a:b] for a, b in compress(zip(spans[:-1], spans[1:], strict=True), keep))
                else:
                    kept = b" ".join(compress(words, keep))
                rows.append((len(words), int(len(words) - keep.sum()), kept.decode()))
            if rows:
                made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[3:-1], *made], names=["doc_id", *batch.schema.names[3:-1], "n_words", "n_removed", "kept"])

    return run


def places(docs: DataFrame, *, size: int = 20, minimiser: int = 8) -> DataFrame:
    """Of docs(doc_id, text): doc_id, starts, counts (packed 32-bit runs of windows that start elsewhere earlier), a row for each document that has any."""
    base = texts(docs, "doc_id", "text").where("doc_id is not null")
    buckets = bucket_count(docs.sparkSession, text_bytes(base), BUCKET_BYTES)
    sent = base.mapInArrow(_minimisers(size, minimiser, buckets), "bucket int, once binary, ids binary, starts binary, often binary, own_ids binary, own_starts binary")
    kinds = "dest int, ids binary, starts binary, counts binary"
    shared = dealt(sent, "bucket", n=buckets).mapInArrow(_shared_minimisers(buckets), kinds)
    wanted = dealt(shared, "dest", n=buckets).mapInArrow(_gathered, _PLACES)
    strings = packed(base).join(wanted.hint("merge"), "doc_id").select("doc_id", F.array("starts").alias("pieces"), "body").mapInArrow(_strings(size, minimiser, buckets), f"bucket int, body binary, ids binary, starts_ binary, mins binary, {_PLACES}")
    judged = dealt(strings, "bucket", n=buckets).mapInArrow(_judge(size, buckets), kinds)
    return dealt(judged, "dest", n=buckets).mapInArrow(_gathered, _PLACES)


def remove_repeats(docs: DataFrame, *, size: int = 20, minimiser: int = 8, layout: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Of docs(doc_id, text): doc_id, the columns named in carry, n_words, n_removed and kept, the words that stay joined by one blank.

    layout: kept is instead the text without the removed words and the white space after each (null where the text is null).
    """
    found = written(places(docs, size=size, minimiser=minimiser)).select("doc_id", F.array("starts").alias("starts"), F.array("counts").alias("counts"))
    whole = packed(texts(docs, "doc_id", *carry, "text"))
    kinds = "".join(f"`{c}` {t}, " for c, t in whole.dtypes[1:-1])
    rows = whole.join(found.hint("merge"), "doc_id", "left").select("doc_id", "starts", "counts", *carry, "body")
    return rows.mapInArrow(_cut(size, layout, len(carry)), f"doc_id long, {kinds}n_words long, n_removed long, kept string")
