"""Document fingerprints by winnowing.

Every run of ``k`` code points has a rolling hash; of each window of ``w`` consecutive hashes the smallest is chosen, the rightmost
among equal ones, and kept with its position. Two texts that share a passage of w + k - 1 code points or more share a chosen hash;
none shorter than k is seen. A text of fewer than w hashes is one window; one shorter than k is one gram of its own length.

The fingerprint string is a 128-bit digest of the chosen (hash, position) pairs; likeness is the Jaccard similarity of the sets of
chosen hashes (two empty texts: 1; one empty: 0).

Rows. Null text is empty: no chosen hashes, fingerprint "". Equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ammlytics.llm import _arrays as A
from ammlytics.llm._spark import parts, texts, written

U64 = np.uint64


def winnow(points: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes (32 bits) and their positions in a text given as code points."""
    n = len(points)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    grams = A.gram_hashes(points.astype(U64), min(k, n))
    m = len(grams)
    # hash above, distance from the end below: the smallest key is the rightmost of the smallest hashes
    key = (grams & U64(0xFFFFFFFF00000000)) | (U64(m - 1) - np.arange(m, dtype=U64))
    low = A.sliding_min(key, min(w, m))
    chosen = low[np.concatenate(([True], low[1:] != low[:-1]))]
    return (chosen >> U64(32)).astype(np.uint32), (m - 1) - (chosen & U64(0xFFFFFFFF)).astype(np.int64)


def digest(hashes: np.ndarray, positions: np.ndarray) -> str:
    return hashlib.blake2b(hashes.tobytes() + positions.tobytes(), digest_size=16).hexdigest() if len(hashes) else ""


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """a, b: sorted distinct hashes."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    shared = int(np.count_nonzero(b[at] == a))
    return shared / (len(a) + len(b) - shared)


def fingerprints(docs: DataFrame, *, k: int = 12, w: int = 10) -> DataFrame:
    """Of docs(doc_id, text): doc_id, hashes, positions (arrays, in order of position) and fingerprint."""

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("hashes", pa.list_(pa.int64())), ("positions", pa.list_(pa.int64())), ("fingerprint", pa.string())])
        for ids, data, offsets in A.chunks(batches, 2):
            points, at = A.code_points(data, offsets)
            found = [winnow(points[a:b], k, w) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array([h.astype(np.int64) for h, _ in found], pa.list_(pa.int64())), pa.array([p for _, p in found], pa.list_(pa.int64())), pa.array([digest(*x) for x in found])], schema=schema)

    return texts(docs, "doc_id", "text").mapInArrow(run, "doc_id long, hashes array<long>, positions array<long>, fingerprint string")


class _Text:
    """A text with its code points and chosen hashes."""

    def __init__(self, text: str | None, k: int, w: int):
        self.text = text or ""
        self.points = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.hashes, self.positions = winnow(self.points, k, w)


def _result(i, a: _Text, b: _Text, k: int, w: int) -> tuple:
    """Of a document and the one after it."""
    n = len(a.points)
    half = n // 2
    edited = np.concatenate((a.points[: n - half], b.points[:half]))
    eh, ep = winnow(edited, k, w)
    mine = np.unique(a.hashes)
    sha = hashlib.sha256((a.text[: n - half] + b.text[:half]).encode("utf-8", "surrogatepass")).hexdigest()
    return i, n, sha, digest(a.hashes, a.positions), digest(eh, ep), likeness(mine, np.unique(eh)), likeness(mine, np.unique(b.hashes))


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_SQL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _ordered(k: int, w: int):
    """Rows of one range in order: results of all but the last; first and last text of the range for its neighbours."""
    schema = pa.schema([("range", pa.int32()), ("end", pa.string()), ("text", pa.string()), *_RESULT])

    def run(batches):
        at = TaskContext.get().partitionId()
        before, rows = None, []
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                now = _Text(text, k, w)
                if before is None:
                    rows.append((at, "first", now.text, i, *[None] * 6))
                else:
                    rows.append((at, None, None, *_result(*before, now, k, w)))
                before = i, now
                if len(rows) >= 2000:
                    yield _batch(rows, schema)
                    rows = []
        if before:
            rows.append((at, "last", before[1].text, before[0], *[None] * 6))
            yield _batch(rows, schema)

    return run


def _ends(k: int, w: int):
    def run(batches):
        for batch in batches:
            rows = [_result(i, _Text(a, k, w), _Text(b, k, w), k, w) for i, a, b in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True)]
            if rows:
                yield _batch(rows, _RESULT)

    return run


def edited_fingerprints(docs: DataFrame, *, k: int = 12, w: int = 10) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness to each other and to the next document's.

    Edited: the last floor(n / 2) code points replaced by the first as many of the next document in ascending doc_id (the first
    document after the last). Texts move once, into ranges of doc_id; of each range only the last text still has to meet the first
    of the next range. Null doc_ids come first, repeated ones follow one another in order of their texts, and a single document
    follows itself.
    """
    base = texts(docs, "doc_id", "text")
    ranges = base.repartitionByRange(2 * parts(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    table = written(ranges.mapInArrow(_ordered(k, w), f"range int, end string, text string, {_SQL}"))
    # one row a range
    order = table.where("end = 'first'").select("range", F.lead("range").over(Window.orderBy("range")).alias("following"), F.min("range").over(Window.partitionBy()).alias("lowest"))
    order = order.select("range", F.coalesce("following", "lowest").alias("following"))
    last = table.where("end = 'last'").select("range", "doc_id", F.col("text").alias("a")).join(order, "range")
    first = table.where("end = 'first'").select(F.col("range").alias("following"), F.col("text").alias("b"))
    ends = last.join(first, "following").select("doc_id", "a", "b").mapInArrow(_ends(k, w), _SQL)
    return table.where("end is null").select(*_RESULT.names).unionByName(ends)
