"""Product codes of vectors by Lloyd rounds after Elkan: bounds are kept between rounds and spare most distances, the result stays exact.

Components become integers, floor(4096 x), vectors are cut into equal parts, and each part position has a codebook of its own. All
distances are squared Euclidean distances of integers, so equal ones are known to be equal and go to the lower index.

A row of the working table is a vector: its integers, the entry of each part, an upper bound of the distance to that and a lower bound of
the distance to each entry. A round reads the table and writes the next one; nothing is shuffled but sums, a row for each part, entry and
component. Bounds are whole numbers of two bytes, upper ones rounded up and lower ones rounded down (in steps of a power of two where
distances are larger than that). Between rounds each lower bound falls by the movement of its entry and the upper bound rises by that of
its own, both rounded up. An entry is left out only if it is farther than the upper bound for certain: its lower bound is larger, or the
distance between it and the current entry is more than twice as large; equality is never left out, but computed. The table of a round
is deleted when that of the next one is complete.

Rows. A vector that is null or holds a null or non-finite component takes no part; nor does an empty one, or one whose length isn't the
most frequent one (ties: the longer). Repeated rows count each. The codebooks start from the 16 smallest vec_ids (null is the largest;
equal vec_ids by vector); with fewer rows there are fewer entries. Lengths that 8 doesn't divide are cut at floor(i * length / 8). An
error beyond 64 bits is null. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ammlytics.llm._arrays import text_buffers
from ammlytics.llm._spark import dropped, limited, written

SCALE = 4096
#: The largest bound that is stored; an upper bound of this size is none.
NONE = 65535
#: Integers below this in absolute value stay in 64 bits, squared distances included; larger ones are handled as Python ints.
SMALL = 2**24
#: What whole numbers are computed in, by how they are stored: with two bytes, all sums are exact as doubles.
_COMPUTED = {"int16": np.float64, "int32": np.int64, "text": object}
_STATE = "vec_id long, label string, body binary, codes binary, upper binary, lower binary, sums array<decimal(38,0)>"


class Codebooks(NamedTuple):
    """entries[part][index] as lists of whole numbers, the cuts of a vector, the step of stored bounds, how integers are stored."""

    entries: list[list[list[int]]]
    cuts: list[int]
    step: int
    kind: str

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.entries for entry in part for x in entry).encode()).hexdigest()


def valid(table: DataFrame) -> DataFrame:
    """vec_id, label (as text), vector of the rows that take part, all of one length."""
    v = F.col("embedding").cast("array<double>").alias("vector")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), v)
    rows = rows.where("size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    lengths = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    return rows.where(F.size("vector") == (lengths[0]["length"] if lengths else 0))


def _whole(flat: np.ndarray, kind: str) -> np.ndarray:
    """floor(4096 x) as int64, or as Python ints where they are stored as text."""
    if kind != "text":
        return np.floor(flat * SCALE).astype(np.int64)
    return np.array([math.floor(x) * SCALE + math.floor((x - math.floor(x)) * SCALE) for x in flat.tolist()], object)


def _roots(squares: np.ndarray, up: bool) -> np.ndarray:
    """Square roots, rounded up or down."""
    if squares.dtype == object:
        roots = np.array([math.isqrt(x) for x in squares.tolist()], object)
    else:
        roots = np.sqrt(squares.astype(np.float64)).astype(np.int64)
        roots -= roots * roots > squares
        roots += (roots + 1) * (roots + 1) <= squares
    return roots + (roots * roots < squares) if up else roots


def _stored(distances: np.ndarray, step: int, up: bool) -> np.ndarray:
    """Distances in steps, rounded to the safe side; from NONE on NONE (up), or NONE - 1 (down), which is still a lower bound."""
    steps = -(-distances // step) if up else distances // step
    return np.minimum(steps, NONE if up else NONE - 1).astype(np.int64)


def squared(x: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Squared distances of rows to an entry, or to one each, as whole numbers."""
    if not x.shape[1]:
        return np.zeros(len(x), np.int64)
    apart = x - entry
    total = (apart * apart).sum(axis=1)
    return total.astype(np.int64) if total.dtype == np.float64 else total


class Movement(NamedTuple):
    """Of one part: the entries as an array, distances between them rounded down, and how far each moved, rounded up (in steps)."""

    entries: np.ndarray
    between: np.ndarray
    moved: np.ndarray


def movements(books: Codebooks, before: Codebooks | None) -> list[Movement]:
    out = []
    for p, part in enumerate(books.entries):
        new = np.array(part, object)
        new = new.astype(_COMPUTED[books.kind]).reshape(len(part), books.cuts[p + 1] - books.cuts[p])
        between = np.stack([_stored(_roots(squared(new, entry), False), books.step, False) for entry in new])
        moved = np.zeros(len(part), np.int64)
        if before is not None:
            old = np.array(before.entries[p], object).reshape(new.shape)
            apart = squared(new, old.astype(_COMPUTED[books.kind]))
            moved = _stored(_roots(apart, True), books.step, True)
        out.append(Movement(new, between, moved))
    return out


def reassigned(x: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray, move: Movement, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest entries (ties: the lower index) of the parts x with their bounds, and how many distances that took."""
    at = at.astype(np.int64)
    upper = np.where(upper >= NONE, NONE, np.minimum(upper.astype(np.int64) + move.moved[at], NONE))
    lower = np.maximum(lower.astype(np.int64) - move.moved[None, :], 0)
    k = lower.shape[1]

    def open_to(rows: np.ndarray) -> np.ndarray:
        """Which entries but the current one may be as near, for certain pruned ones apart."""
        mine, bound = at[rows], upper[rows, None]
        out = (bound >= NONE) | ((bound >= lower[rows]) & (2 * bound >= move.between[mine]))
        out[np.arange(len(rows)), mine] = False
        return out

    rows = np.flatnonzero(open_to(np.arange(len(at))).any(axis=1))
    best = squared(x[rows], move.entries[at[rows]])
    lower[rows, at[rows]] = _stored(_roots(best, False), step, False)
    upper[rows] = _stored(_roots(best, True), step, True)
    row, entry = np.nonzero(open_to(rows))
    found = squared(x[rows[row]], move.entries[entry])
    lower[rows[row], entry] = _stored(_roots(found, False), step, False)
    apart = np.full((len(rows), k), 1 << 300 if found.dtype == object else np.iinfo(np.int64).max, found.dtype)
    apart[np.arange(len(rows)), at[rows]] = best
    apart[row, entry] = found
    nearest = np.argmin(apart, axis=1) if len(rows) else np.zeros(0, np.int64)  # of equal ones the first
    at[rows] = nearest
    upper[rows] = _stored(_roots(apart[np.arange(len(rows)), nearest], True), step, True)
    return at, upper, lower, len(rows) + len(row)


def _stored_rows(column: pa.Array, kind: str, n: int, *shape: int) -> np.ndarray:
    """A binary column whose rows are arrays of one shape."""
    if kind == "text":
        return np.array([[int(v) for v in row.decode().split(",")] for row in column.to_pylist()], object).reshape(n, *shape)
    data, _ = text_buffers(column)
    return np.frombuffer(data.tobytes(), kind).reshape(n, *shape)


def _column(rows: np.ndarray, kind: str) -> pa.Array:
    """Rows of numbers as a binary column."""
    if kind == "text":
        return pa.array([",".join(map(str, row)).encode() for row in rows.tolist()], pa.binary())
    data = np.ascontiguousarray(rows.astype(kind))
    size = data[:1].nbytes
    offsets = np.arange(len(data) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _state(ids: pa.Array, labels: pa.Array, body: pa.Array, codes: np.ndarray, upper: np.ndarray, lower: np.ndarray, sums: list[int]) -> pa.RecordBatch:
    n = len(codes)
    last = pa.array([*[None] * (n - 1), sums], pa.list_(pa.decimal128(38, 0)))
    columns = [ids, labels, body, _column(codes, "uint8"), _column(upper, "uint16"), _column(lower.reshape(n, -1), "uint16"), last]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _STATE.split(", ")])


def _begun(books: Codebooks):
    """Rows with no bounds yet: entry 0, no upper bound, lower bounds 0."""
    parts, k = len(books.entries), len(books.entries[0])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                body = _column(_whole(batch.column(2).flatten().to_numpy(zero_copy_only=False), books.kind).reshape(n, -1), books.kind)
                yield _state(batch.column(0), batch.column(1), body, np.zeros((n, parts)), np.full((n, parts), NONE), np.zeros((n, parts * k)), [])

    return run


def _sums(x: np.ndarray, at: np.ndarray, entries: int) -> list[int]:
    """Count and component sums of each entry, one after another."""
    out = []
    for c in range(entries):
        mine = x[at == c]
        out += [len(mine), *(int(v) for v in (mine.sum(axis=0) if len(mine) else [0] * x.shape[1]))]
    return out


def _round(books: Codebooks, before: Codebooks | None):
    """The table with parts assigned anew; the last row of a batch has the batch's sums."""
    parts, k, width = len(books.entries), len(books.entries[0]), books.cuts[-1]

    def run(batches) -> Iterator[pa.RecordBatch]:
        moves = movements(books, before)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            whole = _stored_rows(batch.column(2), books.kind, n, width)
            whole = whole.astype(_COMPUTED[books.kind])
            codes = _stored_rows(batch.column(3), "uint8", n, parts).astype(np.int64)
            upper = _stored_rows(batch.column(4), "uint16", n, parts).astype(np.int64)
            lower = _stored_rows(batch.column(5), "uint16", n, parts, k).astype(np.int64)
            sums = []
            for p in range(parts):
                x = whole[:, books.cuts[p] : books.cuts[p + 1]]
                codes[:, p], upper[:, p], lower[:, p], _ = reassigned(x, codes[:, p], upper[:, p], lower[:, p], moves[p], books.step)
                sums += _sums(x, codes[:, p], k)
            yield _state(*batch.columns[:3], codes, upper, lower, sums)

    return run


def _coded(books: Codebooks):
    """The table's vec_id, label, code, error."""
    parts, width = len(books.entries), books.cuts[-1]

    def run(batches) -> Iterator[pa.RecordBatch]:
        moves = movements(books, None)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            whole = _stored_rows(batch.column(2), books.kind, n, width)
            whole = whole.astype(_COMPUTED[books.kind])
            codes = _stored_rows(batch.column(3), "uint8", n, parts)
            error = np.zeros(n, object if books.kind == "text" else np.int64)
            for p in range(parts):
                error = error + squared(whole[:, books.cuts[p] : books.cuts[p + 1]], moves[p].entries[codes[:, p]])
            code = [row.tobytes().hex() for row in codes]
            error = [v if v < 2**63 else None for v in error.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def _first_books(rows: DataFrame, parts: int, entries: int) -> Codebooks | None:
    """The first vectors by vec_id as codebooks."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    if not first:
        return None
    width = len(first[0]["vector"])
    cuts = [i * width // parts for i in range(parts + 1)]
    most = (math.floor(rows.agg(F.max(F.array_max(F.transform("vector", F.abs)))).first()[0]) + 1) * SCALE
    kind = "int16" if most < 2**15 else "int32" if most < SMALL and width < 2**12 else "text"
    vectors = [[int(v) for v in _whole(np.array(r["vector"], np.float64), kind).tolist()] for r in first]
    reach = math.isqrt(4 * most**2 * max(b - a for a, b in zip(cuts, cuts[1:], strict=False))) + 1
    step = 1 << (reach // (NONE - 1)).bit_length()
    return Codebooks([[v[a:b] for v in vectors] for a, b in zip(cuts, cuts[1:], strict=False)], cuts, step, kind)


def _moved(books: Codebooks, table: DataFrame) -> Codebooks:
    """Each entry moved to the floor of its parts' mean; an unused one stays. What comes to the driver is one row for each number of the codebooks."""
    sums = table.select(F.posexplode("sums").alias("place", "value")).groupBy("place").agg(F.sum("value").alias("total"))
    totals = {r["place"]: int(r["total"]) for r in sums.collect()}
    place, parts = 0, []
    for part in books.entries:
        entries = []
        for entry in part:
            count = totals.get(place, 0)
            entries.append([totals[place + 1 + i] // count for i in range(len(entry))] if count else entry)
            place += 1 + len(entry)
        parts.append(entries)
    return books._replace(entries=parts)


def train(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> tuple[Codebooks, DataFrame] | None:
    """Codebooks after the rounds, and the working table with parts assigned to them; None without rows. rows: what ``valid`` gives."""
    limited(rows.sparkSession)
    books = _first_books(rows, parts, entries)
    if books is None:
        return None
    table, before = written(rows.mapInArrow(_begun(books), _STATE)), None
    for turn in range(rounds + 1):
        after = written(table.mapInArrow(_round(books, before), _STATE))
        dropped(table)
        table = after
        if turn < rounds:
            before, books = books, _moved(books, table)
    return books, table


def compress(table: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of each vector that takes part."""
    found = train(valid(table), parts, entries, rounds)
    if found is None:
        return table.sparkSession.createDataFrame([], "vec_id long, label string, code string, error long, label_error long, codebooks_sha256 string")
    books, working = found
    rows = working.mapInArrow(_coded(books), "vec_id long, label string, code string, error long")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    by_label = rows.groupBy("label").agg(F.when(total < F.lit("9223372036854775808").cast("decimal(38,0)"), total).cast("long").alias("label_error"))
    by_label = by_label.withColumnRenamed("label", "other")
    return rows.join(by_label, F.col("label").eqNullSafe(F.col("other")), "left").drop("other").withColumn("codebooks_sha256", F.lit(books.sha256()))


def decode(code: str, books: Codebooks) -> list[int]:
    """The vector that a code stands for."""
    return [x for part, index in zip(books.entries, bytes.fromhex(code), strict=True) for x in part[index]]


def oracle_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """DuckDB text of the digest: every distance of every round."""
    steps = [
        "e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)",
        f"x AS MATERIALIZED (SELECT id, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS v FROM e, range({parts}) t(p))",
        f"c0 AS MATERIALIZED (SELECT p, id - 1 AS j, v FROM x WHERE id <= {entries})",
    ]
    for r in range(rounds + 1):
        apart = "list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        steps.append(f"a{r} AS MATERIALIZED (SELECT id, p, j, d FROM (SELECT x.id, x.p, c.j, CAST({apart} AS BIGINT) AS d FROM x JOIN c{r} c USING (p)) QUALIFY row_number() OVER (PARTITION BY id, p ORDER BY d, j) = 1)")
        if r < rounds:
            steps.append(
                f"m{r} AS (SELECT p, j, list(m ORDER BY i) AS v FROM (SELECT a.p, a.j, i, CAST(floor_div AS BIGINT) AS m FROM (SELECT a.p, a.j, i, CASE WHEN sum(x.v[i]) < 0 THEN -((count(*) - 1 - sum(x.v[i])) // count(*)) ELSE sum(x.v[i]) // count(*) END AS floor_div"
                f" FROM a{r} a JOIN x USING (id, p), range(1, len(x.v) + 1) t(i) GROUP BY a.p, a.j, i) a) GROUP BY p, j)"
            )
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.p, c.j, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m USING (p, j))")
    return f"""WITH {", ".join(steps)},
k AS (SELECT id, lower(string_agg(lpad(to_hex(j), 2, '0'), '' ORDER BY p)) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY id),
s AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, j)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN k USING (id), s"""
