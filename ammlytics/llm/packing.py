"""Best-fit packing of token sequences with certified bounds.

Documents become ids (with one end id each), are cut into pieces of at most ``size`` ids, and pieces are packed whole into
sequences of at most ``size``. Each partition packs its pieces best-fit decreasing; dual feasible functions give a lower bound of
its number of sequences. Sequences that are full, or whose count the bound certifies with nothing to gain from neighbours, stay;
of each partition the least filled ones (all in which its gap may lie, at most ``give`` for each missing in its bound) go to the next round, where the
documents of several partitions meet and are packed again. What a round doesn't better stays as it was. Rounds end when one
partition has seen what is left, when nothing is left, or when a round saves less than ``least_gain`` of its sequences.

Rows. Null or empty text: a document of the end id only. Repeated rows are packed each for itself. A null doc_id is carried
through. An empty table gives an empty result. Very long texts give many pieces, dealt by (doc_id, piece).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ammlytics.llm import _arrays as A
from ammlytics.llm._bpe import byte_level
from ammlytics.llm._spark import dealt, texts, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _pieces(path: str, size: int, end_id: int):
    def run(batches):
        coder = byte_level(path)
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        tail = np.array([end_id], "<u4").tobytes()
        for ids, data, offsets in A.chunks(batches, 2):
            tokens, at = coder.encode(data, offsets)
            raw = memoryview(tokens.astype("<u4").tobytes())
            owner, piece, start, length, crc = [], [], [], [], []
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                n = b - a + 1
                s, head = 0, n % size or size  # the first piece takes the remainder
                p = 0
                while s < n:
                    e = s + (head if not p else size)
                    c = zlib.crc32(raw[4 * (a + s) : 4 * (a + min(e, n - 1))])
                    owner.append(i), piece.append(p), start.append(s), length.append(e - s)
                    crc.append(zlib.crc32(tail, c) if e == n else c)
                    s, p = e, p + 1
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], schema=schema)

    return run


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each item, and what is left free in each bin. Largest first; the fullest bin that has room."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[int] = []
    by_free: list[list[int]] = [[] for _ in range(size + 1)]
    some = 0  # bit f: a bin with f free
    for i, x in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fit = some >> x
        if fit:
            f = x + (fit & -fit).bit_length() - 1
            b = by_free[f].pop()
            if not by_free[f]:
                some &= ~(1 << f)
        else:
            f, b = size, len(free)
            free.append(size)
        bins[i], offsets[i] = b, size - f
        free[b] = f = f - x
        if f:
            by_free[f].append(b)
            some |= 1 << f
    return bins, offsets, free


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """Least number of bins by two families of dual feasible functions over the histogram of lengths."""
    count = np.bincount(lengths, minlength=size + 1).astype(np.int64)
    x = np.arange(size + 1, dtype=np.int64)
    best = -(-int((count * x).sum()) // size)
    for e in range(1, size // 2 + 1):  # above size - e: a whole bin; below e: nothing
        total = int(count[size - e + 1 :].sum()) * size + int((count * x)[e : size - e + 1].sum())
        best = max(best, -(-total // size))
    for k in range(1, 65):  # rounded down to multiples of 1/k, unless (k + 1) x / size is whole
        q = (k + 1) * x
        value = np.where(q % size == 0, x * k, (q // size) * size)
        best = max(best, -(-int((count * value).sum()) // (k * size)))
    return best


def _packed(size: int, give: int, round_: int, last: bool):
    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for part in pc.unique(batch.column(0)).to_pylist():
                held.setdefault(part, []).append(table.filter(pc.equal(table["part"], part)))
        for part, tables in held.items():
            t = pa.concat_tables(tables).combine_chunks()
            lengths = t["length"].to_numpy()
            bins, offsets, free = best_fit_decreasing(lengths, size)
            before = t["sequence_id"].to_numpy()
            if round_ and len(free) >= len(np.unique(before)):
                yield from t.append_column("open", pa.array(np.full(len(t), not last))).drop_columns(["part"]).to_batches()
                continue
            gap = len(free) - lower_bound(lengths, size)
            loose = np.array(free, np.int64)
            rank = np.argsort(-loose, kind="stable")[: max(1, give * gap)]
            opened = np.zeros(len(free), bool)
            opened[rank[loose[rank] > 0]] = not last
            at = t.column_names.index
            t = t.set_column(at("sequence_id"), "sequence_id", pa.array((np.int64(round_) << 56 | np.int64(part) << 32) + bins)).set_column(at("offset"), "offset", pa.array(offsets))
            yield from t.append_column("open", pa.array(opened[bins])).drop_columns(["part"]).to_batches()

    return run


def pack(docs: DataFrame, *, path: str | None = None, size: int = 2048, end_id: int = 0, partition_pieces: int = 50_000, give: int = 64) -> DataFrame:
    """Of docs(doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece.

    partition_pieces: pieces that one task packs. give: least filled sequences that a partition passes on for each missing in its bound.
    """
    pieces = written(texts(docs, "doc_id", "text").mapInArrow(_pieces(path or tokenizer_path(), size, end_id), PIECES))
    return pack_pieces(pieces, size=size, partition_pieces=partition_pieces, give=give)


def pack_pieces(pieces: DataFrame, *, size: int = 2048, partition_pieces: int = 50_000, give: int = 64, least_gain: float = 0.0005) -> DataFrame:
    """Packs rows of pieces(doc_id, piece, length, ...) and adds sequence_id and offset. A task never holds more than about partition_pieces."""
    columns = pieces.columns
    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes) + ", sequence_id long, `offset` long, open boolean"
    left = pieces.withColumns({"sequence_id": F.lit(-1).cast("long"), "offset": F.lit(0).cast("long")})
    out, round_ = None, 0
    while True:
        n = max(1, -(-left.count() // partition_pieces))
        key = "doc_id, piece" if not round_ else "sequence_id"
        dealt_out = left.select(F.expr(f"pmod(xxhash64({key}, {round_}), {n})").alias("part"), *columns, "sequence_id", "offset")
        done = written(dealt(dealt_out, "part", n=n).mapInArrow(_packed(size, give, round_, n == 1), schema))
        # a sequence has one piece at its start, so sequences are counted without a shuffle
        begun = F.col("offset") == 0
        was, now, open_ = (left.where(begun).count() if round_ else None), *done.agg(F.count_if(begun), F.count_if("open")).first()
        if n == 1 or not open_ or (was is not None and was - now < least_gain * was):
            return done.drop("open") if out is None else out.unionByName(done.drop("open"))
        closed = done.where("not open").drop("open")
        out = closed if out is None else out.unionByName(closed)
        left = done.where("open").drop("open")
        round_ += 1
