"""Where intermediate tables go, and how many partitions a job deals to."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ammlytics.session import ship


#: Rows of an Arrow batch at most: whole documents are long, and a batch stands in the executor's and in the worker's memory.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or on a single machine, where that is unset, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ammlytics-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: computed once, lineage cut, readable after the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ammlytics-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes the files of a written table whose successor is written."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint (small tables: it is stored row by row)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def parts(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session says."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bucket_count(spark: SparkSession, elements: float, most: int) -> int:
    """Buckets for so many elements of about ``most`` each: the partitions of a shuffle, or more where they would hold too much."""
    return max(parts(spark), -(-int(elements) // most))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts: what numbers of buckets follow."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def dealt(df: DataFrame, *keys: str, n: int | None = None) -> DataFrame:
    """df hash-partitioned by keys, rows of a key together; partitions stay as they are (no coalescing)."""
    return df.repartition(n or parts(df.sparkSession), *keys)


def limited(spark: SparkSession) -> None:
    """Ships the package to the workers and bounds the rows of an Arrow batch."""
    ship(spark)
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def texts(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns only, in order; ids as long, text as string. Other columns, whatever their names, are not read."""
    limited(docs.sparkSession)
    kind = {"doc_id": "long", "page_id": "long", "vec_id": "long", "n_chars": "long"}
    return docs.select(*[F.col(f"`{c}`").cast(kind.get(c, "string")).alias(c) for c in columns])


def packed(docs: DataFrame) -> DataFrame:
    """docs(..., text) with each text compressed as ``body``, for a shuffle by doc_id: about half the bytes of Spark's own compression."""
    names, kinds = docs.columns[:-1], dict(docs.dtypes)

    def run(batches):
        press = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            body = [press(x) if x else x for x in batch.column(len(names)).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(body, pa.binary())], names=[*names, "body"])

    return docs.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", body binary")


def restored(docs: DataFrame) -> DataFrame:
    """packed() undone: the last column, ``body``, as text."""
    names, kinds = docs.columns[:-1], dict(docs.dtypes)

    def run(batches):
        for batch in unpacked(batches, len(names) + 1):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], batch.column(len(names)).cast(pa.binary()).cast(pa.string())], names=[*names, "text"])

    return docs.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", text string")


def unpacked(batches, column: int, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches with their compressed column number ``column`` - 1 as plain bytes, at most ``rows`` rows at a time."""
    press = zstandard.ZstdDecompressor().decompress
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            batch = whole.slice(at, rows)
            body = [press(x) if x else x for x in batch.column(column - 1).to_pylist()]
            columns = [batch.column(i) for i in range(batch.num_columns)]
            columns[column - 1] = pa.array(body, pa.large_binary())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
