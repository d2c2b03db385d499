"""Session helpers shared by all parts of the package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors once per application, so that Python workers can import it wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="ammlytics-src-"), "ammlytics_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join(os.path.basename(top), os.path.relpath(full, top)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def workspace(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); on a single machine, where that is unset, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ammlytics-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new path in the workspace for a table of this application."""
    return f"{workspace(spark)}/ammlytics-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def materialised(df: DataFrame) -> DataFrame:
    """df written to the workspace and read again: computed once, its lineage cut, readable after the loss of any executor."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
