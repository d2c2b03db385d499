"""A table that is replaced by key, version by version: readers see whole versions only.

Rows lie in buckets by a hash of their key, a folder for each bucket that a writer touched. A version is a small file that names the folder
of every bucket; it appears by a rename that fails if another writer's version is there already. An upsert writes new folders for
the buckets of the keys that come in and leaves the others where they are, so it costs what it touches; a writer that dies before the
rename leaves folders that no version names. A reader is pinned to a version, and its files stay until ``expire`` drops them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(Exception):
    """Another writer committed first."""


class Snapshots:
    """Versions of a table at path, keyed by ``keys``: all rows of a key are replaced together."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _listed(self, name: str) -> list[str]:
        at = self._at(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        return [int(n.split(".")[0]) for n in self._listed("_versions") if n.endswith(".json")]

    def manifest(self, version: int) -> dict:
        """The file of a version; version 0 is the empty table."""
        if version == 0:
            return {"version": 0, "schema": None, "buckets": {}}
        stream = self._fs.open(self._at(f"_versions/{version:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def latest(self) -> int:
        return max(self.versions(), default=0)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version (the latest), None of the empty table. What later writers do doesn't show in it."""
        return self._rows(self.manifest(self.latest() if version is None else version), None)

    def _rows(self, manifest: dict, buckets: set[str] | None) -> DataFrame | None:
        if manifest["schema"] is None:
            return None
        folders = sorted({f for b, f in manifest["buckets"].items() if buckets is None or b in buckets})
        schema = T.StructType.fromJson(manifest["schema"])
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def prepare(self, new: DataFrame, base: int) -> dict:
        """Writes the touched buckets of a version after ``base``; nothing shows yet. Columns that only one side has are null on the other."""
        old = self.manifest(base)
        keys = new.select(*self.keys).distinct()
        touched = {str(r[0]) for r in keys.select(self._bucket()).distinct().collect()}  # at most ``buckets``
        before = self._rows(old, touched & set(old["buckets"]))
        if before is not None:
            here = before.alias("o").join(keys.alias("k"), [F.col(f"o.{k}").eqNullSafe(F.col(f"k.{k}")) for k in self.keys], "left_anti")
            new = here.unionByName(new, allowMissingColumns=True)
        folder = f"data/{uuid.uuid4().hex}"
        # a rebalance splits the bucket of a hot key over several files
        new.withColumn("_bucket", self._bucket()).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        there = {n.split("=")[1] for n in self._listed(folder) if n.startswith("_bucket=")}
        buckets = {b: f for b, f in old["buckets"].items() if b not in touched}
        return {"version": base + 1, "schema": new.schema.jsonValue(), "buckets": buckets | {b: f"{folder}/_bucket={b}" for b in there}}

    def commit(self, manifest: dict) -> int:
        """Makes a prepared version the latest; Conflict if its number is taken."""
        draft, final = self._at(f"_versions/.{uuid.uuid4().hex}"), self._at(f"_versions/{manifest['version']:012d}.json")
        stream = self._fs.create(draft)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else self._fs.getUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(final), options)
        except Exception as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(manifest["version"]) from e
            raise
        return manifest["version"]

    def upsert(self, new: DataFrame, tries: int = 3) -> int:
        """Replaces all rows of the keys in ``new``; returns the version. Starts anew from the latest version if another writer was first."""
        for left in range(tries - 1, -1, -1):
            try:
                return self.commit(self.prepare(new, self.latest()))
            except Conflict:
                if not left:
                    raise
        raise AssertionError

    def expire(self, keep: int = 1) -> int:
        """Deletes all but the last ``keep`` versions and what no version names, dead writers' folders too; returns how many folders went.

        Not while a writer is at work: its folders aren't named yet.
        """
        kept = self.versions()[-keep:]
        for v in self.versions():
            if v not in kept:
                self._fs.delete(self._at(f"_versions/{v:012d}.json"), False)
        named = {f for v in kept for f in self.manifest(v)["buckets"].values()}
        gone = 0
        for run in self._listed("data"):
            for bucket in self._listed(f"data/{run}"):
                if bucket.startswith("_bucket=") and f"data/{run}/{bucket}" not in named:
                    self._fs.delete(self._at(f"data/{run}/{bucket}"), True)
                    gone += 1
            if not any(f.startswith(f"data/{run}/") for f in named):
                self._fs.delete(self._at(f"data/{run}"), True)
        return gone
