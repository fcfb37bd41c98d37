"""Tables that change all at once: files that never change, and a manifest that says which of them count.

Rows lie in folders by a hash of their key. A change writes new folders for the hashes that it touches and then the next
manifest, in one step that fails if another writer was first; it is then planned again on what that writer left. A reader sees
the manifest of before or of after, never between; a writer that dies before the manifest leaves the old table and some files
that ``vacuum`` deletes. The manifest names the batches that made it, so a batch that is tried again changes nothing.

The manifest is made by the file system's creation of a file that must not exist yet: one step where the file system has
such a step, as HDFS and local disks do.

Defined results: a table without a manifest is empty; a bucket that a change leaves empty has no folder; null keys share a bucket;
a change of no rows still is a version. Of the batches the last ``remember`` are known.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import file_system


class Conflict(Exception):
    """Another writer has made this version."""


class ManifestTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, keys: list[str], buckets: int = 16, remember: int = 1000):
        self.spark, self.path, self.keys, self.buckets, self.remember = spark, path, keys, buckets, remember
        self.schema = schema if isinstance(schema, T.StructType) else spark.createDataFrame([], schema).schema

    # --- reading

    def version(self) -> int:
        """The newest version's number; 0 before the first."""
        system, there = file_system(self.spark, f"{self.path}/versions")
        if not system.exists(there):
            return 0
        return max((int(f.getPath().getName().removesuffix(".json")) for f in system.listStatus(there) if f.getPath().getName().endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "folders": {}, "batches": []}
        system, there = file_system(self.spark, f"{self.path}/versions/{version:012d}.json")
        stream = system.open(there)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of a version (the newest), of some buckets (all)."""
        return self._rows(self.manifest(version), only)

    def _rows(self, manifest: dict, only: list[int] | None = None) -> DataFrame:
        folders = [f"{self.path}/{f}" for b, of in manifest["folders"].items() if only is None or int(b) in only for f in of]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    # --- writing

    def rewrite(self, touched: DataFrame, make: Callable[[DataFrame], DataFrame], batch: str | None = None, tries: int = 5) -> int:
        """Replace the buckets of the keys of ``touched`` by what ``make`` gives of their rows; the version that has it.

        ``make`` is called again when another writer was first.
        """
        at = sorted(r[0] for r in touched.select(self.bucket()).distinct().collect())  # as many as there are buckets
        kept = lambda base: {b: of for b, of in base["folders"].items() if int(b) not in at}
        return self._change(lambda base: make(self._rows(base, at)), kept, batch, tries)

    def append(self, make: Callable[[DataFrame], DataFrame], batch: str | None = None, tries: int = 5) -> int:
        """Add what ``make`` gives of all rows, as further files; the version that has it."""
        return self._change(lambda base: make(self._rows(base)), lambda base: dict(base["folders"]), batch, tries)

    def _change(self, make, kept, batch: str | None, tries: int) -> int:
        for _ in range(tries):
            base = self.manifest()
            if batch is not None and batch in base["batches"]:
                return base["version"]
            folder = f"data/{uuid.uuid4().hex}"
            rows = make(base).select(*self.schema.names)
            rows.withColumn("_bucket", self.bucket()).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
            system, there = file_system(self.spark, f"{self.path}/{folder}")
            folders = kept(base)
            for f in system.listStatus(there):
                if f.isDirectory():
                    b = f.getPath().getName().removeprefix("_bucket=")
                    folders[b] = [*folders.get(b, []), f"{folder}/{f.getPath().getName()}"]
            batches = [*base["batches"], *([batch] if batch is not None else [])][-self.remember :]
            try:
                return self.commit({"version": base["version"] + 1, "folders": folders, "batches": batches})
            except Conflict:
                system.delete(there, True)
        raise Conflict(f"other writers were first {tries} times")

    def commit(self, manifest: dict) -> int:
        """Make the manifest the newest one, if its version is still free."""
        system, there = file_system(self.spark, f"{self.path}/versions/{manifest['version']:012d}.json")
        try:
            stream = system.create(there, False)
        except Exception as e:
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                raise Conflict(str(manifest["version"])) from None
            raise
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        return manifest["version"]

    def vacuum(self, keep: int = 2) -> int:
        """Delete the data that none of the last ``keep`` versions has; how many folders went. For times without writers."""
        newest = self.version()
        live = {f.split("/")[1] for v in range(max(1, newest - keep + 1), newest + 1) for of in self.manifest(v)["folders"].values() for f in of}
        system, there = file_system(self.spark, f"{self.path}/data")
        dead = [f.getPath() for f in system.listStatus(there) if f.getPath().getName() not in live] if system.exists(there) else []
        for folder in dead:
            system.delete(folder, True)
        return len(dead)


PASSAGES = "media_track_id long, window_key string, starts_at double, ends_at double, text string, state string"


def replace_passages(table: ManifestTable, passages: DataFrame, spans: DataFrame, batch: str | None = None) -> int:
    """Publish ``passages`` (keyed by track and window_key) and withdraw what else overlaps ``spans`` (media_track_id, starts_at,
    ends_at), all at once."""
    new = passages.withColumn("state", F.lit("published"))
    where = spans.select(F.col("media_track_id").alias("_track"), F.col("starts_at").alias("_from"), F.col("ends_at").alias("_to"))

    def make(old: DataFrame) -> DataFrame:
        stay = old.join(new.select("media_track_id", "window_key"), ["media_track_id", "window_key"], "left_anti").select(*old.columns)
        meets = (F.col("media_track_id") == F.col("_track")) & (F.col("starts_at") < F.col("_to")) & (F.col("ends_at") > F.col("_from"))
        gone = stay.join(where, meets, "left_semi").withColumn("state", F.lit("withdrawn"))
        return stay.join(where, meets, "left_anti").unionByName(gone).unionByName(new.select(*old.columns))

    return table.rewrite(new.select("media_track_id").union(spans.select("media_track_id")), make, batch)
