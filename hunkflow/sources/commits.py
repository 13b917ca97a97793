"""Tables that change together, by one commit.

A commit writes new folders of Parquet first and then one small manifest that
lists all folders of all tables. Readers take the latest manifest, so they see
all of a commit or nothing of it, and a job that fails half-way leaves folders
that nobody lists. Manifests are numbered and published by a rename that fails
where the number is taken: the writer who lost reads the winner's and tries again.
Each names the last batch of every writer, so a batch that runs again is skipped.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRIES = 20
NOTHING: dict[str, Any] = {"version": 0, "tables": {}, "batches": {}}


class Store:
    """Tables under ``path``, in a file system that drivers and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict[str, Any]:
        """The latest manifest; version 0 before the first commit."""
        where, fs = self._fs(f"{self.path}/_commits")
        names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        versions = sorted(n for n in names if n.endswith(".json"))
        if not versions:
            return json.loads(json.dumps(NOTHING))
        return json.loads(self.spark.read.text(f"{self.path}/_commits/{versions[-1]}", wholetext=True).first()[0])

    def _publish(self, manifest: dict[str, Any]) -> bool:
        jvm = self.spark.sparkContext._jvm
        name = f"{self.path}/_commits/{manifest['version']:012d}.json"
        temporary, fs = self._fs(f"{self.path}/_commits/.{uuid.uuid4().hex}")
        out = fs.create(temporary, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(temporary, self._fs(name)[0], options)
        except Exception as e:  # what Java throws reaches Python as one class
            if "FileAlreadyExists" not in str(e):
                raise
            fs.delete(temporary, False)
            return False
        return True

    def commit(self, append: dict[str, DataFrame] | None = None, replace: Callable[[dict[str, list[str]]], dict[str, list[str]]] | None = None, batch: tuple[str, int] | None = None) -> int | None:
        """Appends to tables and publishes; the new version, or None for a
        ``batch`` (writer, number) that was published before. ``replace`` gets the
        folders of all tables and gives those of the tables it changes."""
        if batch and self._done(self.manifest(), batch):
            return None
        fresh = {name: self.write(name, df) for name, df in (append or {}).items()}
        for _ in range(TRIES):
            now = self.manifest()
            if batch and self._done(now, batch):
                return None
            tables = now["tables"] | {n: [*now["tables"].get(n, []), folder] for n, folder in fresh.items()}
            if replace:
                tables |= replace(tables)
            now = {"version": now["version"] + 1, "tables": tables, "batches": now["batches"] | ({batch[0]: batch[1]} if batch else {})}
            if self._publish(now):
                return now["version"]
        raise RuntimeError(f"{TRIES} other commits came in between")

    @staticmethod
    def _done(manifest: dict[str, Any], batch: tuple[str, int]) -> bool:
        return manifest["batches"].get(batch[0], -1) >= batch[1]

    def write(self, name: str, df: DataFrame) -> str:
        """A folder that no manifest lists yet."""
        folder = f"data/{name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        return folder

    def read(self, name: str, schema: str | None = None, version: str | None = None) -> DataFrame | None:
        """A table as of the latest commit, or None. ``version``: a column for
        the place of a row's folder among the table's."""
        folders = self.manifest()["tables"].get(name, [])
        if not folders:
            return None
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        rows = reader.parquet(*(f"{self.path}/{f}" for f in folders))
        if version:
            places = self.spark.createDataFrame([(f.rsplit("/", 1)[1], i) for i, f in enumerate(folders)], f"_folder string, {version} int")
            rows = rows.withColumn("_folder", F.element_at(F.split(F.input_file_name(), "/"), -2)).join(F.broadcast(places), "_folder").drop("_folder")
        return rows

    def clean(self) -> int:
        """Deletes data that the latest manifest doesn't list; how many folders.
        For times without writers, or readers of older versions."""
        listed = {f for folders in self.manifest()["tables"].values() for f in folders}
        where, fs = self._fs(f"{self.path}/data")
        gone = 0
        for table in fs.listStatus(where) if fs.exists(where) else []:
            for folder in fs.listStatus(table.getPath()):
                if f"data/{table.getPath().getName()}/{folder.getPath().getName()}" not in listed:
                    gone += fs.delete(folder.getPath(), True)
        return gone


def save_scans(store: Store, scans: DataFrame, findings: DataFrame, batch: tuple[str, int] | None = None) -> int | None:
    """Parents and children in one commit: ``scans`` with a key ``id`` made from
    writer, batch and ``scan_id``, and ``findings`` that refer to it by
    ``scan_ref``. A finding of a scan that isn't among them is an error."""
    own = F.sha2(F.concat_ws("/", F.lit(f"{batch}" if batch else uuid.uuid4().hex), F.col("scan_id").cast("string")).cast("binary"), 256)
    lost = findings.join(scans.select("scan_id"), "scan_id", "left_anti").limit(1).count()
    if lost:
        raise ValueError("a finding refers to a scan that is not saved with it")
    return store.commit({"scans": scans.withColumn("id", own), "findings": findings.withColumn("scan_ref", own)}, batch=batch)
