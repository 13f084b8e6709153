"""A library table in buckets of users, with a manifest that says which files are its current version.

Rows lie in ``data/version=.../bucket=...`` by a hash of their user. A manifest names, for each bucket, the version whose
files hold it, and the file ``CURRENT`` names the manifest. A change reads the buckets of the users that it touches,
writes these anew under a version of its own, and then replaces ``CURRENT`` by a rename, so a reader finds the old table
or the new one, never parts of both, and files of other buckets stay as they are. A change that began from a version that
isn't current any more is refused. Files of older versions stay until ``expire``.

Reads of some users take the buckets of these users only, as partition filters of the scan.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64


class Conflict(RuntimeError):
    """Another change came first."""


def bucket_of(user: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(user.cast("string")), F.lit(buckets)).cast("int")


class Store:
    """A table under ``folder``, which driver and executors share; ``user`` is the column that rows are bucketed by."""

    def __init__(self, spark: SparkSession, folder: str, user: str = "userId"):
        self.spark, self.folder, self.user = spark, folder.rstrip("/"), user
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs

    def _path(self, *parts: str):
        return self.hadoop.Path("/".join([self.folder, *parts]))

    def _files(self):
        return self._path("CURRENT").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _text(self, *parts: str) -> str | None:
        path = self._path(*parts)
        if not self._files().exists(path):
            return None
        stream = self._files().open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _put(self, text: str, *parts: str) -> None:
        stream = self._files().create(self._path(*parts), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def manifest(self) -> dict | None:
        """version, schema, buckets, held (version by bucket) of the current table; None where there is none."""
        name = self._text("CURRENT")
        return json.loads(self._text("manifests", name)) if name else None

    def _publish(self, manifest: dict, began: str | None) -> None:
        name = f"{manifest['version']}.json"
        self._put(json.dumps(manifest), "manifests", name)
        self._put(name, f"CURRENT.{manifest['version']}")
        now = self.manifest()
        if (now and now["version"]) != began:
            raise Conflict(f"the table is at version {now and now['version']}, the change began at {began}")
        context = self.hadoop.FileContext.getFileContext(self._path("CURRENT").toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.hadoop.Options.Rename, 1)
        options[0] = self.hadoop.Options.Rename.OVERWRITE
        context.rename(self._path(f"CURRENT.{manifest['version']}"), self._path("CURRENT"), options)

    def _write(self, rows: DataFrame, version: str, buckets: int) -> list[int]:
        """The buckets that have rows. Each version is a job's output of its own, so changes at the same time don't meet."""
        placed = rows.withColumn("bucket", bucket_of(F.col(self.user), buckets))
        placed.repartition("bucket").write.mode("error").partitionBy("bucket").parquet(f"{self.folder}/data/version={version}")
        path = self._path("data", f"version={version}")
        found = self._files().listStatus(path) if self._files().exists(path) else []
        return [int(name.removeprefix("bucket=")) for name in (s.getPath().getName() for s in found) if name.startswith("bucket=")]

    def create(self, rows: DataFrame, buckets: int = BUCKETS) -> dict:
        """Publish ``rows`` as the whole table, whatever it was before."""
        began, version = self.manifest(), uuid.uuid4().hex
        held = {str(b): version for b in self._write(rows, version, buckets)}
        manifest = {"version": version, "schema": rows.schema.jsonValue(), "buckets": buckets, "held": held}
        self._publish(manifest, began and began["version"])
        return manifest

    def read(self, users: DataFrame | None = None, manifest: dict | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The current table (or that of ``manifest``), with the column ``bucket``; of ``users`` only, if given, a table with the user
        column. Which buckets these are in is looked up first: it is at most the number of buckets."""
        manifest = manifest or self.manifest()
        if manifest is None:
            raise FileNotFoundError(f"no table in {self.folder}")
        schema = T.StructType.fromJson(manifest["schema"])
        if users is not None:
            buckets = [r["b"] for r in users.select(bucket_of(F.col(self.user), manifest["buckets"]).alias("b")).distinct().collect()]
        paths = [f"{self.folder}/data/version={v}/bucket={b}" for b, v in sorted(manifest["held"].items())]
        full = T.StructType([*schema.fields, T.StructField("version", T.StringType()), T.StructField("bucket", T.IntegerType())])
        if not paths:
            return self.spark.createDataFrame([], full).drop("version")
        rows = self.spark.read.schema(full).option("basePath", f"{self.folder}/data").parquet(*paths)
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))
        if users is not None:
            rows = rows.join(users.select(self.user).distinct(), self.user, "left_semi")
        return rows.select(*schema.names, "bucket")

    def change(self, commands: DataFrame, apply: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]) -> tuple[dict, DataFrame]:
        """(manifest, rejects): ``apply(table, commands)`` gives the new rows and rejects of the buckets that the commands' users are
        in; those buckets are written anew and published. Null users are in a bucket as well."""
        began, version = self.manifest(), uuid.uuid4().hex
        if began is None:
            raise FileNotFoundError(f"no table in {self.folder}")
        touched = [r["b"] for r in commands.select(bucket_of(F.col(self.user), began["buckets"]).alias("b")).distinct().collect()]  # at most the number of buckets
        rows, rejects = apply(self.read(manifest=began, buckets=touched).drop("bucket"), commands)
        new = self._write(rows.select(T.StructType.fromJson(began["schema"]).names), version, began["buckets"])
        held = {b: v for b, v in began["held"].items() if int(b) not in touched} | {str(b): version for b in new}
        manifest = began | {"version": version, "held": held}
        self._publish(manifest, began["version"])
        return manifest, rejects

    def expire(self) -> list[str]:
        """Delete the files that the current version doesn't use, for when nobody reads older ones; the versions that lost files."""
        now, gone = self.manifest(), set()
        used = {(v, b) for b, v in now["held"].items()} if now else set()
        root = self._path("data")
        for version in self._files().listStatus(root) if self._files().exists(root) else []:
            name = version.getPath().getName().removeprefix("version=")
            for part in self._files().listStatus(version.getPath()):
                key = part.getPath().getName().removeprefix("bucket=")
                if part.isDirectory() and (name, key) not in used:
                    self._files().delete(part.getPath(), True)
                    gone.add(name)
        return sorted(gone)
