"""Reading landed records and library tables, writing new versions of tables and API-shaped JSON."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwork.sources.schemas import SCHEMAS, parse


def read(spark: SparkSession, name: str, path: str, kind: str = "parquet") -> DataFrame:
    """A table of ``SCHEMAS`` from JSON lines or Parquet; fields that a record lacks are null, unknown ones are dropped."""
    reader = spark.read.schema(parse(SCHEMAS[name]))
    return reader.json(path) if kind == "json" else reader.parquet(path)


def scratch_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` or the context's checkpoint folder says. Only a session in one process does
    with a temporary one of its own; on a cluster the setting has to be there."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if spark.sparkContext.applicationId not in _OWN:
            _OWN[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="shelfwork-")
        found = _OWN[spark.sparkContext.applicationId]
    return found.rstrip("/")


_OWN: dict[str, str] = {}


def saved(rows: DataFrame, name: str) -> DataFrame:
    """Write ``rows`` to the shared folder and read them back: what several steps use is worked out once, and outlives lost
    executors. The files stay until that folder is cleared."""
    path = f"{scratch_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def write_version(table: DataFrame, folder: str, *partition_by: str) -> str:
    """Write a new version of a table beside its older ones and return its path; no version is written over."""
    path = f"{folder.rstrip('/')}/v-{uuid.uuid4().hex}"
    table.write.mode("error").partitionBy(*partition_by).parquet(path)
    return path


def json_rows(rows: DataFrame, *order_by) -> DataFrame:
    """One ``json`` column; null fields are left out, as in the API's answers."""
    return rows.orderBy(*order_by).select(F.to_json(F.struct("*")).alias("json")) if order_by else rows.select(F.to_json(F.struct("*")).alias("json"))


def write_answer(data: DataFrame, meta: DataFrame, folder: str) -> None:
    """``data`` and ``meta`` of an answer as JSON lines."""
    data.write.mode("error").json(f"{folder}/data")
    meta.write.mode("error").json(f"{folder}/meta")
