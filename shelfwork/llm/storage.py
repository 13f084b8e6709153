"""Shared-folder tables: how lineage is cut and intermediate results outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` or the context's checkpoint folder. Only a session in one process does with a
    temporary one of its own, the same for all its tables."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if spark.sparkContext.applicationId not in _OWN:
            _OWN[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="shelfwork-")
        found = _OWN[spark.sparkContext.applicationId]
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Has Spark delete the shuffle files of a query when it ends, rather than when the driver's heap is next collected.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: later steps read files, not lineage."""
    path = new_path(df.sparkSession, name)
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stashed = path
    return table


def drop(df: DataFrame) -> None:
    """Delete the folder of a stashed table that nothing reads any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stashed)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of text are long: so many go to a Python worker at once.
BATCH_ROWS = 1000


def short_batches(df: DataFrame) -> None:
    """Lower the session's number of rows in an Arrow batch, whose buffers are held on both sides, if it is higher."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(conf.get(name, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sampled(df: DataFrame, key: str, rows: int, cap: int) -> DataFrame:
    """About ``cap`` of ``rows`` rows, chosen by a hash of ``key``: the same rows on every run and partitioning."""
    from pyspark.sql import functions as F

    if rows <= cap:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(71)), F.lit(1 << 40)) < int((1 << 40) * (cap / rows)))


def fold(doc_id, parts: int):
    """CRC-32 of the doc_id as text, modulo ``parts``; 0 for a null id."""
    from pyspark.sql import functions as F

    return F.coalesce(F.pmod(F.crc32(doc_id.cast("long").cast("string").cast("binary")), F.lit(parts)), F.lit(0)).cast("int")
