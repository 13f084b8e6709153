"""Decisions on rows, given by (doc_id, row_hash), applied to a table of documents with any columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from shelfwork.llm.storage import stash

#: Decisions are broadcast up to this many rows of two numbers; beyond, documents are joined by shuffle.
FEW = 200_000


def keyed(docs: DataFrame) -> DataFrame:
    """The rows as structs, so that columns may have any names, with what they are known by."""
    own = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    return docs.select(F.struct(*own).alias("row"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64(F.col("text").cast("string")).alias("hash"))


def _names(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("doc_id").alias("d"), F.col("row_hash").alias("h")).distinct()


def _join(docs: DataFrame, names: DataFrame, how: str) -> DataFrame:
    same = F.col("doc").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("h"))
    return docs.join(F.broadcast(names) if names.count() <= FEW else names, same, how)


def keep(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``found`` (doc_id, row_hash, kept; a row for each) keeps, with the columns of ``docs``.

    Of rows that are the same in doc_id and text, of which some are kept and others not, the first by its columns stays.
    """
    found = stash(found.select("doc_id", "row_hash", "kept"), "found")
    dropped = stash(_names(found.where("not kept")), "dropped")
    same = F.col("a.d").eqNullSafe(F.col("b.d")) & (F.col("a.h") == F.col("b.h"))
    torn = stash(_names(found.where("kept")).alias("a").join(dropped.alias("b"), same, "left_semi"), "torn")
    rest = _join(keyed(docs), dropped, "left_anti").select("row.*")
    if torn.isEmpty():
        return rest
    ordered = [F.col("row")[f.name] for f in docs.schema.fields if isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.VariantType)]
    w = Window.partitionBy("doc", "hash").orderBy(*ordered)
    once = _join(keyed(docs), torn, "left_semi").withColumn("n", F.row_number().over(w)).where("n = 1")
    return rest.union(once.select("row.*"))
