"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words: a share of the total by its weight, at most ``cap`` times its own size, the excess
reshared by weight. A document is expected ``target / source size`` times; the whole part is allocated as certain
copies and the rest is an inclusion probability ``p``. Documents are ranked by random odds over inclusion odds,
``u / (1 - u) / (p / (1 - p))``, and the first in that order are taken until the source's remaining words are met: of
the document that crosses the mark the nearer side decides, so a source is off by half a document at most.

Inside a source, p is in proportion to ``measure``, at most 1 (such documents are certain and come first): the name of a
column, or a function of the size; by default the number of binary digits of the size, so longer documents are likelier.

No source is sorted in one task: order keys are counted in buckets (source x 4096), the bucket with the mark is counted
again in 4096 finer ones, and only the documents of that one are ordered.

Defined results: null or empty text has size 0 and is never taken; a null source is a source, last in order; ``u`` comes
from the doc_id, so repeated rows share a rank; of those that differ in text or source the lesser hash comes first, equal
ones count each; an empty table gives an empty result; other columns don't matter, whatever their names. Reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from shelfwork.llm.storage import drop, stash

WORD = r"[^\x20\x09-\x0D]+"
FINE = 4096


def words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long")
    return (h.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sources: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``sources`` (source, source_size; a row for each) with target: weights go round by code point, null last.

    The capped shares are found at once: with sources ordered by cap * size / weight, the first of them are at their
    cap and the others share what is left by weight. Only counts by source are in these windows, never documents.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (turn + 1).cast("int"))
    rows = sources.withColumn("weight", w).withColumn("most", F.col("source_size") * F.lit(cap))
    by = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
    level = (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    rows = rows.withColumn("level", level).withColumn("turn", F.row_number().over(by))
    # the level that holds: the first at which the source in turn is not above its cap
    free = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct("turn", "level"))).over(Window.partitionBy())
    rows = rows.withColumn("free", free["level"])
    return rows.withColumn("target", F.when(F.col("free").isNull(), F.col("most")).otherwise(F.least("most", F.col("free") * F.col("weight")))).drop("level", "free", "most", "turn")


def _once(value: Column) -> Column:
    """A column that is worked out once a row, however often later expressions ask for it: a generator is a step of its own."""
    return F.explode(F.array(value))


def binary_digits(size: Column) -> Column:
    return F.length(F.bin(size))


def _described(docs: DataFrame, measure: str | Callable[[Column], Column] | None) -> DataFrame:
    """row (all columns of ``docs``), doc_id, source, row_hash, size, m."""
    text = F.col("text").cast("string")
    named = F.col(f"`{measure}`") if isinstance(measure, str) else F.lit(1.0)
    rows = docs.select(
        F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(text).alias("row_hash"),
        _once(words(text)).alias("size"), F.greatest(F.coalesce(named.cast("double"), F.lit(0.0)), F.lit(0.0)).alias("m"),
    )
    return rows.withColumn("m", measure(F.col("size")).cast("double")) if callable(measure) else rows


def _ranked(rows: DataFrame, seed: str) -> DataFrame:
    """With rank_key in (0, 1), random odds over inclusion odds in their order, and its two buckets; null is never taken."""
    u, q = F.col("u"), F.col("q")
    rows = rows.withColumn("p", F.col("m") * F.col("rate")).withColumn("u", _once(uniform(F.col("doc_id"), seed)))
    # what is certain comes first
    rows = rows.withColumn("q", F.when((F.col("p") > 0) & (F.col("p") < 1), u / (1 - u) * (1 - F.col("p")) / F.col("p")))
    rows = rows.withColumn("rank_key", _once(F.when(F.col("size") == 0, F.lit(None)).when(F.col("p") >= 1, F.lit(0.0)).otherwise(q / (1 + q)))).drop("u", "q")
    cell = lambda scale, x: F.least(F.floor(x * scale), F.lit(scale - 1)).cast("int")
    return rows.withColumn("b1", cell(FINE, F.col("rank_key"))).withColumn("b2", cell(FINE, F.col("rank_key") * FINE - F.col("b1")))


def _with_marks(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """``rows`` with their source's row of ``marks``."""
    own = marks.withColumnRenamed("source", "__source")
    return rows.join(F.broadcast(own) if _few(marks) else own, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


def _extra() -> Column:
    """1 or 0 copies beside the whole ones; null in the bucket with the mark, where documents are ordered."""
    # without a mark in a source all that can be taken is taken
    below = (F.col("b1") < F.col("c1")) | F.col("c1").isNull() | ((F.col("b1") == F.col("c1")) & ((F.col("b2") < F.col("c2")) | F.col("c2").isNull()))
    return F.when(F.col("rank_key").isNull() | (F.col("rest") <= 0), 0).when(below, 1).when((F.col("b1") == F.col("c1")) & (F.col("b2") == F.col("c2")), F.lit(None)).otherwise(0)


def _plan(docs: DataFrame, weights, share: float, cap: float, seed: str, measure) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ranked rows without their texts, a row of targets and marks for each source, rows taken at the mark)."""
    base = stash(_described(docs, measure).drop("row").withColumn("uid", F.monotonically_increasing_id()), "sizes")
    by_source = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("m")).alias("weighed"))
    goal = stash(targets(by_source, weights, share, cap), "targets")
    # whole copies leave a remainder of the target for which p * size sums up over the source
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goal = goal.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("rate", F.when(F.col("weighed") > 0, F.col("rest") / F.col("weighed")).otherwise(F.lit(0.0)))
    goal = stash(goal.select("source", "source_size", "target", "whole", "rest", "rate"), "targets")
    rows = stash(_ranked(_with_marks(base, goal), seed), "ranked")
    drop(base)
    key = ["source", "rest"]
    cut1 = _cut(rows.where("b1 is not null").groupBy(*key, "b1").agg(F.sum("size").alias("n")).withColumn("done", F.lit(0).cast("long")), key, "b1")
    edge1 = _held(rows, cut1, "b1")
    cut2 = _cut(edge1.groupBy(*key, "b2", "done").agg(F.sum("size").alias("n")), key, "b2")
    edge2 = _held(edge1.drop("done"), cut2, "b2")
    w = Window.partitionBy("source").orderBy("rank_key", "doc_id", "row_hash", "uid")
    after = F.col("done") + F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))
    last = edge2.withColumn("after", after).where((F.col("after") - F.col("size") < F.col("rest")) & (F.col("after") - F.col("rest") <= F.col("rest") - (F.col("after") - F.col("size"))))
    last = stash(last.select("uid", "doc_id", "row_hash", "source"), "taken")
    c1 = cut1.select(F.col("source").alias("s1"), F.col("b1").alias("c1"))
    c2 = cut2.select(F.col("source").alias("s2"), F.col("b2").alias("c2"))
    marks = goal.join(c1, F.col("source").eqNullSafe(F.col("s1")), "left").join(c2, F.col("source").eqNullSafe(F.col("s2")), "left").drop("s1", "s2")
    return rows, stash(marks, "marks"), last


def pareto_mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix:", measure: str | Callable[[Column], Column] | None = binary_digits) -> DataFrame:
    """uid, doc_id, source, row_hash, size, source_size, target, copies (whole times the mix takes the document), taken (words)."""
    rows, marks, last = _plan(docs, weights, share, cap, seed, measure)
    out = _with_marks(rows, marks.select("source", "c1", "c2")).withColumn("extra", _extra()).join(last.select("uid", F.lit(1).alias("in")), "uid", "left")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce("extra", "in", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return out.select("uid", "doc_id", "source", "row_hash", "size", "source_size", F.col("target").cast("double").alias("target"), copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix:", measure: str | Callable[[Column], Column] | None = binary_digits) -> DataFrame:
    """The rows of ``docs``, with its columns, as many times as ``pareto_mix`` takes them.

    No text is shuffled: a row's rank is worked out where it is, by the marks of its source. Only the documents at a mark
    are joined with what is taken of them; of those that are the same in doc_id, text and source the first ones by
    their columns are taken.
    """
    _, marks, last = _plan(docs, weights, share, cap, seed, measure)
    rows = _ranked(_with_marks(_described(docs, measure), marks), seed).withColumn("extra", _extra()).where("size > 0")
    sure = rows.where("extra is not null or rank_key is null").select("row", (F.col("whole") + F.coalesce("extra", F.lit(0))).alias("copies"))
    edge = rows.where("extra is null and rank_key is not null")
    same = Window.partitionBy("doc_id", "row_hash", "source").orderBy(*[F.col("row")[f.name] for f in docs.schema.fields if _orderable(f.dataType)])
    taken = last.groupBy(F.col("doc_id").alias("d"), F.col("row_hash").alias("h"), F.col("source").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    met = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_hash") == F.col("h")) & F.col("source").eqNullSafe(F.col("s"))
    edge = edge.withColumn("k", F.row_number().over(same)).join(taken, met, "left").select("row", (F.col("whole") + (F.col("k") <= F.coalesce("n", F.lit(0))).cast("int")).alias("copies"))
    every = sure.unionByName(edge).where("copies > 0")
    return every.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def _orderable(kind: T.DataType) -> bool:
    return isinstance(kind, T.AtomicType) and not isinstance(kind, T.VariantType)


#: A table of sources is broadcast only up to this many rows.
FEW_SOURCES = 100_000


def _few(goal: DataFrame) -> bool:
    return goal.count() <= FEW_SOURCES


def _cut(counts: DataFrame, key: list[str], bucket: str) -> DataFrame:
    """For each source the bucket in which the running size meets what is to be taken, and the size before it."""
    w = Window.partitionBy("source").orderBy(bucket)
    rows = counts.withColumn("upto", F.col("done") + F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    hit = rows.where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("n") < F.col("rest")))
    return stash(hit.select("source", bucket, (F.col("upto") - F.col("n")).alias("done")), "cut")


def _held(rows: DataFrame, cut: DataFrame, bucket: str) -> DataFrame:
    c = cut.select(F.col("source").alias("__s"), F.col(bucket).alias("__b"), "done")
    return rows.join(c, F.col("source").eqNullSafe(F.col("__s")) & (F.col(bucket) == F.col("__b"))).drop("__s", "__b")

