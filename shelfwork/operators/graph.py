"""Connected components of rows that share keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwork.sources.tables import saved


def shared_keys(rows: DataFrame, node: str, keys: tuple[str, ...]) -> DataFrame:
    """(a, b): each row linked to the least row with the same value of a key. Nulls are shared with nobody."""
    found = None
    for key in keys:
        own = rows.where(F.col(key).isNotNull()).select(F.col(node).alias("a"), F.col(key).alias("k"))
        one = own.join(own.groupBy("k").agg(F.min("a").alias("b")), "k").where("a <> b").select("a", "b")
        found = one if found is None else found.unionByName(one)
    return found


def _to_least(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node go to the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _down(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the least of these."""
    low = edges.groupBy("a").agg(F.min("b").alias("low"))
    others = edges.join(low, "a").where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return others.unionByName(low.select("a", F.col("low").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b); root is the least node of its component. The number of steps grows with
    the logarithm of the longest path; each writes its edges to the shared folder."""
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    known = None
    while True:
        sign = now.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("a", "b"), 20))).first()
        if sign == known:
            break
        known, now = sign, saved(_down(_to_least(now)), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
