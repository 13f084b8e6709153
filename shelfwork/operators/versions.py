"""Grouping of editions under their parent game."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwork.sources.tables import saved


def group_versions(page: DataFrame, catalogue: DataFrame, strict: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each parent, with its versions in page order; rows come with their place in ``place``.

    ``page`` has ``id, name, cover, category, version_parent, rank``; a ``version_parent`` of null or 0 makes a game a
    main one. A parent that the page lacks is fetched from ``catalogue`` (unfiltered). Versions of a parent that isn't
    in the catalogue become rows of their own, last, by parent and rank. Chains of parents aren't followed.

    ``strict`` adds two traits of the original: versions ranked before their parent in the page are lost, and an unknown
    parent leaves an empty row.

    With ``by``, columns that tell pages of many requests apart, each page is grouped on its own; parents that any page
    lacks are fetched once for all. These columns come first in the result.

    Result: place (0 for groups, 1 for orphans), group (the parent's id), rank (orphans only), id, name, cover, category,
    fetched, versions (array of structs rank, id, name, cover).
    """
    parent = F.coalesce("version_parent", F.lit(0))
    rows = page.withColumn("main", parent == 0).withColumn("group", F.when(parent != 0, parent).otherwise(F.col("id")))
    head = F.struct("rank", "id", "name", "cover", "category")
    version = F.struct("rank", "id", "name", "cover", "category")
    groups = rows.groupBy(*by, "group").agg(
        F.max(F.when(F.col("main"), head)).alias("head"), F.array_sort(F.collect_list(F.when(~F.col("main"), version))).alias("versions")
    )
    if strict:
        groups = groups.withColumn("versions", F.when(F.col("head").isNull(), F.col("versions")).otherwise(F.filter("versions", lambda v: v["rank"] > F.col("head.rank"))))
    if by:  # read by each part of the result; of one page they are few
        groups = saved(groups, "groups")
    # the catalogue is met by the ids that are missing, then the few hits by the groups
    missing = groups.where("head is null").select(F.col("group").alias("id")).distinct()
    missing = missing.hint("merge") if by else missing  # of one page they are few
    hits = catalogue.join(missing, "id", "left_semi").select(F.col("id").alias("h_id"), F.col("name").alias("h_name"), F.col("cover").alias("h_cover"), F.col("category").alias("h_category"))
    full = groups.join(hits.hint("merge"), (F.col("group") == F.col("h_id")) & F.col("head").isNull(), "left")
    known = F.col("head").isNotNull() | F.col("h_id").isNotNull()
    pick = lambda c: F.when(F.col("head").isNotNull(), F.col(f"head.{c}")).otherwise(F.col(f"h_{c}"))
    none = F.filter("versions", lambda v: F.lit(False))
    grouped = full.where(known | F.lit(strict)).select(
        *by, F.lit(0).alias("place"), "group", F.lit(None).cast("bigint").alias("rank"), pick("id").alias("id"), pick("name").alias("name"), pick("cover").alias("cover"), pick("category").alias("category"),
        (F.col("head").isNull() & F.col("h_id").isNotNull()).alias("fetched"), F.when(known, F.col("versions")).otherwise(none).alias("versions"),
    )
    orphans = full.where(~known).select(*by, "group", F.explode("versions").alias("v"), none.alias("versions")).select(
        *by, F.lit(1).alias("place"), "group", F.col("v.rank").cast("bigint").alias("rank"), F.col("v.id").alias("id"), F.col("v.name").alias("name"), F.col("v.cover").alias("cover"), F.col("v.category").alias("category"),
        F.lit(False).alias("fetched"), "versions",
    )
    return grouped.unionByName(orphans)


def in_order(groups: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Groups by ascending id, then orphans by parent and rank, of each page."""
    return groups.orderBy(*by, "place", "group", F.col("rank").asc_nulls_first())
