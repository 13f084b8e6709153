"""Users' libraries: listings, categories with counts, lookups and pages, for all users at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfwork.functions.scalars import names, page_parameters, slug


def owned_by(rows: DataFrame, users: DataFrame | str) -> DataFrame:
    """Rows of one user, or of all users in a table of ``userId``."""
    if isinstance(users, DataFrame):
        return rows.join(users.select("userId").distinct(), "userId", "left_semi")
    return rows.where(F.col("userId") == users)


def in_category(backlogs: DataFrame, category_id) -> DataFrame:
    return backlogs.where(F.coalesce(F.array_contains("categories", category_id), F.lit(False)))


def in_categories(backlogs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(category_id, entry columns) for many categories: explode and join by equality."""
    return backlogs.withColumn("category_id", F.explode(F.array_distinct("categories"))).join(wanted.select("category_id").distinct(), "category_id")


def in_category_if_owned(backlogs: DataFrame, categories: DataFrame, requests: DataFrame, strict_reference: bool = False) -> DataFrame:
    """Entries of each request's user (userId, category_id): filtered by the category if it is the user's own.

    ``strict_reference`` never filters, as the original does in effect.
    """
    own = categories.select(F.col("_id").alias("category_id"), "userId", F.lit(True).alias("__own"))
    asked = requests.select("userId", "category_id").join(own, ["category_id", "userId"], "left")
    rows = backlogs.join(asked.withColumnRenamed("category_id", "__wanted"), "userId")
    if not strict_reference:
        rows = rows.where(F.col("__own").isNull() | F.coalesce(F.array_contains(F.col("categories"), F.col("__wanted")), F.lit(False)))
    return rows.drop("__own", "__wanted")


def populate(backlogs: DataFrame, categories: DataFrame) -> DataFrame:
    """Category ids become (_id, name) in their order; unknown ids vanish. Owners aren't compared."""
    narrow = backlogs.select(F.col("_id").alias("__entry"), F.posexplode("categories").alias("__pos", "__cat"))
    found = narrow.join(categories.select(F.col("_id").alias("__cat"), F.struct("_id", "name").alias("__row")), "__cat")
    grouped = found.groupBy("__entry").agg(F.transform(F.array_sort(F.collect_list(F.struct("__pos", "__row"))), lambda x: x["__row"]).alias("__rows"))
    kind = found.schema["__row"].dataType.simpleString()
    rows = backlogs.join(grouped, F.col("_id") == F.col("__entry"), "left")
    return rows.withColumn("categories", F.coalesce("__rows", F.from_json(F.lit("[]"), f"array<{kind}>"))).drop("__entry", "__rows")


def short_view(populated: DataFrame) -> DataFrame:
    data = lambda c: F.col(f"igdb_data.{c}")
    return populated.select(F.col("_id").alias("id"), data("name").alias("name"), names(data("genres")).alias("genres"), names(F.col("categories")).alias("categories"), names(data("platforms")).alias("platforms"), data("cover").alias("cover"))


def detail_view(populated: DataFrame) -> DataFrame:
    return populated.withColumn("categories", F.transform("categories", lambda x: F.struct(x["_id"].alias("id"), x["name"].alias("name"))))


def lookup(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Each key (_id, userId) with the row it names and ``found``; a key of another owner's row isn't found."""
    return keys.select("_id", "userId").join(rows.withColumn("found", F.lit(True)), ["_id", "userId"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def games_per_category(backlogs: DataFrame) -> DataFrame:
    """userId, category_id, countGames: entries, a repeated id inside one counted once."""
    return backlogs.select("userId", F.explode(F.array_distinct("categories")).alias("category_id")).groupBy("userId", "category_id").agg(F.count(F.lit(1)).alias("countGames"))


def category_list(categories: DataFrame, backlogs: DataFrame) -> DataFrame:
    """Every category with its slug and its number of games, 0 included."""
    counts = games_per_category(backlogs).withColumnRenamed("category_id", "_id")
    return categories.join(counts, ["userId", "_id"], "left").select("_id", "userId", "name", slug(F.col("name")).alias("slug"), F.coalesce("countGames", F.lit(0)).cast("bigint").alias("countGames"))


def backlog_page(backlogs: DataFrame, page: Column, limit: Column, paginate: bool = False) -> DataFrame:
    """Entries of all users with page, limit and offset; all of them unless ``paginate``, as the original reports a page
    without applying it."""
    p = page_parameters(page, limit)
    rows = backlogs.withColumns({"page": p["page"], "limit": p["limit"], "offset": p["offset"]})
    if not paginate:
        return rows
    w = Window.partitionBy("userId").orderBy("_id")
    return rows.withColumn("__n", F.row_number().over(w)).where((F.col("__n") > F.col("offset")) & (F.col("__n") <= F.col("offset") + F.col("limit"))).drop("__n")


def sorted_page(backlogs: DataFrame, categories: DataFrame, category_name: str, sort_by: Column, direction: str = "asc", limit: int = 10, offset: int = 0) -> DataFrame:
    """Of each user the entries of the category of that name, sorted and cut to a page."""
    own = categories.where(F.col("name") == category_name).select("userId", F.col("_id").alias("category_id"))
    rows = backlogs.withColumn("category_id", F.explode(F.array_distinct("categories"))).join(own, ["userId", "category_id"])
    key = sort_by.asc_nulls_last() if direction.lower() == "asc" else sort_by.desc_nulls_last()
    w = Window.partitionBy("userId").orderBy(key, "_id")
    return rows.withColumn("place", F.row_number().over(w)).where((F.col("place") > offset) & (F.col("place") <= offset + limit))
