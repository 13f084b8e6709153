"""Catalogue: filters, sorting, paging, totals and formats."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from shelfwork.functions.scalars import large_image
from shelfwork.sources.schemas import GAMES, parse

#: Fixed values of the catalogue's answers.
MOST_ROWS, DEFAULT_ROWS, MOST_DIMENSIONS, MOST_LISTED, BEST = 500, 100, 50, 200, 50

#: What the two cards show of a record, by paths. A referenced record's id comes along with its fields.
FULL_CARD = (
    "id", "name", "summary", "storyline", "first_release_date", "genres.name", "platforms.name", "platforms.platform_logo.url", "cover.url", "screenshots.url", "artworks.url",
    "involved_companies.company.name", "involved_companies.publisher", "rating", "aggregated_rating", "follows", "hypes", "game_localizations.name", "game_localizations.region",
    "language_supports.language.name", "language_supports.language_support_type.name", "similar_games.name", "franchise.name", "collection.name", "version_parent", "category", "status",
)
SHORT_CARD = (
    "id", "name", "first_release_date", "genres.name", "platforms.name", "cover.url", "involved_companies.company.name", "involved_companies.publisher", "aggregated_rating",
    "version_parent", "category", "status",
)


def epoch(iso: str) -> Column:
    """Seconds of an ISO date or date-time; without a zone it is UTC."""
    return F.unix_seconds(F.lit(iso).cast("timestamp"))


def released_since(iso: str) -> Column:
    """Games without a date are left out."""
    return F.coalesce(F.col("first_release_date") >= epoch(iso), F.lit(False))


def main_only() -> Column:
    return F.coalesce(F.col("category") == 0, F.lit(False))


def rated() -> Column:
    return F.col("total_rating").isNotNull()


def all_of(*conditions: Column | None) -> Column:
    """AND of those that are given."""
    return reduce(and_, [c for c in conditions if c is not None], F.lit(True))


def matching(dimension: DataFrame, text: str) -> DataFrame:
    """At most 50 rows of a dimension whose name contains the text in any case, by id."""
    return dimension.where(F.contains(F.lower("name"), F.lit(text.lower()))).orderBy("id").limit(MOST_DIMENSIONS)


def having_any(games: DataFrame, dimension: DataFrame, column: str, text: str | None) -> DataFrame:
    """Games with any platform (or genre) whose name matches. If none matches, the filter is left out.

    The ids are one row of at most 50, so it goes along with every partition and no game moves.
    """
    if text is None:
        return games
    ids = matching(dimension, text).agg(F.collect_set("id").alias("__ids"))
    kept = games.crossJoin(F.broadcast(ids)).where((F.size("__ids") == 0) | F.coalesce(F.exists(F.col(column), lambda x: F.array_contains(F.col("__ids"), x["id"])), F.lit(False)))
    return kept.drop("__ids")


def title_rank(title: str) -> tuple[Column, list[Column]]:
    """(condition, order): every word of the title is in the name; exact, prefix, other matches, then shorter names.

    The order of relevance is this library's own choice.
    """
    low, name = title.lower(), F.lower("name")
    condition = reduce(and_, [F.coalesce(F.contains(name, F.lit(w)), F.lit(False)) for w in low.split()], F.lit(True))
    rank = F.when(name == low, 0).when(F.startswith(name, F.lit(low)), 1).otherwise(2)
    return condition, [rank.asc(), F.length("name").asc(), F.col("id").asc()]


def ordering(sort_by: str = "total_rating", direction: str = "desc") -> list[Column]:
    c = F.col(sort_by)
    return [c.asc_nulls_last() if direction.lower() == "asc" else c.desc_nulls_last(), F.col("id").asc()]


def bounds(limit: int | None, offset: int | None) -> tuple[int, int]:
    return min(limit if limit is not None else DEFAULT_ROWS, MOST_ROWS), offset or 0


def page(games: DataFrame, order: list[Column], limit: int | None = None, offset: int | None = None) -> DataFrame:
    """A page in order, with its place in it as ``rank`` (from 0). The page, of 500 rows at most, is numbered, not the table."""
    n, skip = bounds(limit, offset)
    rows = games.orderBy(*order).offset(skip).limit(n)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)


#: Rows that a deep page is cut down to before they are sorted, and the parts that a cut counts.
DEEP, PARTS = 100_000, 32


def _behind(sort_by: str, direction: str, value, key) -> Column:
    """Whether a row comes after (value, key) in the order of ``ordering``."""
    c = F.col(sort_by)
    if value is None:
        return c.isNull() & (F.col("id") > key)
    further = c > F.lit(value) if direction.lower() == "asc" else c < F.lit(value)
    return F.coalesce(further | ((c == F.lit(value)) & (F.col("id") > key)), F.lit(True))


def deep_page(games: DataFrame, sort_by: str = "total_rating", direction: str = "desc", limit: int | None = None, offset: int | None = None, most: int = DEEP) -> DataFrame:
    """The same page as ``page``, for offsets of any depth: no task holds or sorts the rows before it.

    A sample by hash of the ids gives at most 31 places in the order; rows are counted between them, and only the parts that
    the page lies in are looked at further, until these have ``most`` rows at most. Each cut is one scan without a sort or
    shuffle of rows. Ids should be unique: rows that are equal in the sort field and id can't be cut apart.
    """
    n, skip = bounds(limit, offset)
    order, rows, before = ordering(sort_by, direction), games, 0
    left, last = games.count(), None
    while left > max(most, n) and left != last:
        step = max(1, left // (64 * PARTS))
        sample = rows.where(F.pmod(F.xxhash64("id", F.lit(left)), F.lit(step)) == 0).select(F.col(sort_by).alias("v"), F.col("id").alias("k"))
        c = F.col("v").asc_nulls_last() if direction.lower() == "asc" else F.col("v").desc_nulls_last()
        found = sample.orderBy(c, "k").limit(256 * PARTS).collect()
        cuts = [found[len(found) * i // PARTS] for i in range(1, PARTS) if found]
        part = reduce(lambda a, b: a + b, [_behind(sort_by, direction, r["v"], r["k"]).cast("int") for r in cuts], F.lit(0))
        sizes = {r["p"]: r["n"] for r in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
        ends, upto = [], before
        for p in range(len(cuts) + 1):
            upto += sizes.get(p, 0)
            ends.append(upto)
        first = next((p for p, e in enumerate(ends) if e > skip), None)
        if first is None:
            return rows.where(F.lit(False)).withColumn("rank", F.lit(0))
        end = next((p for p, e in enumerate(ends) if e >= skip + n), len(cuts))
        before = ends[first - 1] if first else before
        if first:
            rows = rows.where(_behind(sort_by, direction, cuts[first - 1]["v"], cuts[first - 1]["k"]))
        if end < len(cuts):
            rows = rows.where(~_behind(sort_by, direction, cuts[end]["v"], cuts[end]["k"]))
        last, left = left, sum(sizes.get(p, 0) for p in range(first, end + 1))
    found = rows.orderBy(*order).offset(skip - before).limit(n)
    return found.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)


def total(games: DataFrame) -> DataFrame:
    return games.agg(F.count(F.lit(1)).alias("total"))


def meta(matches: DataFrame | None, shown: DataFrame, limit: int | None, offset: int | None, before: DataFrame | None = None) -> DataFrame:
    """One row: page, limit, offset, total, totalPages, hasMore, and shown before grouping.

    ``matches`` is None for a title search, whose totals are null. ``shown`` are the rows after grouping: it is their
    number that says whether there is more, though the total counts before grouping.
    """
    n, skip = bounds(limit, offset)
    rows = shown.agg(F.count(F.lit(1)).alias("after"))
    first = before.agg(F.count(F.lit(1)).alias("beforeGrouping")) if before is not None else rows.select(F.col("after").alias("beforeGrouping"))
    counted = total(matches) if matches is not None else rows.select(F.lit(None).cast("bigint").alias("total"))
    joined = rows.crossJoin(F.broadcast(first)).crossJoin(F.broadcast(counted))
    pages = F.when(F.col("total") > 0, F.ceil(F.col("total") / F.lit(n)).cast("bigint"))
    return joined.select(
        F.lit(skip // n + 1).cast("bigint").alias("page"), F.lit(n).cast("bigint").alias("limit"), F.lit(skip).cast("bigint").alias("offset"),
        "total", pages.alias("totalPages"), (F.col("after") == n).alias("hasMore"), "beforeGrouping",
    )


def _tree(paths: tuple[str, ...]) -> dict:
    tree: dict = {}
    for path in paths:
        now = tree
        for step in path.split("."):
            now = now.setdefault(step, {})
    return tree


def _part(value: Column, kind: T.DataType, fields: dict) -> Column:
    """``value`` with those of its fields only that are asked for; ids of records stay."""
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _part(x, kind.elementType, fields))
    if not isinstance(kind, T.StructType) or not fields:
        return value
    own = [f for f in kind.fields if f.name in fields or f.name == "id"]
    return F.when(value.isNotNull(), F.struct(*[_part(value[f.name], f.dataType, fields.get(f.name, {})).alias(f.name) for f in own]))


def projected(games: DataFrame, paths: tuple[str, ...]) -> DataFrame:
    """The paths of a card, in their order, by the catalogue's schema. What the input hasn't is null, what it has besides goes."""
    schema = parse(GAMES)
    columns = []
    for name, fields in _tree(paths).items():
        kind = games.schema[name].dataType if name in games.columns else schema[name].dataType
        columns.append(_part(F.col(name) if name in games.columns else F.lit(None).cast(kind), kind, fields).alias(name))
    return games.select(columns)


def full_card(games: DataFrame) -> DataFrame:
    return projected(games, FULL_CARD)


def short_card(games: DataFrame) -> DataFrame:
    return projected(games, SHORT_CARD)


def card(games: DataFrame, short: str | None) -> DataFrame:
    """The short card for any text that isn't empty, ``"0"`` too."""
    return short_card(games) if short else full_card(games)


def listing(games: DataFrame) -> DataFrame:
    """The listing's fields with their defaults and large images; of a short card, what it doesn't show is as if it were null."""
    games = games.withColumns({c: F.lit(None).cast(parse(GAMES)[c].dataType) for c in ("summary", "total_rating") if c not in games.columns})
    shown = "platform_logo" in games.schema["platforms"].dataType.elementType.names
    url, key = (lambda p: p["platform_logo"]["url"], lambda p: p["platform_logo"]["id"]) if shown else (lambda p: F.lit(None).cast("string"), lambda p: F.lit(None).cast("bigint"))
    logo = lambda p: F.struct(large_image(url(p)).alias("url"), key(p).alias("id"))
    platforms = F.transform("platforms", lambda p: F.struct(p["id"].alias("id"), p["name"].alias("name"), logo(p).alias("platform_logo")))
    empty = lambda c, kind: F.coalesce(c, F.from_json(F.lit("[]"), kind))
    return games.select(
        "id", "name", empty(F.col("genres"), "array<struct<id: bigint, name: string>>").alias("genres"),
        empty(platforms, "array<struct<id: bigint, name: string, platform_logo: struct<url: string, id: bigint>>>").alias("platforms"),
        "first_release_date", F.coalesce("summary", F.lit("")).alias("summary"), F.struct(large_image(F.col("cover.url")).alias("url")).alias("cover"), "total_rating",
    )


def platform_list(platforms: DataFrame) -> DataFrame:
    """At most 200 platforms by id, with ``logo``: the large image or null."""
    return platforms.orderBy("id").limit(MOST_LISTED).withColumn("logo", large_image(F.col("platform_logo.url"), None))


def genre_list(genres: DataFrame) -> DataFrame:
    return genres.select("id", "name").orderBy("id").limit(MOST_LISTED)


def best_rated(games: DataFrame) -> DataFrame:
    """The fifty best of the rated games."""
    return games.where(rated()).orderBy(*ordering()).limit(BEST).select("id", "name", "total_rating", "first_release_date", "cover")


def expand_references(games: DataFrame, column: str, dimension: DataFrame, fields: list[str]) -> DataFrame:
    """Replace an array of ids by structs of the referenced rows' fields, in order; unknown ids vanish.

    Only (id, place, reference) is exploded and regrouped, so the wide columns move once.
    """
    narrow = games.select("id", F.posexplode(column).alias("__pos", "__ref"))
    found = narrow.join(dimension.select(F.col("id").alias("__ref"), F.struct(*fields).alias("__row")), "__ref")
    grouped = found.groupBy(F.col("id").alias("__id")).agg(F.array_sort(F.collect_list(F.struct("__pos", "__row"))).alias("__rows"))
    rows = games.join(grouped, F.col("id") == F.col("__id"), "left")
    kind = found.schema["__row"].dataType.simpleString()
    value = F.coalesce(F.transform("__rows", lambda x: x["__row"]), F.from_json(F.lit("[]"), f"array<{kind}>"))
    return rows.withColumn(column, F.when(F.col(column).isNotNull(), value)).drop("__id", "__rows")


#: Levels of nested spans of time, each of SPAN of the level below; seconds from 2 ** 35 before to 2 ** 35 after 1970.
LEVELS, SPAN_BITS = 9, 4
_START = 1 << 35


def _at(level: int):
    return lambda span: F.struct(F.lit(level).alias("level"), span.alias("span"))


def _later(since: Column) -> Column:
    """(level, span) of the spans that together hold all times from ``since`` on: at most 16 of each level; null: the whole."""
    at = F.greatest(F.lit(0), F.least(F.lit((1 << 36) - 1), since + _START)).cast("bigint")
    found = []
    for level in range(LEVELS):
        own = F.shiftright(at, SPAN_BITS * level)
        first, last = (own if level == 0 else own + 1), F.shiftleft(F.shiftright(own, SPAN_BITS), SPAN_BITS) + (1 << SPAN_BITS) - 1
        spans = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
        found.append(F.transform(spans, _at(level)))
    whole = F.array(F.struct(F.lit(LEVELS).alias("level"), F.lit(0).cast("bigint").alias("span")))
    return F.when(since.isNull(), whole).otherwise(F.flatten(F.array(*found)))


def _spans(time: Column) -> Column:
    """The span of each level that holds a time; a game without one is in the whole only."""
    at = F.greatest(F.lit(0), F.least(F.lit((1 << 36) - 1), time + _START)).cast("bigint")
    own = [F.struct(F.lit(level).alias("level"), F.shiftright(at, SPAN_BITS * level).cast("bigint").alias("span")) for level in range(LEVELS)]
    whole = F.struct(F.lit(LEVELS).alias("level"), F.lit(0).cast("bigint").alias("span"))
    return F.when(time.isNull(), F.array(whole)).otherwise(F.array(*own, whole))


def _by_request_order() -> list[Column]:
    """Nulls last, then as sort_by and direction of the row say, then by id."""
    number = F.when(F.col("sort_by") == "total_rating", F.col("total_rating")).when(F.col("sort_by") == "first_release_date", F.col("first_release_date").cast("double"))
    whole = F.when(F.col("sort_by") == "id", F.col("id"))
    text, up = F.when(F.col("sort_by") == "name", F.col("name")), F.col("direction") == "asc"
    return [F.coalesce(number.cast("string"), whole.cast("string"), text).isNull(), F.when(up, number).asc(), F.when(~up, number).desc(), F.when(up, text).asc(), F.when(~up, text).desc(), F.when(~up, whole).desc(), F.col("id").asc()]


def _substrings(text: Column) -> Column:
    """All different substrings, the empty one too. Names of a dimension are short."""
    n = F.length(text)
    every = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substring(text, i, k))))
    return F.array_distinct(F.concat(F.array(F.lit("")), F.when(n > 0, every).otherwise(F.array().cast("array<string>"))))


#: The fields that an answer can be sorted by.
SORTS = ("total_rating", "first_release_date", "name", "id")
