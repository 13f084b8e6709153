"""Validation: rows with ``reasons``, an array of what is wrong, and the split by it. Unknown fields are dropped by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of an entry's status.
STATUSES = ("Zerado", "Jogando", "Dropado", "Wishlist")


def reasons(**bad: Column) -> Column:
    """Names of the conditions that hold; a null condition doesn't."""
    return F.array_compact(F.array(*(F.when(c, F.lit(code)) for code, c in bad.items())))


def entry_reasons() -> Column:
    data, player = F.col("igdb_data"), F.col("player_data")
    return reasons(
        NO_USER=F.col("userId").isNull(), NO_CATEGORIES=F.col("categories").isNull(), NO_GAME_ID=data["id"].isNull(), NO_GAME_NAME=data["name"].isNull(),
        BAD_STATUS=~player["status"].isin(*STATUSES), BAD_RATING=~player["rating"].between(0, 10),
    )


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` has it."""
    return F.transform(F.array(value), use)[0]


def _kind(parsed: Column, field: str) -> Column:
    """What a field of a parsed command is, as Spark names types of variants; null where it is null or missing."""
    return _once(F.variant_get(parsed, f"$.{field}", "variant"), lambda value: F.when(~F.is_variant_null(value), F.schema_of_variant(value)))


def create_reasons(body: str = "body") -> Column:
    """Of a create command as JSON text: category_ids is an array of strings (it may be empty), igdb_data an object,
    player_data an object if it is given."""

    def found(parsed: Column) -> Column:
        ids, game, player = (_kind(parsed, f) for f in ("category_ids", "igdb_data", "player_data"))
        return reasons(
            BAD_BODY=F.col(body).isNotNull() & parsed.isNull(), BAD_CATEGORY_IDS=~F.coalesce(ids.isin("ARRAY<STRING>", "ARRAY<VOID>") & ~_holds_null(parsed), F.lit(False)),
            BAD_GAME=~F.coalesce(game.startswith("OBJECT<"), F.lit(False)), BAD_PLAYER=~player.startswith("OBJECT<"),
        )

    return _once(F.try_parse_json(F.col(body)), found)


def _holds_null(parsed: Column) -> Column:
    ids = F.try_variant_get(parsed, "$.category_ids", "array<string>")
    return F.coalesce(F.exists(ids, lambda x: x.isNull()), F.lit(False))


def update_reasons(body: str = "body") -> Column:
    """Of an update command as JSON text: what is given of categories, igdb_data and player_data is an array or an object."""

    def found(parsed: Column) -> Column:
        categories, game, player = (_kind(parsed, f) for f in ("categories", "igdb_data", "player_data"))
        return reasons(BAD_BODY=F.col(body).isNotNull() & parsed.isNull(), BAD_CATEGORIES=~categories.startswith("ARRAY<"), BAD_GAME=~game.startswith("OBJECT<"), BAD_PLAYER=~player.startswith("OBJECT<"))

    return _once(F.try_parse_json(F.col(body)), found)


def category_reasons() -> Column:
    return reasons(NO_NAME=F.col("name").isNull())


def user_reasons() -> Column:
    well = F.col("email").rlike(r"^[^@\s]+@[^@\s.]+(\.[^@\s.]+)+$")
    return reasons(BAD_EMAIL=~F.coalesce(well, F.lit(False)), SHORT_PASSWORD=F.coalesce(F.length("password"), F.lit(0)) < 6)


def search_reasons() -> Column:
    """Numbers are texts with an optional sign and fraction. A limit below 1 is refused here, as pages would be divided by it."""
    number = lambda c: ~F.col(c).rlike(r"^[+-]?([0-9]*\.)?[0-9]+$")
    date = F.col("releaseDate")
    return reasons(
        BAD_DATE=date.isNotNull() & (~date.rlike(r"^\d{4}-") | date.try_cast("timestamp").isNull()), BAD_LIMIT=number("limit") | (F.col("limit").try_cast("double") < 1), BAD_OFFSET=number("offset"), BAD_PAGE=number("page"),
        BAD_SHORT=number("short"), BAD_LAST_RATING=number("lastRating"), BAD_ORDER=~F.col("order").isin("asc", "desc"),
    )


def judged(rows: DataFrame, found: Column) -> DataFrame:
    """All rows with their ``reasons``, in one pass."""
    return rows.withColumn("reasons", found)


def split(rows: DataFrame, found: Column, fields: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid rows with the known ``fields``, rejected rows with ``reasons``): two passes, if both are used."""
    known = judged(rows, found)
    valid = known.where(F.size("reasons") == 0)
    return valid.select(fields or rows.columns), known.where(F.size("reasons") > 0)
