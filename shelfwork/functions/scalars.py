"""Scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(name: Column) -> Column:
    """Lower case, each space a hyphen, anything but ASCII letters, digits, hyphens and underscores dropped; null stays null."""
    return F.regexp_replace(F.replace(F.lower(name), F.lit(" "), F.lit("-")), r"[^A-Za-z0-9_-]+", "")


def large_image(url: Column, missing: str | None = "") -> Column:
    """The first ``t_thumb`` becomes ``t_720p``; a missing url becomes ``missing``."""
    changed = F.regexp_replace(url, r"(?s)^(.*?)t_thumb", "$1t_720p")
    return F.coalesce(changed, F.lit(missing)) if missing is not None else changed


def names(entries: Column) -> Column:
    """Names of an array of structs."""
    return F.transform(entries, lambda x: x["name"])


def mixed_names(entries: Column) -> Column:
    """Names of an array of strings each of which is a name or a JSON object that has one."""
    return F.transform(entries, lambda x: F.when(x.startswith("{"), F.get_json_object(x, "$.name")).otherwise(x))


def is_object_id(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-fA-F]{24}$"), F.lit(False))


def page_number(text: Column, default: int) -> Column:
    """An integer prefix like parseInt takes it; junk and 0 give the default."""
    number = F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*([+-]?\d+)", 1)
    value = F.when(F.length(number) > 0, number.try_cast("bigint"))
    return F.coalesce(F.nullif(value, F.lit(0).cast("bigint")), F.lit(default).cast("bigint"))


def page_parameters(page: Column, limit: Column) -> dict[str, Column]:
    """page, limit, offset, valid: an invalid pair (one below 1) has no offset."""
    p, n = page_number(page, 1), page_number(limit, 10)
    valid = (p >= 1) & (n >= 1)
    return {"page": p, "limit": n, "offset": F.when(valid, (p - 1) * n), "valid": valid}
