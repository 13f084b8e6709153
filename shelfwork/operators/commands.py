"""Batches of commands applied to library tables. Each gives (new table, rejects); rejects have ``seq`` and ``reason``.

Several kinds of commands in one batch are applied by the caller in this order: create, update, membership, delete,
category delete. Times are those of the commands, so a rerun gives the same rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfwork.functions.scalars import is_object_id
from shelfwork.operators.graph import components, shared_keys
from shelfwork.sources.schemas import GAME_COPY, PLAYER
from shelfwork.sources.tables import saved

#: The categories that a new user starts with.
DEFAULT_CATEGORIES = ("Favoritos", "Na fila", "Jogando", "Zerados", "Dropados")


def _player(player: Column) -> Column:
    return F.struct(
        F.coalesce(player["status"], F.lit("Wishlist")).alias("status"), F.coalesce(player["hours_played"], F.lit(0.0)).alias("hours_played"), player["rating"].alias("rating"), player["review"].alias("review")
    ).cast(PLAYER)


def _game(data: Column) -> Column:
    filled = data.withField("genres", F.coalesce(data["genres"], F.array().cast("array<struct<id: bigint, name: string>>")))
    return filled.withField("platforms", F.coalesce(data["platforms"], F.from_json(F.lit("[]"), "array<struct<id: bigint, name: string, platform_logo: struct<id: bigint, url: string>>>"))).cast(GAME_COPY)


def insert_entries(backlogs: DataFrame, commands: DataFrame) -> DataFrame:
    """``commands``: _id, userId, category_ids, igdb_data, player_data, ts. Categories aren't checked, order and repeats stay."""
    new = commands.select("_id", "userId", F.col("category_ids").alias("categories"), _game(F.col("igdb_data")).alias("igdb_data"), _player(F.col("player_data")).alias("player_data"), F.col("ts").alias("createdAt"), F.col("ts").alias("updatedAt"))
    return backlogs.unionByName(new)


def _numbered(commands: DataFrame) -> DataFrame:
    """The commands with a row id of their own, written once: ``seq`` may be null or repeated, and ids must not change between
    readings."""
    return saved(commands.withColumn("__id", F.monotonically_increasing_id()), "commands")


def _owned(commands: DataFrame, categories: DataFrame) -> DataFrame:
    """__id, ok of numbered commands."""
    asked = commands.where(F.size("categories") > 0).select("__id", "userId", F.explode("categories").alias("_id"))
    found = asked.join(categories.select("_id", "userId").distinct().withColumn("own", F.lit(True)), ["_id", "userId"], "left")
    met = found.groupBy("__id").agg(F.count_distinct(F.when(F.col("own"), F.col("_id"))).alias("met"))
    n = F.greatest(F.coalesce(F.size("categories"), F.lit(0)), F.lit(0))
    rows = commands.select("__id", n.alias("n")).join(met, "__id", "left")
    return rows.select("__id", (F.coalesce("met", F.lit(0)) == F.col("n")).alias("ok"))


def owned_check(commands: DataFrame, categories: DataFrame) -> DataFrame:
    """seq, ok of each command, whatever its ``seq``: whether its categories are all different ones of its user; none at all,
    or a null, passes."""
    rows = _numbered(commands)
    return rows.select("__id", "seq").join(_owned(rows, categories), "__id").select("seq", "ok")


def _latest(value: str, tie: str) -> Column:
    return F.max_by(F.when(F.col(value).isNotNull(), F.col(value)), F.when(F.col(value).isNotNull(), F.struct("ts", "seq", tie)))


def update_entries(backlogs: DataFrame, categories: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``commands``: seq, ts, _id, userId, categories, igdb_data, player_data; what is null stays as it is, what is given
    replaces the whole. Of several commands the last by (ts, seq) gives each field; a null ``seq`` is before all others, and
    of commands with the same the one that comes later in the table is last. Each command is applied or rejected once."""
    rows = _numbered(commands)
    checked = rows.join(_owned(rows, categories), "__id")
    known = backlogs.select("_id", "userId").distinct().withColumn("known", F.lit(True))
    judged = checked.join(known, ["_id", "userId"], "left")
    reason = F.when(~F.col("ok"), "CATEGORIES_NOT_OWNED").when(F.col("known").isNull(), "GAME_NOT_FOUND")
    rejects = judged.select("seq", reason.alias("reason")).where("reason is not null")
    last = judged.where(reason.isNull()).groupBy("_id", "userId").agg(*[_latest(c, "__id").alias(f"new_{c}") for c in ("categories", "igdb_data", "player_data")], F.max("ts").alias("new_ts"))
    met = backlogs.join(last, ["_id", "userId"], "left")
    player = F.when(F.col("new_player_data").isNotNull(), _player(F.col("new_player_data"))).otherwise(F.col("player_data"))
    out = met.select("_id", "userId", F.coalesce("new_categories", "categories").alias("categories"), F.coalesce("new_igdb_data", "igdb_data").alias("igdb_data"), player.alias("player_data"), "createdAt", F.coalesce("new_ts", "updatedAt").alias("updatedAt"))
    return out, rejects


def delete_rows(table: DataFrame, commands: DataFrame, reason: str = "GAME_NOT_FOUND") -> tuple[DataFrame, DataFrame]:
    """Delete by (_id, userId)."""
    key = ["_id", "userId"]
    rejects = commands.join(table.select(key).distinct(), key, "left_anti").select("seq", F.lit(reason).alias("reason"))
    return table.join(commands.select(key).distinct(), key, "left_anti"), rejects


def create_categories(categories: DataFrame, commands: DataFrame) -> DataFrame:
    return categories.unionByName(commands.select("_id", "name", "userId"))


def rename_categories(categories: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``commands``: seq, ts, _id, userId, name; the last by (ts, seq) wins."""
    key = ["_id", "userId"]
    rejects = commands.join(categories.select(key).distinct(), key, "left_anti").select("seq", F.lit("CATEGORY_NOT_FOUND").alias("reason"))
    last = commands.groupBy(key).agg(_latest("name", "name").alias("new_name"))
    out = categories.join(last, key, "left").select("_id", F.coalesce("new_name", "name").alias("name"), "userId")
    return out, rejects


def delete_categories(categories: DataFrame, backlogs: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(categories, backlogs, rejects): a deleted category leaves its owner's entries, and entries that only had deleted
    ones go. Entries that held none stay untouched, empty ones too."""
    kept, rejects = delete_rows(categories, commands, "CATEGORY_NOT_FOUND")
    gone = commands.join(categories.select("_id", "userId").distinct(), ["_id", "userId"], "left_semi")
    by_user = gone.groupBy("userId").agg(F.collect_set("_id").alias("gone"), F.max("ts").alias("gone_ts"))
    rows = backlogs.join(by_user, "userId", "left")
    left = F.filter("categories", lambda x: ~F.array_contains(F.col("gone"), x))
    hit = F.col("gone").isNotNull() & (F.size(left) < F.size("categories"))
    rows = rows.withColumns({"hit": F.coalesce(hit, F.lit(False)), "left_over": left}).where("not hit or size(left_over) > 0")
    rows = rows.withColumn("categories", F.when(F.col("hit"), F.col("left_over")).otherwise(F.col("categories")))
    if "updatedAt" in backlogs.columns:
        rows = rows.withColumn("updatedAt", F.when(F.col("hit"), F.col("gone_ts")).otherwise(F.col("updatedAt")))
    return kept, rows.select(backlogs.columns), rejects


def _folded(batches):
    """Entries (kind 0) and their commands (kind 1) come sorted by entry and time. Of an entry only its categories are held while
    its commands pass; rejects go on at once, the entry once the next one begins."""

    def entries(held):
        return [(*key, before, cats, changed, None, None) for key, before, cats, changed in held]

    held, now, schema = [], None, None
    for batch in batches:
        schema, out = batch.schema, []
        names = ("_id", "userId", "kind", "categories", "ts", "seq", "op", "category_id")
        for entry, user, kind, cats, ts, seq, op, category in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names), strict=True):
            if (entry, user) != now:
                out += entries(held)
                held, now = [], (entry, user)
            if kind == 0:
                held.append((now, cats, list(cats or []), None))
                continue
            for k, (key, before, mine, changed) in enumerate(held):
                reason = None
                if op == "add":
                    if category in mine:
                        reason = "ALREADY_IN_CATEGORY"
                    else:
                        mine.append(category)
                elif category not in mine:
                    reason = "NOT_IN_CATEGORY"
                elif len(mine) == 1:
                    reason = "LAST_CATEGORY"
                else:
                    mine.remove(category)
                if reason is None:
                    held[k] = (key, before, mine, ts)
                elif k == 0:
                    out.append((None, None, None, None, None, seq, reason))
        if out:
            yield _batch_of(out, schema)
    if held:
        yield _batch_of(entries(held), schema)


def _batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    like = ("_id", "userId", "categories", "categories", "ts", "seq")
    kinds = [schema.field(c).type for c in like] + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["_id", "userId", "before", "cats", "changed", "seq", "reason"])


def membership(backlogs: DataFrame, categories: DataFrame, commands: DataFrame, check_ids: bool = True) -> tuple[DataFrame, DataFrame]:
    """Adds and removals, one after another for each entry.

    ``commands``: seq, ts, op (add, remove), _id (entry), userId, category_id. An add is checked for the form of the ids
    (unless not ``check_ids``), the owner's entry, the category (of any owner) and membership; a removal for the entry,
    membership, and whether it was the last. Each entry's commands are applied in order of (ts, seq), nulls first, then of
    op and category.

    Entries with commands meet these in one partition, sorted, and are folded as they pass: an entry with any number of
    commands takes no more memory than its categories. Rows that repeat an entry's ids are folded each; rejects are
    those of the first.
    """
    key, types = ["_id", "userId"], dict(commands.dtypes)
    exists = categories.select(F.col("_id").alias("category_id")).distinct().withColumn("there", F.lit(True))
    form = F.lit(True) if not check_ids else is_object_id(F.col("_id").cast("string")) & is_object_id(F.col("category_id").cast("string"))
    judged = commands.withColumn("well", F.coalesce(form, F.lit(False)) | (F.col("op") != "add")).join(exists, "category_id", "left")
    owned = judged.join(backlogs.select(key).distinct().withColumn("own", F.lit(True)), key, "left")
    early = F.when(~F.col("well"), "INVALID_ID").when(F.col("own").isNull(), "GAME_NOT_FOUND").when((F.col("op") == "add") & F.col("there").isNull(), "CATEGORY_NOT_FOUND")
    owned = saved(owned.select(*key, "ts", F.col("seq").cast("bigint").alias("seq"), "op", "category_id", early.alias("early")), "judged")
    todo = owned.where("early is null").select(*key, F.lit(1).alias("kind"), F.lit(None).cast(dict(backlogs.dtypes)["categories"]).alias("categories"), "ts", "seq", "op", "category_id")
    hit = backlogs.select(*key, "categories").join(todo.select(key).distinct(), key, "left_semi").distinct()
    entries = hit.select(*key, F.lit(0).alias("kind"), "categories", *[F.lit(None).cast(types[c] if c != "seq" else "bigint").alias(c) for c in ("ts", "seq", "op", "category_id")])
    stream = entries.unionByName(todo).repartition(*key).sortWithinPartitions(*key, "kind", "categories", "ts", "seq", "op", "category_id")
    kinds = dict(stream.dtypes)
    folded = saved(stream.mapInArrow(_folded, f"_id {kinds['_id']}, userId {kinds['userId']}, before {kinds['categories']}, cats {kinds['categories']}, changed {kinds['ts']}, seq bigint, reason string"), "folded")
    done = folded.where("changed is not null").select(*[F.col(c).alias(f"done_{c}") for c in key], F.struct("before").alias("done_before"), "cats", "changed")
    same = (F.col("_id") == F.col("done__id")) & (F.col("userId") == F.col("done_userId")) & (F.struct(F.col("categories").alias("before")) == F.col("done_before"))
    out = backlogs.join(done, same, "left").withColumn("categories", F.when(F.col("changed").isNotNull(), F.col("cats")).otherwise(F.col("categories")))
    if "updatedAt" in backlogs.columns:
        out = out.withColumn("updatedAt", F.coalesce("changed", "updatedAt"))
    rejects = owned.where("early is not null").select("seq", F.col("early").alias("reason")).unionByName(folded.where("reason is not null").select("seq", "reason"))
    return out.select(backlogs.columns), rejects


#: Sign-ups that hang together by names and emails are settled in one pass up to so many; their names are held meanwhile.
TOGETHER = 1_000_000


def _first_come(batches):
    """(__id, accepted) of rows sorted by component and time: who finds neither name nor email taken takes both."""
    now, taken = None, (set(), set())
    for batch in batches:
        root, ids, *names = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("root", "__id", "username", "email"))
        out = []
        for r, *own in zip(root, *names, strict=True):
            if r != now:
                now, taken = r, (set(), set())
            free = not any(x in t for x, t in zip(own, taken, strict=True))
            if free:
                for x, t in zip(own, taken, strict=True):
                    if x is not None:
                        t.add(x)
            out.append(free)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.bool_())], names=["__id", "accepted"])


def _round(open_: DataFrame) -> DataFrame:
    """(__id, accepted) of the rows that are first in name and email, and of those that share one with such a row."""
    first = [F.col(k).isNull() | (F.row_number().over(Window.partitionBy(k).orderBy("ts", "seq", "__id")) == 1) for k in ("username", "email")]
    ranked = open_.withColumn("__now", first[0] & first[1])
    met = [F.col(k).isNotNull() & F.max("__now").over(Window.partitionBy(k)) for k in ("username", "email")]
    return ranked.withColumn("__met", met[0] | met[1]).where("__now or __met").select("__id", F.col("__now").alias("accepted"))


def register_users(users: DataFrame, commands: DataFrame, together: int = TOGETHER) -> tuple[DataFrame, DataFrame]:
    """(new users, rejects): first come by (ts, seq), then by place in the table, takes a username and an email; who finds either
    taken is rejected. A null name or email is shared with nobody; ``seq`` may be null or repeated.

    A row that is refused for its email doesn't keep its username, so rows that share names and emails depend on each
    other in chains. A first round accepts those that are first in both and refuses those that share a key with them, which
    decides nearly all. What is left falls into components by shared keys. Those of at most ``together`` rows are
    settled each by one sorted pass; larger ones go through another round, fall apart, and are looked at again. The first
    of all open rows is accepted in each round, so this ends.
    """
    rows = _numbered(commands)
    taken_u, taken_e = users.select("username").distinct(), users.select("email").distinct()
    narrow = rows.select("__id", "ts", "seq", "username", "email")
    open_ = saved(narrow.join(taken_u, "username", "left_anti").join(taken_e, "email", "left_anti"), "open")
    decided = saved(_round(open_), "decided")
    found = decided
    while True:
        open_ = saved(open_.join(decided.select("__id"), "__id", "left_anti"), "open")
        if open_.isEmpty():
            break
        roots = components(shared_keys(open_, "__id", ("username", "email"))).select(F.col("node").alias("__id"), "root")
        grouped = saved(open_.join(roots, "__id", "left").withColumn("root", F.coalesce("root", "__id")), "grouped")
        large = grouped.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > together).select("root")
        small = grouped.join(large, "root", "left_anti").repartition("root").sortWithinPartitions("root", "ts", "seq", "__id")
        settled = small.select("root", "__id", "username", "email").mapInArrow(_first_come, "__id bigint, accepted boolean")
        decided = saved(settled.unionByName(_round(grouped.join(large, "root", "left_semi"))), "decided")
        found = found.unionByName(decided)
    accepted = found.where("accepted").select("__id")
    new = rows.join(accepted, "__id", "left_semi").select(commands.columns)
    return new, rows.join(accepted, "__id", "left_anti").select("seq", F.lit("DUPLICATE_USER").alias("reason"))


def seed_categories(new_users: DataFrame) -> DataFrame:
    """userId, name, place (from 0) of the default categories of each new user."""
    rows = F.posexplode(F.array(*(F.lit(x) for x in DEFAULT_CATEGORIES))).alias("place", "name")
    return new_users.select(F.col("_id").alias("userId"), rows)


def stamped(rows: DataFrame, ts: Column) -> DataFrame:
    """createdAt and updatedAt of new rows."""
    return rows.withColumns({"createdAt": ts, "updatedAt": ts})
