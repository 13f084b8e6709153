from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelfwork.operators import commands, library
from shelfwork.sources.schemas import BACKLOGS, CATEGORIES


def backlogs(spark, rows):
    game = (1, "g", None, None, None, None, None, None)
    return spark.createDataFrame([(i, u, c, game, None, None, None) for i, u, c in rows], BACKLOGS)


def categories(spark, rows):
    return spark.createDataFrame(rows, CATEGORIES)


def cats(rows):
    return {r._id: r.categories for r in rows.collect()}


def test_counts_take_a_repeated_category_once(spark):
    rows = backlogs(spark, [("1", "u", ["a", "a", "b"]), ("2", "u", ["a"]), ("3", "v", ["a"])])
    own = categories(spark, [("a", "Na fila", "u"), ("b", "B", "u"), ("c", "C", "u")])
    assert {(r._id, r.slug, r.countGames) for r in library.category_list(own, rows).collect()} == {("a", "na-fila", 2), ("b", "b", 1), ("c", "c", 0)}
    counts = library.games_per_category(rows).agg(F.sum("countGames")).first()[0]
    assert counts == rows.select(F.explode(F.array_distinct("categories"))).count()


def test_populate_keeps_order_and_drops_dangling(spark):
    rows = backlogs(spark, [("1", "u", ["b", "x", "a", "b"]), ("2", "u", [])])
    got = {r.id: r.categories for r in library.short_view(library.populate(rows, categories(spark, [("a", "A", "u"), ("b", "B", "other")]))).collect()}
    assert got == {"1": ["B", "A", "B"], "2": []}


def test_short_list_filters_only_by_an_owned_category(spark):
    rows = backlogs(spark, [("1", "u", ["a"]), ("2", "u", ["b"])])
    own = categories(spark, [("a", "A", "u"), ("b", "B", "v")])
    ask = lambda c: spark.createDataFrame([("u", c)], "userId string, category_id string")
    assert set(cats(library.in_category_if_owned(rows, own, ask("a")))) == {"1"}
    assert set(cats(library.in_category_if_owned(rows, own, ask("b")))) == {"1", "2"}
    assert set(cats(library.in_category_if_owned(rows, own, ask("a"), strict_reference=True))) == {"1", "2"}
    assert set(cats(library.in_category(rows, "a"))) == {"1"}


def test_updates(spark):
    rows = backlogs(spark, [("1", "u", ["a"]), ("2", "u", ["a"])])
    own = categories(spark, [("a", "A", "u"), ("b", "B", "u"), ("z", "Z", "v")])
    kind = "seq bigint, ts bigint, _id string, userId string, categories array<string>"
    cmd = spark.createDataFrame([(1, 1, "1", "u", ["b"]), (2, 2, "1", "u", []), (3, 3, "1", "u", None), (4, 1, "2", "u", ["b", "b"]), (5, 1, "2", "u", ["z"]), (6, 1, "9", "u", ["a"])], kind)
    cmd = cmd.withColumn("ts", F.timestamp_seconds("ts"))
    for f in ("igdb_data", "player_data"):
        cmd = cmd.withColumn(f, F.lit(None).cast(rows.schema[f].dataType))
    got, rejects = commands.update_entries(rows, own, cmd)
    assert cats(got) == {"1": [], "2": ["a"]}
    assert {(r.seq, r.reason) for r in rejects.collect()} == {(4, "CATEGORIES_NOT_OWNED"), (5, "CATEGORIES_NOT_OWNED"), (6, "GAME_NOT_FOUND")}


def test_membership_depends_on_order(spark):
    a, b, c, e1, e2 = (ch * 24 for ch in "abc12")
    rows = backlogs(spark, [(e1, "u", [a, b, a]), (e2, "u", [a])])
    own = categories(spark, [(a, "A", "u"), (b, "B", "u"), (c, "C", "other")])
    steps = [("remove", e1, a), ("add", e1, c), ("add", e1, c), ("remove", e1, "d" * 24), ("remove", e2, a), ("add", e2, b), ("remove", e2, a), ("add", e2, "nope"), ("add", "f" * 24, a), ("add", e2, "e" * 24)]
    cmd = spark.createDataFrame([(k, 0, op, e, "u", x) for k, (op, e, x) in enumerate(steps)], "seq bigint, ts bigint, op string, _id string, userId string, category_id string").withColumn("ts", F.timestamp_seconds("ts"))
    got, rejects = commands.membership(rows, own, cmd)
    assert cats(got) == {e1: [b, a, c], e2: [b]}
    assert {(r.seq, r.reason) for r in rejects.collect()} == {(2, "ALREADY_IN_CATEGORY"), (3, "NOT_IN_CATEGORY"), (4, "LAST_CATEGORY"), (7, "INVALID_ID"), (8, "GAME_NOT_FOUND"), (9, "CATEGORY_NOT_FOUND")}


def test_commands_without_or_with_repeated_numbers(spark):
    """Every command is applied or rejected once, whatever its seq."""
    rows = backlogs(spark, [("1", "u", ["a"]), ("2", "u", ["a"]), ("3", "u", ["a"])])
    own = categories(spark, [("a", "A", "u"), ("b", "B", "u"), ("z", "Z", "v")])
    kind = "seq bigint, ts bigint, _id string, userId string, categories array<string>"
    asked = [(1, 1, "1", "u", ["a", "b"]), (1, 1, "2", "u", ["z"]), (None, 1, "3", "u", ["b"]), (None, 1, "9", "u", ["a"]), (None, 1, None, "u", []), (4, 1, "2", None, ["z", "z"]), (4, 0, "2", "u", ["b"]), (4, 0, "2", "u", ["b", "a"])]
    cmd = spark.createDataFrame(asked, kind).coalesce(1).withColumn("ts", F.timestamp_seconds("ts"))
    assert sorted((str(r.seq), r.ok) for r in commands.owned_check(cmd, own).collect()) == [("1", False), ("1", True), ("4", False), ("4", True), ("4", True), ("None", True), ("None", True), ("None", True)]
    for f in ("igdb_data", "player_data"):
        cmd = cmd.withColumn(f, F.lit(None).cast(rows.schema[f].dataType))
    got, rejects = commands.update_entries(rows, own, cmd)
    assert cats(got) == {"1": ["a", "b"], "2": ["b", "a"], "3": ["b"]}
    assert sorted((str(r.seq), r.reason) for r in rejects.collect()) == [("1", "CATEGORIES_NOT_OWNED"), ("4", "CATEGORIES_NOT_OWNED"), ("None", "GAME_NOT_FOUND"), ("None", "GAME_NOT_FOUND")]
    users = spark.createDataFrame([("old", "o@x")], "username string, email string")
    signups = spark.createDataFrame([(1, 1, "ann", "a@x"), (1, 2, "ann", "b@x"), (None, 3, "bob", "c@x"), (None, 4, "bob", "d@x"), (1, 5, "old", "e@x"), (2, 6, "eve", "f@x")], "seq bigint, ts bigint, username string, email string")
    new, rejects = commands.register_users(users, signups)
    assert sorted((str(r.seq), r.email) for r in new.collect()) == [("1", "a@x"), ("2", "f@x"), ("None", "c@x")]
    assert sorted(str(r.seq) for r in rejects.collect()) == ["1", "1", "None"]


def test_membership_as_the_sequential_rule(spark):
    """Random commands, with nulls, ties and repeats, against one command at a time; rows that repeat an entry."""
    import random

    rng = random.Random(5)
    start = [(str(k), "u", [rng.choice("abcd") for _ in range(rng.randrange(0, 5))]) for k in range(20)] + [("3", "u", ["d"]), ("30", "v", ["a"])]
    own = categories(spark, [(c, c, "u") for c in "abc"])
    asked = [(rng.choice([None, k, k // 2]), rng.choice([None, *range(6)]), rng.choice(["add", "remove"]), str(rng.randrange(22)), "u", rng.choice([*"abcde", None])) for k in range(900)]
    cmd = spark.createDataFrame(asked, "seq bigint, ts bigint, op string, _id string, userId string, category_id string").withColumn("ts", F.timestamp_seconds("ts")).repartition(3)
    got, rejects = commands.membership(backlogs(spark, start), own, cmd, check_ids=False)
    low = lambda x: (x is not None, x if x is not None else 0)
    word = lambda x: (x is not None, x or "")
    want, refused = [], []
    ids = {e for e, u, _ in start if u == "u"}
    refused += [(s, "GAME_NOT_FOUND") for s, _, _, e, _, _ in asked if e not in ids]
    refused += [(s, "CATEGORY_NOT_FOUND") for s, _, op, e, _, c in asked if e in ids and op == "add" and c not in set("abc")]
    first = set()
    for e, u, held in sorted(start, key=lambda x: (x[0], x[2])):
        held, own_cmd = list(held), [x for x in asked if x[3] == e and u == "u" and not (x[2] == "add" and x[5] not in set("abc"))]
        for s, _, op, _, _, c in sorted(own_cmd, key=lambda x: (low(x[1]), low(x[0]), x[2], word(x[5]))):
            reason = None
            if op == "add":
                reason = "ALREADY_IN_CATEGORY" if c in held else held.append(c)
            elif c not in held:
                reason = "NOT_IN_CATEGORY"
            elif len(held) == 1:
                reason = "LAST_CATEGORY"
            else:
                held.remove(c)
            if reason and (e, u) not in first:
                refused.append((s, reason))
        first.add((e, u))
        want.append((e, held))
    assert sorted((r._id, r.categories) for r in got.collect()) == sorted(want)
    assert sorted((str(r.seq), r.reason) for r in rejects.collect()) == sorted((str(s), r) for s, r in refused)


def test_an_entry_with_many_commands_takes_little_memory():
    """Commands pass; only the entry's categories are held."""
    import tracemalloc

    import pyarrow as pa

    schema = pa.schema([("_id", pa.int64()), ("userId", pa.int64()), ("kind", pa.int32()), ("categories", pa.list_(pa.int64())), ("ts", pa.timestamp("us")), ("seq", pa.int64()), ("op", pa.string()), ("category_id", pa.int64())])

    def batches(n):
        yield pa.RecordBatch.from_pylist([{"_id": 1, "userId": 1, "kind": 0, "categories": [1, 2, 3]}], schema)
        for k in range(n):
            ops = ["add" if (k + j) % 3 else "remove" for j in range(1000)]
            yield pa.RecordBatch.from_pylist([{"_id": 1, "userId": 1, "kind": 1, "ts": k, "seq": k * 1000 + j, "op": op, "category_id": (k * j) % 40} for j, op in enumerate(ops)], schema)

    def most(n):
        tracemalloc.start()
        rows = sum(b.num_rows for b in commands._folded(batches(n)))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return rows, peak

    (few, low), (many, high) = most(5), most(60)
    assert many > 8 * few and high < 1.5 * low


def test_cascade(spark):
    rows = backlogs(spark, [("1", "u", ["a", "b", "a", "b"]), ("2", "u", ["a"]), ("3", "u", []), ("4", "v", ["a"])])
    own = categories(spark, [("a", "A", "u"), ("b", "B", "u")])
    cmd = spark.createDataFrame([(1, "a", "u"), (2, "b", "v")], "seq bigint, _id string, userId string").withColumn("ts", F.timestamp_seconds(F.lit(5)))
    kept, left, rejects = commands.delete_categories(own, rows, cmd)
    assert [r._id for r in kept.collect()] == ["b"]
    assert cats(left) == {"1": ["b", "b"], "3": [], "4": ["a"]}
    assert [(r.seq, r.reason) for r in rejects.collect()] == [(2, "CATEGORY_NOT_FOUND")]


def test_insert_fills_defaults(spark):
    new = spark.createDataFrame([("9", "u", ["x", "x"], (5, "n", None, None, None, None, None, None), None)], f"_id string, userId string, category_ids array<string>, igdb_data {dict(backlogs(spark, []).dtypes)['igdb_data']}, player_data {dict(backlogs(spark, []).dtypes)['player_data']}")
    r = commands.insert_entries(backlogs(spark, []), new.withColumn("ts", F.timestamp_seconds(F.lit(1)))).first()
    assert (r.categories, r.igdb_data.genres, r.player_data.status, r.player_data.hours_played) == (["x", "x"], [], "Wishlist", 0.0)
    assert r.createdAt == r.updatedAt


def test_registration_refused_for_email_frees_the_name(spark):
    kind = "seq bigint, ts bigint, _id string, username string, email string"
    cmd = spark.createDataFrame([(1, 1, "1", "ann", "a@x"), (2, 2, "2", "bob", "a@x"), (3, 3, "3", "bob", "b@x"), (4, 4, "4", "old", "c@x")], kind)
    users = spark.createDataFrame([("0", "old", "o@x")], "_id string, username string, email string")
    new, rejects = commands.register_users(users, cmd)
    assert {r.seq for r in new.collect()} == {1, 3}
    assert {r.seq for r in rejects.collect()} == {2, 4}
    assert [r.name for r in commands.seed_categories(new.where("seq = 1")).orderBy("place").collect()] == list(commands.DEFAULT_CATEGORIES)


def test_registration_settles_long_chains(spark):
    """Each row shares its username or its email with the one before: every second one is a valid sign-up."""
    n = 140
    users = spark.createDataFrame([], "_id string, username string, email string, password string")
    rows = [(i, i, f"u{i // 2}", f"e{(i + 1) // 2}") for i in range(n)] + [(n, n, None, None), (n + 1, n + 1, None, None)]
    cmd = spark.createDataFrame(rows, "seq bigint, ts bigint, username string, email string").coalesce(1)
    new, rejects = commands.register_users(users, cmd)
    assert sorted(r.seq for r in new.select("seq").collect()) == [*range(0, n, 2), n, n + 1]
    assert {r.seq for r in rejects.collect()} == set(range(1, n, 2))


@pytest.mark.parametrize("together", [1_000_000, 40])
def test_registration_by_components(spark, together):
    """A chain of ten thousand, small groups and single rows, against the sequential rule; with a small bound, rounds break the
    chain up first."""
    import random

    rng = random.Random(1)
    n = 10_000 if together > 40 else 45
    # from the second row on a chain is decided one by one, as its first rows come last
    rows = [(i, n - i, f"u{(i + 1) // 2}", f"e{i // 2}") for i in range(n)] + [(n + i, rng.randrange(9), rng.choice([None, f"x{rng.randrange(150)}"]), rng.choice([None, f"y{rng.randrange(150)}"])) for i in range(400)]
    cmd = spark.createDataFrame(rows, "seq bigint, ts bigint, username string, email string").repartition(3)
    new, rejects = commands.register_users(spark.createDataFrame([("x3", "y5")], "username string, email string"), cmd, together)
    names, emails, want = {"x3"}, {"y5"}, set()
    for i, _, u, e in sorted(rows, key=lambda r: (r[1], r[0])):
        if u not in names and e not in emails:
            want.add(i)
            names |= {u} - {None}
            emails |= {e} - {None}
    assert {r.seq for r in new.select("seq").collect()} == want
    assert {r.seq for r in rejects.collect()} == {r[0] for r in rows} - want


def test_lookup_and_pages(spark):
    rows = backlogs(spark, [(str(i), "u", ["a"]) for i in range(5)])
    keys = spark.createDataFrame([("1", "u"), ("1", "v"), ("9", "u")], "_id string, userId string")
    assert {(r._id, r.userId): r.found for r in library.lookup(rows, keys).collect()} == {("1", "u"): True, ("1", "v"): False, ("9", "u"): False}
    assert library.backlog_page(rows, F.lit("2"), F.lit("2")).count() == 5
    assert {r._id for r in library.backlog_page(rows, F.lit("2"), F.lit("2"), paginate=True).collect()} == {"2", "3"}
    page = library.sorted_page(rows, categories(spark, [("a", "Fav", "u")]), "Fav", F.col("_id"), "desc", 2, 1)
    assert [r._id for r in page.orderBy("place").collect()] == ["3", "2"]


def test_commands_as_a_stream(spark, tmp_path):
    from shelfwork.streaming.commands import apply_stream

    spark.createDataFrame([(1, "1", "u")], "seq bigint, _id string, userId string").write.json(f"{tmp_path}/in")
    got = {}
    rows = backlogs(spark, [("1", "u", ["a"]), ("2", "u", ["a"])])
    stream = spark.readStream.schema("seq bigint, _id string, userId string").json(f"{tmp_path}/in")
    apply_stream(stream, lambda s: rows, commands.delete_rows, lambda table, rejects, n: got.update({n: cats(table)}), f"{tmp_path}/check").awaitTermination()
    assert got == {0: {"2": ["a"]}}


def test_registration_decides_long_chains_and_null_names(spark, tmp_path):
    """A chain of shared names and emails, and rows without a name, against the sequential rule."""
    rows = [(i, f"u{(i + 1) // 2}", f"e{i // 2}") for i in range(60)] + [(100 + i, None, f"n{i}") for i in range(40)] + [(200, "u1000", "n3")]
    commands_ = spark.createDataFrame([(i, 0, f"id{i}", u, e) for i, u, e in rows], "seq bigint, ts int, _id string, username string, email string")
    users = spark.createDataFrame([], "username string, email string")
    accepted, rejects = commands.register_users(users, commands_)
    names, emails, want = set(), set(), set()
    for i, u, e in rows:
        if (u is None or u not in names) and (e is None or e not in emails):
            want.add(i)
            names.add(u)
            emails.add(e)
    assert {r.seq for r in accepted.collect()} == want
    assert {r.seq for r in rejects.collect()} == {i for i, _, _ in rows} - want
