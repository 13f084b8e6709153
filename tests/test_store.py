from __future__ import annotations

import glob
import random

import pytest
from pyspark.sql import functions as F

from shelfwork.operators import catalog, commands
from shelfwork.sources.store import Conflict, Store


def files(folder):
    return set(glob.glob(f"{folder}/data/*/*/*.parquet"))


def test_a_change_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"u{k % 50}", k) for k in range(500)] + [(900, None, 1)], "_id long, userId string, v int")
    held = Store(spark, f"file://{tmp_path}/t")
    with pytest.raises(FileNotFoundError):
        held.read()
    held.create(rows, 16)
    old, before = held.manifest(), files(f"{tmp_path}/t")
    assert sorted(map(tuple, held.read().drop("bucket").collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    cmd = spark.createDataFrame([(1, 3, "u3"), (2, 53, "u3"), (3, 4, "u3")], "seq long, _id long, userId string")
    reader = held.read()  # keeps the version that it began with
    new, rejects = held.change(cmd, commands.delete_rows)
    assert [r.seq for r in rejects.collect()] == [3]
    assert reader.count() == 501 and held.read().count() == 499
    changed = {b for b in new["held"] if new["held"][b] != old["held"].get(b)}
    assert len(changed) == 1 and before <= files(f"{tmp_path}/t")
    assert held.expire() == [old["version"]]
    kept = before & files(f"{tmp_path}/t")
    assert {f.split("bucket=")[1].split("/")[0] for f in before - kept} == changed and held.read().count() == 499


def test_the_switch_is_whole(spark, tmp_path):
    """A change that fails, or that began from an older version, leaves the table as it is."""
    held = Store(spark, f"file://{tmp_path}/t")
    held.create(spark.createDataFrame([(1, "a"), (2, "b")], "_id long, userId string"), 4)
    began = held.manifest()
    cmd = spark.createDataFrame([(1, 1, "a")], "seq long, _id long, userId string")

    def fails(table, asked):
        return table.withColumn("userId", F.raise_error(F.lit("no")).cast("string")), asked

    with pytest.raises(Exception, match="no"):
        held.change(cmd, fails)
    assert held.manifest() == began and held.read().count() == 2

    def late(table, asked):
        Store(spark, held.folder).create(spark.createDataFrame([(7, "z")], "_id long, userId string"), 4)
        return commands.delete_rows(table, asked)

    with pytest.raises(Conflict):
        held.change(cmd, late)
    assert [r._id for r in held.read().collect()] == [7]
    held.change(spark.createDataFrame([(1, 7, "z")], "seq long, _id long, userId string"), commands.delete_rows)
    assert held.read().count() == 0 and held.manifest()["held"] == {}


def test_reads_of_some_users_scan_their_buckets(spark, tmp_path):
    held = Store(spark, f"file://{tmp_path}/t")
    held.create(spark.createDataFrame([(k, f"u{k % 50}") for k in range(200)], "_id long, userId string"), 16)
    some = held.read(spark.createDataFrame([("u1",), ("u1",), ("nobody",)], "userId string"))
    assert sorted(r._id for r in some.collect()) == [1, 51, 101, 151]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket), ", "") and "bucket" in plan.split("PartitionFilters: ")[1].split("]")[0]
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert " IN " in scan or "= " in scan


@pytest.mark.parametrize("sort_by", ["total_rating", "name", "id"])
def test_deep_pages_are_those_of_the_whole_sort(spark, sort_by):
    rng = random.Random(6)
    rows = [(k, rng.choice([None, "a", "b", f"n{rng.randrange(300)}"]), rng.choice([None, 1.0, 1.0, float(rng.randrange(50))])) for k in rng.sample(range(10_000), 3000)]
    games = spark.createDataFrame(rows, "id long, name string, total_rating double").cache()
    for direction in ("asc", "desc"):
        for limit, offset in ((7, 0), (20, 1490), (500, 2800), (5, 2999), (5, 3000), (0, 3)):
            want = [(r.id, r["rank"]) for r in catalog.page(games, catalog.ordering(sort_by, direction), limit, offset).collect()]
            got = catalog.deep_page(games, sort_by, direction, limit, offset, most=40)
            assert sorted((r.id, r["rank"]) for r in got.collect()) == sorted(want)


def test_deep_pages_hold_few_rows(spark):
    """Nothing before the page is sorted: the last step sees no more rows than it may."""
    games = spark.range(300_000).selectExpr("id", "cast(id % 1000 as double) as total_rating")
    page = catalog.deep_page(games, "total_rating", "asc", 10, 250_000, most=1000)
    assert [r.id for r in page.orderBy("rank").collect()] == [833 + 1000 * k for k in range(100, 110)]
    assert page.drop("rank")._jdf.queryExecution().optimizedPlan().toString().count("Filter") >= 1


def test_deletions_are_met_by_equality(spark):
    from shelfwork.plans import queries
    from shelfwork.sources.adapter import Domain

    d = Domain(spark, "/root/testdata/sf0.001")
    rows = queries._deletions(d)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    orders = {(r.o_orderkey, r.o_custkey) for r in d.flat("orders").collect()}
    who = {r.s_suppkey for r in d.flat("supplier").collect()}
    wanted = sorted((o * 2 + (c == u), o, u) for o, c in orders for u in (c, c - 1) if u in who)
    assert wanted and sorted(tuple(r) for r in rows.collect()) == wanted
