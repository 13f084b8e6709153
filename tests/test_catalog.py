from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelfwork.functions import scalars as S
from shelfwork.operators import batch, catalog, validate, versions
from shelfwork.sources import tables
from shelfwork.sources.schemas import GAMES, PLATFORMS


def games(spark, rows):
    fields = ("id", "name", "category", "version_parent", "first_release_date", "total_rating", "cover")
    kind = "id bigint, name string, category int, version_parent bigint, first_release_date bigint, total_rating double, cover struct<url: string>"
    return spark.createDataFrame([tuple(r.get(f) for f in fields) for r in rows], kind)


def test_slug_image_names_and_ids(spark):
    rows = spark.createDataFrame([("Ação!  x", "//t_thumb/t_thumb.jpg", ["PC", '{"id":1,"name":"Switch"}'], "a" * 24), (None, None, None, "g" * 24)], "name string, url string, mixed array<string>, oid string")
    a, b = rows.select(S.slug(F.col("name")).alias("s"), S.large_image(F.col("url")).alias("u"), S.mixed_names(F.col("mixed")).alias("m"), S.is_object_id(F.col("oid")).alias("o")).collect()
    assert (a.s, a.u, a.m, a.o) == ("ao--x", "//t_720p/t_thumb.jpg", ["PC", "Switch"], True)
    assert (b.s, b.u, b.m, b.o) == (None, "", None, False)


@pytest.mark.parametrize(("page", "limit", "expected"), [("0", "abc", (1, 10, 0, True)), ("12abc", None, (12, 10, 110, True)), ("-1", "5", (-1, 5, None, False)), (" 3", "4", (3, 4, 8, True))])
def test_page_numbers(spark, page, limit, expected):
    p = S.page_parameters(F.lit(page), F.lit(limit).cast("string"))
    assert tuple(spark.range(1).select(*[c.alias(n) for n, c in p.items()]).first()) == expected


def test_filters_leave_out_missing_dates_and_unmatched_names(spark):
    rows = games(spark, [{"id": 1, "name": "A", "category": 0, "first_release_date": 1577836800}, {"id": 2, "name": "B", "category": 0}, {"id": 3, "name": "C", "category": 1, "first_release_date": 1600000000}])
    got = rows.where(catalog.all_of(catalog.released_since("2020-01-01"), catalog.main_only(), None))
    assert [r.id for r in got.collect()] == [1]
    dims = spark.createDataFrame([(7, "Nintendo Switch"), (8, "PC")], "id bigint, name string")
    held = rows.withColumn("platforms", F.when(F.col("id") == 1, F.array(F.struct(F.lit(7).cast("bigint").alias("id")))))
    assert [r.id for r in catalog.having_any(held, dims, "platforms", "SWITCH").collect()] == [1]
    assert catalog.having_any(held, dims, "platforms", "none").count() == 3
    assert catalog.having_any(held, dims, "platforms", "pc").count() == 0


def test_pages_put_together_are_the_sorted_table(spark):
    rows = games(spark, [{"id": i, "name": str(i), "total_rating": None if i % 5 == 0 else float(i * 7 % 11)} for i in range(1, 24)])
    whole = [r.id for r in rows.orderBy(*catalog.ordering()).collect()]
    pages = [r.id for k in range(0, 24, 5) for r in catalog.page(rows, catalog.ordering(), 5, k).orderBy("rank").collect()]
    assert pages == whole
    assert catalog.bounds(None, None) == (100, 0) and catalog.bounds(9999, 3) == (500, 3)


def test_meta_counts_before_and_after_grouping(spark):
    rows = games(spark, [{"id": 1, "name": "a", "category": 0}, {"id": 2, "name": "b", "category": 0, "version_parent": 1}])
    page = catalog.page(rows, catalog.ordering("id", "asc"), 2, 0)
    m = catalog.meta(rows, versions.group_versions(page, rows), 2, 0, page).first()
    assert (m.total, m.totalPages, m.hasMore, m.beforeGrouping) == (2, 1, False, 2)
    none = catalog.meta(rows.where("id < 0"), rows.where("id < 0"), 2, 4).first()
    assert (none.page, none.total, none.totalPages) == (3, 0, None)
    assert catalog.meta(None, rows, 2, 0).first().total is None


def test_title_needs_every_word_and_ranks_exact_first(spark):
    rows = games(spark, [{"id": 1, "name": "The Zelda Game"}, {"id": 2, "name": "Zelda Game"}, {"id": 3, "name": "Zelda"}, {"id": 4, "name": "Zelda Game II"}, {"id": 5}])
    condition, order = catalog.title_rank("zelda game")
    assert [r.id for r in rows.where(condition).orderBy(*order).collect()] == [2, 4, 1]


def _groups(rows, catalogue, strict=False):
    got = versions.in_order(versions.group_versions(rows, catalogue, strict)).collect()
    return [(r.place, r.group, r.id, r.fetched, [v.id for v in r.versions]) for r in got]


def test_versions(spark):
    catalogue = games(spark, [{"id": 1, "name": "head"}, {"id": 2, "name": "early", "version_parent": 1}, {"id": 3, "name": "late", "version_parent": 1}, {"id": 4, "name": "of a stranger", "version_parent": 99},
                              {"id": 5, "name": "zero", "version_parent": 0}, {"id": 6, "name": "chained", "version_parent": 3}, {"id": 7, "name": "outside"}, {"id": 8, "name": "lone", "version_parent": 7}])
    rank = F.create_map(*(F.lit(x) for pair in ((2, 0), (1, 1), (3, 2), (4, 3), (5, 4), (6, 5), (8, 6)) for x in pair))
    page = catalogue.where("id <> 7").withColumn("rank", rank[F.col("id").cast("int")])
    assert _groups(page, catalogue) == [(0, 1, 1, False, [2, 3]), (0, 3, 3, True, [6]), (0, 5, 5, False, []), (0, 7, 7, True, [8]), (1, 99, 4, False, [])]
    assert _groups(page, catalogue, True) == [(0, 1, 1, False, [3]), (0, 3, 3, True, [6]), (0, 5, 5, False, []), (0, 7, 7, True, [8]), (0, 99, None, False, []), (1, 99, 4, False, [])]


def test_expand_references_keeps_order_and_drops_unknown(spark):
    rows = spark.createDataFrame([(1, [3, 9, 1]), (2, []), (3, None)], "id bigint, genres array<bigint>")
    dims = spark.createDataFrame([(1, "a"), (3, "c")], "id bigint, name string")
    got = {r.id: r.genres and [g.name for g in r.genres] for r in catalog.expand_references(rows, "genres", dims, ["id", "name"]).collect()}
    assert got == {1: ["c", "a"], 2: [], 3: None}


def test_listing_fills_what_is_missing(spark):
    rows = spark.createDataFrame([(1, "g")], "id bigint, name string")
    for f in spark.createDataFrame([], GAMES).schema:
        if f.name not in rows.columns:
            rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
    r = catalog.listing(rows).first()
    assert (r.genres, r.platforms, r.summary, r.cover.url, r.first_release_date) == ([], [], "", "", None)
    assert catalog.card(rows, "0").columns == catalog.short_card(rows).columns
    assert "storyline" in catalog.card(rows, "").columns
    shown = catalog.platform_list(spark.createDataFrame([(1, "PC", "pc", None)], PLATFORMS)).first()
    assert shown.logo is None


def test_search_validation(spark):
    kind = "releaseDate string, limit string, offset string, page string, short string, lastRating string, `order` string"
    rows = spark.createDataFrame([("2020-01-01", "5", None, None, None, "8.5", "asc"), ("soon", "0", "x", "1-", "y", "z", "up")], kind)
    good, bad = validate.split(rows, validate.search_reasons())
    assert good.count() == 1
    assert len(bad.first().reasons) == 7
    users = spark.createDataFrame([("a@b.co", "secret"), ("a@b", "x"), (None, None)], "email string, password string")
    assert sorted(map(len, (r.reasons for r in users.withColumn("reasons", validate.user_reasons()).collect()))) == [0, 2, 2]


def test_tables_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x", ["PC"])], "id bigint, name string, unknown array<string>")
    rows.write.json(f"{tmp_path}/games")
    got = tables.read(spark, "games", f"{tmp_path}/games", "json")
    assert "unknown" not in got.columns and got.first().name == "x"
    one, two = (tables.write_version(got, str(tmp_path / "v")) for _ in range(2))
    assert one != two and tables.read(spark, "games", two).first().id == 1
    tables.write_answer(got.select("id"), got.select("name"), str(tmp_path / "answer"))
    assert spark.read.json(f"{tmp_path}/answer/meta").first().name == "x"


def test_batch_search_against_single_searches(spark):
    """Hot and rare searches, dates on and off the edges of spans, unknown sorts, deep pages."""
    import random

    rng = random.Random(4)
    kind = "id bigint, name string, category int, total_rating double, first_release_date bigint, platforms array<struct<id: bigint, name: string>>, genres array<struct<id: bigint, name: string>>"
    pick = lambda: [(i, f"d{i}") for i in rng.sample(range(5), rng.randrange(4))] or None
    games = [(i, f"g{i % 37}", 0 if i % 9 else 1, rng.choice([None, float(i % 17)]), rng.choice([None, -5, 0, 946684800 + (i % 23) * 3600, 1 << 33]), pick(), pick()) for i in range(300)]
    dims = spark.createDataFrame([(i, f"Dim{i}") for i in range(5)], "id bigint, name string")
    sinces = [None, "1969-12-31", "1970-01-01", "2000-01-01T05:00:00", "2000-01-01T05:00:01", "2100-01-01"]
    requests = [(k, rng.choice(sinces), rng.choice([None, "dim", "M3", "zz", ""]), rng.choice([None, "dim1", "none"]), rng.choice([None, "name", "id", "first_release_date", "odd"]), rng.choice([None, "ASC", "desc"]), rng.choice([None, 0, 3, 600]), rng.choice([None, 0, 7])) for k in range(80)]
    got: dict = {}
    table = spark.createDataFrame(requests, "req_id int, since string, platform string, genre string, sort_by string, direction string, `limit` bigint, offset bigint")
    for r in batch.batch_search(table, spark.createDataFrame(games, kind), dims, dims).collect():
        got.setdefault(r.req_id, {})[r["rank"]] = r.id
    from datetime import UTC, datetime

    for k, since, platform, genre, sort_by, direction, limit, offset in requests:
        at = None if since is None else int(datetime.fromisoformat(since).replace(tzinfo=UTC).timestamp())
        ids = lambda t: None if t is None else {i for i in range(5) if t.lower() in f"dim{i}"} or None
        rows = [g for g in games if g[2] == 0 and (at is None or (g[4] is not None and g[4] >= at))]
        for wanted, c in ((ids(platform), 5), (ids(genre), 6)):
            rows = [g for g in rows if wanted is None or any(x[0] in wanted for x in g[c] or [])]
        up = sort_by == "odd" or (direction or "desc").lower() == "asc"
        column = {None: 3, "name": 1, "id": 0, "first_release_date": 4, "odd": 0}[sort_by]
        some, none = sorted((g for g in rows if g[column] is not None), key=lambda g: g[0]), sorted((g for g in rows if g[column] is None), key=lambda g: g[0])
        some.sort(key=lambda g: g[column], reverse=not up)
        n, skip = min(100 if limit is None else limit, 500), offset or 0
        assert got.get(k, {}) == dict(enumerate(g[0] for g in (some + none)[skip : skip + n])), requests[k]


def test_batch_equals_single_requests(spark):
    """Titles, dates, names and sorts in any mix: pages, groups and meta are those of one search at a time."""
    import random

    rng = random.Random(11)
    kind = "id bigint, name string, category int, total_rating double, first_release_date bigint, version_parent bigint, cover struct<url: string>, platforms array<struct<id: bigint, name: string>>, genres array<struct<id: bigint, name: string>>"
    words = ["red", "Red", "ring", "of", "a", "Éa", "rings", "x"]
    pick = lambda: [(i, f"d{i}") for i in rng.sample(range(4), rng.randrange(4))] or None
    rows = [(i, rng.choice([None, *(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) for _ in range(6))]), 0 if i % 7 else 1, rng.choice([None, float(i % 13)]), rng.choice([None, 0, 946684800 + i % 5]), rng.choice([None, 0, 3, 14, 9999, 40]), None, pick(), pick()) for i in range(1, 160)]
    games = spark.createDataFrame(rows, kind).cache()
    dims = spark.createDataFrame([(i, f"Dim{i}") for i in range(4)], "id bigint, name string")
    titles = [None, "", "  ", "red", "RED ring", "ring  of", "éa", "g", "of a", "rin ngs", "zzz", "red zzz", "x", "\u2003a\u2003"]
    asked = [(k, rng.choice(titles), rng.choice([None, "2000-01-01", "2000-01-01T00:00:02", "2100-01-01"]), rng.choice([None, None, "dim1", "im", "zz"]), rng.choice([None, None, "DIM2", "zz"]), rng.choice([None, "name", "id"]), rng.choice([None, "asc"]), rng.choice([None, 4, 7, 600]), rng.choice([None, 0, 2])) for k in range(60)]
    requests = spark.createDataFrame(asked, "req_id int, title string, since string, platform string, genre string, sort_by string, direction string, `limit` bigint, offset bigint")
    search = batch.BatchSearch(requests, games, dims, dims)
    pages = search.pages().cache()
    groups = batch.batch_groups(pages, games).cache()
    meta = {r.req_id: r for r in batch.batch_meta(search, pages, groups).collect()}
    page_of, group_of = {}, {}
    for r in pages.orderBy("rank").collect():
        page_of.setdefault(r.req_id, []).append((r["rank"], r.id))
    for r in versions.in_order(groups, ("req_id",)).collect():
        group_of.setdefault(r.req_id, []).append((r.place, r.group, r["rank"], r.id, r.fetched, [v.id for v in r.versions]))
    for k, title, since, platform, genre, sort_by, direction, limit, offset in asked[:24]:
        found = catalog.having_any(catalog.having_any(games.where(catalog.main_only()), dims, "platforms", platform), dims, "genres", genre)
        found = found.where(catalog.released_since(since)) if since else found
        order = catalog.ordering(sort_by or "total_rating", direction or "desc")
        if title and title.split():
            condition, order = catalog.title_rank(title)
            found = found.where(condition)
        shown = catalog.page(found, order, limit, offset).cache()
        assert page_of.get(k, []) == [(r["rank"], r.id) for r in shown.orderBy("rank").collect()], asked[k]
        single = versions.group_versions(shown, games)
        assert group_of.get(k, []) == [(r.place, r.group, r["rank"], r.id, r.fetched, [v.id for v in r.versions]) for r in versions.in_order(single).collect()], asked[k]
        want = catalog.meta(None if title and title.split() else found, single, limit, offset, shown).first()
        assert {c: want[c] for c in want.asDict()} == {c: meta[k][c] for c in want.asDict()}, asked[k]
    assert set(meta) == set(range(60))


def test_batch_of_nothing(spark):
    games = spark.createDataFrame([], "id bigint, name string, category int, total_rating double, first_release_date bigint, version_parent bigint, cover struct<url: string>, platforms array<struct<id: bigint, name: string>>, genres array<struct<id: bigint, name: string>>")
    dims = spark.createDataFrame([], "id bigint, name string")
    for rows in ([], [(1, "a", None), (2, None, 0)]):
        search = batch.BatchSearch(spark.createDataFrame(rows, "req_id int, title string, `limit` int"), games, dims, dims)
        pages = search.pages()
        assert pages.count() == 0
        meta = {r.req_id: (r.page, r.total, r.totalPages, r.hasMore) for r in batch.batch_meta(search, pages, batch.batch_groups(pages, games)).collect()}
        assert meta == ({1: (1, None, None, False), 2: (None, 0, None, True)} if rows else {})


def test_cards_and_the_listing_of_a_short_one(spark):
    """Paths of a card in their order, nested ones too; what isn't asked for goes, what is missing is null."""
    kind = "id bigint, name string, platforms array<struct<id: bigint, name: string, slug: string, platform_logo: struct<id: bigint, url: string, width: int>>>, total_rating double, involved_companies array<struct<id: bigint, company: struct<id: bigint, name: string, country: int>, publisher: boolean, developer: boolean>>, odd int"
    rows = spark.createDataFrame([(1, "a", [(2, "p", "s", (3, "//x/t_thumb/y", 90)), None], 5.0, [(4, (5, "c", 6), True, False)], 7), (2, None, None, None, None, 8)], kind)
    full, short = catalog.card(rows, None), catalog.card(rows, "0")
    assert catalog.card(rows, "").columns == full.columns and "total_rating" not in full.columns and "odd" not in full.columns
    assert short.columns == ["id", "name", "first_release_date", "genres", "platforms", "cover", "involved_companies", "aggregated_rating", "version_parent", "category", "status"]
    assert full.schema["platforms"].dataType.elementType.names == ["id", "name", "platform_logo"]
    assert full.schema["platforms"].dataType.elementType["platform_logo"].dataType.names == ["id", "url"]
    assert short.schema["platforms"].dataType.elementType.names == ["id", "name"]
    one = short.where("id = 1").first()
    assert one.platforms[0].asDict() == {"id": 2, "name": "p"} and one.platforms[1] is None and one.involved_companies[0].asDict(True) == {"id": 4, "company": {"id": 5, "name": "c"}, "publisher": True}
    shown = {r.id: r for r in catalog.listing(short).collect()}
    assert shown[1].platforms[0].platform_logo.asDict() == {"url": "", "id": None} and shown[1].total_rating is None and shown[1].summary == "" and shown[2].platforms == []
    assert catalog.listing(full).where("id = 1").first().platforms[0].platform_logo.asDict() == {"url": "//x/t_720p/y", "id": 3}


def test_commands_as_json_are_judged(spark):
    rows = spark.createDataFrame([(1, '{"category_ids": [], "igdb_data": {}}'), (2, None), (3, "{}"), (4, "[1]"), (5, "nonsense"), (6, '{"category_ids": ["a", null], "igdb_data": [], "player_data": "x"}'), (7, '{"categories": null, "igdb_data": {"id": 1}}')], "id int, body string")
    got = {r.id: r.reasons for r in rows.select("id", validate.create_reasons().alias("reasons")).collect()}
    assert got == {1: [], 2: ["BAD_CATEGORY_IDS", "BAD_GAME"], 3: ["BAD_CATEGORY_IDS", "BAD_GAME"], 4: ["BAD_CATEGORY_IDS", "BAD_GAME"], 5: ["BAD_BODY", "BAD_CATEGORY_IDS", "BAD_GAME"], 6: ["BAD_CATEGORY_IDS", "BAD_GAME", "BAD_PLAYER"], 7: ["BAD_CATEGORY_IDS"]}
    got = {r.id: r.reasons for r in rows.select("id", validate.update_reasons().alias("reasons")).collect()}
    assert got == {1: [], 2: [], 3: [], 4: [], 5: ["BAD_BODY"], 6: ["BAD_GAME", "BAD_PLAYER"], 7: []}


def test_batch_joins_are_not_left_to_file_sizes(spark, monkeypatch):
    """Small files that hold many rows (exploded, or texts stored once) must not go to the driver."""
    from shelfwork.sources.tables import saved

    monkeypatch.setattr(batch, "FEW", 0)
    games = spark.sql("select id, concat('game ', id % 7) as name, 0 as category, cast(null as bigint) as version_parent, id * 1.0d as total_rating, id * 1000 as first_release_date, named_struct('url', 'u') as cover, array(named_struct('id', id % 3)) as platforms, array(named_struct('id', id % 2)) as genres from range(20)")
    games, dims = saved(games, "games"), saved(spark.sql("select id, concat('n', id) as name from range(3)"), "dims")
    requests = saved(spark.sql("select id as req_id, if(id % 2 = 0, 'game', null) as title, 'n1' as platform, if(id % 3 = 0, 'n1', null) as genre, 3L as `limit` from range(50)"), "requests")
    search = batch.BatchSearch(requests, games, dims, dims)
    pages = search.pages()
    groups = batch.batch_groups(saved(pages, "pages"), games)
    for rows in (pages, groups, batch.batch_meta(search, pages, groups)):
        assert "BroadcastExchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_command_bodies_are_parsed_once(spark):
    for found in (validate.create_reasons(), validate.update_reasons()):
        rows = validate.judged(spark.range(1).select(F.concat(F.lit("{"), F.col("id").cast("string")).alias("body")), found)
        plan = rows.select(F.array_join("reasons", "|"), F.size("reasons") == 0)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.lower().count("parsejson") + plan.lower().count("parse_json") == 1, plan


def test_batch_groups_work_out_pages_once(spark):
    """Both parts of the grouping and its parents read groups that are written once, not the pages behind them, and a title meets a name once."""
    from shelfwork.sources.tables import saved

    games = spark.sql("select id, 'red game' as name, 0 as category, if(id % 5 = 4, id - 1, null) as version_parent, 1.0d as total_rating, id * 40000000 as first_release_date, named_struct('url', 'u') as cover, array(named_struct('id', 0L)) as platforms, array(named_struct('id', 0L)) as genres from range(300)")
    games, dims = saved(games, "games"), saved(spark.sql("select id, concat('n', id) as name from range(3)"), "dims")
    requests = spark.sql("select id as req_id, 'RED' as title, cast(date_add(date'1970-06-01', cast(id * 500 as int)) as string) as since, 4L as `limit`, id % 3 as offset from range(40)")
    search = batch.BatchSearch(requests, games, dims, dims)
    assert search._names()[1].count() == 1
    pages = saved(search.pages(), "onlypages")
    groups = batch.batch_groups(pages, games)
    assert "/onlypages-" not in groups._jdf.queryExecution().optimizedPlan().toString() and not any("/onlypages-" in f for f in groups.inputFiles())
    epoch = {r.req_id: r.at for r in requests.selectExpr("req_id", "unix_seconds(cast(since as timestamp)) as at").collect()}
    want = {(i, k): g for i, at in epoch.items() for k, g in enumerate([g for g in range(300) if g * 40000000 >= at][i % 3 : i % 3 + 4])}
    assert {(r.req_id, r["rank"]): r.id for r in pages.collect()} == want
    assert {r.req_id for r in groups.collect()} == set(range(40))
