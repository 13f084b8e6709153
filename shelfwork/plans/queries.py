"""Registered queries over the driver's tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwork.functions import scalars as S
from shelfwork.operators import batch, catalog, commands, library, validate, versions
from shelfwork.sources import store, tables
from shelfwork.sources.adapter import Domain, with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

SINCE, PLATFORM, GENRE, TITLE = "2012-06-01", "on_1", "a", "red widget"
SLUG = "regexp_replace(replace(lower(name), ' ', '-'), '[^A-Za-z0-9_-]+', '', 'g')"
ANY_PLATFORM = "(select list(id) from (select id from platforms where contains(lower(name), '{text}') order by id limit 50))"


def query(sql: str | None = None):
    def register(f):
        name = f.__name__
        QUERIES[name] = lambda spark, folder: f(Domain(spark, folder))
        if sql is not None:
            ORACLES[name] = with_views(sql.strip())
        return f

    return register


def joined(c, separator: str = "|"):
    return F.array_join(c, separator)


@query(f"select category_id as _id, user_id as \"userId\", name, {SLUG} as slug, cast(count(distinct backlog_id) as bigint) as \"countGames\" from categories left join backlog_categories using (category_id, user_id) group by 1, 2, 3")
def category_counts(d: Domain) -> DataFrame:
    return library.category_list(d.categories(), d.memberships())


@query(f"select id, name, {SLUG} as slug from games union all select category_id, name, {SLUG} from categories")
def slugs(d: Domain) -> DataFrame:
    rows = d.games().select("id", "name").unionByName(d.categories().select(F.col("_id").alias("id"), "name"))
    return rows.select("id", "name", S.slug(F.col("name")).alias("slug"))


@query("select id, coalesce(regexp_replace(cover_url || '?t_thumb', 't_thumb', 't_720p'), '') as url from games")
def image_rewrite(d: Domain) -> DataFrame:
    return d.flat("games").select("id", S.large_image(F.concat("cover_url", F.lit("?t_thumb"))).alias("url"))


@query(f"select id, name, first_release_date from games where category = 0 and first_release_date >= epoch(timestamp '{SINCE}')")
def search_since(d: Domain) -> DataFrame:
    return d.games().where(catalog.all_of(catalog.released_since(SINCE), catalog.main_only())).select("id", "name", "first_release_date")


def _having(kind: str, text: str) -> str:
    dim, link, key = (("platforms", "game_platforms", "platform_id") if kind == "platforms" else ("genres", "game_genres", "genre_id"))
    return f"(not exists (select 1 from {dim} where contains(lower(name), '{text}')) or id in (select game_id from {link} where {key} in (select id from {dim} where contains(lower(name), '{text}') order by id limit 50)))"


@query(f"select id, name from games where category = 0 and {_having('platforms', PLATFORM)}")
def search_platform(d: Domain) -> DataFrame:
    return catalog.having_any(d.full_games().where(catalog.main_only()), d.platforms(), "platforms", PLATFORM.upper()).select("id", "name")


@query(f"select id, name from games where category = 0 and {_having('genres', 'asi')}")
def search_genre(d: Domain) -> DataFrame:
    return catalog.having_any(d.full_games().where(catalog.main_only()), d.genres(), "genres", "asi").select("id", "name")


@query("select id, name from games where category = 0")
def search_platform_unmatched(d: Domain) -> DataFrame:
    return catalog.having_any(d.full_games().where(catalog.main_only()), d.platforms(), "platforms", "no such").select("id", "name")


@query(f"""select id, name, cast(row_number() over (order by case when lower(name) = '{TITLE}' then 0 when starts_with(lower(name), '{TITLE}') then 1 else 2 end, length(name), id) - 1 as bigint) as rank
 from games where category = 0 and contains(lower(name), 'red') and contains(lower(name), 'widget') qualify rank < 100""")
def search_title(d: Domain) -> DataFrame:
    condition, order = catalog.title_rank(TITLE)
    return catalog.page(d.games().where(condition & catalog.main_only()), order).select("id", "name", F.col("rank").cast("bigint").alias("rank"))


PAGE = f"select *, row_number() over (order by total_rating desc nulls last, id) - 21 as rank from games where category = 0 and first_release_date >= epoch(timestamp '{SINCE}') and {_having('platforms', PLATFORM)} order by total_rating desc nulls last, id limit 50 offset 20"


def _matches(d: Domain) -> DataFrame:
    games = d.full_games().where(catalog.all_of(catalog.released_since(SINCE), catalog.main_only()))
    return catalog.having_any(games, d.platforms(), "platforms", PLATFORM)


def _page(d: Domain) -> DataFrame:
    return catalog.page(_matches(d), catalog.ordering(), 50, 20)


@query(f"select id, name, total_rating, cast(rank as bigint) as rank from ({PAGE})")
def search_page(d: Domain) -> DataFrame:
    return _page(d).select("id", "name", "total_rating", F.col("rank").cast("bigint").alias("rank"))


@query("""select id, name, total_rating, cast(row_number() over (order by total_rating desc nulls last, id) - 1 as bigint) as rank
 from (select * from games where category = 0 order by total_rating desc nulls last, id limit 50 offset 900)""")
def search_deep_page(d: Domain) -> DataFrame:
    """Cut down to 200 rows before any sort."""
    rows = catalog.deep_page(d.games().where(catalog.main_only()), "total_rating", "desc", 50, 900, most=200)
    return rows.select("id", "name", "total_rating", F.col("rank").cast("bigint").alias("rank"))


def _grouped(page: str, strict: bool) -> str:
    """The grouping in SQL: groups and orphans of a page (id, name, cover_url, category, version_parent, rank)."""
    return f"""
pg as ({page}),
r as (select *, coalesce(version_parent, 0) = 0 as main, case when coalesce(version_parent, 0) <> 0 then version_parent else id end as grp from pg),
h as (select grp, max(case when main then rank end) as head_rank, max(case when main then id end) as head_id from r group by grp),
g as (select h.grp, h.head_rank, coalesce(h.head_id, c.id) as gid, coalesce(h.head_id, c.id) is not null as known, h.head_id is null and c.id is not null as fetched from h left join games c on c.id = h.grp and h.head_id is null),
v as (select r.grp, string_agg(cast(r.id as varchar), '|' order by r.rank) as versions from r join g using (grp) where not main and known {"and (head_rank is null or r.rank > head_rank)" if strict else ""} group by r.grp),
res as (select 0 as place, g.grp as "group", cast(null as bigint) as rank, gid as id, c.name, g.fetched, coalesce(v.versions, '') as versions from g left join v on v.grp = g.grp left join games c on c.id = g.gid where {"true" if strict else "known"}
 union all select 1, r.grp, cast(r.rank as bigint), r.id, r.name, false, '' from r join g using (grp) where not g.known)"""


@query("with " + _grouped(PAGE, False).strip() + """,
 n as (select count(*) as after from res), b as (select count(*) as before from pg), t as (select count(*) as total from games where category = 0 and first_release_date >= epoch(timestamp '""" + SINCE + "') and " + _having("platforms", PLATFORM) + """)
 select cast(1 as bigint) as page, cast(50 as bigint) as "limit", cast(20 as bigint) as "offset", total, cast(case when total > 0 then ceil(total / 50.0) end as bigint) as "totalPages", after = 50 as "hasMore", before as "beforeGrouping" from n, b, t""")
def search_meta(d: Domain) -> DataFrame:
    matches = _matches(d)
    page = catalog.page(matches, catalog.ordering(), 50, 20)
    return catalog.meta(matches, versions.group_versions(page, d.games()), 50, 20, page)


@query(f"""with pg as ({PAGE}),
 p as (select game_id, string_agg(concat(pl.id, ':', pl.name, ':', coalesce(regexp_replace(logo_url, 't_thumb', 't_720p'), '')), '|' order by pl.id) as platforms from game_platforms join platforms pl on pl.id = platform_id group by game_id),
 g as (select game_id, string_agg(gn.name, '|' order by gn.id) as genres from game_genres join genres gn on gn.id = genre_id group by game_id)
 select pg.id, pg.name, coalesce(genres, '') as genres, coalesce(platforms, '') as platforms, first_release_date, '' as summary, coalesce(regexp_replace(cover_url, 't_thumb', 't_720p'), '') as cover, total_rating
 from pg left join p on p.game_id = pg.id left join g on g.game_id = pg.id""")
def search_listing(d: Domain) -> DataFrame:
    rows = catalog.listing(_page(d))
    platform = F.transform("platforms", lambda p: F.concat(p["id"].cast("string"), F.lit(":"), p["name"], F.lit(":"), p["platform_logo"]["url"]))
    return rows.select("id", "name", joined(S.names(F.col("genres"))).alias("genres"), joined(platform).alias("platforms"), "first_release_date", "summary", F.col("cover.url").alias("cover"), "total_rating")


#: Requests by customer, so that their number grows with the table: names that match, that don't, dates and sorts in turn.
REQUESTS = """select c_custkey as req_id, case c_custkey % 3 when 0 then '2011-01-01' when 1 then '2005-01-01' end as since,
 case c_custkey % 4 when 0 then 'nation_2' when 1 then 'none' when 2 then concat('_', cast(c_custkey % 25 as string)) end as platform, case c_custkey % 5 when 0 then 'a' when 1 then 'asia' when 2 then 'none' end as genre,
 case c_custkey % 3 when 0 then 'total_rating' when 1 then 'first_release_date' when 2 then 'name' end as sort_by, case c_custkey % 2 when 0 then 'asc' else 'desc' end as direction, cast(5 + c_custkey % 7 as bigint) as "limit", cast(c_custkey % 4 as bigint) as "offset"
 from {customer}"""


@query(f"""with rq as ({REQUESTS.format(customer="customer")}),
 pm as (select platform as text, list(id) as ids from (select distinct platform from rq where platform is not null) t join platforms p on contains(lower(p.name), lower(t.platform)) group by 1),
 gm as (select genre as text, list(id) as ids from (select distinct genre from rq where genre is not null) t join genres g on contains(lower(g.name), lower(t.genre)) group by 1),
 pg as (select text, game_id from pm join game_platforms on list_contains(ids, platform_id) group by 1, 2),
 gg as (select text, game_id from gm join game_genres on list_contains(ids, genre_id) group by 1, 2),
 m as (select rq.*, g.id, g.name, g.total_rating, g.first_release_date from rq join games g on g.category = 0
  and (rq.since is null or g.first_release_date >= epoch(cast(rq.since as timestamp)))
  and (rq.platform is null or rq.platform not in (select text from pm) or (rq.platform, g.id) in (select text, game_id from pg))
  and (rq.genre is null or rq.genre not in (select text from gm) or (rq.genre, g.id) in (select text, game_id from gg))),
 k as (select *, case sort_by when 'total_rating' then total_rating when 'first_release_date' then cast(first_release_date as double) end as num, case when sort_by = 'name' then name end as txt from m),
 o as (select *, row_number() over (partition by req_id order by (num is null and txt is null), case when direction = 'asc' then num end, case when direction = 'desc' then num end desc, case when direction = 'asc' then txt end, case when direction = 'desc' then txt end desc, id) as n from k)
 select req_id, cast(n - 1 - "offset" as bigint) as rank, id from o where n > "offset" and n <= "offset" + "limit" """)
def search_batch(d: Domain) -> DataFrame:
    requests = d.spark.sql(REQUESTS.replace('"', "`"), customer=d.flat("customer"))
    return batch.batch_search(requests, d.full_games(), d.platforms(), d.genres())


#: The requests above, four fifths of them with a title: parts of a game's name, so that words are cut anywhere.
TITLED = "select r.*, case when req_id % 5 <> 4 then substr(upper(p_name), cast(1 + req_id % 3 as int), cast(3 + req_id % 6 as int)) end as title from (" + REQUESTS + ") r left join {part} on p_partkey = req_id"

#: Every request's page in SQL: pg (req_id, rank, id), and m, its matches.
TITLED_PAGES = f"""rq as ({TITLED.format(customer="customer", part="part")}),
 tq as (select *, case when trim(title) <> '' then lower(title) end as low from rq),
 pm as (select platform as text, list(id) as ids from (select distinct platform from rq where platform is not null) t join platforms p on contains(lower(p.name), lower(t.platform)) group by 1),
 gm as (select genre as text, list(id) as ids from (select distinct genre from rq where genre is not null) t join genres g on contains(lower(g.name), lower(t.genre)) group by 1),
 pg_ as (select text, game_id from pm join game_platforms on list_contains(ids, platform_id) group by 1, 2),
 gg as (select text, game_id from gm join game_genres on list_contains(ids, genre_id) group by 1, 2),
 m as (select rq.*, g.id, g.name, g.total_rating, g.first_release_date from tq rq join games g on g.category = 0
  and (rq.low is null or len(list_filter(string_split(rq.low, ' '), lambda w: w <> '' and not contains(lower(g.name), w))) = 0)
  and (rq.since is null or g.first_release_date >= epoch(cast(rq.since as timestamp)))
  and (rq.platform is null or rq.platform not in (select text from pm) or (rq.platform, g.id) in (select text, game_id from pg_))
  and (rq.genre is null or rq.genre not in (select text from gm) or (rq.genre, g.id) in (select text, game_id from gg))),
 k as (select *, case when low is null then case sort_by when 'total_rating' then total_rating when 'first_release_date' then cast(first_release_date as double) end end as num, case when low is null and sort_by = 'name' then name end as txt,
  case when low is null then 0 when lower(name) = low then 0 when starts_with(lower(name), low) then 1 else 2 end as kind, case when low is null then 0 else length(name) end as long from m),
 o as (select *, row_number() over (partition by req_id order by kind, long, (num is null and txt is null), case when direction = 'asc' then num end, case when direction = 'desc' then num end desc, case when direction = 'asc' then txt end, case when direction = 'desc' then txt end desc, id) as n from k),
 pg as (select req_id, cast(n - 1 - "offset" as bigint) as rank, id from o where n > "offset" and n <= "offset" + "limit")"""

TITLED_GROUPS = TITLED_PAGES + """,
 r as (select pg.req_id, pg.rank, g.id, coalesce(version_parent, 0) = 0 as main, case when coalesce(version_parent, 0) <> 0 then version_parent else g.id end as grp from pg join games g using (id)),
 h as (select req_id, grp, max(case when main then id end) as head_id from r group by 1, 2),
 gr as (select h.req_id, h.grp, coalesce(head_id, c.id) as gid, head_id is null and c.id is not null as fetched from h left join games c on c.id = h.grp and h.head_id is null),
 v as (select r.req_id, r.grp, string_agg(cast(r.id as varchar), '|' order by r.rank) as versions from r where not main group by 1, 2),
 res as (select gr.req_id, 0 as place, gr.grp as "group", cast(null as bigint) as rank, gid as id, c.name, fetched, coalesce(versions, '') as versions from gr left join v using (req_id, grp) join games c on c.id = gid
  union all select r.req_id, 1, r.grp, r.rank, r.id, c.name, false, '' from r join gr using (req_id, grp) join games c on c.id = r.id where gid is null)"""


def _titled(d: Domain) -> batch.BatchSearch:
    requests = d.spark.sql(TITLED.replace('"', "`"), customer=d.flat("customer"), part=d.flat("part"))
    return batch.BatchSearch(requests, d.full_games(), d.platforms(), d.genres())


@query(f"with {TITLED_PAGES} select * from pg")
def search_batch_titles(d: Domain) -> DataFrame:
    return _titled(d).pages()


@query(f"with {TITLED_GROUPS} select * from res")
def search_batch_groups(d: Domain) -> DataFrame:
    groups = batch.batch_groups(_titled(d).pages(), d.games())
    return _flat_groups(groups, "req_id")


@query(f"""with {TITLED_GROUPS},
 t as (select req_id, count(*) as total from m group by 1), b as (select req_id, count(*) as n from pg group by 1), a as (select req_id, count(*) as n from res group by 1)
 select req_id, "offset" // "limit" + 1 as page, "limit", "offset", case when low is null then coalesce(total, 0) end as total, case when low is null and total > 0 then (total + "limit" - 1) // "limit" end as "totalPages",
  coalesce(a.n, 0) = "limit" as "hasMore", coalesce(b.n, 0) as "beforeGrouping" from tq left join t using (req_id) left join b using (req_id) left join a using (req_id)""")
def search_batch_meta(d: Domain) -> DataFrame:
    search = _titled(d)
    pages = tables.saved(search.pages(), "pages")
    return batch.batch_meta(search, pages, batch.batch_groups(pages, d.games()))


@query("select id, name, total_rating, first_release_date, cover_url as cover from games where total_rating is not null order by total_rating desc, id limit 50")
def best_rated(d: Domain) -> DataFrame:
    return catalog.best_rated(d.games()).withColumn("cover", F.col("cover.url"))


@query("select id, name, upper(substr(name, 1, 3)) as abbreviation, logo_url as url, regexp_replace(logo_url, 't_thumb', 't_720p') as logo from platforms order by id limit 200")
def platform_list(d: Domain) -> DataFrame:
    return catalog.platform_list(d.platforms()).select("id", "name", "abbreviation", F.col("platform_logo.url").alias("url"), "logo")


@query("select id, name from genres order by id limit 200")
def genre_list(d: Domain) -> DataFrame:
    return catalog.genre_list(d.genres())


@query("""with p as (select game_id, string_agg(concat(pl.name, '=', coalesce(logo_url, '-')), '|' order by pl.id) as platforms from game_platforms join platforms pl on pl.id = platform_id group by 1),
 g as (select game_id, string_agg(gn.name, '|' order by gn.id) as genres from game_genres join genres gn on gn.id = genre_id group by 1)
 select games.id, platforms, genres from games left join p on p.game_id = games.id left join g on g.game_id = games.id""")
def expand_refs(d: Domain) -> DataFrame:
    games = catalog.expand_references(d.reference_ids(), "platforms", d.platforms(), ["id", "name", "platform_logo"])
    games = catalog.expand_references(games, "genres", d.genres(), ["id", "name"])
    platform = F.transform("platforms", lambda p: F.concat(p["name"], F.lit("="), F.coalesce(p["platform_logo"]["url"], F.lit("-"))))
    return games.select("id", joined(platform).alias("platforms"), joined(S.names(F.col("genres"))).alias("genres"))


def _flat_groups(rows: DataFrame, *by: str) -> DataFrame:
    return rows.select(*by, F.col("place").cast("int").alias("place"), "group", "rank", "id", "name", "fetched", joined(F.transform("versions", lambda v: v["id"].cast("string"))).alias("versions"))


WHOLE = "select *, id as rank from games where category = 0"
#: Ranked so that some editions come before their parent.
SHUFFLED = "select *, (id * 7919) % 10007 * 1000000 + id as rank from games where category = 0"


@query("with " + _grouped(WHOLE, False).strip() + " select * from res")
def version_groups(d: Domain) -> DataFrame:
    page = d.games().where(catalog.main_only()).withColumn("rank", F.col("id"))
    return _flat_groups(versions.group_versions(page, d.games()))


@query("with " + _grouped(SHUFFLED, True).strip() + " select * from res")
def version_groups_strict(d: Domain) -> DataFrame:
    page = d.games().where(catalog.main_only()).withColumn("rank", (F.col("id") * 7919) % 10007 * 1000000 + F.col("id"))
    return _flat_groups(versions.group_versions(page, d.games(), strict=True))


@query("with " + _grouped(PAGE, False).strip() + ' select *, cast(row_number() over (order by place, "group", rank nulls first) as bigint) as position from res')
def result_order(d: Domain) -> DataFrame:
    from pyspark.sql.window import Window

    rows = versions.in_order(_flat_groups(versions.group_versions(_page(d), d.games())))
    return rows.withColumn("position", F.row_number().over(Window.orderBy("place", "group", F.col("rank").asc_nulls_first())).cast("bigint"))


ENTRIES = """held as (select backlog_id, list(category_id order by category_id) as categories from backlog_categories group by backlog_id),
 entries as (select b.backlog_id, b.user_id, b.game_id, b.status, b.hours_played, b.created_at, held.categories, g.name as game_name from backlogs b left join held using (backlog_id) left join games g on g.id = b.game_id)"""
TEXT = "array_to_string(categories, '|')"


@query(f"with {ENTRIES} select backlog_id as _id, user_id, {TEXT} as categories, status from entries where user_id in (select c_custkey from customer where c_nationkey = 3) and len(list_filter(categories, lambda x: x % 5 = 2)) > 0")
def library_all(d: Domain) -> DataFrame:
    users = d.flat("customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("userId"))
    wanted = d.categories().where("_id % 5 = 2").select(F.col("_id").alias("category_id"))
    rows = library.in_categories(library.owned_by(d.backlogs(), users), wanted).dropDuplicates(["_id"])
    return rows.select("_id", F.col("userId").alias("user_id"), joined(F.col("categories").cast("array<string>")).alias("categories"), F.col("player_data.status").alias("status"))


POPULATED = "pop as (select e.backlog_id, string_agg({what}, '|' order by c.category_id) as names from entries e, unnest(e.categories) as t(cid) join categories c on c.category_id = t.cid group by 1)"
SHORT_REQUESTS = "select c_custkey as user_id, case c_custkey % 3 when 0 then c_custkey * 5 + 1 when 1 then 7 end as category_id from {customer}"


@query(f"""with {ENTRIES}, {POPULATED.format(what="c.name")}, rq as ({SHORT_REQUESTS.format(customer="customer")}),
 own as (select rq.user_id, rq.category_id, c.category_id is not null as own from rq left join categories c on c.category_id = rq.category_id and c.user_id = rq.user_id)
 select e.backlog_id as id, game_name as name, coalesce(names, '') as categories from entries e join own using (user_id) left join pop using (backlog_id) where not own.own or list_contains(e.categories, own.category_id)""")
def library_short(d: Domain) -> DataFrame:
    requests = d.spark.sql(SHORT_REQUESTS, customer=d.flat("customer")).withColumnRenamed("user_id", "userId")
    rows = library.in_category_if_owned(d.backlogs(), d.categories(), requests)
    return library.short_view(library.populate(rows, d.categories())).select("id", "name", joined("categories").alias("categories"))


@query(f"""with {ENTRIES}, {POPULATED.format(what="concat(c.category_id, ':', c.name)")}, keys as (select o_orderkey as _id, case when o_orderkey % 5 = 0 then o_custkey + 1 else o_custkey end as user_id from orders)
 select k._id, k.user_id, e.backlog_id is not null as found, names as categories, e.status from keys k left join entries e on e.backlog_id = k._id and e.user_id = k.user_id left join pop on pop.backlog_id = e.backlog_id""")
def library_detail(d: Domain) -> DataFrame:
    keys = d.flat("orders").select(F.col("o_orderkey").alias("_id"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("userId"))
    detail = library.detail_view(library.populate(d.backlogs(), d.categories()))
    rows = library.lookup(detail, keys)
    text = F.transform("categories", lambda x: F.concat(x["id"].cast("string"), F.lit(":"), x["name"]))
    shown = F.when(F.size("categories") > 0, joined(text))
    return rows.select("_id", F.col("userId").alias("user_id"), "found", shown.alias("categories"), F.col("player_data.status").alias("status"))


@query("select backlog_id as _id, user_id, cast(2 as bigint) as page, cast(3 as bigint) as \"limit\", cast(3 as bigint) as \"offset\" from backlogs qualify row_number() over (partition by user_id order by backlog_id) between 4 and 6")
def library_page(d: Domain) -> DataFrame:
    rows = library.backlog_page(d.backlogs(), F.lit("2nd"), F.lit(" 3"), paginate=True)
    return rows.select("_id", F.col("userId").alias("user_id"), "page", "limit", "offset")


@query("""select b.backlog_id as _id, b.user_id, cast(row_number() over (partition by b.user_id order by g.name nulls last, b.backlog_id) as bigint) as place from backlogs b join (select distinct backlog_id, category_id from backlog_categories) bc using (backlog_id)
 join categories c on c.category_id = bc.category_id and c.user_id = b.user_id and c.name = 'Na fila' left join games g on g.id = b.game_id qualify place between 2 and 6""")
def library_sorted_page(d: Domain) -> DataFrame:
    rows = library.sorted_page(d.backlogs(), d.categories(), "Na fila", F.col("igdb_data.name"), "asc", 5, 1)
    return rows.select("_id", F.col("userId").alias("user_id"), F.col("place").cast("bigint").alias("place"))


#: Update commands made of orders: own categories, another user's, a repeated one, none.
UPDATES = """select o_orderkey as seq, timestamp '2024-05-06 00:00:00' as ts, case when o_orderkey % 13 = 0 then o_orderkey + 100000000 else o_orderkey end as _id, o_custkey as user_id,
 case o_orderkey % 6 when 0 then {a}o_custkey * 5 + 1, o_custkey * 5 + 3{z} when 1 then {a}o_custkey * 5 + 7{z} when 2 then {a}o_custkey * 5, o_custkey * 5{z} when 3 then {none} end as categories,
 case when o_orderkey % 4 = 0 then 'Dropado' end as status from {orders}"""
UPDATES_SQL = UPDATES.format(a="[", z="]", none="cast([] as bigint[])", orders="orders")
CHECKED = "ck as (select *, coalesce(len(categories), 0) = 0 or len(list_filter(list_distinct(categories), lambda x: x // 5 = user_id and x // 5 in (select c_custkey from customer))) = len(categories) as ok from up)"


def _updates(d: Domain) -> DataFrame:
    rows = d.spark.sql(UPDATES.format(a="array(", z=")", none="cast(array() as array<bigint>)", orders="{orders}"), orders=d.flat("orders")).withColumnRenamed("user_id", "userId")
    player = F.when(F.col("status").isNotNull(), F.struct("status", F.lit(None).cast("double").alias("hours_played"), F.lit(7.5).alias("rating"), F.lit(None).cast("string").alias("review")))
    return rows.withColumn("player_data", player).withColumn("igdb_data", F.lit(None).cast(d.backlogs().schema["igdb_data"].dataType)).withColumn("ts", F.col("ts").cast("timestamp"))


OWN = "own as (select u.seq, count(distinct c.category_id) as met from up u, unnest(u.categories) as t(cid) join categories c on c.category_id = t.cid and c.user_id = u.user_id group by 1)"
OK = "(coalesce(len(u.categories), 0) = 0 or coalesce(own.met, 0) = len(u.categories))"


@query(f"with up as ({UPDATES_SQL}), {OWN} select u.seq, {OK} as ok from up u left join own using (seq)")
def owned_check(d: Domain) -> DataFrame:
    return commands.owned_check(_updates(d), d.categories())


@query(f"""with {ENTRIES}, up as ({UPDATES_SQL}), {OWN}, j as (select u.*, {OK} as ok from up u left join own using (seq))
 select e.backlog_id as key, array_to_string(coalesce(j.categories, e.categories), '|') as categories, case when j.status is not null then 'Dropado' else e.status end as status, case when j.status is not null then 0 else e.hours_played end as hours, case when j.status is not null then 7.5::double end as rating, strftime(coalesce(j.ts, e.created_at), '%Y-%m-%d') as updated, 'row' as kind
 from entries e left join j on j._id = e.backlog_id and j.user_id = e.user_id and j.ok
 union all select seq, '', case when not ok then 'CATEGORIES_NOT_OWNED' else 'GAME_NOT_FOUND' end, 0, null, null, 'reject' from j left join backlogs b on b.backlog_id = j._id and b.user_id = j.user_id where not ok or b.backlog_id is null""")
def update_entries(d: Domain) -> DataFrame:
    rows, rejects = commands.update_entries(d.backlogs(), d.categories(), _updates(d))
    flat = rows.select(F.col("_id").alias("key"), joined(F.col("categories").cast("array<string>")).alias("categories"), F.col("player_data.status").alias("status"), F.col("player_data.hours_played").cast("bigint").alias("hours"), F.col("player_data.rating").alias("rating"), F.date_format("updatedAt", "yyyy-MM-dd").alias("updated"), F.lit("row").alias("kind"))
    return flat.unionByName(rejects.select(F.col("seq").alias("key"), F.lit("").alias("categories"), F.col("reason").alias("status"), F.lit(0).cast("bigint").alias("hours"), F.lit(None).cast("double").alias("rating"), F.lit(None).cast("string").alias("updated"), F.lit("reject").alias("kind")))


@query(f"""with {ENTRIES} select backlog_id as _id, user_id, {TEXT} as categories, status, hours_played as hours, strftime(created_at, '%Y-%m-%d') as created from entries
 union all select c_custkey + 500000000, c_custkey, array_to_string([c_custkey * 5 + 4, 1, 1], '|'), case when c_custkey % 2 = 0 then 'Zerado' else 'Wishlist' end, 0, '2024-01-01' from customer""")
def insert_entries(d: Domain) -> DataFrame:
    old = d.backlogs()
    game = F.struct(F.col("c_custkey").alias("id"), F.lit("game").alias("name"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in old.schema["igdb_data"].dataType.fields[2:]])
    player = F.struct(F.when(F.col("c_custkey") % 2 == 0, "Zerado").alias("status"), F.lit(None).cast("double").alias("hours_played"), F.lit(None).cast("double").alias("rating"), F.lit(None).cast("string").alias("review"))
    new = d.flat("customer").select((F.col("c_custkey") + 500000000).alias("_id"), F.col("c_custkey").alias("userId"), F.array(F.col("c_custkey") * 5 + 4, F.lit(1).cast("bigint"), F.lit(1).cast("bigint")).alias("category_ids"), game.alias("igdb_data"), player.alias("player_data"), F.lit("2024-01-01").cast("timestamp").alias("ts"))
    rows = commands.insert_entries(old, new)
    return rows.select("_id", F.col("userId").alias("user_id"), joined(F.col("categories").cast("array<string>")).alias("categories"), F.col("player_data.status").alias("status"), F.col("player_data.hours_played").cast("bigint").alias("hours"), F.date_format("createdAt", "yyyy-MM-dd").alias("created"))


@query("""with cmd as (select l_orderkey * 10 + l_linenumber as seq, l_partkey as _id, case when l_linenumber = 7 then -1 else o_custkey end as user_id from lineitem join orders on o_orderkey = l_partkey)
 select backlog_id as key, 'row' as kind from backlogs b where not exists (select 1 from cmd where cmd._id = b.backlog_id and cmd.user_id = b.user_id)
 union all select seq, 'GAME_NOT_FOUND' from cmd where not exists (select 1 from backlogs b where cmd._id = b.backlog_id and cmd.user_id = b.user_id)""")
def delete_entries(d: Domain) -> DataFrame:
    """Each line asks for the entry that has the number of its part; every seventh in nobody's name."""
    lines = d.flat("lineitem").join(d.flat("orders"), F.col("o_orderkey") == F.col("l_partkey"))
    cmd = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_partkey").alias("_id"), F.when(F.col("l_linenumber") == 7, F.lit(-1)).otherwise(F.col("o_custkey")).cast("bigint").alias("userId"))
    rows, rejects = commands.delete_rows(d.backlogs(), cmd)
    return rows.select(F.col("_id").alias("key"), F.lit("row").alias("kind")).unionByName(rejects.select(F.col("seq").alias("key"), F.col("reason").alias("kind")))


@query(f"""with recursive {ENTRIES},
 cmd as (select m.*, row_number() over (partition by m.backlog_id order by m.ts, m.seq) as k, exists (select 1 from categories c where c.category_id = m.category_id) as there from membership_commands m),
 ok as (select *, row_number() over (partition by backlog_id order by ts, seq) as n from cmd where there or op = 'remove'),
 fold as (select e.backlog_id, e.categories as cats, cast(0 as bigint) as n, cast(null as bigint) as seq, cast(null as varchar) as reason, cast(e.created_at as timestamp) as changed from entries e
  union all
  select f.backlog_id, case when r.reason is not null then f.cats when o.op = 'add' then list_append(f.cats, o.category_id) else list_concat(f.cats[1:list_position(f.cats, o.category_id) - 1], f.cats[list_position(f.cats, o.category_id) + 1:]) end, o.n, o.seq, r.reason, case when r.reason is null then cast(o.ts as timestamp) else f.changed end
  from fold f join ok o on o.backlog_id = f.backlog_id and o.n = f.n + 1, lateral (select case when o.op = 'add' and list_contains(f.cats, o.category_id) then 'ALREADY_IN_CATEGORY' when o.op = 'remove' and not list_contains(f.cats, o.category_id) then 'NOT_IN_CATEGORY' when o.op = 'remove' and len(f.cats) = 1 then 'LAST_CATEGORY' end as reason) r)
 select backlog_id as key, array_to_string(arg_max(cats, n), '|') as value, strftime(arg_max(changed, n), '%Y-%m-%d %H:%M:%S') as updated, 'row' as kind from fold group by backlog_id
 union all select seq, reason, null, 'reject' from fold where reason is not null
 union all select seq, 'CATEGORY_NOT_FOUND', null, 'reject' from cmd where not there and op = 'add'""")
def membership_commands(d: Domain) -> DataFrame:
    rows, rejects = commands.membership(d.backlogs(), d.categories(), d.commands(), check_ids=False)
    flat = rows.select(F.col("_id").alias("key"), joined(F.col("categories").cast("array<string>")).alias("value"), F.date_format("updatedAt", "yyyy-MM-dd HH:mm:ss").alias("updated"), F.lit("row").alias("kind"))
    return flat.unionByName(rejects.select(F.col("seq").alias("key"), F.col("reason").alias("value"), F.lit(None).cast("string").alias("updated"), F.lit("reject").alias("kind")))


@query("select category_id as _id, name, user_id from categories union all select 800000000 + s_suppkey, concat('Lista ', cast(s_suppkey as string)), s_suppkey from supplier")
def create_categories(d: Domain) -> DataFrame:
    new = d.flat("supplier").select((F.col("s_suppkey") + 800000000).alias("_id"), F.concat(F.lit("Lista "), F.col("s_suppkey").cast("string")).alias("name"), F.col("s_suppkey").alias("userId"))
    return commands.create_categories(d.categories(), new).withColumnRenamed("userId", "user_id")


RENAMES = "select o_orderkey as seq, o_orderdate as ts, o_custkey * 5 + o_orderkey % 5 as _id, case when o_orderkey % 17 = 0 then o_custkey + 1 else o_custkey end as user_id, concat('Nova ', cast(o_orderkey as string)) as name from {orders}"


@query(f"""with rn as ({RENAMES.format(orders="orders")}), l as (select _id, user_id, arg_max(name, (ts, seq)) as name from rn group by 1, 2)
 select category_id as key, coalesce(l.name, c.name) as value, 'row' as kind from categories c left join l on l._id = c.category_id and l.user_id = c.user_id
 union all select seq, 'CATEGORY_NOT_FOUND', 'reject' from rn where not exists (select 1 from categories c where c.category_id = rn._id and c.user_id = rn.user_id)""")
def rename_categories(d: Domain) -> DataFrame:
    cmd = d.spark.sql(RENAMES, orders=d.flat("orders")).withColumnRenamed("user_id", "userId")
    rows, rejects = commands.rename_categories(d.categories(), cmd)
    return rows.select(F.col("_id").alias("key"), F.col("name").alias("value"), F.lit("row").alias("kind")).unionByName(rejects.select(F.col("seq").alias("key"), F.col("reason").alias("value"), F.lit("reject").alias("kind")))


DROPS = "select c_custkey as seq, timestamp '2024-02-01 00:00:00' as ts, c_custkey * 5 + c_custkey % 4 as _id, case when c_custkey % 9 = 0 then c_custkey + 1 else c_custkey end as user_id from {customer}"


@query(f"""with {ENTRIES}, dr as ({DROPS.format(customer="customer")}), gone as (select dr.* from dr join categories c on c.category_id = dr._id and c.user_id = dr.user_id),
 e as (select backlog_id, categories, created_at, list_filter(categories, lambda x: not coalesce(list_contains(g.ids, x), false)) as rest from entries left join (select user_id, list(_id) as ids from gone group by 1) g using (user_id))
 select backlog_id as key, array_to_string(rest, '|') as value, case when len(rest) < len(categories) then '2024-02-01' else strftime(created_at, '%Y-%m-%d') end as updated, 'entry' as kind from e where len(rest) > 0 or len(rest) = len(categories)
 union all select category_id, name, null, 'category' from categories c where not exists (select 1 from gone where gone._id = c.category_id)
 union all select seq, 'CATEGORY_NOT_FOUND', null, 'reject' from dr where not exists (select 1 from gone where gone.seq = dr.seq)""")
def delete_categories(d: Domain) -> DataFrame:
    cmd = d.spark.sql(DROPS, customer=d.flat("customer")).withColumnRenamed("user_id", "userId")
    kept, rows, rejects = commands.delete_categories(d.categories(), d.backlogs(), cmd)
    none = F.lit(None).cast("string")
    part = lambda t, value, kind, key="_id", updated=none: t.select(F.col(key).alias("key"), value.alias("value"), updated.alias("updated"), F.lit(kind).alias("kind"))
    return part(rows, joined(F.col("categories").cast("array<string>")), "entry", updated=F.date_format("updatedAt", "yyyy-MM-dd")).unionByName(part(kept, F.col("name"), "category")).unionByName(part(rejects, F.col("reason"), "reject", "seq"))


#: Two thirds of the suppliers ask for names of the form of the users' ones, some of them taken, some twice.
SIGNUPS = "select s_suppkey as seq, timestamp '2024-03-01 00:00:00' as ts, concat('signup-', cast(s_suppkey as string)) as _id, case when s_suppkey % 3 = 0 then concat('Customer#', lpad(cast(s_suppkey as string), 9, '0')) else concat('New', cast(floor(s_suppkey / 4) as int)) end as username, concat('m', cast(floor(s_suppkey / 3) as int), '@example.org') as email from {supplier}"


@query(f"""with recursive sg as ({SIGNUPS.format(supplier="supplier")}), free as (select * from sg where username not in (select username from users) and email not in (select email from users)),
 ord as (select *, row_number() over (order by ts, seq) as n from free),
 walk as (select cast(0 as bigint) as n, cast([] as varchar[]) as us, cast([] as varchar[]) as es, cast(null as bigint) as seq, false as ok
  union all select o.n, case when f.ok then list_append(w.us, o.username) else w.us end, case when f.ok then list_append(w.es, o.email) else w.es end, o.seq, f.ok
  from walk w join ord o on o.n = w.n + 1, lateral (select not list_contains(w.us, o.username) and not list_contains(w.es, o.email) as ok) f)
 select sg.seq, sg.username, coalesce(ok, false) as accepted, case when ok then 'Favoritos|Na fila|Jogando|Zerados|Dropados' else '' end as categories, case when ok then strftime(sg.ts, '%Y-%m-%d') end as created from sg left join walk using (seq)""")
def register_users(d: Domain) -> DataFrame:
    cmd = d.spark.sql(SIGNUPS, supplier=d.flat("supplier"))
    new, _ = commands.register_users(d.users(), cmd)
    seeded = commands.seed_categories(new).groupBy("userId").agg(joined(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"])).alias("seeded"))
    made = commands.stamped(new.select("seq", "_id", F.col("ts").alias("at")), F.col("at")).join(seeded, F.col("_id") == F.col("userId"), "left").select("seq", "seeded", "createdAt")
    rows = cmd.join(made, "seq", "left")
    return rows.select("seq", "username", F.col("createdAt").isNotNull().alias("accepted"), F.coalesce("seeded", F.lit("")).alias("categories"), F.date_format("createdAt", "yyyy-MM-dd").alias("created"))


@query(f"""with {ENTRIES}, r as (select backlog_id as _id, array_to_string(list_filter([case when backlog_id % 31 = 0 then 'NO_USER' end, case when backlog_id % 29 = 0 then 'NO_CATEGORIES' end, case when game_name is null then 'NO_GAME_NAME' end, case when backlog_id % 7 = 0 then 'BAD_STATUS' end, case when backlog_id % 12 > 10 then 'BAD_RATING' end], lambda x: x is not null), '|') as reasons from entries)
 select _id, reasons, reasons = '' as valid from r""")
def validate_entries(d: Domain) -> DataFrame:
    rows = d.backlogs().withColumn("userId", F.when(F.col("_id") % 31 != 0, F.col("userId"))).withColumn("categories", F.when(F.col("_id") % 29 != 0, F.col("categories")))
    player = F.col("player_data").withField("status", F.when(F.col("_id") % 7 == 0, F.lit("Lost")).otherwise(F.col("player_data.status"))).withField("rating", (F.col("_id") % 12).cast("double"))
    valid, rejected = validate.split(rows.withColumn("player_data", player), validate.entry_reasons())
    return valid.select("_id", F.lit("").alias("reasons"), F.lit(True).alias("valid")).unionByName(rejected.select("_id", joined("reasons").alias("reasons"), F.lit(False).alias("valid")))


PAGES = "select o_orderkey as id, case o_orderkey % 6 when 0 then '0' when 1 then 'abc' when 2 then '12abc' when 3 then '-1' when 4 then cast(o_orderkey as string) end as page, case o_orderkey % 4 when 0 then '25' when 1 then '' when 2 then ' 7' end as \"limit\" from {orders}"


@query(f"""with r as ({PAGES.format(orders="orders")}), n as (select id, coalesce(nullif(try_cast(nullif(regexp_extract(page, '^\\s*([+-]?\\d+)', 1), '') as bigint), 0), 1) as page, coalesce(nullif(try_cast(nullif(regexp_extract("limit", '^\\s*([+-]?\\d+)', 1), '') as bigint), 0), 10) as "limit" from r)
 select id, page, "limit", case when page >= 1 and "limit" >= 1 then (page - 1) * "limit" end as "offset", page >= 1 and "limit" >= 1 as valid from n""")
def page_params(d: Domain) -> DataFrame:
    rows = d.spark.sql(PAGES.replace('"', "`"), orders=d.flat("orders"))
    p = S.page_parameters(F.col("page"), F.col("limit"))
    return rows.select("id", *[c.alias(n) for n, c in p.items()])


IDS = "select o_orderkey as id, case when o_orderkey % 3 = 0 then lpad(cast(o_orderkey as string), 24, 'a') when o_orderkey % 3 = 1 then lpad(cast(o_orderkey as string), 24, 'g') else cast(o_orderkey as string) end as text from {orders}"


@query(f"select id, regexp_full_match(text, '[0-9a-fA-F]{{24}}') as ok from ({IDS.format(orders='orders')})")
def object_id_check(d: Domain) -> DataFrame:
    rows = d.spark.sql(IDS, orders=d.flat("orders"))
    return rows.select("id", S.is_object_id(F.col("text")).alias("ok"))


@query("""select g.id, string_agg(gn.name, '|' order by gn.id) as names from games g join game_genres gg on gg.game_id = g.id join genres gn on gn.id = gg.genre_id group by 1""")
def mixed_names(d: Domain) -> DataFrame:
    entry = lambda x: F.when(x["id"] % 2 == 0, x["name"]).otherwise(F.to_json(x))
    rows = d.full_games().where("genres is not null").select("id", F.transform("genres", entry).alias("mixed"))
    return rows.select("id", joined(S.mixed_names(F.col("mixed"))).alias("names"))


@query("select id, name, cover_url as url, total_rating from games")
def catalog_json(d: Domain) -> DataFrame:
    """Records as JSON text, read back by the catalogue's schema."""
    from shelfwork.sources.schemas import GAMES

    text = tables.json_rows(d.games())
    got = text.select(F.from_json("json", GAMES).alias("g"))
    return got.select("g.id", "g.name", F.col("g.cover.url").alias("url"), "g.total_rating")


@query(f"with {ENTRIES} select backlog_id as _id, user_id, {TEXT} as categories, game_name as name from entries")
def library_roundtrip(d: Domain) -> DataFrame:
    """The library as a new version of its table, read back by its schema."""
    spark, shared = d.spark, tables.scratch_folder(d.spark)
    rows = d.backlogs().withColumns({"_id": F.col("_id").cast("string"), "userId": F.col("userId").cast("string"), "categories": F.col("categories").cast("array<string>")})
    path = tables.write_version(rows, f"{shared}/backlogs")
    got = tables.read(spark, "backlogs", path)
    return got.select(F.col("_id").cast("bigint").alias("_id"), F.col("userId").cast("bigint").alias("user_id"), joined("categories").alias("categories"), F.col("igdb_data.name").alias("name"))


@query(f"""with {ENTRIES} select backlog_id as _id, user_id, {TEXT} as categories, game_name as name, 'row' as kind from entries where user_id not in (select s_suppkey from supplier)
 union all select o_orderkey, s_suppkey, null, null, 'reject' from supplier join orders on o_custkey = s_suppkey + 1 where not exists (select 1 from backlogs b where b.backlog_id = o_orderkey and b.user_id = s_suppkey)""")
def library_store(d: Domain) -> DataFrame:
    """Users who are suppliers delete all their entries, and ask for those of the next user too; only their buckets are written anew."""
    held = store.Store(d.spark, f"{tables.scratch_folder(d.spark)}/library-{uuid.uuid4().hex}")
    held.create(d.backlogs())
    asked = tables.saved(_deletions(d), "asked")
    manifest, rejects = held.change(asked, commands.delete_rows)
    left = held.read(manifest=manifest).select("_id", F.col("userId").alias("user_id"), joined(F.col("categories").cast("array<string>")).alias("categories"), F.col("igdb_data.name").alias("name"), F.lit("row").alias("kind"))
    refused = rejects.join(asked, "seq").select("_id", F.col("userId").alias("user_id"), F.lit(None).cast("string").alias("categories"), F.lit(None).cast("string").alias("name"), F.lit("reject").alias("kind"))
    return left.unionByName(refused)


def _deletions(d: Domain) -> DataFrame:
    """seq, _id, userId: of each supplier the orders of the customer with its number and of the next one. Both are met by equality."""
    who = d.flat("supplier").select(F.col("s_suppkey").alias("userId"), F.explode(F.array(F.col("s_suppkey"), F.col("s_suppkey") + 1)).alias("customer"))
    orders = d.flat("orders").select(F.col("o_orderkey").alias("_id"), F.col("o_custkey").alias("customer"))
    return who.join(orders, "customer").select((F.col("_id") * 2 + (F.col("customer") == F.col("userId")).cast("int")).alias("seq"), "_id", "userId")


#: Two updates of each order under numbers that repeat, and none for each 700th.
REPEATED = "select rid, nullif(rid % 700, 0) as seq, ts, _id, user_id, categories from (select seq * 2 as rid, ts, _id, user_id, categories from ({updates}) union all select seq * 2 + 1, ts, seq, user_id, null from ({updates}))"


@query(f"""with {ENTRIES}, up as ({REPEATED.format(updates=UPDATES_SQL)}),
 own as (select u.rid, count(distinct c.category_id) as met from up u, unnest(u.categories) as t(cid) join categories c on c.category_id = t.cid and c.user_id = u.user_id group by 1),
 j as (select u.*, {OK} as ok from up u left join own using (rid)), n as (select _id, user_id, max(categories) as categories, max(ts) as ts from j where ok group by 1, 2)
 select e.backlog_id as key, array_to_string(coalesce(n.categories, e.categories), '|') as value, strftime(coalesce(n.ts, e.created_at), '%Y-%m-%d') as updated, cast(1 as bigint) as times from entries e left join n on n._id = e.backlog_id and n.user_id = e.user_id
 union all select seq, case when not ok then 'CATEGORIES_NOT_OWNED' else 'GAME_NOT_FOUND' end as reason, null, count(*) from j left join backlogs b on b.backlog_id = j._id and b.user_id = j.user_id where not ok or b.backlog_id is null group by seq, reason""")
def repeated_commands(d: Domain) -> DataFrame:
    updates = UPDATES.format(a="array(", z=")", none="cast(array() as array<bigint>)", orders="{orders}")
    rows = d.spark.sql(REPEATED.format(updates=updates), orders=d.flat("orders")).drop("rid").withColumnRenamed("user_id", "userId").withColumn("ts", F.col("ts").cast("timestamp"))
    old = d.backlogs()
    new, rejects = commands.update_entries(old, d.categories(), rows.withColumns({c: F.lit(None).cast(old.schema[c].dataType) for c in ("igdb_data", "player_data")}))
    shown = new.select(F.col("_id").alias("key"), joined(F.col("categories").cast("array<string>")).alias("value"), F.date_format("updatedAt", "yyyy-MM-dd").alias("updated"), F.lit(1).cast("bigint").alias("times"))
    return shown.unionByName(rejects.groupBy(F.col("seq").alias("key"), F.col("reason").alias("value")).agg(F.count(F.lit(1)).alias("times")).withColumn("updated", F.lit(None).cast("string")))


RECORDS = """p as (select game_id, string_agg(concat(pl.id, ':', pl.name{logo}), '|' order by pl.id) as platforms from game_platforms join platforms pl on pl.id = platform_id group by game_id),
 g as (select game_id, string_agg(concat(gn.id, ':', gn.name), '|' order by gn.id) as genres from game_genres join genres gn on gn.id = genre_id group by game_id)"""
FULL_FIELDS = "id,name,summary,storyline,first_release_date,genres,platforms,cover,screenshots,artworks,involved_companies,rating,aggregated_rating,follows,hypes,game_localizations,language_supports,similar_games,franchise,collection,version_parent,category,status"
SHORT_FIELDS = "id,name,first_release_date,genres,platforms,cover,involved_companies,aggregated_rating,version_parent,category,status"


def _text(d: DataFrame, column: str) -> F.Column:
    """A field as text, all that it holds: parts of a struct by colons, elements of an array by bars."""
    from pyspark.sql import types as T

    def flat(value, kind):
        if isinstance(kind, T.ArrayType):
            return joined(F.transform(value, lambda x: flat(x, kind.elementType)))
        if isinstance(kind, T.StructType):
            return F.when(value.isNotNull(), F.concat_ws(":", *[F.coalesce(flat(value[f.name], f.dataType), F.lit("")) for f in kind.fields]))
        return value.cast("string")

    return F.coalesce(flat(F.col(column), d.schema[column].dataType), F.lit(""))


def _card(rows: DataFrame) -> DataFrame:
    plain = [c for c in ("id", "name", "first_release_date", "rating", "aggregated_rating", "follows", "hypes", "version_parent") if c in rows.columns]
    return rows.select(*plain, *[_text(rows, c).alias(c) for c in rows.columns if c not in plain], F.lit(",".join(rows.columns)).alias("fields"))


@query(f"""with {RECORDS.format(logo=", ':', case when logo_url is not null then concat(pl.id, ':', logo_url) else '' end")}
 select id, name, first_release_date, (id % 100) / 4.0::double as rating, case when id % 3 <> 0 then (id % 64) / 8.0::double end as aggregated_rating, id % 77 as follows, id % 5 as hypes, version_parent,
 '' as summary, case when id % 3 = 0 then concat('Story ', id) else '' end as storyline, coalesce(genres, '') as genres, coalesce(platforms, '') as platforms, coalesce(cover_url, '') as cover,
 case when id % 4 <> 0 then concat(id * 10, '://img.example/t_thumb/s', id, '|', id * 10, '://img.example/t_thumb/t', id) else '' end as screenshots, case when id % 5 <> 0 then concat(id * 10, '://img.example/t_thumb/a', id) else '' end as artworks,
 case when id % 6 <> 0 then concat(id, ':', id % 50, ':Company ', id % 50, ':', case when id % 2 = 0 then 'true' else 'false' end) else '' end as involved_companies,
 case when id % 2 = 0 then concat(id, ':Jogo ', id, ':', id % 9) else '' end as game_localizations, case when id % 3 = 1 then concat(id, ':', id % 4, ':Language ', id % 4, ':', id % 3, ':Support ', id % 3) else '' end as language_supports,
 concat(id + 1, ':Game ', id + 1, '|', id + 2, ':Game ', id + 2) as similar_games, case when id % 8 = 0 then concat(id % 10, ':Franchise ', id % 10) else '' end as franchise, case when id % 9 = 0 then concat(id % 12, ':Collection ', id % 12) else '' end as collection,
 cast(category as varchar) as category, cast(id % 4 as varchar) as status, '{FULL_FIELDS}' as fields from games left join p on p.game_id = id left join g on g.game_id = id""")
def full_cards(d: Domain) -> DataFrame:
    return _card(catalog.card(d.records(), None))


@query(f"""with {RECORDS.format(logo="")}
 select id, name, first_release_date, case when id % 3 <> 0 then (id % 64) / 8.0::double end as aggregated_rating, version_parent, coalesce(genres, '') as genres, coalesce(platforms, '') as platforms, coalesce(cover_url, '') as cover,
 case when id % 6 <> 0 then concat(id, ':', id % 50, ':Company ', id % 50, ':', case when id % 2 = 0 then 'true' else 'false' end) else '' end as involved_companies,
 cast(category as varchar) as category, cast(id % 4 as varchar) as status, '{SHORT_FIELDS}' as fields from games left join p on p.game_id = id left join g on g.game_id = id""")
def short_cards(d: Domain) -> DataFrame:
    return _card(catalog.card(d.records(), "0"))


def _landed(d: Domain, rows: DataFrame, name: str) -> DataFrame:
    """Rows landed as JSON lines and read by the table's schema."""
    path = f"{tables.scratch_folder(d.spark)}/landed-{name}-{uuid.uuid4().hex}"
    tables.json_rows(rows).write.text(path)
    return tables.read(d.spark, name, path, "json")


@query(f"""with {RECORDS.format(logo=", ':', case when logo_url is not null then concat(pl.id, ':', logo_url) else '' end")}
 select id, name, first_release_date, total_rating, coalesce(genres, '') as genres, coalesce(platforms, '') as platforms, coalesce(cover_url, '') as cover, id % 4 as status, {len(FULL_FIELDS.split(",")) + 1} as columns
 from games left join p on p.game_id = id left join g on g.game_id = id""")
def landed_games(d: Domain) -> DataFrame:
    """Records as they land, with a field that the schema doesn't have, read by the schema."""
    rows = _landed(d, d.records(), "games")
    return rows.select("id", "name", "first_release_date", "total_rating", *[_text(rows, c).alias(c) for c in ("genres", "platforms", "cover")], F.col("status").cast("bigint").alias("status"), F.lit(len(rows.columns)).alias("columns"))


@query("""select 'platform' as kind, id, name, upper(substr(name, 1, 3)) as abbreviation, logo_url as url from platforms
 union all select 'genre', id, name, null, null from genres""")
def landed_dimensions(d: Domain) -> DataFrame:
    platforms, genres = _landed(d, d.platforms(), "platforms"), _landed(d, d.genres(), "genres")
    none = F.lit(None).cast("string")
    p = platforms.select(F.lit("platform").alias("kind"), "id", "name", "abbreviation", F.col("platform_logo.url").alias("url"))
    return p.unionByName(genres.select(F.lit("genre").alias("kind"), "id", "name", none.alias("abbreviation"), none.alias("url")))


@query("with " + _grouped(PAGE, False).strip() + f""",
 n as (select count(*) as after from res), t as (select count(*) as total from games where category = 0 and first_release_date >= epoch(timestamp '{SINCE}') and {_having("platforms", PLATFORM)})
 select 'data' as part, id, name, cast(null as bigint) as total, cast(null as bigint) as pages, cast(null as boolean) as more from ({PAGE})
 union all select 'meta', 1, null, total, cast(case when total > 0 then ceil(total / 50.0) end as bigint), after = 50 from n, t""")
def search_answer(d: Domain) -> DataFrame:
    """The answer of a search as landed JSON: its listing and its meta row, read back."""
    matches = _matches(d)
    page = catalog.page(matches, catalog.ordering(), 50, 20)
    folder = f"{tables.scratch_folder(d.spark)}/answer-{uuid.uuid4().hex}"
    tables.write_answer(catalog.listing(page), catalog.meta(matches, versions.group_versions(page, d.games()), 50, 20, page), folder)
    data, meta = d.spark.read.schema("id bigint, name string").json(f"{folder}/data"), d.spark.read.schema("page bigint, total bigint, totalPages bigint, hasMore boolean").json(f"{folder}/meta")
    none = F.lit(None)
    rows = data.select(F.lit("data").alias("part"), "id", "name", none.cast("bigint").alias("total"), none.cast("bigint").alias("pages"), none.cast("boolean").alias("more"))
    return rows.unionByName(meta.select(F.lit("meta").alias("part"), F.col("page").alias("id"), none.cast("string").alias("name"), "total", F.col("totalPages").alias("pages"), F.col("hasMore").alias("more")))


def _judged(rows: DataFrame, reasons) -> DataFrame:
    return validate.judged(rows, reasons).select("id", joined("reasons").alias("reasons"), (F.size("reasons") == 0).alias("valid"))


def _rules(source: str, rules: str) -> str:
    return f"with r as ({source}), x as (select id, array_to_string(list_filter([{rules}], lambda v: v is not null), '|') as reasons from r) select id, reasons, reasons = '' as valid from x"


#: Bodies of create and update commands, of all kinds of right and wrong fields in turn.
BODIES = """select o_orderkey as id, case when o_orderkey % 101 = 0 then 'no json' else concat('{{', concat_ws(',', case o_orderkey % 7 when 0 then '"{list}":[]' when 1 then '"{list}":["a","b"]' when 2 then '"{list}":["a",1]' when 3 then '"{list}":"a"' when 4 then '"{list}":null' when 5 then '"{list}":["a",null]' end,
 case o_orderkey % 5 when 0 then '"igdb_data":{{"id":1}}' when 1 then '"igdb_data":{{}}' when 2 then '"igdb_data":"x"' when 3 then '"igdb_data":null' end, case o_orderkey % 3 when 0 then '"player_data":{{"status":"Jogando"}}' when 1 then '"player_data":7' end, '"more":1'), '}}') end as body from {orders}"""
_JSON = "case when id % 101 = 0 then 'BAD_BODY' end"


@query(_rules(BODIES.format(list="category_ids", orders="orders"), f"{_JSON}, case when id % 101 = 0 or id % 7 > 1 then 'BAD_CATEGORY_IDS' end, case when id % 101 = 0 or id % 5 > 1 then 'BAD_GAME' end, case when id % 101 <> 0 and id % 3 = 1 then 'BAD_PLAYER' end"))
def validate_create_commands(d: Domain) -> DataFrame:
    return _judged(_bodies(d, "category_ids"), validate.create_reasons())


@query(_rules(BODIES.format(list="categories", orders="orders"), f"{_JSON}, case when id % 101 <> 0 and id % 7 = 3 then 'BAD_CATEGORIES' end, case when id % 101 <> 0 and id % 5 = 2 then 'BAD_GAME' end, case when id % 101 <> 0 and id % 3 = 1 then 'BAD_PLAYER' end"))
def validate_update_commands(d: Domain) -> DataFrame:
    return _judged(_bodies(d, "categories"), validate.update_reasons())


def _bodies(d: Domain, name: str) -> DataFrame:
    return d.spark.sql(BODIES.replace("{list}", name), orders=d.flat("orders"))


@query("select category_id as id, case when category_id % 6 = 0 then 'NO_NAME' else '' end as reasons, category_id % 6 <> 0 as valid from categories")
def validate_categories(d: Domain) -> DataFrame:
    rows = d.categories().select(F.col("_id").alias("id"), F.when(F.col("_id") % 6 != 0, F.col("name")).alias("name"))
    return _judged(rows, validate.category_reasons())


SIGNS = "select c_custkey as id, case c_custkey % 6 when 0 then null when 1 then 'a@b' when 2 then 'a b@c.d' when 3 then 'a.b@c-d.example' when 4 then '@c.d' else concat('u', cast(c_custkey as string), '@example.com') end as email, case c_custkey % 4 when 0 then null when 1 then '12345' else '123456' end as password from {customer}"


@query(_rules(SIGNS.format(customer="customer"), "case when id % 6 in (0, 1, 2, 4) then 'BAD_EMAIL' end, case when id % 4 in (0, 1) then 'SHORT_PASSWORD' end"))
def validate_users(d: Domain) -> DataFrame:
    return _judged(d.spark.sql(SIGNS, customer=d.flat("customer")), validate.user_reasons())


SEARCHES = """select o_orderkey as id, case o_orderkey % 5 when 0 then '2012-06-01' when 1 then '2012-06-01T10:00:00Z' when 2 then 'June' when 3 then '2012-13-01' end as {q}releaseDate{q}, case o_orderkey % 7 when 0 then '10' when 1 then '0' when 2 then '-1' when 3 then '1.5' when 4 then 'ten' when 5 then '' end as {q}limit{q},
 case o_orderkey % 4 when 0 then '+3' when 1 then '.5' when 2 then '5.' end as {q}offset{q}, case o_orderkey % 3 when 0 then '2' when 1 then 'two' end as page, case o_orderkey % 2 when 0 then '1' else 'yes' end as short, case o_orderkey % 11 when 0 then '8.5' when 1 then 'x' end as {q}lastRating{q}, case o_orderkey % 13 when 0 then 'asc' when 1 then 'desc' when 2 then 'up' end as {q}order{q} from {orders}"""


@query(_rules(SEARCHES.format(q='"', orders="orders"), "case when id % 5 in (2, 3) then 'BAD_DATE' end, case when id % 7 in (1, 2, 4, 5) then 'BAD_LIMIT' end, case when id % 4 = 2 then 'BAD_OFFSET' end, case when id % 3 = 1 then 'BAD_PAGE' end, case when id % 2 = 1 then 'BAD_SHORT' end, case when id % 11 = 1 then 'BAD_LAST_RATING' end, case when id % 13 = 2 then 'BAD_ORDER' end"))
def validate_searches(d: Domain) -> DataFrame:
    return _judged(d.spark.sql(SEARCHES.replace("{q}", "`"), orders=d.flat("orders")), validate.search_reasons())
