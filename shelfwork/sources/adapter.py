"""The driver's tables seen as domain tables. One SQL text serves Spark and DuckDB: ``{name}`` stands for a table or an
earlier view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = {
    "platforms": "select cast(n_nationkey as bigint) as id, n_name as name, case when n_nationkey % 4 <> 0 then concat('//img.example/t_thumb/p', cast(n_nationkey as string), '.png') end as logo_url from {nation}",
    "genres": "select cast(r_regionkey as bigint) as id, r_name as name from {region}",
    "users": "select c_custkey as user_id, c_name as username, concat(lower(replace(c_name, '#', '.')), '@example.com') as email from {customer}",
    "game_platforms": "select distinct l_partkey as game_id, cast(s_nationkey as bigint) as platform_id from {lineitem} join {supplier} on l_suppkey = s_suppkey where l_linenumber = 1",
    "game_genres": "select distinct gp.game_id, cast(n_regionkey as bigint) as genre_id from {game_platforms} gp join {nation} on gp.platform_id = n_nationkey",
    "games": """select p_partkey as id, p_name as name, case when p_partkey % 10 = 9 then 1 else 0 end as category,
 case when p_partkey % 7 = 3 then p_partkey - 3 when p_partkey % 97 = 5 then 10000000 + p_partkey end as version_parent,
 case when p_partkey % 11 <> 0 then 946684800 + cast(p_size as bigint) * 15552000 end as first_release_date,
 case when p_partkey % 5 <> 0 then (p_partkey * 37 % 1000) / cast(10 as double) end as total_rating,
 case when p_partkey % 13 <> 0 then concat('//img.example/t_thumb/', cast(p_partkey as string), '.jpg') end as cover_url from {part}""",
    "categories": "select c_custkey * 5 + k as category_id, c_custkey as user_id, nm as name from {customer} cross join (values (0, 'Favoritos'), (1, 'Na fila'), (2, 'Jogando'), (3, 'Zerados'), (4, 'Dropados')) as d(k, nm)",
    "backlogs": """select o_orderkey as backlog_id, o_custkey as user_id, coalesce(g, 0) as game_id, case o_orderstatus when 'F' then 'Zerado' when 'O' then 'Jogando' else 'Wishlist' end as status,
 cast(floor(o_totalprice / 10000) as bigint) as hours_played, o_orderdate as created_at from {orders} left join (select l_orderkey, min(l_partkey) as g from {lineitem} group by l_orderkey) x on l_orderkey = o_orderkey""",
    "backlog_categories": """select distinct o_orderkey as backlog_id, o_custkey as user_id, o_custkey * 5 + coalesce(l_suppkey % 4, 0) as category_id from {orders} left join {lineitem} on l_orderkey = o_orderkey
 union all select o_orderkey, o_custkey, 900000000 from {orders} where o_orderkey % 101 = 0""",
    "membership_commands": """select event_id as seq, ts, e.user_id, b.backlog_id, e.user_id * 5 + event_id % 5 as category_id, case event_type when 'click' then 'add' else 'remove' end as op
 from {events} e join (select o_custkey, min(o_orderkey) as backlog_id from {orders} group by o_custkey) b on e.user_id = b.o_custkey where event_type in ('click', 'view')""",
}
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def with_views(sql: str) -> str:
    """DuckDB text: ``sql`` over the views, as common table expressions."""
    names = {n: n for n in (*BASE, *VIEWS)}
    views = ",\n".join(f"{n} as ({text.format(**names)})" for n, text in VIEWS.items())
    recursive = "recursive " if sql.startswith("with recursive") else ""
    rest = sql.removeprefix("with recursive").removeprefix("with")
    return f"with {recursive}{views}{',' if sql.startswith('with') else ''}\n{rest}"


class Domain:
    """Domain tables of one folder; each is planned when it is asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.known = spark, folder, {}

    def flat(self, name: str) -> DataFrame:
        if name not in self.known:
            if name in BASE:
                self.known[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                text = VIEWS[name]
                used = {n: self.flat(n) for n in (*BASE, *VIEWS) if "{" + n + "}" in text}
                self.known[name] = self.spark.sql(text, **used)
        return self.known[name]

    def platforms(self) -> DataFrame:
        return self.flat("platforms").select("id", "name", F.upper(F.substring("name", 1, 3)).alias("abbreviation"), F.when(F.col("logo_url").isNotNull(), F.struct("id", F.col("logo_url").alias("url"))).alias("platform_logo"))

    def genres(self) -> DataFrame:
        return self.flat("genres")

    def reference_ids(self) -> DataFrame:
        """Games with arrays of platform and genre ids."""
        ids = lambda name, c, out: self.flat(name).groupBy("game_id").agg(F.array_sort(F.collect_list(c)).alias(out))
        games = self.flat("games")
        p, g = ids("game_platforms", "platform_id", "platforms"), ids("game_genres", "genre_id", "genres")
        games = games.join(p.withColumnRenamed("game_id", "p_id"), F.col("id") == F.col("p_id"), "left").drop("p_id")
        return games.join(g.withColumnRenamed("game_id", "g_id"), F.col("id") == F.col("g_id"), "left").drop("g_id")

    def games(self) -> DataFrame:
        """Games without references, as records."""
        return self.flat("games").select("id", "name", "category", "version_parent", "first_release_date", "total_rating", F.when(F.col("cover_url").isNotNull(), F.struct(F.col("cover_url").alias("url"))).alias("cover"), F.lit(None).cast("string").alias("summary"))

    def full_games(self) -> DataFrame:
        """Games with platforms and genres as structs, in order of their ids."""
        dim = lambda link, key, rows, fields, out: self.flat(link).join(rows, F.col(key) == F.col("id")).groupBy(F.col("game_id").alias(f"{out}_of")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(out))
        p = dim("game_platforms", "platform_id", self.platforms(), ["id", "name", "platform_logo"], "platforms")
        g = dim("game_genres", "genre_id", self.genres(), ["id", "name"], "genres")
        games = self.games()
        return games.join(p, F.col("id") == F.col("platforms_of"), "left").join(g, F.col("id") == F.col("genres_of"), "left").drop("platforms_of", "genres_of")

    def records(self) -> DataFrame:
        """Games with all fields of the catalogue's schema, and one (``checksum``) that it doesn't have."""
        i = F.col("id")
        image = lambda kind: F.struct((i * 10).alias("id"), F.concat(F.lit(f"//img.example/t_thumb/{kind}"), i.cast("string")).alias("url"), F.lit(90).alias("width"))
        named = lambda key, text: F.struct(key.cast("bigint").alias("id"), F.concat(F.lit(text), key.cast("string")).alias("name"), F.lit("x").alias("slug"))
        company = F.struct(i.alias("id"), named(i % 50, "Company ").alias("company"), (i % 2 == 0).alias("publisher"), F.lit(True).alias("developer"))
        localised = F.struct(i.alias("id"), F.concat(F.lit("Jogo "), i.cast("string")).alias("name"), (i % 9).alias("region"))
        language = F.struct(i.alias("id"), named(i % 4, "Language ").alias("language"), named(i % 3, "Support ").alias("language_support_type"))
        return self.full_games().withColumns({
            "storyline": F.when(i % 3 == 0, F.concat(F.lit("Story "), i.cast("string"))), "screenshots": F.when(i % 4 != 0, F.array(image("s"), image("t"))), "artworks": F.when(i % 5 != 0, F.array(image("a"))),
            "involved_companies": F.when(i % 6 != 0, F.array(company)), "rating": (i % 100) / F.lit(4.0), "aggregated_rating": F.when(i % 3 != 0, (i % 64) / F.lit(8.0)), "follows": i % 77, "hypes": i % 5,
            "game_localizations": F.when(i % 2 == 0, F.array(localised)), "language_supports": F.when(i % 3 == 1, F.array(language)), "similar_games": F.array(named(i + 1, "Game "), named(i + 2, "Game ")),
            "franchise": F.when(i % 8 == 0, named(i % 10, "Franchise ")), "collection": F.when(i % 9 == 0, named(i % 12, "Collection ")), "status": (i % 4).cast("int"), "checksum": i,
        })

    def memberships(self) -> DataFrame:
        """Entries with their category ids alone."""
        held = self.flat("backlog_categories").groupBy("backlog_id").agg(F.array_sort(F.collect_list("category_id")).alias("categories"))
        rows = self.flat("backlogs").select("backlog_id", "user_id")
        return rows.join(held, "backlog_id", "left").select(F.col("backlog_id").alias("_id"), F.col("user_id").alias("userId"), "categories")

    def categories(self) -> DataFrame:
        return self.flat("categories").select(F.col("category_id").alias("_id"), "name", F.col("user_id").alias("userId"))

    def backlogs(self) -> DataFrame:
        """Entries with their category ids in ascending order and a copy of the game's id and name."""
        held = self.flat("backlog_categories").groupBy("backlog_id").agg(F.array_sort(F.collect_list("category_id")).alias("categories"))
        names = self.flat("games").select(F.col("id").alias("game_id"), F.col("name").alias("game_name"))
        rows = self.flat("backlogs").join(held, "backlog_id", "left").join(names, "game_id", "left")
        player = F.struct("status", F.col("hours_played").cast("double").alias("hours_played"), F.lit(None).cast("double").alias("rating"), F.lit(None).cast("string").alias("review"))
        game = F.struct(F.col("game_id").cast("bigint").alias("id"), F.col("game_name").alias("name"), *[F.lit(None).cast(t).alias(n) for n, t in (
            ("genres", "array<struct<id: bigint, name: string>>"), ("platforms", "array<struct<id: bigint, name: string, platform_logo: struct<id: bigint, url: string>>>"),
            ("first_release_date", "bigint"), ("summary", "string"), ("cover", "struct<url: string>"), ("total_rating", "double"))])
        ts = F.col("created_at").cast("timestamp")
        return rows.select(F.col("backlog_id").alias("_id"), F.col("user_id").alias("userId"), "categories", game.alias("igdb_data"), player.alias("player_data"), ts.alias("createdAt"), ts.alias("updatedAt"))

    def commands(self) -> DataFrame:
        return self.flat("membership_commands").select("seq", F.col("ts").cast("timestamp").alias("ts"), "op", F.col("backlog_id").alias("_id"), F.col("user_id").alias("userId"), "category_id")

    def users(self) -> DataFrame:
        return self.flat("users").select(F.col("user_id").alias("_id"), "username", "email")
