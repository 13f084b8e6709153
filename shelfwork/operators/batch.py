"""A table of search requests answered at once: pages, their grouping under parents, totals and page meta.

``requests``: req_id, title, since (ISO date), platform, genre, sort_by (total_rating, first_release_date, name or id),
direction, limit, offset; any but req_id may be null, and all but req_id may be absent. A name of a platform or genre
that matches nothing doesn't filter, an unknown sort_by sorts by id. A title replaces the order by relevance and has no
total; a blank one counts as none. Rows that repeat a req_id are requests of their own with the same name: their pages
come under one req_id, so ids should be unique.

How it is spread. Requests that differ in req_id, limit and offset only are one search. What a search filters by besides
its date (texts of platform and genre) is its pool; pools and dates are met by equality alone:

- names of platforms and genres meet the texts by equality of substrings. Texts are numbered, a game has the numbers of
  those it matches, and is dealt to its pools from there: no table of pools and games is joined with the games;
- titles meet the different names by an inverted index of the names' grams: of all grams of a title's words the rarest one
  gives the candidates, which are then looked at. How a title matches is the same for all games of a name, so each pool's
  games are ranked by id once for each name and span, and a search merges the best of its names;
- a date is a set of at most 16 spans of each of nine lengths. Each pool's games are ranked once for each order and span
  that some search uses, as far as the deepest page of these goes, and counted once for each span; a search then merges
  the best of its spans and adds up their counts. So what is sorted grows with searches times pages, and no matches are
  listed to count them.

Sizes of files don't tell what comes of them (exploded rows, texts that are stored once), so no join is left to Spark's
estimate: a side whose rows were counted and are at most FEW is broadcast, all else meets by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfwork.operators import catalog, versions
from shelfwork.sources.tables import saved

#: Grams of the title index have so many characters at most; words that are shorter are grams themselves.
GRAM = 3
#: What searches use (pools, orders, spans) is broadcast to games up to so many rows, else joined by shuffle.
FEW = 100_000
#: Stands for no platform or genre; texts are numbered from 0.
ANY = -1

_TEXTS = {"title": "string", "since": "string", "platform": "string", "genre": "string", "sort_by": "string", "direction": "string", "limit": "bigint", "offset": "bigint"}


def _or_any(numbers: str) -> Column:
    """The numbers of the texts that a game matches, and the one that stands for no filter."""
    return F.concat(F.array(F.lit(ANY)), F.coalesce(numbers, F.array().cast("array<bigint>")))


def _shuffled(rows: DataFrame) -> DataFrame:
    """Neither ``rows`` nor what they are joined with goes whole to the driver."""
    return rows.hint("merge")


def _few_or_shuffled(n: int):
    """What is done with a side of so many rows before a join."""
    return F.broadcast if n <= FEW else _shuffled


def _grams(text: Column, shortest: int) -> Column:
    """The different substrings of ``shortest`` to GRAM characters."""
    n = F.length(text)
    own = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[own(k) for k in range(shortest, GRAM + 1)]))


def _words(title: Column) -> Column:
    return F.filter(F.split(title, r"(?U)\s+"), lambda w: F.length(w) > 0)


def _word_grams(title: Column) -> Column:
    """Grams that each name with all words of the title has."""
    return F.array_distinct(F.flatten(F.transform(_words(title), lambda w: F.when(F.length(w) < GRAM, F.array(w)).otherwise(_grams(w, GRAM)))))


class BatchSearch:
    """``games``: id, name, category, total_rating, first_release_date, platforms, genres."""

    def __init__(self, requests: DataFrame, games: DataFrame, platforms: DataFrame, genres: DataFrame):
        ids = {c: F.array_distinct(F.transform(c, lambda x: x["id"])) for c in ("platforms", "genres")}
        # narrow and read often: once per step that uses it
        main = saved(games.where(catalog.main_only()).select("id", "name", "total_rating", "first_release_date", *[v.alias(c) for c, v in ids.items()]), "games")
        wanted = saved(self._wanted(requests), "wanted")
        known_p, of_p = self._matching(wanted, "platform", platforms, "platforms", main)
        known_g, of_g = self._matching(wanted, "genre", genres, "genres", main)
        plain = main.select("id", "name", "total_rating", "first_release_date").join(_shuffled(of_p), "id", "left").join(_shuffled(of_g), "id", "left")
        self.games = saved(plain.select("id", "name", "total_rating", "first_release_date", _or_any("of_platform").alias("of_platform"), _or_any("of_genre").alias("of_genre")), "pooled")
        rows = wanted.join(known_p, "platform", "left").join(known_g, "genre", "left")  # the texts that are known come with hints
        rows = rows.withColumns({"platform": F.coalesce("platform_known", F.lit(ANY)), "genre": F.coalesce("genre_known", F.lit(ANY))})
        what = ["title", "since", "platform", "genre", "sort_by", "direction"]
        rows = saved(rows.select("req_id", *what, "limit", "offset"), "rows").withColumn("key", F.to_json(F.struct(*what)))
        searches = rows.groupBy("key", *what).agg(F.max(F.col("limit") + F.col("offset")).alias("depth"))
        self.searches = saved(searches.withColumn("search", F.monotonically_increasing_id()), "searches")
        most = self.searches.agg(F.max("depth").alias("depth"), F.count("title").alias("titles"), F.count(F.lit(1)).alias("n")).first()
        self.deepest, self.titles = most["depth"] or 0, most["titles"]
        self.of_ranked, self.of_searches = _few_or_shuffled(most["n"] * max(self.deepest, 1)), _few_or_shuffled(most["n"])
        numbers = self.searches.select("key", "search")
        self.asked = saved(rows.select("req_id", "key", F.col("title").isNotNull().alias("titled"), "limit", "offset").join(self.of_searches(numbers), "key").drop("key"), "asked")
        self.spans = self._spans(self.searches.where("title is null").select("search", "platform", "genre", "sort_by", "direction", "depth", "since"))
        self.hint = _few_or_shuffled(self.spans.count())

    def _wanted(self, requests: DataFrame) -> DataFrame:
        given = requests.select("req_id", *[(F.col(c) if c in requests.columns else F.lit(None)).cast(kind).alias(c) for c, kind in _TEXTS.items()])
        title = F.when(F.size(_words(F.lower("title"))) > 0, F.lower("title"))
        sort_by = F.coalesce("sort_by", F.lit("total_rating"))
        up = ~sort_by.isin(*catalog.SORTS) | (F.lower(F.coalesce("direction", F.lit("desc"))) == "asc")
        unsorted = title.isNotNull()
        return given.select(
            "req_id", title.alias("title"), F.unix_seconds(F.col("since").cast("timestamp")).alias("since"), F.lower("platform").alias("platform"), F.lower("genre").alias("genre"),
            F.when(unsorted, F.lit(None)).when(sort_by.isin(*catalog.SORTS), sort_by).otherwise("id").alias("sort_by"), F.when(unsorted, F.lit(None)).when(up, "asc").otherwise("desc").alias("direction"),
            F.least(F.coalesce("limit", F.lit(catalog.DEFAULT_ROWS)), F.lit(catalog.MOST_ROWS)).alias("limit"), F.coalesce("offset", F.lit(0)).alias("offset"),
        )

    @staticmethod
    def _matching(wanted: DataFrame, text: str, dimension: DataFrame, column: str, main: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(texts that match rows of a dimension, with numbers, (id, numbers of the texts) of the games with any of these rows)."""
        texts = wanted.select(text).where(F.col(text).isNotNull()).distinct()
        named = dimension.select("id", F.explode(catalog._substrings(F.lower("name"))).alias("sub"))
        near = texts.join(_shuffled(named), F.col("sub") == F.col(text))
        near = near.withColumn("n", F.row_number().over(Window.partitionBy(text).orderBy("id"))).where(F.col("n") <= catalog.MOST_DIMENSIONS)
        near = saved(near.groupBy(text).agg(F.collect_set("id").alias("dims")).withColumn("number", F.monotonically_increasing_id()), "names")
        hint = _few_or_shuffled(near.count() * catalog.MOST_DIMENSIONS)
        held = main.select("id", F.explode(column).alias("dim")).join(hint(near.select("number", F.explode("dims").alias("dim"))), "dim")
        return hint(near.select(text, F.col("number").alias(f"{text}_known"))), held.groupBy("id").agg(F.collect_set("number").alias(f"of_{text}"))

    def _spans(self, rows: DataFrame) -> DataFrame:
        """``rows`` with (level, span) in place of ``since``: the spans of their date that any game is in."""
        filled = saved(self.games.select(F.explode(catalog._spans(F.col("first_release_date"))).alias("at")).select("at.level", "at.span").distinct(), "filled")
        at = rows.withColumn("at", F.explode(catalog._later(F.col("since")))).drop("since").select("*", "at.level", "at.span").drop("at")
        return saved(at.join(_few_or_shuffled(filled.count())(filled), ["level", "span"], "left_semi"), "spans")

    @staticmethod
    def _listed(games: DataFrame, lists: DataFrame) -> DataFrame:
        """Games of each of ``lists``: platform, genre, level, span and other columns. A game comes to its pools where it lies."""
        hint = _few_or_shuffled(lists.count())
        at = games.withColumn("at", F.explode(catalog._spans(F.col("first_release_date")))).select("*", "at.level", "at.span").drop("at")
        at = at.join(hint(lists.select("level", "span").distinct()), ["level", "span"], "left_semi")
        at = at.withColumn("platform", F.explode("of_platform")).withColumn("genre", F.explode("of_genre")).drop("of_platform", "of_genre")
        return at.join(hint(lists), ["platform", "genre", "level", "span"])

    def _best(self, rows: DataFrame, by: list[str], order: list) -> DataFrame:
        """``rows`` with their place ``n`` (from 1), as far as the deepest page."""
        return rows.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("n") <= self.deepest)

    def _names(self) -> tuple[DataFrame, DataFrame]:
        """((name, low) of the different names that some title matches, (title, name, kind of match: 0 exact, 1 prefix, 2 other, length of the name))."""
        titles = saved(self.searches.select("title").where("title is not null").distinct().select("title", F.explode(_word_grams(F.col("title"))).alias("gram")), "titles")
        grams = titles.select("gram").distinct()
        hint = _few_or_shuffled(grams.count())
        names = saved(self.games.select(F.lower("name").alias("low")).where("low is not null").distinct().withColumn("name", F.monotonically_increasing_id()), "lows")
        index = saved(names.withColumn("gram", F.explode(_grams(F.col("low"), 1))).join(hint(grams), "gram", "left_semi"), "grams")
        often = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        rarest = titles.join(hint(often), "gram", "left").groupBy("title").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))["gram"].alias("gram"))
        near = rarest.join(_shuffled(index), "gram").where(F.forall(_words(F.col("title")), lambda w: F.contains(F.col("low"), w)))
        kind = F.when(F.col("low") == F.col("title"), 0).when(F.startswith("low", "title"), 1).otherwise(2)
        found = saved(near.select("title", "name", kind.alias("kind"), F.length("low").alias("length")), "named")
        return names.join(_shuffled(found.select("name").distinct()), "name", "left_semi"), found

    def _by_title(self) -> DataFrame:
        """search, n, id of the searches with a title. Games of one name match alike, so the first of each pool, span and name are
        looked for once, then those of each pool and date, and a search merges what the names that it matches have."""
        names, found = self._names()
        searches = self.searches.where("title is not null").select("search", "title", "platform", "genre", "depth", "since")
        views = searches.groupBy("platform", "genre", "since").agg(F.max("depth").alias("depth")).withColumn("key", F.to_json(F.struct("platform", "genre", "since")))
        views = saved(views.withColumn("view", F.monotonically_increasing_id()), "views")
        searches = searches.withColumn("key", F.to_json(F.struct("platform", "genre", "since"))).join(_few_or_shuffled(views.count())(views.select("key", "view")), "key")
        spans = self._spans(views.select("view", "platform", "genre", "since"))
        lists = saved(spans.select("platform", "genre", "level", "span").distinct().withColumn("list", F.monotonically_increasing_id()), "lists")
        spans = spans.join(_few_or_shuffled(lists.count())(lists), ["platform", "genre", "level", "span"]).select("view", "list")
        named = self.games.select("id", F.lower("name").alias("low"), "first_release_date", "of_platform", "of_genre").join(_few_or_shuffled(names.count())(names), "low").drop("low")
        first = self._best(self._listed(named, lists).select("list", "name", "id"), ["list", "name"], ["id"]).drop("n")
        first = self._best(first.join(_few_or_shuffled(spans.count())(spans), "list").select("view", "name", "id"), ["view", "name"], ["id"]).drop("n")
        met = searches.join(_few_or_shuffled(found.count())(found), "title").select("search", "view", "name", "kind", "length", "depth").join(_shuffled(first), ["view", "name"])
        return self._best(met, ["search"], ["kind", "length", "id"]).where(F.col("n") <= F.col("depth")).select("search", "n", "id")

    def ranked(self) -> DataFrame:
        """search, n (from 1), id of the best of each search, as far as its deepest page."""
        shown = ["platform", "genre", "sort_by", "direction", "level", "span"]
        lists = saved(self.spans.select(*shown).distinct().withColumn("list", F.monotonically_increasing_id()), "lists")
        of_list = self.spans.join(_few_or_shuffled(lists.count())(lists), shown).select("search", "depth", "list")
        rows = self._listed(self.games, lists).select("list", "sort_by", "direction", "id", "name", "total_rating", "first_release_date")
        merged = self.hint(of_list).join(self._best(rows, ["list"], catalog._by_request_order()).drop("n"), "list")
        sorted_ = self._best(merged, ["search"], catalog._by_request_order()).where(F.col("n") <= F.col("depth")).select("search", "n", "id")
        return sorted_.unionByName(self._by_title()) if self.titles else sorted_

    def pages(self) -> DataFrame:
        """req_id, rank (from 0), id of every request's page."""
        places = self.asked.where(F.col("limit") > 0).select("req_id", "search", "offset", F.explode(F.sequence(F.col("offset") + 1, F.col("offset") + F.col("limit"))).alias("n"))
        return places.join(self.of_ranked(self.ranked()), ["search", "n"]).select("req_id", (F.col("n") - 1 - F.col("offset")).cast("bigint").alias("rank"), "id")

    def totals(self) -> DataFrame:
        """req_id, total of every request: how many games match before paging; null with a title."""
        shown = ["platform", "genre", "level", "span"]
        counted = self._listed(self.games, saved(self.spans.select(*shown).distinct(), "counted")).groupBy(*shown).agg(F.count(F.lit(1)).alias("games"))
        by_search = self.hint(self.spans).join(counted, shown).groupBy("search").agg(F.sum("games").alias("total"))
        total = F.when(~F.col("titled"), F.coalesce("total", F.lit(0)))
        return self.asked.join(self.of_searches(by_search), "search", "left").select("req_id", total.alias("total"))


def batch_search(requests: DataFrame, games: DataFrame, platforms: DataFrame, genres: DataFrame) -> DataFrame:
    """req_id, rank (from 0) and id of every request's page."""
    return BatchSearch(requests, games, platforms, genres).pages()


def batch_groups(pages: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Each request's page (req_id, rank, id) grouped under parents; what all pages lack is fetched from ``catalogue`` once."""
    rows = pages.join(_shuffled(catalogue.select("id", "name", "cover", "category", "version_parent")), "id")
    return versions.group_versions(rows, catalogue, by=("req_id",))


def batch_meta(search: BatchSearch, pages: DataFrame, groups: DataFrame) -> DataFrame:
    """req_id, page, limit, offset, total, totalPages, hasMore, beforeGrouping of every request, also of those without rows.

    totalPages is null where nothing matches, page and totalPages are where the limit is 0.
    """
    asked = search.asked.select("req_id", "limit", "offset").join(_shuffled(search.totals()), "req_id")
    before = pages.groupBy("req_id").agg(F.count(F.lit(1)).alias("before"))
    after = groups.groupBy("req_id").agg(F.count(F.lit(1)).alias("after"))
    rows = asked.join(_shuffled(before), "req_id", "left").join(_shuffled(after), "req_id", "left")
    limit = F.when(F.col("limit") > 0, F.col("limit"))
    return rows.select(
        "req_id", (F.floor(F.col("offset") / limit) + 1).cast("bigint").alias("page"), "limit", "offset", "total", F.when(F.col("total") > 0, F.ceil(F.col("total") / limit)).cast("bigint").alias("totalPages"),
        (F.coalesce("after", F.lit(0)) == F.col("limit")).alias("hasMore"), F.coalesce("before", F.lit(0)).cast("bigint").alias("beforeGrouping"),
    )
