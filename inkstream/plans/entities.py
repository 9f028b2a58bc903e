"""Joins between articles, areas, developers and rules, and choices of distinct articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.operators import entities, similarity
from inkstream.plans.registrar import Registrar
from inkstream.sources import views
from inkstream.sources.store import written
from inkstream.sources.views import HOUR_MS, NOW_MS

query = Registrar()

#: Dimensions for the invented prose of the test tables; a newsroom passes its own.
AREAS = {"north": ("the thon", "onthe"), "south": ("de la",), "east": ("der die", "und die"), "west": ("was of", "of the")}
DEVELOPERS = {"acme": ("ouen",), "birch": ("thon", "the thon"), "cedar": ("attion to",)}
VERTICALS = {"homes": (0, 1), "policy": (2,), "capital": (3, 4, 1)}
LIVE = "status IS DISTINCT FROM 'research'"


def _values(name: str, pairs: dict[str, tuple]) -> str:
    rows = ", ".join(f"('{k}', {v!r})" for k, vs in pairs.items() for v in vs)
    return f"{name}(slug, alias) AS (VALUES {rows})"


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.articles(spark, sf_dir).where(~F.col("status").eqNullSafe("research"))


# A letter with a mark decomposes into the bare letter and the mark, which is no letter and so a blank.
BARE = "array_to_string(list_transform(string_split(lower({t}), ''), lambda c: CASE WHEN strip_accents(c) <> c THEN strip_accents(c) || ' ' ELSE c END), '')"
PLAIN = f"' ' || trim(regexp_replace(replace({BARE.format(t="title || ' ' || body")}, '&', ' and '), '[^a-z0-9]+', ' ', 'g')) || ' '"
MENTIONS = views.sql("articles") + f", {{dim}}, x AS (SELECT slug AS article, published_ms, {PLAIN} AS t FROM articles WHERE {LIVE})"


def _text() -> Column:
    return F.concat_ws(" ", "title", "body")


@query(MENTIONS.format(dim=_values("d", DEVELOPERS)) + " SELECT slug, count(DISTINCT article) AS reports, max(published_ms) AS newest_ms FROM x JOIN d ON contains(t, ' ' || alias || ' ') GROUP BY slug")
def developer_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles that hold a phrase of each developer."""
    found = entities.mentions(_live(spark, sf_dir).select("slug", "published_ms", _text().alias("text")), "text", DEVELOPERS)
    return found.groupBy(F.col("name").alias("slug")).agg(F.count(F.lit(1)).alias("reports"), F.max("published_ms").alias("newest_ms"))


@query(MENTIONS.format(dim=_values("d", DEVELOPERS | AREAS)) + " SELECT DISTINCT article, slug AS name FROM x JOIN d ON contains(t, ' ' || alias || ' ')")
def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every article with each area and developer that it names."""
    return entities.mentions(_live(spark, sf_dir).select(F.col("slug").alias("article"), _text().alias("text")), "text", DEVELOPERS | AREAS).select("article", "name")


@query(views.sql("articles") + ", v(vertical, c) AS (VALUES " + ", ".join(f"('{v}', {c})" for v, cs in VERTICALS.items() for c in cs) + f") SELECT slug, vertical FROM articles JOIN v ON category = c WHERE {LIVE}")
def article_verticals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verticals whose categories hold the article's: an equi-join with a fixed bridge."""
    bridge = spark.createDataFrame([(v, c) for v, cs in VERTICALS.items() for c in cs], "vertical string, c int")
    return _live(spark, sf_dir).join(F.broadcast(bridge), F.col("category") == F.col("c")).select("slug", "vertical")


# Rules of a vertical: curated slugs, categories, words that exclude and keywords.
@query(
    views.sql("articles")
    + """, m AS (SELECT slug, status, category, ord, lower(title) AS t FROM articles), v(vertical, cats, ex, kw, cur) AS (VALUES ('homes', [0, 1], ['ther'], ['thon', 'que'], ['doc-5', 'doc-12']), ('policy', [2], []::VARCHAR[], ['ouen'], []::VARCHAR[]))
SELECT slug, vertical FROM m, v WHERE status IS DISTINCT FROM 'research' AND (list_contains(cur, slug) OR list_contains(cats, category) OR (NOT list_has_any([true], list_transform(ex, lambda x: contains(t, x))) AND list_has_any([true], list_transform(kw, lambda x: contains(t, x)))))"""
)
def vertical_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every article with the verticals whose rules it meets."""
    rules = [
        entities.Vertical("homes", categories=(0, 1), excluded=("ther",), keywords=("thon", "que"), curated=("doc-5", "doc-12")),
        entities.Vertical("policy", categories=(2,), keywords=("ouen",)),
    ]
    return entities.verticals(views.articles(spark, sf_dir), rules).select("slug", "vertical")


STOP = ("a", "an", "and", "as", "at", "by", "for", "from", "in", "into", "is", "of", "on", "s", "the", "to", "with")  # fixed value
SQL_WORDS = f"list_distinct(list_filter(string_split(trim(regexp_replace(replace({BARE.format(t='title')}, '&', ' and '), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) > 1 AND x NOT IN {STOP}))"
COMMON = "len(list_intersect(a.w, b.w))"
NEAR = f"{COMMON} >= 4 AND ({COMMON}::DOUBLE / (len(a.w) + len(b.w) - {COMMON}) >= 0.44 OR {COMMON}::DOUBLE / least(len(a.w), len(b.w)) >= 0.72)"


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live articles with the sorted distinct words of their plain titles."""
    words = F.filter(F.split(F.trim(entities.padded(F.col("title"))), " "), lambda x: (F.length(x) > 1) & ~x.isin(*STOP))
    return _live(spark, sf_dir).select("ord", "slug", "published_ms", F.array_sort(F.array_distinct(words)).alias("tokens"))


TOKENS = views.sql("articles", recursive=True) + f", t AS MATERIALIZED (SELECT ord, slug, published_ms, list_sort({SQL_WORDS}) AS w, row_number() OVER (ORDER BY published_ms DESC, ord) AS n FROM articles WHERE {LIVE})"


@query(TOKENS + f", c AS MATERIALIZED (SELECT min(ord) AS cls, w FROM t WHERE len(w) > 0 GROUP BY w) SELECT a.cls AS a, b.cls AS b FROM c a JOIN c b ON a.cls < b.cls AND {NEAR}")
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of distinct title word sets that are near duplicates, each by its smallest ord."""
    return entities.near_pairs(written(similarity.token_classes(_titles(spark, sf_dir)))).select("a", "b")


SCAN = (
    TOKENS
    + f""", p AS MATERIALIZED (SELECT a.n AS x, b.n AS y FROM t a JOIN t b ON a.n < b.n AND len(a.w) > 0 AND len(b.w) > 0 AND {NEAR}), q AS MATERIALIZED (SELECT y, list(x) AS xs FROM p GROUP BY y),
scan AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS kept UNION ALL SELECT s.n + 1, CASE WHEN q.xs IS NOT NULL AND list_has_any(s.kept, q.xs) THEN s.kept ELSE list_append(s.kept, s.n + 1) END
FROM scan s LEFT JOIN q ON q.y = s.n + 1 WHERE s.n < (SELECT count(*) FROM t)),
chosen AS (SELECT t.* FROM t JOIN (SELECT unnest(kept) AS k FROM (SELECT kept FROM scan ORDER BY n DESC LIMIT 1)) ON t.n = k)"""
)


@query(SCAN + " SELECT slug FROM chosen")
def distinct_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles that a scan from the newest keeps, each unlike all kept before it."""
    return entities.distinct_articles(_titles(spark, sf_dir)).select("slug")


@query(SCAN + " SELECT slug, CASE WHEN (1735689600000 - published_ms) / 3600000.0 <= 48 THEN 'fresh' ELSE 'stale' END AS state FROM chosen ORDER BY published_ms DESC, ord LIMIT 6")
def front_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six newest distinct articles, fresh for 48 hours."""
    best = entities.distinct_articles(_titles(spark, sf_dir)).orderBy(F.desc("published_ms"), "ord").limit(6)
    age = (F.lit(NOW_MS) - F.col("published_ms")) / HOUR_MS
    return best.select("slug", F.when(age <= 48, "fresh").otherwise("stale").alias("state"))


QUERIES, ORACLE_SQL = query.queries, query.sql
