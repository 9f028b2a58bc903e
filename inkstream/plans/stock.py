"""Picture searches and licences, tags, sources, and which developers stand behind addresses and areas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.operators import stock
from inkstream.plans.registrar import Registrar
from inkstream.sources import views
from inkstream.sources.views import load

query = Registrar()

NAMES = ("CC0", "CC BY 4.0", "cc by-sa 2.0", "Public domain", "PD-old", "All rights reserved", "", None)


@query(
    """WITH p AS (SELECT p_partkey, list_extract(['CC0', 'CC BY 4.0', 'cc by-sa 2.0', 'Public domain', 'PD-old', 'All rights reserved', '', NULL], CAST(p_partkey % 8 AS INT) + 1) AS licence, CASE WHEN p_partkey % 11 > 0 THEN p_size * 100 END AS width, p_name FROM part)
SELECT p_partkey, licence, CAST(width AS INT) AS width, CASE p_partkey % 5 WHEN 0 THEN 'Wikimedia Commons' ELSE p_name END AS artist FROM p WHERE regexp_matches(licence, '(?i)CC0|CC BY|public domain|PD') AND width >= 800"""
)
def licence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures that may be used: by licence and width, with the artist as plain text."""
    key = F.col("p_partkey")
    licence = F.element_at(F.array(*map(F.lit, NAMES)), (key % 8 + 1).cast("int"))
    artist = F.when(key % 10 == 0, None).when(key % 5 == 0, "").when(key % 5 == 1, F.concat(F.lit('<a href="x">'), "p_name", F.lit("</a>"))).otherwise(F.col("p_name"))
    rows = load(spark, sf_dir, "part").select("p_partkey", licence.alias("licence"), F.when(key % 11 > 0, F.col("p_size") * 100).alias("width"), artist.alias("artist"))
    return stock.usable(rows, 800)


DEVELOPERS = {"acme-works": "acme tower aerial", "thon": "thon quarter skyline", "ouen-gate": "ouen gate sunset"}
AREAS = {"de-la": "old quay aerial", "der": "garden city aerial", "onthe": "north shore"}
CATEGORIES = {"0": "city aerial", "1": "launch site", "2": "court building"}
MARKETS = {"en": "island skyline", "fr": "river skyline"}
LAST = "coast at dusk"


def _named(table: dict[str, str]) -> str:
    return " ".join(f"WHEN contains(t, '{k.replace('-', ' ')}') OR contains(t, '{k}') THEN '{q}'" for k, q in table.items())


@query(
    views.sql("articles")
    + f", x AS (SELECT slug, lower(title) AS t, category, coalesce(market, '') AS m FROM articles) SELECT slug, CASE {_named(DEVELOPERS | AREAS)} "
    + " ".join(f"WHEN category = {k} THEN '{q}'" for k, q in CATEGORIES.items()) + " " + " ".join(f"WHEN contains(m, '{k}') THEN '{q}'" for k, q in MARKETS.items()) + f" ELSE '{LAST}' END AS query FROM x"
)
def picture_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to search for each article, by the dictionaries of developers, areas, categories and markets."""
    found = stock.picture_query(F.col("title"), F.col("category").cast("string"), F.col("market"), DEVELOPERS, AREAS, CATEGORIES, MARKETS, LAST)
    return views.articles(spark, sf_dir).select("slug", found.alias("query"))


ASKED = ("villa in abu dhabi", "Marjan beach tower", "mansion", "apartment on the waterfront", "desert", "ras al khaimah coastline villa")


def _texts(some: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in some) + "]::VARCHAR[]"


def _has(terms: tuple[str, ...]) -> str:
    return " OR ".join(f"contains(q, '{t}')" for t in terms)


@query(
    f"WITH p AS (SELECT p_partkey, lower(list_extract({_texts(ASKED)}, CAST(p_partkey % 6 AS INT) + 1) || ' ' || p_name) AS q FROM part) SELECT p_partkey, array_to_string(list_concat(CASE "
    + " ".join(f"WHEN {_has(t)} THEN {_texts(w)}" if t else f"ELSE {_texts(w)} END" for t, w in stock.BROADER_REGIONS) + ", "
    + "list_concat(" + ", ".join(f"CASE WHEN {_has(t)} THEN {_texts(w)} ELSE []::VARCHAR[] END" for t, w in stock.BROADER_KINDS) + f"), {_texts(stock.BROADER_LAST)}), '|') AS wider FROM p"
)
def broader_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wider searches that follow one without a find."""
    asked = F.concat(F.element_at(F.array(*map(F.lit, ASKED)), (F.col("p_partkey") % 6 + 1).cast("int")), F.lit(" "), "p_name")
    return load(spark, sf_dir, "part").select("p_partkey", F.array_join(stock.broader_queries(asked), "|").alias("wider"))


OF_MARKET = {"en": ("Isles",), "fr": ("Rivers", "Isles"), "de": ("Gardens",)}
OF_CATEGORY = {"1": ("OffPlan",), "2": ("Courts", "Gardens")}


@query(
    views.sql("articles")
    + """ SELECT slug, array_to_string(list_concat(CASE market WHEN 'en' THEN ['Isles'] WHEN 'fr' THEN ['Rivers', 'Isles'] WHEN 'de' THEN ['Gardens'] ELSE []::VARCHAR[] END,
CASE category WHEN 1 THEN ['OffPlan'] WHEN 2 THEN CASE WHEN market = 'de' THEN ['Courts'] ELSE ['Courts', 'Gardens'] END ELSE []::VARCHAR[] END, ['Desk']), ',') AS tags FROM articles"""
)
def article_hashtags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of each article by its market and category, none twice."""
    tags = stock.hashtags(F.array_compact(F.array("market")), F.col("category").cast("string"), OF_MARKET, OF_CATEGORY, "Desk")
    return views.articles(spark, sf_dir).select("slug", F.array_join(tags, ",").alias("tags"))


OFFICIAL = ("the.example.com", "an.example.com", "th.example.com", "le.example.com")


@query(f"WITH p AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]+)', 1)), '^www\\.', '') AS h FROM pages) SELECT page_id, {' OR '.join(f'''h = '{h}' OR ends_with(h, '.{h}')''' for h in OFFICIAL)} AS official FROM p")
def official_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page's address is a developer's own."""
    return load(spark, sf_dir, "pages").select("page_id", stock.on_hosts(F.col("url"), OFFICIAL).alias("official"))


@query(
    """SELECT 'discovery' AS registry, CAST(s_suppkey AS BIGINT) AS ord, s_name AS name, 'https://' || lower(replace(s_name, '#', '-')) || '.example/feed' AS url, 'industry' AS tier FROM supplier
UNION ALL SELECT 'trade', CAST(n_nationkey AS BIGINT), n_name, 'https://' || lower(replace(n_name, '_', '-')) || '.example/feed', 'national-press' FROM nation
UNION ALL SELECT 'direct', CAST(r_regionkey AS BIGINT), r_name, 'https://' || lower(replace(r_name, ' ', '-')) || '.example/feed', 'developer' FROM region"""
)
def source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of a run: three registries, one after the other."""
    def registry(name: str, prefix: str, mark: str, tier: str) -> DataFrame:
        label = "suppkey" if prefix == "s" else "nationkey" if prefix == "n" else "regionkey"
        url = F.concat(F.lit("https://"), F.lower(F.replace(f"{prefix}_name", F.lit(mark), F.lit("-"))), F.lit(".example/feed"))
        return load(spark, sf_dir, name).select(F.col(f"{prefix}_{label}").cast("long").alias("ord"), F.col(f"{prefix}_name").alias("name"), url.alias("url"), F.lit(tier).alias("tier"))

    parts = ("discovery", registry("supplier", "s", "#", "industry")), ("trade", registry("nation", "n", "_", "national-press")), ("direct", registry("region", "r", " ", "developer"))
    return stock.union_of_sources(*parts)


@query(
    views.sql("transactions")
    + """, l AS (SELECT DISTINCT area, project AS developer FROM transactions WHERE worth > 90000),
r AS (SELECT n_name AS area, ' ' || lower(p_name) || ' tower ' AS name FROM part JOIN nation ON n_nationkey = p_partkey % 25 WHERE p_size = 2),
a AS (SELECT DISTINCT p_brand AS developer, lower(p_name) AS alias FROM part WHERE p_size = 1)
SELECT area, developer FROM l UNION SELECT area, developer FROM r JOIN a ON contains(name, ' ' || alias || ' ')"""
)
def developers_of_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Developers of each area: those that list it (areas of their dearer sales), or whose phrase a recorded name holds."""
    sales = views.transactions(spark, sf_dir).where("worth > 90000")
    active = sales.groupBy(F.col("project").alias("developer")).agg(F.collect_set("area").alias("areas"))
    part, nation = load(spark, sf_dir, "part"), load(spark, sf_dir, "nation")
    recorded = part.where("p_size = 2").join(nation, F.col("n_nationkey") == F.col("p_partkey") % 25).select(F.col("n_name").alias("area"), F.concat("p_name", F.lit(" tower")).alias("name"))
    aliases = part.where("p_size = 1").select(F.col("p_brand").alias("developer"), F.col("p_name").alias("alias")).distinct()
    return stock.area_developers(active, recorded, aliases)


@query(views.sql("transactions") + " SELECT project AS developer, area, count(*) AS sales FROM transactions WHERE day >= DATE '2001-01-01' GROUP BY ALL")
def developers_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas in which a developer has sold since a day, with how often: its list of areas, exploded."""
    recent = views.transactions(spark, sf_dir).where("day >= date'2001-01-01'")
    lists = recent.groupBy(F.col("project").alias("developer"), "area").agg(F.count(F.lit(1)).alias("sales")).groupBy("developer").agg(F.collect_list(F.struct("area", "sales")).alias("areas"))
    return lists.select("developer", F.explode("areas").alias("a")).select("developer", "a.area", "a.sales")


QUERIES, ORACLE_SQL = query.queries, query.sql
