"""Queries over stores that they write: bucketed records, dated runs, drafts, JSON of any shape; facets and locale order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkstream.functions import canonical
from inkstream.operators import facets
from inkstream.plans.archives import new_folder
from inkstream.plans.registrar import Registrar
from inkstream.sources import drafts, records, views
from inkstream.sources.views import load, words

query = Registrar()

RANGE = (820454400000, 900000000000)


@query(f"SELECT o_orderkey AS id, epoch_ms(o_orderdate) AS score, o_orderstatus AS status FROM orders WHERE o_orderkey % 7 <> 0 AND epoch_ms(o_orderdate) BETWEEN {RANGE[0]} AND {RANGE[1]}")
def indexed_multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of an index's range of scores, by their buckets; every seventh id of the index has no record and gives no row."""
    orders = load(spark, sf_dir, "orders")
    table = records.store(orders.where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")))
    index = orders.select(F.col("o_orderkey").alias("id"), views.millis("o_orderdate").alias("score"))
    return records.multi_get(records.indexed_range(index, *RANGE), table).select("id", "score", "status")


RUNS = """r AS (SELECT CAST(ts AS DATE) AS day, event_type AS topic, count(*) AS n, round(sum(value), 2) AS worth FROM events WHERE day(ts) <= 3 GROUP BY ALL),
again AS (SELECT CAST(ts AS DATE) AS day, event_type AS topic, count(*) AS n, round(sum(value), 2) AS worth FROM events WHERE day(ts) = 2 AND value > 20 GROUP BY ALL),
runs AS (SELECT * FROM r WHERE day(day) <> 2 UNION ALL SELECT * FROM again)"""


@query(f"WITH {RUNS}, logs AS (SELECT day, count(*) AS clusters, sum(n) AS entries FROM runs GROUP BY day) SELECT CAST(day AS VARCHAR) AS run_day, topic, n, worth, clusters, CAST(entries AS BIGINT) AS entries FROM runs JOIN logs USING (day)")
def cluster_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of three days' runs as dated files with a log each; the second day's run is saved twice, which replaces it alone."""
    events = load(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    folder = new_folder(spark)

    def save(day: str, kept: str = "true") -> None:
        own = events.where(F.col("day") == day).where(kept)
        topics = own.groupBy(F.col("event_type").alias("topic")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("worth"))
        drafts.save_run(topics, folder, day, entries=F.coalesce(F.sum("n"), F.lit(0)))

    for day in ("2024-01-01", "2024-01-02", "2024-01-03"):
        save(day)
    save("2024-01-02", "value > 20")
    runs = drafts.read_runs(spark, folder, "topic string, n bigint, worth double")
    logs = drafts.read_logs(spark, folder, "rows bigint, entries bigint").select(F.col("run_day").alias("d"), F.col("rows").alias("clusters"), "entries")
    return runs.join(logs, F.col("run_day") == F.col("d")).select("run_day", "topic", "n", "worth", "clusters", "entries")


@query("SELECT 'user-' || user_id AS slug, last.t AS saved_ms, last.i AS event_id, last.e AS kind FROM (SELECT user_id, max(struct_pack(t := epoch_ms(date_trunc('second', ts)), i := event_id, e := event_type)) AS last FROM events WHERE event_id % 2 = 0 OR user_id % 3 = 0 GROUP BY user_id)")
def draft_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts kept by slug in files, the last save of each; two saves, of which the second has a third of the slugs."""
    rows = views.requests(spark, sf_dir).select(F.concat(F.lit("user-"), F.col("key").cast("string")).alias("slug"), F.col("ts_ms").alias("saved_ms"), F.col("id").alias("event_id"), F.col("namespace").alias("kind"))
    folder = new_folder(spark)
    drafts.save_drafts(rows.where("event_id % 2 = 0"), folder)
    drafts.save_drafts(rows.where("event_id % 2 = 1 AND cast(substring(slug, 6) AS bigint) % 3 = 0"), folder)
    return drafts.read_drafts(spark, folder, "slug string, saved_ms bigint, event_id bigint, kind string")


TITLE = r"array_to_string(list_slice(list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda x: x <> ''), 1, 12), ' ')"
CANONICAL = """'{' || CASE WHEN doc_id % 3 = 1 THEN '' ELSE '"article":{"deep":{"a":[1,{"c":' || doc_id || ',"d":2.5}],"b":null},"title":' || to_json(t)::VARCHAR || '},' END || '"score":' || doc_id % 7 || ',"tags":["x","y"]}'"""


@query(f"WITH d AS (SELECT doc_id, {TITLE} AS t FROM documents) SELECT doc_id, sha256({CANONICAL}) AS hash FROM d")
def canonical_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of JSON records of three shapes, whose keys come in different orders at every depth."""
    title = F.array_join(F.slice(words("text"), 1, 12), " ")
    key = F.col("doc_id").cast("string")
    quoted = F.regexp_extract(F.to_json(F.struct(title.alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)
    score = (F.col("doc_id") % 7).cast("string")
    one = F.concat(F.lit('{"tags": ["x", "y"], "score": '), score, F.lit('.0, "article": {"title": '), quoted, F.lit(', "deep": {"b": null, "a": [1, {"d": 2.50, "c": '), key, F.lit("}]}}}"))
    two = F.concat(F.lit('{"score":'), score, F.lit(',"tags":["x","y"]}'))
    three = F.concat(F.lit('{"article":{"deep":{"a":[1,{"c":'), key, F.lit(',"d":2.5}],"b":null},"title":'), quoted, F.lit('},\n "tags":["x","y"],"score":'), score, F.lit("}"))
    shape = F.col("doc_id") % 3
    text = F.when(shape == 0, one).when(shape == 1, two).otherwise(three)
    return load(spark, sf_dir, "documents").select("doc_id", canonical.json_hash(text).alias("hash"))


CHOSEN = {"category": "2", "market": "en", "tags": "lines"}
TAGS = r"list_filter([CASE WHEN regexp_matches(body, '[0-9]') THEN 'figures' END, CASE WHEN contains(body, chr(10)) THEN 'lines' END, CASE WHEN regexp_matches(body, '[!#]') THEN 'marks' END], lambda x: x IS NOT NULL)"
FACETED = views.sql("articles") + f", f AS (SELECT category::VARCHAR AS category, market, {TAGS} AS tags FROM articles WHERE status IS DISTINCT FROM 'research')"


def _faceted(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = lambda met, name: F.when(met, F.lit(name))
    tags = F.array(tag(F.col("body").rlike("[0-9]"), "figures"), tag(F.contains("body", F.lit("\n")), "lines"), tag(F.col("body").rlike("[!#]"), "marks"))
    live = views.articles(spark, sf_dir).where(~F.col("status").eqNullSafe("research"))
    return live.select("slug", "category", "market", F.array_compact(tags).alias("tags"))


@query(
    FACETED
    + """ SELECT 'category' AS facet, category AS value, count(*) FILTER (WHERE market = 'en' AND list_contains(tags, 'lines')) AS n, category = '2' AS picked FROM f GROUP BY category
UNION ALL SELECT 'market', market, count(*) FILTER (WHERE category = '2' AND list_contains(tags, 'lines')), market = 'en' FROM f GROUP BY market
UNION ALL SELECT 'tags', tag, count(*) FILTER (WHERE category = '2' AND market = 'en'), tag = 'lines' FROM (SELECT *, unnest(tags) AS tag FROM f) GROUP BY tag"""
)
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every category, market and tag under what is chosen of the others, in one pass."""
    return facets.counts(_faceted(spark, sf_dir), ["category", "market"], "tags", CHOSEN)


@query(views.sql("articles") + f", f AS (SELECT slug, category, market, {TAGS} AS tags FROM articles WHERE status IS DISTINCT FROM 'research') SELECT slug FROM f WHERE category = 2 AND list_contains(tags, 'lines')")
def facet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of a category with a tag, in all markets."""
    return facets.selected(_faceted(spark, sf_dir), ["category", "market"], "tags", CHOSEN | {"market": facets.ALL}).select("slug")


NAMES = r"""WITH w AS (SELECT lang, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{00FF}]+')) AS w FROM documents), n AS (SELECT coalesce(lang, '') AS lang, w AS name, count(*) AS n FROM w WHERE length(w) BETWEEN 5 AND 7 GROUP BY ALL)"""


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = load(spark, sf_dir, "documents").select("lang", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-zÀ-ÖØ-öø-ÿ]+"), F.lit(0))).alias("w"))
    return found.where(F.length("w").between(5, 7)).groupBy(F.coalesce("lang", F.lit("")).alias("lang"), F.col("w").alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query(NAMES + ', i AS (SELECT *, substr(name, 1, 2) AS initial FROM n) SELECT lang, initial, name, n, row_number() OVER (PARTITION BY lang, initial ORDER BY name COLLATE "de", name) AS place FROM i')
def locale_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a language and their first two letters in a reader's order: accents and case decide only between equals."""
    rows = _names(spark, sf_dir).withColumn("initial", F.substring("name", 1, 2))
    place = F.row_number().over(W.partitionBy("lang", "initial").orderBy(canonical.in_locale(F.col("name")), "name"))
    return rows.select("lang", "initial", "name", "n", place.alias("place"))


@query(NAMES + " SELECT lower(name) AS name, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT name) AS forms FROM n GROUP BY 1")
def locale_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words grouped without regard to case, with how many forms each has: the group key is a collated string."""
    rows = _names(spark, sf_dir).withColumn("key", canonical.in_locale(F.col("name"), canonical.LOCALE_CI))
    grouped = rows.groupBy("key").agg(F.min(F.lower("name")).alias("name"), F.sum("n").alias("n"), F.count_distinct("name").alias("forms"))
    return grouped.select("name", "n", "forms")


QUERIES, ORACLE_SQL = query.queries, query.sql
