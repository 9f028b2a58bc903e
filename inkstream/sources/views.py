"""Logical tables of the editorial engine over the Parquet inputs.

Every view names the columns it needs, so only those reach the scan. ``NOW_MS`` stands for the present in all queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.functions.text import lower

NOW_MS = 1735689600000  # 2025-01-01 UTC
HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS
SPACE = r"[ \t\n\r]+"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts: str) -> Column:
    """Milliseconds since 1970 of a time-zone-less timestamp, whatever the session's zone."""
    return F.expr(f"datediff(to_date({ts}), date'1970-01-01') * 86400000L + hour({ts}) * 3600000L + minute({ts}) * 60000L + second({ts}) * 1000L")


def words(text: str) -> Column:
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), SPACE), lambda x: x != "")


def first_words(text: str, n: int) -> Column:
    """The first ``n`` words; what follows them isn't split."""
    pieces = F.split(F.coalesce(F.col(text), F.lit("")), SPACE, n + 2)  # one may be empty before the first word, the last is the rest
    return F.slice(F.filter(pieces, lambda x: x != ""), 1, n)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed entries: ord, id, title, summary, tier (0 best to 4), domain, url, published_ms, full_text."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source")
    title = F.array_join(first_words("text", 12), " ")
    number = F.substring("source", 4, 9).cast("int")
    path = lower(F.array_join(first_words("text", 4), "-"))
    return docs.select(
        F.col("doc_id").alias("ord"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"), title.alias("title"), F.substring("text", 1, 600).alias("summary"), (number % 5).alias("tier"),
        F.concat("source", F.lit(".example.com")).alias("domain"), F.concat(F.lit("https://www."), "source", F.lit(".example.com/"), path, F.lit("?utm_source=x")).alias("url"),
        (F.lit(NOW_MS) - F.col("doc_id") * 37 * 60_000).alias("published_ms"), F.col("text").alias("full_text"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered articles: slug, title, body, category, market, status (null is live), published_ms."""
    title = F.array_join(first_words("text", 12), " ")  # before the join, so that texts aren't shuffled for titles
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang", title.alias("title"))
    labels = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_doc"), "quality")
    joined = docs.join(labels, F.col("doc_id") == F.col("l_doc"), "left")
    return joined.select(
        F.col("doc_id").alias("ord"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("slug"), "title", F.col("text").alias("body"),
        (F.col("doc_id") % 7).cast("int").alias("category"), F.col("lang").alias("market"), F.when(F.col("quality") == 0, "research").alias("status"), (F.lit(NOW_MS) - F.col("doc_id") * 37 * 60_000).alias("published_ms"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market transactions: worth, day, area, project, per_sqm and a total order (line_key) for ties."""
    line = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_shipdate")
    supplier = load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    part = load(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(F.col("l_extendedprice").alias("worth"), F.to_date("l_shipdate").alias("day"), F.col("n_name").alias("area"), F.col("p_brand").alias("project"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("per_sqm"), "l_orderkey", "l_linenumber")


#: Hours in which an item of each channel must be acted on.
SLA_HOURS = {"1-URGENT": 12, "2-HIGH": 24, "3-MEDIUM": 48, "4-NOT SPECIFIED": 72, "5-LOW": 96}


def queue_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engagement queue: id, channel, status, created_ms, expires_ms, acted_ms (terminal items), version."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate", "o_totalprice")
    hours = F.create_map(*[F.lit(x) for pair in SLA_HOURS.items() for x in pair])[F.col("o_orderpriority")]
    status = F.when(F.col("o_orderstatus") == "F", "posted").when(F.col("o_orderstatus") == "P", "edited").when(F.col("o_orderkey") % 11 == 0, "skipped").otherwise("pending")
    rows = orders.withColumn("created_ms", millis("o_orderdate")).withColumn("status", status).withColumn("hours", hours)
    return rows.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("channel"), "status", "created_ms", (F.col("created_ms") + F.col("hours") * HOUR_MS).alias("expires_ms"),
        F.when(F.col("status").isin("posted", "skipped"), F.col("created_ms") + 6 * HOUR_MS).alias("acted_ms"), (F.col("o_orderkey") % 4 + 1).alias("version"), F.col("o_totalprice").alias("score"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interaction requests: id, key, namespace, ts_ms, value."""
    events = load(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return events.select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.col("event_type").alias("namespace"), millis("ts").alias("ts_ms"), "value")


#: The same views as DuckDB common table expressions.
SQL = {
    "entries": r"""entries AS (SELECT doc_id AS ord, 'doc-' || doc_id AS id, array_to_string(list_slice(w, 1, 12), ' ') AS title, left(text, 600) AS summary, CAST(substr(source, 4) AS INT) % 5 AS tier,
        source || '.example.com' AS domain, 'https://www.' || source || '.example.com/' || lower(array_to_string(list_slice(w, 1, 4), '-')) || '?utm_source=x' AS url,
        1735689600000 - doc_id * 37 * 60000 AS published_ms, text AS full_text
        FROM (SELECT *, list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda x: x <> '') AS w FROM documents))""",
    "articles": r"""articles AS (SELECT d.doc_id AS ord, 'doc-' || d.doc_id AS slug, array_to_string(list_slice(list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda x: x <> ''), 1, 12), ' ') AS title,
        text AS body, CAST(d.doc_id % 7 AS INT) AS category, lang AS market, CASE WHEN quality = 0 THEN 'research' END AS status, 1735689600000 - d.doc_id * 37 * 60000 AS published_ms
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
    "transactions": """transactions AS (SELECT l_extendedprice AS worth, CAST(l_shipdate AS DATE) AS day, n_name AS area, p_brand AS project, l_extendedprice / l_quantity AS per_sqm, l_orderkey, l_linenumber
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)""",
    "queue_items": """queue_items AS (SELECT o_orderkey AS id, o_orderpriority AS channel, status, created_ms, created_ms + hours * 3600000 AS expires_ms,
        CASE WHEN status IN ('posted', 'skipped') THEN created_ms + 6 * 3600000 END AS acted_ms, o_orderkey % 4 + 1 AS version, o_totalprice AS score
        FROM (SELECT *, epoch_ms(o_orderdate) AS created_ms, CASE o_orderpriority WHEN '1-URGENT' THEN 12 WHEN '2-HIGH' THEN 24 WHEN '3-MEDIUM' THEN 48 WHEN '4-NOT SPECIFIED' THEN 72 ELSE 96 END AS hours,
            CASE WHEN o_orderstatus = 'F' THEN 'posted' WHEN o_orderstatus = 'P' THEN 'edited' WHEN o_orderkey % 11 = 0 THEN 'skipped' ELSE 'pending' END AS status FROM orders))""",
    "requests": "requests AS (SELECT event_id AS id, user_id AS key, event_type AS namespace, epoch_ms(date_trunc('second', ts)) AS ts_ms, value FROM events)",
}


def sql(*names: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(SQL[n] for n in names)
