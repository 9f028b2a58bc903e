"""Queue, versioned state, window and streaming-twin queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkstream.operators import commands, folds
from inkstream.plans.registrar import Registrar
from inkstream.sources import views
from inkstream.sources.views import DAY_MS, HOUR_MS, load

query = Registrar()
#: The present of the queue's tables, which end in mid-2001.
QUEUE_NOW = 996_000_000_000


@query(views.sql("queue_items") + " SELECT CASE WHEN grouping(status) = 0 THEN 'status' WHEN grouping(channel) = 0 THEN 'channel' ELSE 'total' END AS kind, coalesce(status, channel, 'all') AS name, count(*) AS n FROM queue_items GROUP BY GROUPING SETS ((), (status), (channel))")
def queue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by status, by channel and of all, in one pass over counts by both."""
    small = views.queue_items(spark, sf_dir).groupBy("status", "channel").agg(F.count(F.lit(1)).alias("n"))
    each = F.array(F.struct(F.lit("total").alias("kind"), F.lit("all").alias("name")), F.struct(F.lit("status").alias("kind"), F.col("status").alias("name")), F.struct(F.lit("channel").alias("kind"), F.col("channel").alias("name")))
    return small.select(F.explode(each).alias("k"), "n").groupBy("k.kind", "k.name").agg(F.sum("n").alias("n"))


@query(views.sql("queue_items") + " SELECT id, channel, expires_ms FROM queue_items WHERE status IN ('pending', 'edited')")
def queue_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All open items, those that expire first ahead."""
    return views.queue_items(spark, sf_dir).where("status IN ('pending', 'edited')").orderBy("expires_ms", "id").select("id", "channel", "expires_ms")


@query(views.sql("queue_items") + f" SELECT id, channel, expires_ms FROM queue_items WHERE status IN ('pending', 'edited') AND expires_ms > {QUEUE_NOW} AND expires_ms <= {QUEUE_NOW} + 40 * 3600000")
def queue_urgent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.queue_items(spark, sf_dir).where(f"status IN ('pending', 'edited') AND expires_ms > {QUEUE_NOW} AND expires_ms <= {QUEUE_NOW + 40 * HOUR_MS}").select("id", "channel", "expires_ms")


@query(views.sql("queue_items") + " SELECT id, status, acted_ms FROM queue_items WHERE acted_ms IS NOT NULL ORDER BY acted_ms DESC, id LIMIT 20")
def queue_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.queue_items(spark, sf_dir).where("acted_ms IS NOT NULL").orderBy(F.desc("acted_ms"), "id").limit(20).select("id", "status", "acted_ms")


@query("SELECT o_orderkey AS id, epoch_ms(o_orderdate) + CASE o_orderpriority WHEN '1-URGENT' THEN 12 WHEN '2-HIGH' THEN 24 WHEN '3-MEDIUM' THEN 48 WHEN '4-NOT SPECIFIED' THEN 72 ELSE 96 END * 3600000 AS expires_ms FROM orders")
def queue_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.queue_items(spark, sf_dir).select("id", "expires_ms")


@query(views.sql("queue_items") + f" SELECT id, CASE WHEN due THEN 'expired' ELSE status END AS status, CASE WHEN due THEN version + 1 ELSE version END AS version, CASE WHEN due THEN {QUEUE_NOW} ELSE acted_ms END AS acted_ms FROM (SELECT *, status IN ('pending', 'edited') AND expires_ms < {QUEUE_NOW} AS due FROM queue_items)")
def expire_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open items past their time become expired and gain a version."""
    due = F.col("status").isin("pending", "edited") & (F.col("expires_ms") < QUEUE_NOW)
    return views.queue_items(spark, sf_dir).select("id", F.when(due, "expired").otherwise(F.col("status")).alias("status"), F.when(due, F.col("version") + 1).otherwise(F.col("version")).alias("version"), F.when(due, QUEUE_NOW).otherwise(F.col("acted_ms")).alias("acted_ms"))


@query(views.sql("queue_items") + f" SELECT id, status FROM queue_items WHERE NOT (status IN ('posted', 'skipped', 'expired') AND acted_ms < {QUEUE_NOW} - 30::BIGINT * 86400000)")
def retention_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.col("status").isin("posted", "skipped", "expired") & (F.col("acted_ms") < QUEUE_NOW - 30 * DAY_MS)
    return views.queue_items(spark, sf_dir).where(~F.coalesce(old, F.lit(False))).select("id", "status")


ACTION = "CASE CAST(id % 6 AS INT) WHEN 0 THEN 'approve' WHEN 1 THEN 'skip' WHEN 2 THEN 'edit' WHEN 3 THEN 'postpone' WHEN 4 THEN 'mark-posted' ELSE 'delete' END"


@query(views.sql("queue_items") + f""" SELECT id, action, CASE WHEN status NOT IN ('pending', 'edited') THEN status WHEN action = 'approve' THEN 'approved' WHEN action = 'skip' THEN 'skipped' WHEN action = 'edit' THEN 'edited' WHEN action = 'postpone' THEN status WHEN action = 'mark-posted' THEN 'posted' END AS status,
CASE WHEN action = 'postpone' AND status IN ('pending', 'edited') THEN expires_ms + 86400000 ELSE expires_ms END AS expires_ms FROM (SELECT *, {ACTION} AS action FROM queue_items)""")
def queue_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after one action: terminal items stay; deleted ones have none."""
    action = F.element_at(F.array(*[F.lit(x) for x in ("approve", "skip", "edit", "postpone", "mark-posted", "delete")]), (F.col("id") % 6 + 1).cast("int"))
    rows = views.queue_items(spark, sf_dir).withColumn("action", action)
    live = F.col("status").isin("pending", "edited")
    to = F.create_map(*[F.lit(x) for p in (("approve", "approved"), ("skip", "skipped"), ("edit", "edited"), ("mark-posted", "posted")) for x in p])[F.col("action")]
    status = F.when(~live | (F.col("action") == "postpone"), F.col("status")).otherwise(to)
    return rows.select("id", "action", status.alias("status"), F.when(live & (F.col("action") == "postpone"), F.col("expires_ms") + DAY_MS).otherwise(F.col("expires_ms")).alias("expires_ms"))


@query(views.sql("requests") + ", r AS (SELECT id, key % 20 AS key, namespace, value, row_number() OVER (PARTITION BY key % 20, namespace, floor(value) ORDER BY ts_ms, id) AS rn, first_value(value) OVER (PARTITION BY key % 20, namespace, floor(value) ORDER BY ts_ms, id) AS stored FROM requests) SELECT id, CASE WHEN rn = 1 THEN 'inserted' WHEN stored = value THEN 'replayed' ELSE 'conflict' END AS outcome FROM r")
def idempotent_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First command of an idempotency key inserts; a later one with the same payload replays it, else it conflicts.

    The first command is a minimum, joined back, so a key with very many retries is no single task.
    """
    rows = views.requests(spark, sf_dir).select("id", "ts_ms", "value", F.concat_ws("|", F.col("key") % 20, "namespace", F.floor("value")).alias("token"))
    first = rows.groupBy("token").agg(F.min(F.struct("ts_ms", "id", "value")).alias("f")).withColumnRenamed("token", "t")
    joined = rows.join(first, F.col("token") == F.col("t"))
    return joined.select("id", F.when(F.col("id") == F.col("f.id"), "inserted").when(F.col("value") == F.col("f.value"), "replayed").otherwise("conflict").alias("outcome"))


CAS = views.sql("requests", recursive=True) + """, c AS (SELECT id, key, CASE WHEN id % 3 = 0 THEN CAST(floor(value) AS BIGINT) % 9 ELSE -1 END AS expected, row_number() OVER (PARTITION BY key ORDER BY ts_ms, id) AS n FROM requests),
f AS (SELECT id, key, n, expected IN (-1, 0) AS applied, CASE WHEN expected IN (-1, 0) THEN 1 ELSE 0 END::BIGINT AS version FROM c WHERE n = 1
UNION ALL SELECT c.id, c.key, c.n, c.expected = -1 OR c.expected = f.version, f.version + CASE WHEN c.expected = -1 OR c.expected = f.version THEN 1 ELSE 0 END FROM f JOIN c ON c.key = f.key AND c.n = f.n + 1)"""


@query(CAS + " SELECT id, applied, version FROM f")
def cas_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compare-and-set: a command applies if it expects the current version; -1 expects whatever it is."""
    expected = F.when(F.col("id") % 3 == 0, F.floor("value") % 9).otherwise(-1)
    rows = views.requests(spark, sf_dir).select("key", "ts_ms", "id", expected.cast("long").alias("arg"))
    return folds.fold(rows, folds.compare_and_set, "id long, applied boolean, version long")


LIMIT = views.sql("requests", recursive=True) + """, c AS (SELECT id, key, ts_ms, row_number() OVER (PARTITION BY key ORDER BY ts_ms, id) AS n FROM requests),
f AS (SELECT id, key, n, ts_ms AS start, 1 AS used, true AS allowed FROM c WHERE n = 1
UNION ALL SELECT c.id, c.key, c.n, CASE WHEN c.ts_ms - f.start >= 86400000 THEN c.ts_ms ELSE f.start END, CASE WHEN c.ts_ms - f.start >= 86400000 THEN 1 ELSE f.used + 1 END,
CASE WHEN c.ts_ms - f.start >= 86400000 THEN true ELSE f.used + 1 <= 2 END FROM f JOIN c ON c.key = f.key AND c.n = f.n + 1)"""


@query(LIMIT + " SELECT id, allowed, CAST(used AS BIGINT) AS used FROM f")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two requests in a day that starts with a key's first request; the window starts anew once it has run out."""
    rows = views.requests(spark, sf_dir).select("key", "ts_ms", "id", F.lit(0).alias("arg"))
    return folds.fold(rows, folds.limiter(2, DAY_MS), "id long, allowed boolean, used long")


DEDUPE = views.sql("requests", recursive=True) + """, c AS (SELECT id, key, ts_ms, row_number() OVER (PARTITION BY key ORDER BY ts_ms, id) AS n FROM requests),
f AS (SELECT id, key, n, ts_ms AS last, true AS accepted FROM c WHERE n = 1
UNION ALL SELECT c.id, c.key, c.n, CASE WHEN c.ts_ms - f.last >= 43200000 THEN c.ts_ms ELSE f.last END, c.ts_ms - f.last >= 43200000 FROM f JOIN c ON c.key = f.key AND c.n = f.n + 1)"""


@query(DEDUPE + " SELECT id, accepted FROM f")
def event_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event is accepted if the last accepted one of its key is long enough ago; suppressed ones don't count."""
    rows = views.requests(spark, sf_dir).select("key", "ts_ms", "id", F.lit(0).alias("arg"))
    return folds.fold(rows, folds.suppressor(12 * HOUR_MS), "id long, accepted boolean")


@query(views.sql("requests") + " SELECT namespace, ts_ms // 3600000 AS hour, count(*) AS used, count(*) <= 2 AS within FROM requests GROUP BY 1, 2")
def quota_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.requests(spark, sf_dir).groupBy("namespace", F.floor(F.col("ts_ms") / HOUR_MS).alias("hour")).agg(F.count(F.lit(1)).alias("used"))
    return rows.select("namespace", "hour", "used", (F.col("used") <= 2).alias("within"))


@query(views.sql("requests") + " SELECT key, namespace, id AS claimed_by FROM (SELECT *, row_number() OVER (PARTITION BY key, namespace ORDER BY ts_ms, id) AS rn FROM requests) WHERE rn = 1")
def claim_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.requests(spark, sf_dir).groupBy("key", "namespace").agg(F.min(F.struct("ts_ms", "id")).alias("f"))
    return rows.select("key", "namespace", F.col("f.id").alias("claimed_by"))


LEASE = views.sql("requests", recursive=True) + """, c AS (SELECT id, key, ts_ms, CAST(floor(value) AS INT) % 3 = 0 AS fails, row_number() OVER (PARTITION BY key ORDER BY ts_ms, id) AS n FROM requests),
f AS (SELECT id, key, n, true AS acquired, ts_ms + CASE WHEN fails THEN 3600000 ELSE 2700000 END AS until_ms FROM c WHERE n = 1
UNION ALL SELECT c.id, c.key, c.n, c.ts_ms >= f.until_ms, CASE WHEN c.ts_ms >= f.until_ms THEN c.ts_ms + CASE WHEN c.fails THEN 3600000 ELSE 2700000 END ELSE f.until_ms END FROM f JOIN c ON c.key = f.key AND c.n = f.n + 1)"""


@query(LEASE + " SELECT id, acquired, until_ms FROM f")
def lease_acquire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lease of 45 minutes, or a back-off of 60 where its holder failed; held until it has run out."""
    rows = views.requests(spark, sf_dir).select("key", "ts_ms", "id", (F.floor("value").cast("int") % 3 == 0).cast("int").alias("arg"))
    return folds.fold(rows, folds.lease(45 * 60_000, 60 * 60_000), "id long, acquired boolean, until_ms long")


@query(views.sql("requests") + ", d AS (SELECT key, ts_ms // 86400000 AS day, max(struct_pack(t := ts_ms, i := id)) AS last FROM requests GROUP BY 1, 2) SELECT key, day, last.i AS id, day = max(day) OVER (PARTITION BY key) AS is_current FROM d")
def archive_on_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current row of each key, and the last row of every earlier day as archive."""
    days = views.requests(spark, sf_dir).groupBy("key", F.floor(F.col("ts_ms") / DAY_MS).alias("day")).agg(F.max(F.struct("ts_ms", "id")).alias("last"))
    newest = F.max("day").over(W.partitionBy("key"))
    return days.select("key", "day", F.col("last.id").alias("id"), (F.col("day") == newest).alias("is_current"))


@query(
    """WITH o AS (SELECT o_custkey AS id, sha256(string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority)) AS h FROM orders GROUP BY 1), n AS (SELECT o_custkey AS id, sha256(string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority)) AS h FROM orders WHERE o_totalprice > 100000 GROUP BY 1)
SELECT CASE WHEN n.id IS NULL THEN 'missing' WHEN o.h = n.h THEN 'same' ELSE 'collision' END AS state, count(*) AS n FROM o LEFT JOIN n ON o.id = n.id GROUP BY 1"""
)
def migration_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one store against those of another by id and content hash; here customers by their orders' kinds."""
    def store(orders: DataFrame) -> DataFrame:
        kinds = F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",")
        return orders.groupBy(F.col("o_custkey").alias("id")).agg(F.sha2(kinds, 256).alias("h"))

    orders = load(spark, sf_dir, "orders")
    return commands.parity(store(orders), store(orders.where("o_totalprice > 100000")))


AGE = f"({QUEUE_NOW} - created_ms)"


@query(views.sql("queue_items") + f" SELECT id FROM queue_items WHERE status = 'pending' ORDER BY created_ms DESC, id LIMIT 10")
def publish_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to ten open drafts, newest first."""
    return commands.publish_order(views.queue_items(spark, sf_dir).where("status = 'pending'"), QUEUE_NOW, 10).select("id")


@query(views.sql("queue_items") + f" SELECT id FROM queue_items WHERE status = 'pending' AND {AGE} BETWEEN 43200000 AND 1814400000 ORDER BY score DESC, created_ms DESC, id LIMIT 10")
def publish_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to ten open drafts of 12 hours to 21 days, the best score first, then the newest."""
    return commands.publish_order(views.queue_items(spark, sf_dir).where("status = 'pending'"), QUEUE_NOW, 10, backlog=True).select("id")


QUERIES, ORACLE_SQL = query.queries, query.sql
