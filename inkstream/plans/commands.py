"""Commands on versioned records: each is a fold over a key's commands in order of time.

The test tables' requests stand for commands; whole numbers cut from their value choose the command and what it expects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.operators import commands, folds, quotas, timed
from inkstream.plans.registrar import Registrar
from inkstream.sources import views
from inkstream.sources.views import DAY_MS, load

query = Registrar()
MINUTE = 60_000


def rows(spark: SparkSession, sf_dir: str, **fields: str) -> DataFrame:
    """Commands (key, ts_ms, id, arg) whose ``arg`` is a struct of whole numbers given as SQL expressions over v."""
    named = ", ".join(f"'{n}', cast({e} as bigint)" for n, e in fields.items())
    return views.requests(spark, sf_dir).withColumn("v", F.floor("value").cast("long")).select("key", "ts_ms", "id", F.expr(f"named_struct({named})").alias("arg"))


def scan(first: str, then: str, **fields: str) -> str:
    """A recursive walk over each key's commands; ``first`` and ``then`` select from c, and from the state f before it."""
    named = ", ".join(f"CAST({e} AS BIGINT) AS {n}" for n, e in fields.items())
    return (
        views.sql("requests", recursive=True)
        + f""", r AS (SELECT *, CAST(floor(value) AS BIGINT) AS v FROM requests), c AS (SELECT id, key, ts_ms, {named}, row_number() OVER (PARTITION BY key ORDER BY ts_ms, id) AS n FROM r),
f AS (SELECT c.id, c.key, c.n, {first} FROM c WHERE c.n = 1 UNION ALL SELECT c.id, c.key, c.n, {then} FROM f JOIN c ON c.key = f.key AND c.n = f.n + 1)"""
    )


@query(
    scan(
        "CASE WHEN c.expected = 0 THEN 1 ELSE 0 END::BIGINT AS version, CASE WHEN c.expected = 0 THEN 'created' ELSE 'missing' END AS outcome",
        """CASE WHEN f.version = 0 THEN CASE WHEN c.expected = 0 THEN 1 ELSE 0 END WHEN c.expected = f.version THEN CASE WHEN c.del = 1 THEN 0 ELSE f.version + 1 END ELSE f.version END,
CASE WHEN f.version = 0 THEN CASE WHEN c.expected = 0 THEN 'created' ELSE 'missing' END WHEN c.expected <> f.version THEN 'conflict' WHEN c.del = 1 THEN 'deleted' ELSE 'updated' END""",
        expected="v % 4", del_="v % 2",
    ).replace(" AS del_", " AS del")
    + " SELECT id, outcome, version FROM f"
)
def cas_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Create (expecting no version), update and delete, each applied only if it expects the record's version."""
    return folds.fold(rows(spark, sf_dir, expected="v % 4", delete="v % 2"), commands.versioned, "id long, outcome string, version long")


LEASE = dict(token="id % 3", kind="v % 3")


@query(
    scan(
        "CASE WHEN c.kind = 0 THEN c.token ELSE -1 END AS holder, CASE WHEN c.kind = 0 THEN 1 ELSE 0 END::BIGINT AS state, CASE WHEN c.kind = 0 THEN c.ts_ms + 2700000 ELSE 0 END AS until_ms, CASE WHEN c.kind = 0 THEN 'acquired' ELSE 'conflict' END AS outcome",
        """CASE WHEN c.kind = 0 AND (c.ts_ms >= f.until_ms OR (f.state = 2 AND c.token = 2)) THEN c.token ELSE f.holder END,
CASE WHEN c.kind = 0 AND (c.ts_ms >= f.until_ms OR (f.state = 2 AND c.token = 2)) THEN 1 WHEN c.kind > 0 AND f.state = 1 AND c.ts_ms < f.until_ms AND c.token = f.holder THEN CASE WHEN c.kind = 1 THEN 2 ELSE 3 END ELSE f.state END,
CASE WHEN c.kind = 0 AND (c.ts_ms >= f.until_ms OR (f.state = 2 AND c.token = 2)) THEN c.ts_ms + 2700000 WHEN c.kind > 0 AND f.state = 1 AND c.ts_ms < f.until_ms AND c.token = f.holder THEN c.ts_ms + CASE WHEN c.kind = 1 THEN 3600000 ELSE 2592000000 END ELSE f.until_ms END,
CASE WHEN c.kind = 0 THEN CASE WHEN c.ts_ms >= f.until_ms OR (f.state = 2 AND c.token = 2) THEN 'acquired' ELSE 'held' END
WHEN f.state = 1 AND c.ts_ms < f.until_ms AND c.token = f.holder THEN CASE WHEN c.kind = 1 THEN 'failed' ELSE 'staged' END ELSE 'conflict' END""",
        **LEASE,
    )
    + " SELECT id, outcome, until_ms FROM f"
)
def reserved_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acquire a lease, fail it or stage a draft under it; token 2 stands for a caller that retries what has failed."""
    kept = rows(spark, sf_dir, token="id % 3", kind="v % 3", retry="if(id % 3 = 2, 1, 0)")
    return folds.fold(kept, commands.reservation(45 * MINUTE, 60 * MINUTE, 30 * DAY_MS), "id long, outcome string, until_ms long")


@query(
    views.sql("requests")
    + ", r AS (SELECT id, ts_ms, key % 20 || '-' || CAST(floor(value) AS BIGINT) AS slug FROM requests), n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY ts_ms, id) AS k FROM r) SELECT id, CASE WHEN k = 1 THEN 'inserted' ELSE 'collision' END AS outcome FROM n"
)
def unique_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first draft of a slug is inserted, later ones collide: a minimum joined back, so no slug is one task."""
    found = views.requests(spark, sf_dir).select("id", "ts_ms", F.concat_ws("-", (F.col("key") % 20).cast("string"), F.floor("value").cast("string")).alias("slug"))
    return commands.first_of(found, "slug", "inserted", "collision")


@query()
def draft_cas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits and touches of drafts, applied only if revision, version, content hash and claim are those expected.

    No SQL: the record has four parts; ``tests/test_commands.py`` holds the fold against a plain walk.
    """
    fields = dict(revision="1 + v % 2", version="1 + v % 3", hash="v % 2", claim="0", edit="v % 2", new_hash="(v + 1) % 2")
    return folds.fold(rows(spark, sf_dir, **fields), commands.draft, "id long, outcome string, revision long, version long, verified boolean")


@query(
    scan(
        "c.digest AS held, CASE WHEN c.kind = 0 THEN 1 ELSE 0 END::BIGINT AS state, CASE WHEN c.kind = 0 THEN c.ts_ms + 120000 ELSE 0 END AS lease_ms, CASE WHEN c.kind = 0 THEN 'claimed' ELSE 'refused' END AS outcome, c.ts_ms + CASE WHEN c.kind = 0 THEN 86400000 ELSE 0 END AS gone_ms",
        """CASE WHEN c.kind = 0 AND (f.state = 0 OR c.ts_ms >= f.gone_ms) THEN c.digest ELSE f.held END,
CASE WHEN f.state = 0 OR c.ts_ms >= f.gone_ms THEN CASE WHEN c.kind = 0 THEN 1 ELSE 0 END WHEN c.digest <> f.held THEN f.state WHEN c.kind = 1 AND f.state = 1 THEN 2 WHEN c.kind = 2 AND f.state = 2 THEN 3 ELSE f.state END,
CASE WHEN f.state = 0 OR c.ts_ms >= f.gone_ms THEN CASE WHEN c.kind = 0 THEN c.ts_ms + 120000 ELSE 0 END WHEN c.kind = 0 AND c.digest = f.held AND f.state = 1 AND c.ts_ms >= f.lease_ms THEN c.ts_ms + 120000 ELSE f.lease_ms END,
CASE WHEN f.state = 0 OR c.ts_ms >= f.gone_ms THEN CASE WHEN c.kind = 0 THEN 'claimed' ELSE 'refused' END WHEN c.digest <> f.held THEN CASE WHEN c.kind = 0 THEN 'conflict' ELSE 'refused' END
WHEN c.kind = 0 THEN CASE f.state WHEN 3 THEN 'completed' WHEN 2 THEN 'dispatched' ELSE CASE WHEN c.ts_ms >= f.lease_ms THEN 'claimed' ELSE 'busy' END END
WHEN c.kind = f.state THEN CASE c.kind WHEN 1 THEN 'dispatched' ELSE 'completed' END ELSE 'refused' END,
CASE WHEN f.state = 0 OR c.ts_ms >= f.gone_ms THEN c.ts_ms + CASE WHEN c.kind = 0 THEN 86400000 ELSE 0 END WHEN c.digest = f.held AND ((c.kind = 0 AND f.state = 1 AND c.ts_ms >= f.lease_ms) OR (c.kind > 0 AND c.kind = f.state)) THEN c.ts_ms + 86400000 ELSE f.gone_ms END""",
        kind="v % 3", digest="id % 2",
    )
    + " SELECT id, outcome FROM f"
)
def ledger_fsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """claimed, dispatched, completed under one payload digest; a claim of two minutes may be taken over; gone in a day."""
    return folds.fold(rows(spark, sf_dir, kind="v % 3", digest="id % 2"), commands.ledger(120_000, DAY_MS), "id long, outcome string")


@query(
    views.sql("requests")
    + ", r AS (SELECT id, key, namespace, ts_ms, CAST(floor(value) AS BIGINT) % 5 AS h FROM requests), f AS (SELECT *, first_value(h) OVER w AS kept, row_number() OVER w AS n FROM r WINDOW w AS (PARTITION BY key, namespace ORDER BY ts_ms, id)) SELECT id, CASE WHEN n = 1 THEN 'set' WHEN h = kept THEN 'unchanged' ELSE 'conflict' END AS outcome FROM f"
)
def set_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first approval of a draft is kept; one with the same hash changes nothing, another conflicts."""
    found = views.requests(spark, sf_dir).select("id", "ts_ms", F.concat_ws("|", F.col("key").cast("string"), "namespace").alias("slot"), (F.floor("value") % 5).alias("hash"))
    return commands.first_of(found, "slot", "set", "conflict", same="unchanged", payload="hash")


LEDGER = """WITH d AS (SELECT doc_id // 4 AS draft, source AS url, text FROM documents), u AS (SELECT draft, url, min(sha256(text)) AS h FROM d GROUP BY ALL),
c AS (SELECT DISTINCT doc_id // 4 AS draft, 'src' || (doc_id % 20) AS url FROM documents WHERE doc_id % 2 = 0 UNION SELECT DISTINCT doc_id // 4, source FROM documents WHERE doc_id % 2 = 1),
j AS (SELECT c.draft, c.url, u.h FROM c LEFT JOIN u ON c.draft = u.draft AND c.url = u.url)"""


@query(LEDGER + " SELECT draft, CASE WHEN count(*) >= 2 AND count(h) = count(*) THEN sha256('[' || string_agg('{\"contentHash\":\"' || h || '\",\"url\":\"' || url || '\"}', ',' ORDER BY url) || ']') END AS ledger FROM j GROUP BY draft")
def evidence_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each draft's cited URLs and the texts fetched for them; null below two, or if one is missing."""
    docs = load(spark, sf_dir, "documents")
    draft = F.floor(F.col("doc_id") / 4).alias("draft")
    fetched = docs.select(draft, F.col("source").alias("url"), "text")
    even = docs.where("doc_id % 2 = 0").select(draft, F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string")).alias("url"))
    return commands.evidence_ledger(even.union(docs.where("doc_id % 2 = 1").select(draft, "source")), fetched)


REVIEW = dict(kind="v % 5", revision="CASE WHEN v % 9 = 0 THEN 2 ELSE 1 END", version="1 + v % 3", hash="CASE WHEN v % 9 = 0 THEN 1 ELSE 0 END", new_hash="id % 2", approval="1 + id % 2", valid="CASE WHEN id % 7 = 0 THEN 0 ELSE 1 END")
REVIEWED = (
    views.sql("requests", recursive=True)
    + ", r AS (SELECT *, CAST(floor(value) AS BIGINT) AS v FROM requests), c AS MATERIALIZED (SELECT id, key, row_number() OVER (PARTITION BY key ORDER BY ts_ms, id) AS n, "
    + ", ".join(f"CAST({e} AS BIGINT) AS c_{n}" for n, e in REVIEW.items())
    + """ FROM r), f AS (SELECT NULL::BIGINT AS id, key, 0::BIGINT AS n, 1::BIGINT AS revision, 1::BIGINT AS version, 0::BIGINT AS content, 0::BIGINT AS evidence, 0::BIGINT AS media, 1::BIGINT AS valid, 0::BIGINT AS claimed, '' AS outcome FROM (SELECT DISTINCT key FROM c)
UNION ALL SELECT id, key, n, CASE WHEN said = 'edited' THEN revision + 1 ELSE revision END, CASE WHEN said IN ('edited', 'touched', 'evidence approved', 'media approved') OR (said = 'claimed' AND claimed = 0) THEN version + 1 ELSE version END,
CASE WHEN said = 'edited' THEN c_new_hash ELSE content END, CASE WHEN said = 'edited' THEN 0 WHEN said = 'evidence approved' THEN c_approval ELSE evidence END, CASE WHEN said = 'edited' THEN 0 WHEN said = 'media approved' THEN c_approval ELSE media END,
CASE WHEN said = 'edited' THEN c_valid ELSE valid END, CASE WHEN said = 'claimed' THEN 1 ELSE claimed END, said FROM (
SELECT c.*, f.* EXCLUDE (id, key, n, outcome), CASE WHEN c_revision <> f.revision OR c_hash <> f.content THEN 'conflict' WHEN c_kind = 4 THEN CASE WHEN f.claimed = 1 OR (f.evidence > 0 AND f.media > 0 AND f.valid = 1) THEN 'claimed' ELSE 'conflict' END
WHEN f.claimed = 1 THEN 'conflict' WHEN c_kind = 2 THEN CASE WHEN f.evidence = c_approval THEN 'unchanged' ELSE 'evidence approved' END WHEN c_kind = 3 THEN CASE WHEN f.media = 0 THEN 'media approved' WHEN f.media = c_approval THEN 'unchanged' ELSE 'conflict' END
WHEN c_version <> f.version THEN 'conflict' WHEN c_kind = 1 THEN 'edited' ELSE 'touched' END AS said FROM f JOIN c ON c.key = f.key AND c.n = f.n + 1))
SELECT id, outcome, revision, version, evidence, media, valid = 1 AS valid FROM f WHERE n > 0"""
)


@query(REVIEWED)
def draft_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits, approvals and claims of drafts under review; an edit takes both approvals away and validates anew."""
    return folds.fold(rows(spark, sf_dir, **REVIEW), commands.review, "id long, outcome string, revision long, version long, evidence long, media long, valid boolean")


QUOTAS = (
    views.sql("requests", recursive=True)
    + """, r AS (SELECT id, id % 700 AS k, ts_ms // 4 AS ts, 'c' || key % 6 AS caller, CASE CAST(floor(value) AS BIGINT) % 6 WHEN 4 THEN 1 WHEN 5 THEN 2 ELSE 0 END AS kind, id // 2100 % 2 AS digest FROM requests),
c AS MATERIALIZED (SELECT *, ts // 3600000 AS hour, row_number() OVER (ORDER BY ts, id) AS n FROM r),
f AS (SELECT 0::BIGINT AS n, -1::BIGINT AS id, -1::BIGINT AS hour, 0::BIGINT AS total, MAP {}::MAP(VARCHAR, BIGINT) AS callers, MAP {}::MAP(BIGINT, STRUCT(digest BIGINT, stage BIGINT, lease BIGINT, gone BIGINT)) AS records, '' AS outcome
UNION ALL SELECT n, id, hour, total::BIGINT, CASE WHEN new THEN map_concat(callers, MAP {caller: used::BIGINT}) ELSE callers END,
CASE WHEN new AND fits THEN map_concat(records, MAP {k: {'digest': digest, 'stage': 1::BIGINT, 'lease': ts + 120000, 'gone': ts + 86400000}}) WHEN NOT live OR digest <> x.digest THEN records
WHEN kind = 0 AND x.stage = 1 AND ts >= x.lease THEN map_concat(records, MAP {k: {'digest': digest, 'stage': 1::BIGINT, 'lease': ts + 120000, 'gone': ts + 86400000}})
WHEN kind = x.stage THEN map_concat(records, MAP {k: {'digest': digest, 'stage': (x.stage + 1)::BIGINT, 'lease': x.lease, 'gone': ts + 86400000}}) ELSE records END,
CASE WHEN new THEN CASE WHEN fits THEN 'claimed' ELSE 'rate-limited' END WHEN NOT live THEN 'refused' WHEN digest <> x.digest THEN CASE WHEN kind = 0 THEN 'conflict' ELSE 'refused' END
WHEN kind = 0 THEN CASE x.stage WHEN 3 THEN 'completed' WHEN 2 THEN 'dispatched' ELSE CASE WHEN ts >= x.lease THEN 'claimed' ELSE 'busy' END END
WHEN kind = x.stage THEN CASE kind WHEN 1 THEN 'dispatched' ELSE 'completed' END ELSE 'refused' END
FROM (SELECT *, used <= 4 AND total <= 20 AS fits FROM (SELECT *, CASE WHEN new THEN coalesce(callers[caller], 0) + 1 END AS used, sofar + CASE WHEN new THEN 1 ELSE 0 END AS total FROM (SELECT *, kind = 0 AND NOT live AS new FROM (
SELECT c.*, f.records, CASE WHEN f.hour = c.hour THEN f.callers ELSE MAP {}::MAP(VARCHAR, BIGINT) END AS callers, CASE WHEN f.hour = c.hour THEN f.total ELSE 0 END AS sofar, f.records[c.k] AS x, coalesce(c.ts < f.records[c.k].gone, false) AS live
FROM f JOIN c ON c.n = f.n + 1)))))
SELECT id, outcome FROM f WHERE n > 0"""
)


@query(QUOTAS)
def ledger_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger's commands when a caller may make four new claims an hour and all together twenty; time runs fourfold."""
    v = F.floor("value").cast("long") % 6
    kind = F.when(v == 4, 1).when(v == 5, 2).otherwise(0)
    found = views.requests(spark, sf_dir).select(
        "id", (F.col("id") % 700).alias("key"), F.floor(F.col("ts_ms") / 4).alias("ts_ms"), F.concat(F.lit("c"), (F.col("key") % 6).cast("string")).alias("caller"),
        kind.cast("long").alias("kind"), (F.floor(F.col("id") / 2100) % 2).alias("digest"),
    )
    return quotas.ledger(found)


PUBLICATION = dict(kind="v % 3", claim="id % 2", sha="v % 2")
PUBLISHED = (
    scan(
        """c.ts_ms AS at_ms, CASE WHEN c.kind = 0 THEN 1 ELSE 0 END AS stage, c.claim AS held, c.ts_ms AS started, -1::BIGINT AS done_sha, 0::BIGINT AS receipt,
CASE WHEN c.kind = 0 THEN 'acquired' ELSE 'conflict' END AS outcome""",
        """c.ts_ms, CASE WHEN f.stage = 0 AND c.kind = 0 THEN 1 WHEN f.stage = 1 AND c.kind = 1 AND c.claim = f.held THEN 2 WHEN f.stage = 2 AND c.kind = 2 AND c.claim = f.held THEN 3 ELSE f.stage END,
CASE WHEN f.stage = 0 THEN c.claim ELSE f.held END, CASE WHEN f.stage = 0 THEN c.ts_ms ELSE f.started END,
CASE WHEN f.stage = 1 AND c.kind = 1 AND c.claim = f.held THEN c.sha ELSE f.done_sha END, CASE WHEN f.stage = 2 AND c.kind = 2 AND c.claim = f.held THEN c.ts_ms + 2592000000 ELSE f.receipt END,
CASE WHEN f.stage = 0 THEN CASE WHEN c.kind = 0 THEN 'acquired' ELSE 'conflict' END WHEN f.stage = 3 THEN CASE WHEN c.kind = 2 AND c.claim = f.held AND c.ts_ms < f.receipt THEN 'repeated' ELSE 'gone' END
WHEN c.kind = 0 THEN CASE WHEN f.stage = 2 THEN 'awaiting' WHEN c.ts_ms >= f.started + 300000 THEN 'resumed' ELSE 'busy' END WHEN c.claim <> f.held THEN 'conflict'
WHEN c.kind = 1 THEN CASE WHEN f.stage = 1 THEN 'committed' WHEN c.sha = f.done_sha THEN 'repeated' ELSE 'conflict' END WHEN f.stage = 1 THEN 'conflict' ELSE 'completed' END""",
        **PUBLICATION,
    )
    + """, h AS (SELECT max(ts_ms) AS upto FROM requests), e AS (
SELECT key, at_ms, id, stage, outcome, started, receipt FROM f
UNION ALL SELECT a.key, a.at_ms + 300000, NULL, 1, 'stale', a.started, 0 FROM f a, h WHERE outcome = 'acquired' AND a.at_ms + 300000 <= upto AND NOT EXISTS (SELECT 1 FROM f b WHERE b.key IS NOT DISTINCT FROM a.key AND b.outcome = 'committed' AND b.at_ms < a.at_ms + 300000)
UNION ALL SELECT key, receipt, NULL, 3, 'receipt gone', started, receipt FROM f, h WHERE outcome = 'completed' AND receipt <= upto
UNION ALL SELECT key, receipt + 28944000000, NULL, 3, 'archive gone', started, receipt FROM f, h WHERE outcome = 'completed' AND receipt + 28944000000 <= upto)
SELECT key, at_ms, id, list_extract(['draft', 'publishing', 'committed', 'completed'], stage + 1) AS state, outcome, CASE WHEN stage > 0 THEN started END AS started_ms,
CASE WHEN stage = 3 AND at_ms < receipt THEN receipt END AS receipt_ms, CASE WHEN stage = 3 AND at_ms < receipt + 28944000000 THEN receipt + 28944000000 END AS archive_ms FROM e"""
)


@query(PUBLISHED)
def publication_fsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims, commits and completions of publications, and what comes by itself: stale claims, receipts and archives that go."""
    found = rows(spark, sf_dir, **PUBLICATION)
    schema = "state string, outcome string, started_ms long, receipt_ms long, archive_ms long"
    return timed.fold(found, timed.Publication(), schema, timed.horizon(found))


@query(
    scan(
        "true AS acquired, c.ts_ms + CASE WHEN c.fails = 1 THEN 3600000 ELSE 2700000 END AS until_ms, c.ts_ms AS at_ms",
        "c.ts_ms >= f.until_ms, CASE WHEN c.ts_ms >= f.until_ms THEN c.ts_ms + CASE WHEN c.fails = 1 THEN 3600000 ELSE 2700000 END ELSE f.until_ms END, c.ts_ms",
        fails="CASE WHEN v % 3 = 0 THEN 1 ELSE 0 END",
    )
    + """ SELECT key, at_ms, id, CASE WHEN acquired THEN 'acquired' ELSE 'held' END AS outcome, until_ms FROM f
UNION ALL SELECT key, until_ms, NULL, 'expired', until_ms FROM f WHERE acquired AND until_ms <= (SELECT max(ts_ms) FROM requests)"""
)
def lease_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leases acquired, refused and run out, the last without a request; a failed holder keeps a key for an hour, others 45 minutes."""
    found = rows(spark, sf_dir, fails="CASE WHEN v % 3 = 0 THEN 1 ELSE 0 END").withColumn("arg", F.col("arg.fails") == 1)
    return timed.fold(found, timed.Lease(45 * MINUTE, 60 * MINUTE), "outcome string, until_ms long", timed.horizon(found))


QUERIES, ORACLE_SQL = query.queries, query.sql
