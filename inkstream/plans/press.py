"""Press mail queries; documents stand for mails, their first line for the subject."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.functions import press as P
from inkstream.plans.registrar import Registrar
from inkstream.sources.views import load

query = Registrar()
#: Tags for the invented prose of the test tables.
TAGS, EXACT = ("thon", "ouen", "The", "la", "attion to", "und", "that"), ("The",)
WORD = r"(?:^|[^A-Za-z0-9_]){t}(?:$|[^A-Za-z0-9_])"


def _flag(t: str) -> str:
    return f"CASE WHEN regexp_matches(text, '{'' if t in EXACT else '(?i)'}{WORD.format(t=t)}') THEN '{t.lower()}' END"


SQL_TAGS = f"list_filter([{', '.join(map(_flag, TAGS))}], lambda x: x IS NOT NULL)"


@query(f"SELECT doc_id, array_to_string({SQL_TAGS}, ',') AS tags FROM documents")
def press_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(P.tags(F.col("text"), TAGS, EXACT), ",").alias("tags"))


@query(f"""SELECT doc_id, least(1.0::DOUBLE, greatest(0.0::DOUBLE, tier + least(len(tags), 6) * 0.05::DOUBLE + CASE WHEN n > 200 AND n < 6000 THEN 0.1::DOUBLE WHEN n < 100 THEN -0.1::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN links BETWEEN 1 AND 10 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN files > 0 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END)) AS score
FROM (SELECT doc_id, {SQL_TAGS} AS tags, length(text) AS n, doc_id % 12 AS links, doc_id % 2 AS files, CASE CAST(substr(source, 4) AS INT) % 5 WHEN 0 THEN 0.35::DOUBLE WHEN 1 THEN 0.30::DOUBLE WHEN 2 THEN 0.25::DOUBLE WHEN 3 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END AS tier FROM documents)""")
def press_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.element_at(F.array(*map(F.lit, ("government", "developer-tier-1", "advisor-tier-1", "trade-pub", "noise"))), F.substring("source", 4, 9).cast("int") % 5 + 1)
    score = P.relevance(tier, F.size(P.tags(F.col("text"), TAGS, EXACT)), F.col("text"), F.col("doc_id") % 12, F.col("doc_id") % 2)
    return load(spark, sf_dir, "documents").select("doc_id", score.alias("score"))


# A sentence end is marked, since the pattern language has no look-behind; the marks are where the text is split.
PIECES = r"string_split(regexp_replace(regexp_replace(text, '\n+', ' ', 'g'), '([.!?])\s+', '\1¤', 'g'), '¤')"


@query(
    rf"""WITH RECURSIVE p AS (SELECT doc_id, {PIECES} AS s FROM documents), d AS (SELECT doc_id, 0 AS i, '' AS out, true AS open FROM p
UNION ALL SELECT d.doc_id, d.i + 1, CASE WHEN length(d.out || ' ' || s[d.i + 1]) <= 280 THEN trim(d.out || ' ' || s[d.i + 1]) ELSE d.out END, length(d.out || ' ' || s[d.i + 1]) <= 280 FROM d JOIN p ON p.doc_id = d.doc_id WHERE d.open AND d.i < len(s))
SELECT doc_id, arg_max(out, i) AS deck FROM d GROUP BY doc_id"""
)
def press_dek(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", P.deck(F.col("text")).alias("deck"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace('FW: RE:' || string_split(text, chr(10))[1], '(?i)^(?:RE:|FW:|FWD:)+\s*', ''), '\s+', ' ', 'g')) AS subject FROM documents")
def press_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    subject = F.concat(F.lit("FW: RE:"), F.split("text", "\n")[0])
    return load(spark, sf_dir, "documents").select("doc_id", P.clean_subject(subject).alias("subject"))


@query(
    r"""SELECT page_id, array_to_string(list_distinct(u), ' ') AS links
FROM (SELECT page_id, [regexp_replace(x, '[.,;]+$', '') for x in regexp_extract_all('See ' || url || ', and (' || url || ').', '(https?://[^\s<>"'')\]]+)', 1)] AS u FROM pages)"""
)
def press_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("See "), "url", F.lit(", and ("), "url", F.lit(")."))
    return load(spark, sf_dir, "pages").select("page_id", F.array_join(P.links(text), " ").alias("links"))


QUERIES, ORACLE_SQL = query.queries, query.sql
