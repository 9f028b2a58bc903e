"""Shape and provenance of drafts: documents written as draft JSON, each with one part out of order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.operators import drafts
from inkstream.plans.registrar import Registrar
from inkstream.sources.views import NOW_MS, load, words

query = Registrar()

HOUSE = drafts.House(author="desk", cta="https://news.example/join")

#: A draft's parts as JSON; title, subtitle and body are the document's.
PARTS = {
    "slug": '"2024-12-31-a-year"', "publishedAt": '"2024-12-30T20:00:00Z"', "modifiedAt": '"2024-12-31T20:00:00.5Z"', "displayDate": '"31 December"', "author": '"desk"', "tier": '"news"',
    "category": '"macro"', "market": '["UAE","GCC"]', "tldr": '["one","two","three"]', "faq": '[{"q":"Why?","a":"So."}]',
    "citations": '[{"source":"A","url":"https://a.example/1","accessedAt":"2024-12-30T20:00:00Z"},{"source":"B","url":"https://b.example/2","accessedAt":"2024-12-30T20:00:00Z"}]',
    "heroImage": '{"src":"/news/2024-12-31-a-year/cover.jpg","alt":"A quay","credit":"A. Person"}', "cta": '{"href":"https://news.example/join?x=1","label":"Join"}', "distribution": '{"telegram":true,"postiz":{"x":false}}',
    "semaform": '{"howIdTradeIt":{"action":"Watch","reasoning":"r"}}',
}

#: A part, what stands in its place, the name of the check that finds it, and of the check that this one follows.
FAULTS = (
    ("mood", '"x"', "fields", ""), ("slug", '"2024-02-30-a"', "slug", ""), ("publishedAt", '"soon"', "publishedAt", "subtitle"), ("modifiedAt", "null", "modifiedAt", "subtitle"),
    ("publishedAt", '"2025-01-01T00:05:01Z"', "publishedAt ahead", "subtitle"), ("modifiedAt", '"2024-12-30T19:59:59Z"', "modifiedAt before", "subtitle"), ("slug", '"2024-12-30-a-year"', "slug day", "subtitle"),
    ("displayDate", '" "', "displayDate", "subtitle"), ("author", '"guest"', "author", "subtitle"), ("tier", "1", "tier", "subtitle"), ("category", '"sport"', "category", "subtitle"), ("market", "[]", "market", "subtitle"),
    ("tldr", '["one","two"]', "tldr", "subtitle"), ("faq", '[{"q":"Why?"}]', "faq", "body"), ("citations", '[{"source":"A","url":"http://a.example","accessedAt":"2024-12-30T20:00:00Z"}]', "citations", "body"),
    ("citations", '[{"source":"A","url":"https://a.example","accessedAt":"2024-12-30T20:00:00Z"},{"source":"A","url":"https://a.example","accessedAt":"2024-12-30T20:00:00Z"}]', "citations twice", "body"),
    ("heroImage", '{"src":"/news/cover.jpg","alt":"A quay","credit":"A. Person"}', "heroImage", "body"), ("cta", '{"href":"https://news.example/elsewhere","label":"Join"}', "cta", "body"), ("distribution", '{"fax":true}', "distribution", "body"),
    ("metaDescription", "null", "metaDescription", "body"), ("speakableSelector", '["lead"]', "speakableSelector", "body"), ("semaform", '{"howIdTradeIt":{"action":"Hold","reasoning":"r"}}', "semaform", "body"),
    ("metaDescription", '"short"', None, "body"), ("semaform", '{"theTake":"t"}', None, "body"),
)
CYCLE = len(FAULTS)


def _fault(after: str) -> str:
    rows = " ".join(f"WHEN {i} THEN '{name}'" for i, (_, _, name, follows) in enumerate(FAULTS) if follows == after and name)
    return f"CASE doc_id % {CYCLE} {rows} END"


def _short(column: str, least: int, most: int) -> str:
    return rf"CASE WHEN NOT (length(regexp_replace({column}, '^\s+|\s+$', '', 'g')) >= {least} AND length({column}) <= {most} AND NOT regexp_matches({column}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]')) THEN '{column}' END"


def _quoted(text: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(text.alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)


WORDS = r"list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda x: x <> '')"
PROSE = f"d AS (SELECT doc_id, array_to_string(list_slice({WORDS}, 1, 12), ' ') AS title, array_to_string(list_slice({WORDS}, 13, 60), ' ') AS subtitle, coalesce(text, '') AS body FROM documents)"


@query(f"WITH {PROSE} SELECT doc_id, coalesce({_fault('')}, {_short('title', 8, 90)}, {_short('subtitle', 1, 300)}, {_fault('subtitle')}, {_short('body', 100, 80_000)}, {_fault('body')}) AS error FROM d")
def draft_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of a draft's parts that isn't as it must be: documents as drafts, of which each has one fault by its number."""
    docs = load(spark, sf_dir, "documents")
    turn = F.col("doc_id") % CYCLE
    own = {"title": F.array_join(F.slice(words("text"), 1, 12), " "), "subtitle": F.array_join(F.slice(words("text"), 13, 48), " "), "body": F.coalesce("text", F.lit(""))}
    fields = []
    for name in dict.fromkeys([*own, *PARTS, *(part for part, *_ in FAULTS)]):
        value = _quoted(own[name]) if name in own else F.lit(PARTS.get(name))
        for i, (part, text, *_) in enumerate(FAULTS):
            value = F.when(turn == i, F.lit(text)).otherwise(value) if part == name else value
        fields.append(F.concat(F.lit(f'"{name}":'), value))
    rows = docs.select("doc_id", F.try_parse_json(F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))).alias("article"))
    return rows.select("doc_id", drafts.article_error(F.col("article"), HOUSE, NOW_MS).alias("error"))


SEEN = r"d AS (SELECT doc_id, doc_id % 8 AS k, left(coalesce(text, ''), 9000) AS t FROM documents)"


@query(
    rf"""WITH {SEEN} SELECT doc_id, CASE WHEN k = 1 THEN 'clusterId' WHEN k = 2 THEN 'score' WHEN k = 3 THEN 'scoreBreakdown' WHEN k = 4 THEN 'sources'
WHEN k IN (5, 6) OR length(regexp_replace(t, '^\s+|\s+$', '', 'g')) < 80 OR regexp_matches(t, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]') THEN 'fetchedEvidence' END AS error FROM d"""
)
def provenance_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of a provenance's parts that isn't as it must be: documents as fetched texts, whose hashes and addresses must be theirs."""
    k = F.col("doc_id") % 8
    text = F.substring(F.coalesce("text", F.lit("")), 1, 9000)
    pick = lambda n, bad, good: F.when(k == n, F.lit(bad)).otherwise(F.lit(good))
    digest = F.when(k == 5, F.sha2(F.concat(text, F.lit(" ")), 256)).otherwise(F.sha2(text, 256))
    hashed = F.when(k == 7, F.lit("")).otherwise(F.concat(F.lit(',"contentHash":"'), digest, F.lit('"')))
    evidence = F.concat(F.lit('"fetchedEvidence":[{"url":"'), pick(6, "https://c.example/", "https://a.example/1"), F.lit('","fetchedAt":"2024-12-30T20:00:00Z","text":'), _quoted(text), hashed, F.lit("}]"))
    parts = [
        F.concat(F.lit('"clusterId":"'), pick(1, "a b", "a:b"), F.lit('"')), F.lit('"topic":"T"'), F.concat(F.lit('"score":'), pick(2, '"7"', "7.5")),
        F.concat(F.lit('"scoreBreakdown":{"relevance":1,"sourceTier":2,"freshness":0.5'), pick(3, "", ',"angle":3'), F.lit("}")),
        F.concat(F.lit('"sources":[{"name":"A","tier":"official","summary":"S","url":"'), pick(4, "ftp://a.example", "https://a.example/1"), F.lit('"}]')), evidence,
    ]
    article = F.parse_json(F.lit('{"citations":[{"source":"A","url":"https://a.example/1","accessedAt":"2024-12-30T20:00:00Z"}]}'))
    rows = load(spark, sf_dir, "documents").select("doc_id", F.try_parse_json(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))).alias("p"))
    return rows.select("doc_id", drafts.provenance_error(F.col("p"), article, HOUSE).alias("error"))


QUERIES, ORACLE_SQL = query.queries, query.sql
