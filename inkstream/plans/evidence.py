"""Evidence, citation and quality-gate queries.

The words bound here occur in the invented prose of the test tables; the operators' defaults hold a newsroom's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.functions import figures as G
from inkstream.operators import citations, evidence, gates
from inkstream.operators.clusters import TIER_WEIGHT
from inkstream.plans.registrar import Registrar
from inkstream.plans.registry import host, suffixes
from inkstream.sources import views
from inkstream.sources.views import load

query = Registrar()

# DuckDB's patterns have no lookahead. So an m or k before another letter is marked first, which keeps it from being
# read as a unit; the m of "million" is spelt µ meanwhile.
MARKED = r"regexp_replace(regexp_replace({t}, '(?i)m(illion)', 'µ\1', 'g'), '(?i)([mk])([a-z])', '¤\1\2', 'g')"
SQL_FIGURE = G.figure_pattern("[mk]", tuple(u.replace("million", "µillion") for u in G.UNITS))
SQL_COLLAPSED = r"trim(regexp_replace(lower({t}), '[ \t\n\r\f\v]+', ' ', 'g'))"
FOUND = f"""m AS (SELECT doc_id, unnest(regexp_extract_all({MARKED.format(t='text')}, '{SQL_FIGURE}')) AS f FROM documents),
n AS (SELECT DISTINCT doc_id, {SQL_COLLAPSED.format(t="replace(replace(f, '¤', ''), 'µ', 'm')")} AS f FROM m WHERE NOT regexp_matches(f, '{G.NO_FIGURE}'))"""


def sql_normal(t: str) -> str:
    """The SQL twin of ``norm_numeric``: commas before three digits are marked, then those after a digit dropped."""
    named = rf"regexp_replace(regexp_replace({SQL_COLLAPSED.format(t=t)}, '\b(?:dhs?|aed)\b', 'aed', 'g'), '\bper\s*cent\b', '%', 'g')"
    commas = rf"replace(regexp_replace(regexp_replace({named}, ',([0-9][0-9][0-9])\b', '¤\1', 'g'), '([0-9])¤', '\1', 'g'), '¤', ',')"
    return rf"regexp_replace(regexp_replace({commas}, '\s+', '', 'g'), '[–—]', '-', 'g')"


@query(f"WITH {FOUND} SELECT doc_id, count(*) AS figures, string_agg(f, ';' ORDER BY f) AS found FROM n GROUP BY doc_id")
def evidence_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct figures of each document that has any; bare integers and spans of years are none."""
    rows = load(spark, sf_dir, "documents").select("doc_id", F.array_sort(G.figures(F.col("text"))).alias("f")).where(F.size("f") > 0)
    return rows.select("doc_id", F.size("f").cast("long").alias("figures"), F.array_join("f", ";").alias("found"))


@query(f"SELECT doc_id, {sql_normal('text')} AS normal FROM documents")
def norm_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", G.norm_numeric(F.col("text")).alias("normal"))


@query(f"SELECT doc_id, regexp_matches(text, '{G.SIGNAL}') AS has_figures FROM documents")
def stat_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", G.has_stat_signal(F.col("text")).alias("has_figures"))


@query(f"WITH {FOUND}, e AS (SELECT doc_id - 1 AS draft, {sql_normal('text')} AS source FROM documents) SELECT doc_id AS draft, f AS figure FROM n LEFT JOIN e ON doc_id = draft WHERE NOT contains(coalesce(source, ''), {sql_normal('f')})")
def amber_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of each document that its evidence, here the next document, doesn't back."""
    docs = load(spark, sf_dir, "documents")
    drafts = docs.select(F.col("doc_id").alias("draft"), F.col("text").alias("body"))
    return evidence.unsupported(drafts, docs.select((F.col("doc_id") - 1).alias("draft"), F.lit(0).alias("place"), "text"))


@query(f"SELECT doc_id AS draft, source AS url FROM documents WHERE source = 'src' || (doc_id % 20) AND length({SQL_COLLAPSED.format(t='text')}) >= 80")
def fetched_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that their draft cites and that are long enough: each document is fetched from its source."""
    docs = load(spark, sf_dir, "documents")
    cited = docs.select(F.col("doc_id").alias("draft"), F.concat(F.lit("src"), F.col("doc_id") % 20).alias("url"))
    return evidence.fetched(docs.select(F.col("doc_id").alias("draft"), F.col("source").alias("url"), "text"), cited).select("draft", "url")


@query(r"SELECT doc_id, length(core) >= 2 AND contains(regexp_replace(substr(text, 601), '[^0-9]', '', 'g'), core) AS backed FROM (SELECT doc_id, text, regexp_replace(regexp_extract(text, '[0-9][0-9.,]*'), '[^0-9]', '', 'g') AS core FROM documents)")
def figure_backed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text's first number occurs again, by its digits, beyond its summary."""
    first = F.regexp_extract("text", "[0-9][0-9.,]*", 0)
    return load(spark, sf_dir, "documents").select("doc_id", G.digits_backed(first, F.expr("substr(text, 601)")).alias("backed"))


#: Names of the source tiers, best first.
TIERS = ("government", "national-press", "institutional-research", "regional-press", "industry-portal")
CATEGORIES = ("market-pulse", "launch", "regulatory", "macro", "developer-corporate", "infrastructure", "policy")
LANES = evidence.Lanes(analysis=("thon", "ouen", "thnd"), attribution=("that", "was", "and", "la"))
ANALYSIS, ATTRIBUTED = evidence.words_pattern(LANES.analysis), evidence.words_pattern(LANES.attribution)


@query(rf"""SELECT doc_id, lane, CAST(CASE WHEN lane = 'corroborated-analysis' THEN 2 ELSE 1 END AS INT) AS needed FROM (SELECT doc_id, CASE WHEN regexp_matches(text, '{ANALYSIS}') THEN 'corroborated-analysis'
WHEN n % 5 = 0 THEN 'official-update' WHEN n % 5 = 1 THEN 'fast-news' WHEN n % 5 = 2 AND c IN (0, 3) AND a THEN 'research-release' WHEN n = 3 AND c IN (1, 4) AND a THEN 'developer-announcement' ELSE 'corroborated-analysis' END AS lane
FROM (SELECT doc_id, text, CAST(substr(source, 4) AS INT) AS n, doc_id % 7 AS c, regexp_matches(text, '{ATTRIBUTED}') AS a FROM documents))""")
def evidence_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many publishers each document needs, fetched from the one source that it has."""
    number = F.substring("source", 4, 9).cast("int")
    tier = F.element_at(F.array(*map(F.lit, TIERS)), number % 5 + 1)
    category = F.element_at(F.array(*map(F.lit, CATEGORIES)), (F.col("doc_id") % 7 + 1).cast("int"))
    lane = evidence.lane(F.col("text"), category, F.array(tier), number == 3, F.lit(False), LANES)
    return load(spark, sf_dir, "documents").select("doc_id", lane.alias("lane")).select("doc_id", "lane", evidence.publishers_needed(F.col("lane")).alias("needed"))


#: Registered hosts and their tiers for the test pages; a newsroom passes its own.
REGISTRY = (("example.com", 1), ("example.org", 3), ("blog.example.net", 4), ("m.example.com", 0))
CITED = f"""s(source, tier, ord) AS (VALUES {', '.join(f"('{h}', {t}, {i})" for i, (h, t) in enumerate(REGISTRY))}),
p AS (SELECT page_id, page_id // 2 AS draft, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS h FROM pages),
c AS (SELECT page_id, draft, (SELECT arg_min(tier, ord) FROM s WHERE h = source OR ends_with(h, '.' || source)) AS tier FROM p)"""


def cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(draft, tier): two pages make a draft's citations; the tier is that of the first registered source, else null."""
    pages = load(spark, sf_dir, "pages").select("page_id", F.floor(F.col("page_id") / 2).alias("draft"), suffixes(host("url")).alias("names"))
    hit = F.coalesce(*[F.when(F.array_contains("names", h), t) for h, t in REGISTRY])
    return pages.select("draft", hit.alias("tier"))


@query(f"WITH {CITED} SELECT draft, count(*) AS citations, count(tier) AS whitelisted FROM c GROUP BY draft")
def whitelist_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cited(spark, sf_dir).groupBy("draft").agg(F.count(F.lit(1)).alias("citations"), F.count("tier").alias("whitelisted"))


@query(f"""WITH {CITED}, g AS (SELECT draft, count(*) AS n, count(tier) AS hits, coalesce(max([{', '.join(map(str, TIER_WEIGHT))}][tier + 1]::DOUBLE), 0) AS top FROM c GROUP BY draft)
SELECT draft, hits, top, hits > 0 AND (top >= 0.8 OR hits >= 2) AS ok, CASE WHEN hits = 0 THEN '{citations.NONE_REGISTERED}' WHEN top < 0.8 AND hits < 2 THEN '{citations.UNCORROBORATED}' END AS reason FROM g""")
def citation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draft needs a source of weight 0.8, or two registered ones."""
    return citations.gate(cited(spark, sf_dir))


@query(f"""WITH {CITED}, g AS (SELECT draft, count(*) AS sources, arg_min(tier, CASE tier WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 3 ELSE 4 END * 1000000 + page_id) FILTER (WHERE tier IS NOT NULL) AS lead FROM c GROUP BY draft),
l AS (SELECT *, CASE lead WHEN 0 THEN 'Official source' WHEN 1 THEN 'National press' WHEN 2 THEN 'Institutional research' WHEN 3 THEN 'Regional press' WHEN 4 THEN 'Industry source' ELSE 'Source links' END AS name FROM g)
SELECT draft, sources, lead, CASE WHEN sources = 1 THEN name || ' · single source' ELSE sources || ' sources · ' || lower(name) || ' led' END AS label, sources < 2 AND (lead IS NULL OR lead >= 3) AS limited FROM l""")
def evidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sources each draft has, which leads and whether that is thin."""
    pages = load(spark, sf_dir, "pages").select("page_id", F.floor(F.col("page_id") / 2).alias("draft"), suffixes(host("url")).alias("names"))
    tier = F.coalesce(*[F.when(F.array_contains("names", h), t) for h, t in REGISTRY])
    return citations.summary(pages.select("draft", F.col("page_id").alias("place"), tier.alias("tier")))


WORDS = gates.Lexicon(banned=("ingthe", "onheed", "éoire"), approved=("thon", "ouen", "attion", "re the", "la ", "der"))
TITLE = r"array_to_string(list_slice(list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda x: x <> ''), 1, 12), ' ')"


def _held(column: str, terms: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains({column}, '{t}')::INT" for t in terms) + ")"


GATES = rf"""t AS (SELECT doc_id, text AS body, {TITLE} AS title, CASE WHEN CAST(substr(source, 4) AS INT) % 5 < 2 THEN 1 ELSE 0 END AS listed FROM documents),
x AS (SELECT *, lower(title || chr(10) || chr(10) || chr(10) || chr(10) || body) AS txt, len(list_filter(string_split_regex(body, '[ \t\n\r]+'), lambda x: x <> '')) AS n FROM t),
g AS (SELECT doc_id, {_held('txt', WORDS.banned)} > 0 AS gate1, {_held('txt', WORDS.approved)} < 3 AS gate2, length(title) + len(regexp_extract_all(title, '[\x{{10000}}-\x{{10FFFF}}]')) > 90 AS gate3,
NOT regexp_matches(string_split(body, chr(10) || chr(10))[1], '[0-9]') AS gate4, listed < 1 AS gate5,
regexp_matches(body, '{gates.OPENING}') OR regexp_matches(body, '{gates.CLOSING}') OR regexp_matches(body, '{gates.SIGNS}') AS gate6,
n < 600 OR n > 1200 AS gate7, NOT contains(body, '—') AS gate8, (length(body) - length(replace(body, '**', ''))) / 4.0 > ceil(n / 500.0) AS bold, n AS words FROM x)"""
BLOCKED = "CAST(" + " + ".join(f"gate{i}::INT" for i in range(1, 8)) + " AS INT) AS blocked"


def _gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    title = F.array_join(F.slice(views.words("text"), 1, 12), " ")
    listed = F.when(F.substring("source", 4, 9).cast("int") % 5 < 2, 1).otherwise(0)
    found = gates.draft_gates(title, F.lit(""), F.col("text"), listed, words=WORDS)
    return docs.select("doc_id", *[c.alias(n) for n, c in found.items()])


@query(f"WITH {GATES} SELECT *, {BLOCKED} FROM g")
def draft_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight gates of each document as a draft, and how many of the blocking seven it fails."""
    return _gates(spark, sf_dir)


@query(f"WITH {GATES} SELECT CAST(floor(avg((8 - blocked)::DOUBLE / 8) * 100 + 0.5) AS BIGINT) AS confidence FROM (SELECT {BLOCKED} FROM g)")
def gate_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean share of the eight gates that no draft fails by a block, in per cent; nought without drafts."""
    return _gates(spark, sf_dir).agg(F.coalesce(F.floor(F.avg((8 - F.col("blocked")) / 8) * 100 + 0.5), F.lit(0)).alias("confidence"))


VOICE = gates.Lexicon(banned=("thon", "of the", "is"), approved=("tion", "ouen", "attion", "re the"))


@query(rf"""WITH t AS (SELECT doc_id, text AS body, {TITLE} AS title, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS tldr FROM documents),
x AS (SELECT *, lower(title || chr(10) || chr(10) || body || chr(10) || array_to_string(tldr, chr(10))) AS txt, len(list_filter(string_split_regex(body, '[ \t\n\r]+'), lambda x: x <> '')) AS n FROM t)
SELECT doc_id, length(title) + len(regexp_extract_all(title, '[\x{{10000}}-\x{{10FFFF}}]')) > 90 AS headline_length, NOT regexp_matches(string_split_regex(body, '\n\n+')[1], '[0-9]') AS number_first, n < 600 OR n > 1200 AS body_length,
{' OR '.join(f"regexp_matches(txt, '(?:^|[^a-z0-9_]){t}(?:$|[^a-z0-9_])')" for t in VOICE.banned)} AS banned, {_held('txt', VOICE.approved)} < 3 AS approved, len(tldr) <> 3 AS tldr_shape FROM x""")
def voice_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which voice gates each document fails; its lines stand for the points of its summary."""
    docs = load(spark, sf_dir, "documents")
    title = F.array_join(F.slice(views.words("text"), 1, 12), " ")
    points = F.filter(F.split("text", "\n"), lambda x: x != "")
    return docs.select("doc_id", *[c.alias(n) for n, c in gates.voice_gates(title, F.lit(""), F.col("text"), points, VOICE).items()])


#: Documents don't hold sums of all kinds, so some are put behind their texts.
SUMS = " It took AED " , "M, usd 3.5 billion and $7 bn, or Dh 1,250 a sq ft; AED 12Mx and 4% more, €9,5 thousand."
SUMMED = f"s AS (SELECT doc_id, coalesce(text, '') || '{SUMS[0]}' || doc_id || '{SUMS[1]}' AS t FROM documents)"


def _summed() -> Column:
    return F.concat(F.coalesce("text", F.lit("")), F.lit(SUMS[0]), F.col("doc_id").cast("string"), F.lit(SUMS[1]))


@query(rf"WITH {SUMMED} SELECT doc_id, array_to_string(regexp_extract_all(t, '(?:AED|aed|USD|usd|\$|€)\s*[0-9]+(?:[.,][0-9]+)?\s*(?:M|B|K|million|billion|thousand)\b'), ';') AS sums FROM s")
def cluster_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of money as clusters collect them from titles and summaries."""
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(G.money(_summed()), ";").alias("sums"))


@query(rf"WITH {SUMMED} SELECT doc_id, array_to_string(list_transform(regexp_extract_all(t, '(?i)(?:AED|USD|Dh|\$|€|£)?\s?[0-9][0-9,]*(?:\.[0-9]+)?(?:\s?(?:%|bps|bn|mn|billion|million|sqft|sq\.?\s?ft|M|B|K))?'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), ';') AS numbers FROM s")
def desk_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as the review desk marks them in a draft."""
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(G.desk_numbers(_summed()), ";").alias("numbers"))


QUERIES, ORACLE_SQL = query.queries, query.sql
