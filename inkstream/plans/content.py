"""Channel texts, packets of sources, checks of slugs, addresses and drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkstream.functions import labels as L
from inkstream.operators import content, media
from inkstream.operators.content import FORMATS
from inkstream.operators.similarity import top
from inkstream.plans.registrar import Registrar
from inkstream.sources import views
from inkstream.sources.store import short_batches
from inkstream.sources.views import load

query = Registrar()
SITE = "news.example.com"
SQL_WORDS = r"list_filter(string_split_regex(body, '[ \t\n\r]+'), lambda x: x <> '')"


def _shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with a subtitle and three points, cut from their words."""
    cut = lambda a, n: F.array_join(F.slice(F.col("w"), a, n), " ")
    rows = views.articles(spark, sf_dir).withColumn("w", views.words("body"))
    return rows.select("ord", "slug", "title", "body", "market", "category", "status", "published_ms", cut(13, 40).alias("subtitle"), F.array(cut(53, 30), cut(83, 60), cut(143, 5)).alias("points"))


SHAPED = views.sql("articles") + f""", a AS (SELECT ord, slug, title, body, market, category, status, published_ms, {SQL_WORDS} AS w FROM articles),
s AS (SELECT * EXCLUDE (w), array_to_string(list_slice(w, 13, 52), ' ') AS subtitle, [array_to_string(list_slice(w, 53, 82), ' '), array_to_string(list_slice(w, 83, 142), ' '), array_to_string(list_slice(w, 143, 147), ' ')] AS points FROM a)"""


def _sql_fill(template: str, link: str) -> str:
    names = {
        "title": "title", "subtitle": "subtitle", "point1": "points[1]", "point2": "points[2]", "hook": "hook", "lead": "coalesce(lead_ || ' — ', '')", "site": f"'{SITE}'", "link": link,
        "safe_title": "replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')", "safe_points": "replace(replace(replace(array_to_string(points, chr(10) || chr(10)), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')",
    }
    out, at = [], 0
    quote = lambda t: "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    while (a := template.find("{", at)) >= 0:
        b = template.index("}", a)
        out += [quote(template[at:a]), names[template[a + 1 : b]]]
        at = b + 1
    return " || ".join([*out, quote(template[at:])])


def _sql_channel(channel: str) -> str:
    f = FORMATS[channel]
    link = f"('https://{SITE}/news/' || slug || '?utm_source={channel}&utm_medium=social&utm_campaign=' || slug)"
    core = f"({_sql_fill(f.core, link)})"
    if f.most:
        budget = f"({f.most} - 4 - {f.reserved}" + (f" - length({link})" if f.with_link else "") + ")"
        head = f"left({core}, {budget})"
        core = f"CASE WHEN length({core}) <= {budget} THEN {core} ELSE CASE WHEN contains({head}, ' ') AND length({head}) > strpos(reverse({head}), ' ') THEN left({head}, length({head}) - strpos(reverse({head}), ' ')) ELSE {head} END || '…' END"
    return f"SELECT slug, '{channel}' AS channel, {_sql_fill(f.head, link)} || {core} || {_sql_fill(f.tail, link)} AS text FROM h"


HOOKED = f""", h AS MATERIALIZED (SELECT *, coalesce(nullif(array_to_string(list_slice(string_split(string_split(body, chr(10) || chr(10))[2], '. '), 1, 2), '. '), ''), subtitle) AS hook, nullif(regexp_extract(body, '{content.LEAD}'), '') AS lead_ FROM s)"""


@query(SHAPED + HOOKED + " " + " UNION ALL ".join(map(_sql_channel, FORMATS)))
def channel_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every article for each of the thirteen channels that have a builder."""
    return content.channel_texts(_shaped(spark, sf_dir), SITE)


@query(views.sql("articles") + f" SELECT slug, 'https://{SITE}/engage?utm_source=news&utm_medium=article&utm_campaign=' || replace(market, ' ', '+') || '%26' || category AS link FROM articles")
def utm_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    campaign = F.concat("market", F.lit("&"), F.col("category").cast("string"))
    return views.articles(spark, sf_dir).select("slug", content.tracked(F.lit(f"https://{SITE}/engage"), F.lit("news"), F.lit("article"), campaign).alias("link"))


TERMS = ["then", "thon", "ouen", "attion"]
SCORE = " + ".join(f"CASE WHEN contains(lower(title), '{t}') THEN 3 WHEN contains(lower(title || ' ' || subtitle || ' ' || array_to_string(points, ' ')), '{t}') THEN 1 ELSE 0 END" for t in TERMS)
CHOSEN = SHAPED + f", r AS (SELECT slug, published_ms, ord, {SCORE} AS score FROM s WHERE status IS DISTINCT FROM 'research'), b AS (SELECT *, row_number() OVER (ORDER BY score DESC, published_ms DESC, ord) AS rank FROM r QUALIFY (score > 0 OR max(score) OVER () = 0) AND rank <= 4)"


def _chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best articles; ones that score nought only where all do, which the order of scores tells."""
    score = content.brief_score(TERMS, F.col("title"), F.concat_ws(" ", "title", "subtitle", F.array_join("points", " ")))
    rows = _shaped(spark, sf_dir).where(~F.col("status").eqNullSafe("research")).select("ord", "slug", "published_ms", score.alias("score"))
    order = [F.desc("score"), F.desc("published_ms"), F.asc("ord")]
    best = rows.orderBy(*order).limit(4).withColumn("rank", F.row_number().over(W.orderBy(*order)))
    return best.withColumn("top", F.max("score").over(W.partitionBy())).where("score > 0 OR top = 0").drop("top")


@query(CHOSEN + " SELECT slug, CAST(score AS INT) AS score FROM b")
def brief_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four articles that match a topic's terms best, newest first."""
    return _chosen(spark, sf_dir).select("slug", "score")


@query(
    CHOSEN
    + """, c AS (SELECT rank, slug, unnest(['https://a.example/' || ord % 3, 'ftp://a.example/', 'https://b.example/' || ord, 'https://a.example/' || ord % 5]) AS url, unnest([0, 1, 2, 3]) AS place FROM b), d AS (SELECT url, min(struct_pack(r := rank, p := place, a := slug)) AS f FROM c WHERE url LIKE 'http%' GROUP BY url)
SELECT 'S' || row_number() OVER (ORDER BY f) AS source_id, f.a AS article, url FROM d QUALIFY row_number() OVER (ORDER BY f) <= 8"""
)
def brief_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight distinct sources of the chosen articles, numbered."""
    host = lambda h, n: F.concat(F.lit(f"https://{h}.example/"), n.cast("string"))
    urls = F.array(host("a", F.col("ord") % 3), F.lit("ftp://a.example/"), host("b", F.col("ord")), host("a", F.col("ord") % 5))
    cited = _chosen(spark, sf_dir).select("rank", F.col("slug").alias("article"), F.posexplode(urls).alias("place", "url"))
    return content.brief_sources(cited)


@query(
    r"""WITH b AS (SELECT doc_id, 'See S' || (doc_id % 5) || ' and S' || (doc_id % 3 + 1) || '. ' || text AS brief FROM documents)
SELECT doc_id, len(list_filter(regexp_extract_all(brief, '\bS([0-9]+)\b', 1), lambda r: CAST(r AS BIGINT) NOT BETWEEN 1 AND 4)) = 0 AND len(regexp_extract_all(brief, '([\p{L}\p{N}][\p{L}\p{N}’''-]*)')) BETWEEN 400 AND 600 AND NOT regexp_matches(brief, '(?i)https?://') AS ok FROM b"""
)
def brief_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = lambda c: c.cast("string")
    brief = F.concat(F.lit("See S"), number(F.col("doc_id") % 5), F.lit(" and S"), number(F.col("doc_id") % 3 + 1), F.lit(". "), "text")
    return load(spark, sf_dir, "documents").select("doc_id", content.brief_bounded(brief, F.lit(4)).alias("ok"))


@query(views.sql("articles") + ", r AS (SELECT market || '-' || category AS path, slug, row_number() OVER (PARTITION BY market, category ORDER BY published_ms DESC, ord) AS k FROM articles) SELECT path, slug FROM r WHERE k = 1")
def first_per_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first article of each path: a minimum, so no path's rows are sorted."""
    rows = views.articles(spark, sf_dir).groupBy(F.concat_ws("-", "market", F.col("category").cast("string")).alias("path"))
    return rows.agg(F.min(F.struct((-F.col("published_ms")).alias("newest"), "ord", "slug")).alias("f")).select("path", "f.slug")


@query(views.sql("articles") + f""" SELECT CAST(row_number() OVER (ORDER BY published_ms DESC, ord) AS INT) AS position, '{{"@type":"ListItem","position":' || row_number() OVER (ORDER BY published_ms DESC, ord) || ',"url":"https://{SITE}/news/' || slug || '"}}' AS item FROM articles ORDER BY published_ms DESC, ord LIMIT 20""")
def itemlist_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty newest articles as items of a list, numbered from one."""
    rows = top(views.articles(spark, sf_dir).select("slug", "ord", "published_ms"), [F.desc("published_ms"), F.asc("ord")], 20)
    item = F.struct(F.lit("ListItem").alias("@type"), F.col("position"), F.concat(F.lit(f"https://{SITE}/news/"), "slug").alias("url"))
    return rows.select("position", F.to_json(item).alias("item"))


@query(r"WITH u AS (SELECT page_id % 60 AS request, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS h FROM pages) SELECT request, count(url) AS urls, CASE WHEN count(url) = 0 THEN 'empty' WHEN count(url) > 3 THEN 'too many' WHEN count(*) FILTER (WHERE h <> 'blog.example.com') > 0 THEN 'off host' ELSE 'valid' END AS verdict FROM u GROUP BY request")
def indexnow_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.submission(load(spark, sf_dir, "pages").select((F.col("page_id") % 60).alias("request"), "url"), "blog.example.com", 3)


@query("SELECT p_partkey AS id FROM part WHERE p_size < 10 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def append_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to append whose key isn't there yet: an anti-join before the write."""
    there = load(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("k"))
    return load(spark, sf_dir, "part").where("p_size < 10").join(there, F.col("p_partkey") == F.col("k"), "left_anti").select(F.col("p_partkey").alias("id"))


DAYS = ("2024-02-29", "2023-02-29", "2024-13-01", "1999-12-31", "2024-04-31")


@query(rf"""SELECT doc_id, length(slug) <= 80 AND regexp_matches(slug, '{content.SLUG}') AND try_cast(left(slug, 10) AS DATE) IS NOT NULL AS ok
FROM (SELECT doc_id, [{', '.join(f"'{d}'" for d in DAYS)}][doc_id % 5 + 1] || '-' || trim(lower(left(replace(text, ' ', '-'), CAST(doc_id % 90 AS INT) + 1))) AS slug FROM documents)""")
def slug_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.element_at(F.array(*map(F.lit, DAYS)), (F.col("doc_id") % 5 + 1).cast("int"))
    tail = F.trim(F.lower(F.replace(F.col("text"), F.lit(" "), F.lit("-")).substr(F.lit(1), (F.col("doc_id") % 90 + 1).cast("int"))))
    return load(spark, sf_dir, "documents").select("doc_id", content.slug_valid(F.concat(day, F.lit("-"), tail)).alias("ok"))


SHAPE = (("title", 8, 90), ("subtitle", 1, 300), ("body", 100, 80_000))


@query(SHAPED + " SELECT slug, CASE " + " ".join(rf"WHEN NOT (length(trim({c})) >= {a} AND length({c}) <= {b} AND NOT regexp_matches({c}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]')) THEN '{c}'" for c, a, b in SHAPE[:2]) + r""" WHEN category > 5 THEN 'category' WHEN len(list_filter(points, lambda p: NOT (length(trim(p)) >= 1 AND length(p) <= 180))) > 0 THEN 'points'
WHEN NOT (length(trim(body)) >= 100 AND length(body) <= 80000 AND NOT regexp_matches(body, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]')) THEN 'body' END AS error FROM s""")
def draft_shape_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first part of each article that isn't shaped as a draft's must be, null for none."""
    within = {c: content.bounded(F.col(c), a, b) for c, a, b in SHAPE}
    points = (F.size("points") == 3) & F.forall("points", lambda p: content.bounded(p, 1, 180))
    checks = [(within["title"], "title"), (within["subtitle"], "subtitle"), (F.col("category") <= 5, "category"), (points, "points"), (within["body"], "body")]
    return _shaped(spark, sf_dir).select("slug", content.first_error(*checks).alias("error"))


CHANNELS = ("email", "linkedin", "x")


@query(
    r"""WITH q AS (SELECT event_id, '{"channel":"' || CASE event_id % 4 WHEN 0 THEN 'email' WHEN 1 THEN 'linkedin' WHEN 2 THEN 'x' ELSE 'fax' END || '","target":"' || repeat('t', CAST(event_id % 3 AS INT)) || '"' || CASE WHEN event_id % 5 = 0 THEN ',"version":0' WHEN event_id % 5 = 1 THEN ',"version":7' ELSE '' END || '}' AS raw FROM events)
SELECT event_id, raw->>'channel' AS channel, coalesce(CASE WHEN CAST(raw->>'version' AS BIGINT) > 0 THEN CAST(raw->>'version' AS BIGINT) END, 1) AS version FROM q WHERE raw->>'channel' IN ('email', 'linkedin', 'x') AND length(raw->>'target') > 0"""
)
def queue_hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored items as rows: unknown channels and empty targets drop out, a missing version is one."""
    channel = F.element_at(F.array(*[F.lit(c) for c in (*CHANNELS, "fax")]), (F.col("event_id") % 4 + 1).cast("int"))
    version = F.when(F.col("event_id") % 5 == 0, ',"version":0').when(F.col("event_id") % 5 == 1, ',"version":7').otherwise("")
    raw = F.concat(F.lit('{"channel":"'), channel, F.lit('","target":"'), F.repeat(F.lit("t"), (F.col("event_id") % 3).cast("int")), F.lit('"'), version, F.lit("}"))
    item = F.from_json(raw, "channel string, target string, version long")
    rows = load(spark, sf_dir, "events").select("event_id", item.alias("i")).where(F.col("i.channel").isin(*CHANNELS) & content.bounded(F.col("i.target"), 1, 1000))
    return rows.select("event_id", "i.channel", F.coalesce(F.when(F.col("i.version") > 0, F.col("i.version")), F.lit(1)).alias("version"))


@query("SELECT CAST(substr(source, 4) AS INT) % 5 AS tier, count(DISTINCT source) AS sources, count(*) AS entries, count(*) FILTER (WHERE n_chars < 60) AS failed FROM documents GROUP BY 1")
def fetch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources, entries and failures by tier; a source is counted once a tier, after counts by source."""
    tier = (F.substring("source", 4, 9).cast("int") % 5).alias("tier")
    rows = load(spark, sf_dir, "documents").groupBy(tier, "source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_chars") < 60).alias("f"))
    return rows.groupBy("tier").agg(F.count(F.lit(1)).alias("sources"), F.sum("n").alias("entries"), F.sum("f").alias("failed"))


@query(SHAPED + """ SELECT slug, sha256('{"body":' || to_json(body) || ',"category":' || category || ',"points":' || to_json(points) || ',"title":' || to_json(title) || '}') AS hash FROM s""")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of an article's JSON with its keys in order."""
    return _shaped(spark, sf_dir).select("slug", F.sha2(F.to_json(F.struct("body", "category", "points", "title")), 256).alias("hash"))


HASH = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(d, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c + 2147483648) % 4294967296 - 2147483648 + CASE WHEN (h * 31 + c + 2147483648) < 0 AND (h * 31 + c + 2147483648) % 4294967296 <> 0 THEN 4294967296 ELSE 0 END)"


@query(f"WITH x AS (SELECT DISTINCT strftime(l_shipdate, '%Y-%m-%d') AS d FROM lineitem) SELECT d AS day, CAST(abs({HASH}) % 7 AS INT) AS pick FROM x")
def daily_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of seven clips a day shows: the string hash of the day, so that a day always shows the same."""
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    return load(spark, sf_dir, "lineitem").select(day.alias("day")).distinct().select("day", (content.string_hash(F.col("day")) % 7).cast("int").alias("pick"))


@query(r"SELECT page_id, array_to_string([regexp_replace(m, '<[^>]+>', '', 'g') for m in regexp_extract_all(t, '(?is)<cite[^>]*>.*?</cite>')], '  ') AS cited, trim(regexp_replace(regexp_replace(t, '(?i)</?cite[^>]*>', '', 'g'), '(?i)&nbsp;', ' ', 'g')) AS clean FROM (SELECT page_id, replace(replace(html, '<b>', '<cite index=''1''>'), '</b>', '</cite>') AS t FROM pages)")
def cite_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is cited in a text, and the text without its tags; bold type stands for citations."""
    t = F.replace(F.replace(F.col("html"), F.lit("<b>"), F.lit("<cite index='1'>")), F.lit("</b>"), F.lit("</cite>"))
    return load(spark, sf_dir, "pages").select("page_id", content.cited_text(t).alias("cited"), content.without_cites(t).alias("clean"))


@query()
def draft_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts recovered from answers; no SQL, ``tests/test_content.py`` has the cases."""
    short_batches(spark)
    answer = F.concat(F.lit('Note {"tool":1} then ```'), F.to_json(F.struct(F.col("title"), F.col("body"), F.col("points").alias("tldr"))), F.lit("``` done"))
    return _shaped(spark, sf_dir).select("slug", F.md5(content.draft_json(answer)).alias("digest"))


FOLLOWS = r"(?i)\b(?:thon|ouen|was of)\b"


@query(SHAPED + rf""" SELECT slug, coalesce(list_filter(string_split_regex(replace(body, chr(10), chr(10) || chr(10)), '\n\n+'), lambda p: p <> '' AND regexp_matches(p, '{FOLLOWS}'))[1], points[3], points[1]) AS excerpt,
left(trim(regexp_replace(array_to_string(list_slice(list_filter(string_split_regex(trim(replace(body, chr(10), chr(10) || chr(10)), ' ' || chr(10) || chr(9)), '\n[ \t]*\n'), lambda p: trim(p, ' ' || chr(10) || chr(9)) <> ''), 1, 3), ' '), '[ \t\n]+', ' ', 'g')), 600) AS voice FROM s""")
def article_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows from each article, and what is read out of it; a line stands for a paragraph."""
    body = F.replace("body", F.lit("\n"), F.lit("\n\n"))
    return _shaped(spark, sf_dir).select("slug", L.consequence_excerpt(body, F.col("points"), FOLLOWS).alias("excerpt"), L.voice_excerpt(body).alias("voice"))


@query(r"""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/avif' ELSE 'image/jpeg' END AS mime, CASE p_partkey % 5 WHEN 4 THEN 'video' ELSE 'image' END AS kind FROM part""")
def media_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.element_at(F.array(*map(F.lit, (".PNG?x=1", ".jpeg", ".avif#a", "", ".Mp4"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    url = F.concat(F.lit("https://a.example/"), F.col("p_partkey").cast("string"), ends)
    return load(spark, sf_dir, "part").select("p_partkey", L.image_mime(url).alias("mime"), L.media_kind(url).alias("kind"))


ABROAD, HOME = ("Thon", "Der", "La"), ("The", "Und")
HEAD = r"' ' || trim(regexp_replace(replace(lower(title || ' ' || subtitle), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) || ' '"


@query(SHAPED + rf""", x AS (SELECT slug, market, {HEAD} AS t, trim(regexp_replace(replace(lower(title), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS h FROM s), y AS (SELECT *, CASE {' '.join(f"WHEN contains(t, ' {m.lower()} ') THEN '{m}'" for m in ABROAD)} END AS n, {' OR '.join(f"contains(t, ' {m.lower()} ')" for m in HOME)} AS local FROM x)
SELECT slug, CASE WHEN n IS NOT NULL AND (NOT local OR starts_with(h, lower(n))) THEN n ELSE market END AS markets FROM y""")
def display_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.display_markets(F.col("title"), F.col("subtitle"), F.array("market"), ABROAD, HOME)
    return _shaped(spark, sf_dir).select("slug", F.array_join(found, ",").alias("markets"))


QUEUE = {"email": "Hello {target}, on {title}: {point1}", "linkedin": "{title}\n\n{point1}\n\n{point2}", "forum": "Re {title} — {subtitle}"}


@query(SHAPED + " " + " UNION ALL ".join(f"SELECT slug, '{c}' AS channel, {_sql_fill(t.replace('{target}', 'desk'), 'NULL')} AS draft FROM s WHERE status IS DISTINCT FROM 'research'" for c, t in QUEUE.items()))
def queue_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draft for the queue of each live article and channel, from templates that a desk passes."""
    live = _shaped(spark, sf_dir).where(~F.col("status").eqNullSafe("research"))
    fields = {"target": F.lit("desk"), "title": F.col("title"), "subtitle": F.col("subtitle"), "point1": F.get("points", 0), "point2": F.get("points", 1)}
    each = F.array(*[F.struct(F.lit(c).alias("channel"), content.filled(t, fields).alias("draft")) for c, t in QUEUE.items()])
    return live.select("slug", F.explode(each).alias("d")).select("slug", "d.channel", "d.draft")


@query()
def media_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A picture for each part, none twice; no SQL, ``tests/test_media.py`` compares with the scan."""
    part = load(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")
    own = part.select(F.col("p_partkey").alias("article"), F.col("p_partkey").alias("place"), F.when(F.col("p_size") < 20, F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string"))).alias("src"))
    names = F.array(*[F.concat("p_brand", F.lit("-"), F.pmod(F.xxhash64("p_partkey", F.lit(i)), F.lit(60)).cast("string")) for i in range(4)])
    some = part.select(F.col("p_partkey").alias("article"), F.posexplode(names).alias("rank", "src"))
    return media.assign(own, some)


QUERIES, ORACLE_SQL = query.queries, query.sql
