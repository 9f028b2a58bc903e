"""Source registry, web page, link graph and ledger queries."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkstream.functions import events as E
from inkstream.functions import text as T
from inkstream.functions.events import snake_case
from inkstream.operators import interactions
from inkstream.plans.registrar import Registrar
from inkstream.sources.views import load

query = Registrar()

HOST = r"regexp_extract(url, '^https?://([^/:?#]+)', 1)"
#: Approved hosts for the test pages, in order of precedence; a newsroom passes its own.
APPROVED = ("blog.example.com", "example.com", "example.org", "example.net")


def host(url: str) -> Column:
    return F.regexp_extract(url, "^https?://([^/:?#]+)", 1)


def suffixes(name: Column) -> Column:
    """The host and all its parent domains, longest first."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."))


@query(f"WITH s(source, ord) AS (VALUES ('blog.example.com', 0), ('example.com', 1), ('example.org', 2), ('example.net', 3)), p AS (SELECT page_id, {HOST} AS h FROM pages) SELECT page_id, (SELECT arg_min(source, ord) FROM s WHERE h = source OR ends_with(h, '.' || source)) AS source FROM p")
def source_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first registered source whose domain is the page's host or a parent of it: an equi-join on host suffixes."""
    sources = spark.createDataFrame([(s, i) for i, s in enumerate(APPROVED)], "source string, ord int")
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    hit = pages.select("page_id", F.explode(suffixes(host("url"))).alias("suffix")).join(F.broadcast(sources), F.col("suffix") == F.col("source"))
    best = hit.groupBy(F.col("page_id").alias("p")).agg(F.min_by("source", "ord").alias("source"))
    return pages.select("page_id").join(best, F.col("page_id") == F.col("p"), "left").select("page_id", "source")


@query(f"SELECT page_id, regexp_matches(url, '^https://') AND NOT contains(url, '#') AND NOT regexp_matches(url, '^https?://[^/]*@') AND NOT regexp_matches({HOST}, '^(m|blog)\\.') AS approved FROM pages")
def https_url_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    ok = url.rlike("^https://") & ~F.contains(url, F.lit("#")) & ~url.rlike("^https?://[^/]*@") & ~host("url").rlike(r"^(m|blog)\.")
    return load(spark, sf_dir, "pages").select("page_id", ok.alias("approved"))


CANON = r"""WITH q AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages),
r AS (SELECT page_id, regexp_replace(regexp_extract(u, '^([^?]*)', 1), '^https?://www\.', 'https://') AS head,
array_to_string(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|source)(=|$)')), '&') AS kept FROM q),
c AS (SELECT page_id, lower(regexp_replace(CASE WHEN coalesce(kept, '') = '' THEN head ELSE head || '?' || kept END, '/$', '')) AS canon FROM r)"""


@query(CANON + " SELECT page_id, canon FROM c")
def canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", T.canonical_url(F.col("url")).alias("canon"))


@query(
    r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, row_number() OVER (PARTITION BY page_id % 50 ORDER BY page_id) AS k, page_id % 50 AS request FROM pages)
SELECT DISTINCT request, regexp_replace(url, '\?.*$', '') AS url FROM p WHERE k <= 3 AND regexp_matches(origin, '^https://[a-z0-9]+\.example\.com$') AND NOT contains(url, '#') AND NOT contains(origin, '@')"""
)
def owned_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the first three URLs of each request those of an owned origin, without query, each once.

    The limit comes before the filter. URLs with a fragment or a user name are left out.
    """
    rows = load(spark, sf_dir, "pages").select("page_id", "url", (F.col("page_id") % 50).alias("request"))
    first = rows.withColumn("k", F.row_number().over(W.partitionBy("request").orderBy("page_id"))).where("k <= 3")
    owned = F.col("url").rlike(r"^https://[a-z0-9]+\.example\.com(?:[/?]|$)") & ~F.contains("url", F.lit("#"))
    return first.where(owned).select("request", F.regexp_replace("url", r"\?.*$", "").alias("url")).distinct()


@query(CANON + f""", u AS (SELECT DISTINCT canon, regexp_extract(canon, '^https?://([^/:?#]+)', 1) AS host, substr(sha256(canon), 1, 2) AS part FROM c),
d AS (SELECT host, part, count(*) AS n, sha256('[' || string_agg('"' || canon || '"', ',' ORDER BY canon) || ']') AS digest FROM u GROUP BY ALL)
SELECT host, CAST(sum(n) AS BIGINT) AS urls, sha256(string_agg(part || digest, '' ORDER BY part)) AS digest FROM d GROUP BY host""")
def url_set_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each host's distinct URLs: sorted lists of 256 parts, by the URLs' own digests, are digested first.

    So no task holds all URLs of a host. ``set_digest`` is the digest of one request's bounded list.
    """
    rows = load(spark, sf_dir, "pages").select(T.canonical_url(F.col("url")).alias("canon")).distinct().withColumn("host", host("canon"))
    parts = rows.groupBy("host", F.substring(F.sha2("canon", 256), 1, 2).alias("part")).agg(F.count(F.lit(1)).alias("n"), set_digest(F.collect_list("canon")).alias("digest"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("part", "digest"))), lambda x: F.concat(x["part"], x["digest"]))
    return parts.groupBy("host").agg(F.sum("n").alias("urls"), F.sha2(F.array_join(listed, ""), 256).alias("digest"))


def set_digest(urls: Column) -> Column:
    """SHA-256 of the sorted list as JSON; URLs hold no character that JSON escapes."""
    listed = F.array_join(F.transform(F.array_sort(urls), lambda u: F.concat(F.lit('"'), u, F.lit('"'))), ",")
    return F.sha2(F.concat(F.lit("["), listed, F.lit("]")), 256)


HREF = r"""(?is)<a\b[^>]*\bhref=["']([^"']+)["'][^>]*>(.*?)</a>"""
SQL_HREF = HREF.replace("'", "''")
LINKS = f"""l AS (SELECT page_id, unnest(regexp_extract_all(html, '{SQL_HREF}', 1)) AS href FROM pages)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, href) of every anchor, in either kind of quotes."""
    return load(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("href"))


@query(f"WITH {LINKS} SELECT page_id, href, count(*) AS n FROM l GROUP BY 1, 2")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link edges of every page with their multiplicity."""
    return links(spark, sf_dir).groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


PATHS = "^/[a-z]"  # paths of content on the test pages; a newsroom passes its own
LEAST_TITLE, MOST_TITLE = 2, 200
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


CUT = '(<a href="/[a-z]{6,}">)[^<]*(</a>)'


def headline_from_url(url: Column) -> Column:
    """The last part of a path, decoded, as words with a capital each: what stands in for a link without a usable text.

    Other letters stay as they are; an address that can't be decoded gives an empty text.
    """
    slug = F.regexp_extract(url, r"^[^?#]*?([^/?#]+)/*(?:[?#].*)?$", 1)
    plain = F.try_url_decode(F.replace(slug, F.lit("+"), F.lit("%2B")))
    spaced = F.trim(F.regexp_replace(plain, r"[-_\s]+", " "))
    capital = lambda w: F.concat(F.translate(F.substring(w, 1, 1), LOWER, UPPER), w.substr(F.lit(2), F.length(w)))
    return F.coalesce(F.array_join(F.transform(F.split(spaced, r"(?<=[^A-Za-z0-9_])(?=[A-Za-z0-9_])"), capital), ""), F.lit(""))


def candidate_links(pages: DataFrame, paths: str, least: int, most: int, limit: int = 15) -> DataFrame:
    """(page_id, position, url, title) of up to ``limit`` content links of each page (page_id, url, html), in page order.

    A link counts once, if its path matches, its address is on the page's host and not the page's own, and its text, or
    else the headline of its address, has ``least`` to ``most`` characters. A page's links are one array of its row.
    """
    hrefs, inner = (F.regexp_extract_all("html", F.lit(HREF), F.lit(i)) for i in (1, 2))
    origin = F.regexp_extract("url", "^(https?://[^/?#]+)", 1)
    text = lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, "<[^>]+>", " "), r"\s+", " "))
    whole = lambda h: F.when(h.rlike("^https?://"), h).when(h.startswith("/"), F.concat(origin, h))
    found = F.transform(F.arrays_zip(hrefs.alias("h"), inner.alias("t")), lambda x: F.struct(whole(x["h"]).alias("url"), text(x["t"]).alias("text"), x["h"].alias("href")))
    titled = F.transform(found, lambda x: F.struct(x["url"].alias("url"), F.when(F.length(x["text"]).between(least, most), x["text"]).otherwise(headline_from_url(x["url"])).alias("title"), x["href"].alias("href")))
    page = F.regexp_replace("url", "/+$", "")
    good = F.filter(titled, lambda x: x["href"].rlike(paths) & x["url"].startswith(F.concat(origin, F.lit("/"))) & (F.regexp_replace(x["url"], "/+$", "") != page) & F.length(x["title"]).between(least, most))
    # Addresses without repeats keep the order of their first links, so no link is compared with all others.
    addresses = F.slice(F.array_distinct(F.transform("good", lambda x: x["url"])), 1, limit)
    first = F.transform(addresses, lambda u: F.element_at(F.filter("good", lambda x: x["url"] == u), 1))
    return pages.select("page_id", good.alias("good")).select("page_id", F.posexplode(first).alias("position", "l")).select("page_id", "position", "l.url", "l.title")


@query(
    rf"""WITH p0 AS (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN regexp_replace(html, '{CUT}', '\1<img>\2', 'g') ELSE html END AS html FROM pages), a AS (SELECT page_id, rtrim(url, '/') AS page, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, unnest(regexp_extract_all(html, '{SQL_HREF}', 1)) AS href, unnest(regexp_extract_all(html, '{SQL_HREF}', 2)) AS inner_html, generate_subscripts(regexp_extract_all(html, '{SQL_HREF}', 1), 1) AS k FROM p0),
b AS (SELECT *, CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '/') THEN origin || href END AS url, trim(regexp_replace(regexp_replace(inner_html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS t, regexp_extract(href, '/([a-z]{{6,}})$', 1) AS slug FROM a),
b2 AS (SELECT * REPLACE (CASE WHEN length(t) BETWEEN {LEAST_TITLE} AND {MOST_TITLE} THEN t ELSE upper(slug[1]) || slug[2:] END AS t) FROM b), c0 AS (SELECT *, t AS title FROM b2),
c AS (SELECT page_id, url, title, k, row_number() OVER (PARTITION BY page_id, url ORDER BY k) AS again FROM c0 WHERE regexp_matches(href, '{PATHS}') AND starts_with(url, origin || '/') AND rtrim(url, '/') <> page AND length(title) BETWEEN {LEAST_TITLE} AND {MOST_TITLE})
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS INT) AS position, url, title FROM c WHERE again = 1 QUALIFY position < 15"""
)
def page_candidate_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 15 distinct content links of each page in page order, with their texts; on a third of the pages links show pictures."""
    pages = load(spark, sf_dir, "pages").select("page_id", "url", "html")
    html = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("html", CUT, "$1<img>$2")).otherwise(F.col("html"))
    return candidate_links(pages.withColumn("html", html), PATHS, LEAST_TITLE, MOST_TITLE)


@query(
    f"WITH {LINKS}, p AS (SELECT regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path, min(page_id) AS known FROM pages GROUP BY 1), e AS (SELECT DISTINCT href, page_id FROM l) SELECT href, count(*) AS pages, min(page_id) AS first_page FROM e LEFT JOIN p ON href = path WHERE known IS NULL GROUP BY href"
)
def broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Destinations that no page answers, with how many pages link to them: a left join of edges with what is there."""
    there = load(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://[^/]+(/[^?#]*)", 1).alias("path")).distinct()
    edges = links(spark, sf_dir).distinct()
    return edges.join(there, F.col("href") == F.col("path"), "left_anti").groupBy("href").agg(F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first_page"))


@query(f"WITH {LINKS} SELECT DISTINCT href FROM l WHERE regexp_matches(href, '^/') AND href NOT IN (SELECT regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) FROM pages)")
def unverified_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited paths that no page of the table has: an anti-join."""
    known = load(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://[^/]+(/[^?#]*)", 1).alias("path")).distinct()
    return links(spark, sf_dir).where(F.col("href").rlike("^/")).select("href").distinct().join(known, F.col("href") == F.col("path"), "left_anti")


LEAST_PARAGRAPH, LEAST_BODY, MOST_BODY = 40, 200, 9000  # fixed values: characters


def main_text(html: Column) -> Column:
    """The paragraphs of a page of more than 40 characters, two blanks apart, else all its text; 9000 characters at most.

    Scripts, styles and their like go first; tags become blanks, references letters, runs of white space one blank.
    """
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script.*?</script>|<style.*?</style>|<noscript.*?</noscript>", " ")
    plain = lambda t: F.trim(F.regexp_replace(T.decode_entities(F.regexp_replace(t, "<[^>]+>", " ")), r"\s+", " "))
    paragraphs = F.transform(F.regexp_extract_all(bare, F.lit(r"(?is)<p[^>]*>(.*?)</p>"), F.lit(1)), plain)
    body = F.array_join(F.filter(paragraphs, lambda p: F.length(p) > LEAST_PARAGRAPH), "  ")
    return F.substring(F.when(F.length(body) < LEAST_BODY, plain(bare)).otherwise(body), 1, MOST_BODY)


def _sql_plain(t: str) -> str:
    out = f"regexp_replace({t}, '<[^>]+>', ' ', 'g')"
    for coded, letter in T.ENTITIES:
        out = f"replace({out}, '{coded}', '{letter.replace(chr(39), chr(39) * 2)}')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


@query(
    rf"""WITH b AS (SELECT page_id, regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<noscript.*?</noscript>', ' ', 'g') AS bare FROM pages),
p AS (SELECT page_id, bare, array_to_string([x for x in [{_sql_plain('y')} for y in regexp_extract_all(bare, '(?is)<p[^>]*>(.*?)</p>', 1)] if length(x) > 40], '  ') AS body FROM b)
SELECT page_id, left(CASE WHEN length(body) < 200 THEN {_sql_plain('bare')} ELSE body END, 9000) AS body FROM p"""
)
def html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", main_text(F.col("html")).alias("body"))


@query(f"SELECT h AS host, page_id FROM (SELECT page_id, {HOST} AS h, row_number() OVER (PARTITION BY {HOST} ORDER BY page_id) AS rn FROM pages) WHERE rn = 1")
def citations_per_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").groupBy(host("url").alias("host")).agg(F.min("page_id").alias("page_id"))


@query(r"SELECT conv_id, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars, max(turn) AS last_turn, sha256(max(CASE WHEN turn = 0 THEN text END)) AS opening FROM conversations GROUP BY conv_id")
def conversation_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").groupBy("conv_id")
    return rows.agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("chars"), F.max("turn").alias("last_turn"), F.sha2(F.max(F.when(F.col("turn") == 0, F.col("text"))), 256).alias("opening"))


SENDERS = (("mail1.example.com", "tier-1"), ("mail2.example.com", "tier-2"), ("example.com", "noise"))


@query(r"""WITH m AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9._-]+@([A-Za-z0-9.-]+[A-Za-z0-9])', 1))) AS domain FROM documents)
SELECT doc_id, domain, CASE WHEN ends_with(domain, 'mail1.example.com') THEN 'tier-1' WHEN ends_with(domain, 'mail2.example.com') THEN 'tier-2' ELSE 'noise' END AS tier, count(*) AS n FROM m GROUP BY ALL""")
def sender_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail domains in a text by the first dictionary entry that ends them."""
    found = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9._-]+@([A-Za-z0-9.-]+[A-Za-z0-9])"), F.lit(1)))
    rows = load(spark, sf_dir, "documents").select("doc_id", found.alias("domain")).select("doc_id", F.lower("domain").alias("domain"))
    tier = F.when(F.endswith("domain", F.lit(SENDERS[0][0])), SENDERS[0][1]).when(F.endswith("domain", F.lit(SENDERS[1][0])), SENDERS[1][1]).otherwise(SENDERS[2][1])
    return rows.groupBy("doc_id", "domain", tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"))


#: Networks that a fetch must not reach.
BLOCKED_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
)
BLOCKED_V6 = ("::/128", "::1/128", "64:ff9b::/96", "100::/64", "2001::/23", "2001:db8::/32", "fc00::/7", "fe80::/10", "ff00::/8", "2002::/16", "3fff::/20")


def ipv4_blocked(ip: Column) -> Column:
    """Whether an address, as a number, lies in a blocked network: its leading bits are compared."""
    found = F.lit(False)
    for net in map(ipaddress.ip_network, BLOCKED_V4):
        shift = 32 - net.prefixlen
        found = found | (F.shiftright(ip, shift) == int(net.network_address) >> shift)
    return found


def ipv6_hex(address: Column) -> Column:
    """The 32 hexadecimal digits of an address in text, ``::`` filled up; a trailing dotted quad isn't taken."""
    low = F.lower(address)
    sides = F.split(low, "::")
    head, tail = (F.filter(F.split(F.coalesce(F.get(sides, i), F.lit("")), ":"), lambda x: x != "") for i in (0, 1))
    gap = F.when(F.contains(low, F.lit("::")), 8 - F.size(head) - F.size(tail)).otherwise(0)
    groups = F.concat(head, F.array_repeat(F.lit("0"), gap), tail)
    return F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), "")


def ipv6_blocked(address: Column) -> Column:
    """Whether an address in text lies in a blocked network; what isn't an address of eight groups is blocked, too."""
    digits = ipv6_hex(address)
    found = ~F.coalesce(digits.rlike("^[0-9a-f]{32}$"), F.lit(False))
    for net in map(ipaddress.ip_network, BLOCKED_V6):
        whole, rest = divmod(net.prefixlen, 4)
        text = f"{int(net.network_address):032x}"
        same = F.substring(digits, 1, whole) == text[:whole] if whole else F.lit(True)
        if rest:
            shift = 4 - rest
            same = same & (F.shiftright(F.conv(F.substring(digits, whole + 1, 1), 16, 10).cast("int"), shift) == int(text[whole], 16) >> shift)
        found = found | same
    return F.coalesce(found, F.lit(True))


V4_SQL = " OR ".join(f"ip >> {32 - n.prefixlen} = {int(n.network_address) >> (32 - n.prefixlen)}" for n in map(ipaddress.ip_network, BLOCKED_V4))


@query(f"WITH a AS (SELECT c_custkey, (c_custkey * 2654435761) % 4294967296 AS ip FROM customer) SELECT c_custkey, {V4_SQL} AS blocked FROM a")
def ip_blocklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses inside a network that a fetch must not reach."""
    ip = F.pmod(F.col("c_custkey") * 2654435761, F.lit(1 << 32))
    return load(spark, sf_dir, "customer").select("c_custkey", ip.alias("ip")).select("c_custkey", ipv4_blocked(F.col("ip")).alias("blocked"))


OWN_HOST = "news.example.com"
ALLOWED = {"click": ("entity", "destination"), "view": ("entity", "progress"), "purchase": ("entity",), "signup": ("destination",)}


def _if_allowed(name: str, value: Column) -> Column:
    return F.when(F.col("event_type").isin(*[e for e, names in ALLOWED.items() if name in names]), value)


@query(
    r"""WITH e AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), r AS (SELECT *, CASE event_id % 5 WHEN 0 THEN ' ' || upper(event_type) || ' ' || k WHEN 1 THEN 'id 1234567' WHEN 2 THEN 'me@x' ELSE 'a_b:' || k END AS entity,
CASE event_id % 4 WHEN 0 THEN 'https://News.example.com/a/' || k || '?q=1' WHEN 1 THEN 'http://Shop.example:80/b#f' WHEN 2 THEN 'mailto:x@y' ELSE '/p/' || k || '?z' END AS dest FROM e),
t AS (SELECT *, left(lower(trim(entity)), 96) AS low, CASE event_id % 4 WHEN 0 THEN '/a/' || k WHEN 1 THEN 'shop.example/b' WHEN 3 THEN '/p/' || k END AS place FROM r)
SELECT event_id, CASE WHEN event_type IN ('click', 'view', 'purchase') AND NOT regexp_matches(low, '@|(?:mailto|tel):|[?&#=]') AND NOT regexp_matches(low, '\b[0-9]{7,}\b') AND regexp_matches(low, '^[a-z0-9][a-z0-9:_./ -]*$') THEN low END AS entity,
CASE WHEN event_type IN ('click', 'signup') THEN place END AS destination, CASE WHEN event_type = 'view' AND k % 30 * 5 IN (0, 25, 50, 75, 100) THEN k % 30 * 5 END AS progress FROM t"""
)
def event_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each event the properties that its kind allows, as tokens, places and steps that name no one."""
    k = F.get_json_object("props", "$.k").cast("long")
    text, kind = k.cast("string"), F.col("event_id") % 5
    entity = F.when(kind == 0, F.concat(F.lit(" "), F.upper("event_type"), F.lit(" "), text)).when(kind == 1, "id 1234567").when(kind == 2, "me@x").otherwise(F.concat(F.lit("a_b:"), text))
    kind = F.col("event_id") % 4
    dest = F.when(kind == 0, F.concat(F.lit("https://News.example.com/a/"), text, F.lit("?q=1"))).when(kind == 1, "http://Shop.example:80/b#f").when(kind == 2, "mailto:x@y").otherwise(F.concat(F.lit("/p/"), text, F.lit("?z")))
    return load(spark, sf_dir, "events").select(
        "event_id", _if_allowed("entity", E.safe_token(entity)).alias("entity"), _if_allowed("destination", E.safe_location(dest, OWN_HOST)).alias("destination"), _if_allowed("progress", E.safe_step(k % 30 * 5)).alias("progress")
    )


def _token_sql(name: str, j: int) -> str:
    low = f"left(lower(trim(list_extract(tokens, CAST((event_id + {j}) % 5 AS INT) + 1))), 96)"
    return rf"CASE WHEN {_kinds_sql(name)} AND NOT regexp_matches({low}, '@|(?:mailto|tel):|[?&#=]') AND NOT regexp_matches({low}, '\b[0-9]{{7,}}\b') AND regexp_matches({low}, '^[a-z0-9][a-z0-9:_./ -]*$') THEN {low} END AS {snake_case(name)}"


def _kinds_sql(name: str) -> str:
    return "kind IN (" + ", ".join(f"'{k}'" for k, names in interactions.ALLOWED.items() if name in names) + ")"


KINDS = tuple(interactions.ALLOWED)
TOKENS = tuple(p for p in interactions.PROPERTIES if p not in interactions.LOCATIONS and p not in interactions.NUMBERS and p != "contentType")
PLACES = "list_extract(['/a/' || k, 'shop.example/b', NULL, '/p/' || k], CAST((event_id + {j}) % 4 AS INT) + 1)"


@query(
    f"WITH e AS (SELECT event_id, list_extract([{', '.join(repr(k) for k in KINDS)}], CAST(event_id % {len(KINDS)} AS INT) + 1) AS kind, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), t AS (SELECT *, [' NAV Bar ' || k, 'id 1234567', 'me@x', 'a_b:' || k, 'ünique'] AS tokens FROM e) SELECT event_id, kind, "
    + ", ".join(_token_sql(name, j) for j, name in enumerate(TOKENS))
    + f", NULL::VARCHAR AS content_type, CASE WHEN {_kinds_sql('route')} THEN {PLACES.format(j=1)} END AS route, CASE WHEN {_kinds_sql('destination')} THEN {PLACES.format(j=0)} END AS destination, CASE WHEN {_kinds_sql('ctaLevel')} AND k % 5 IN (1, 2, 3) THEN k % 5 END AS cta_level, CASE WHEN {_kinds_sql('progress')} AND k % 30 * 5 IN (0, 25, 50, 75, 100) THEN k % 30 * 5 END AS progress FROM t"
)
def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every kind of event the properties that it may carry, in snake case."""
    k, key = F.get_json_object("props", "$.k").cast("long"), F.col("event_id")
    text = k.cast("string")
    pick = lambda some, j: F.get(F.array(*some), ((key + j) % len(some)).cast("int"))
    tokens = [F.concat(F.lit(" NAV Bar "), text), F.lit("id 1234567"), F.lit("me@x"), F.concat(F.lit("a_b:"), text), F.lit("ünique")]
    places = [F.concat(F.lit("https://News.example.com/a/"), text, F.lit("?q=1")), F.lit("http://Shop.example:80/b#f"), F.lit("mailto:x@y"), F.concat(F.lit("/p/"), text, F.lit("?z"))]
    properties = {name: pick(tokens, j) for j, name in enumerate(TOKENS)} | {"contentType": F.lit("x"), "route": pick(places, 1), "destination": pick(places, 0), "ctaLevel": k % 5, "progress": k % 30 * 5}
    kind = pick([F.lit(x) for x in KINDS], 0)
    rows = load(spark, sf_dir, "events").withColumn("kind", kind)
    return rows.select("event_id", "kind", *interactions.sanitized(F.col("kind"), properties, OWN_HOST))


@query("WITH r(slug, pos) AS (VALUES ('Customer#000000007', 0), ('Customer#000000003', 1), ('nobody', 2), ('Customer#000000005', 3)) SELECT pos, slug, c_custkey FROM r JOIN customer ON c_name = slug")
def ordered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested names with their rows, in the order of the request; unknown ones drop out."""
    wanted = spark.createDataFrame([("Customer#000000007", 0), ("Customer#000000003", 1), ("nobody", 2), ("Customer#000000005", 3)], "slug string, pos int")
    return load(spark, sf_dir, "customer").select("c_custkey", "c_name").join(F.broadcast(wanted), F.col("c_name") == F.col("slug")).select("pos", "slug", "c_custkey")


@query("SELECT slug FROM (VALUES ('Customer#000000007'), ('nobody'), ('Customer#9')) r(slug) WHERE slug NOT IN (SELECT c_name FROM customer)")
def missing_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([("Customer#000000007",), ("nobody",), ("Customer#9",)], "slug string")
    hit = load(spark, sf_dir, "customer").select("c_name").join(F.broadcast(wanted), F.col("c_name") == F.col("slug"), "left_semi")
    return wanted.join(hit, F.col("slug") == F.col("c_name"), "left_anti")


@query("SELECT p_partkey, CASE WHEN lower(p_type) LIKE '%brass%' THEN 'brass' WHEN lower(p_type) LIKE '%steel%' THEN 'steel' WHEN lower(p_brand) LIKE '%1' THEN 'house' ELSE 'any' END AS term FROM part")
def image_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.lower("p_type")
    term = F.when(F.contains(kind, F.lit("brass")), "brass").when(F.contains(kind, F.lit("steel")), "steel").when(F.endswith(F.lower("p_brand"), F.lit("1")), "house").otherwise("any")
    return load(spark, sf_dir, "part").select("p_partkey", term.alias("term"))


QUERIES, ORACLE_SQL = query.queries, query.sql
