"""What is made of an article: channel texts, links, packets of sources, and checks of addresses and slugs."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from inkstream.functions.text import ascii_words, truncate_words


@dataclass(frozen=True)
class Format:
    """A channel's text: ``head`` and ``core`` and ``tail``, of which the core is cut to ``most`` characters.

    Names in braces are filled in. ``reserved`` characters are kept free, and the link's length where ``with_link``.
    """

    core: str
    tail: str = ""
    head: str = ""
    most: int | None = None
    reserved: int = 0
    with_link: bool = False


#: The text of each channel.
FORMATS = {
    "linkedin-personal": Format("{title}\n\n{hook}\n\n{point1}\n\n{point2}", "\n\nRead the full read → {link}", most=1300, reserved=4, with_link=True),
    "x": Format("{lead}{point1}", "\n{link}", most=280, reserved=25),
    "facebook": Format("{subtitle}", "\n\n{link}", head="{title}\n\n", most=200),
    "instagram-feed": Format("{subtitle}", "\n\n{point1}\n\n{point2}\n\nFull read at the link in bio — {site}", head="{title}\n\n", most=800),
    "instagram-stories": Format("{title}\n\n{point1}"),
    "threads": Format("{title}\n\n{point1}", "\n{link}", most=500, reserved=2, with_link=True),
    "tiktok": Format("{title}\n\n{point1}\n\nFull read → {link}"),
    "pinterest": Format("{subtitle}\n\nRead more at {site}"),
    "bluesky": Format("{title}\n\n{point1}", "\n{link}", most=300, reserved=2, with_link=True),
    "mastodon": Format("{title}\n\n{point1}", "\n{link}", most=500, reserved=2, with_link=True),
    "youtube-shorts": Format("{title}\n\n{point1}\n\nFull written read → {link}"),
    "telegram": Format('<b>{safe_title}</b>\n\n{safe_points}\n\n<a href="{link}">Read the full read →</a>'),
    "discord": Format("**{title}**\n\n{point1}\n\n{link}"),
}
#: Currencies and sizes of the first figure of a body.
LEAD = r"(?:AED|aed|USD|usd|\$|€)\s*[0-9]+(?:[.,][0-9]+)?\s*(?:M|B|K|million|billion|thousand)\b"


def tracked(url: Column, source: Column, medium: Column, campaign: Column) -> Column:
    """``url`` with the three tracking parameters, encoded as forms are."""
    parts = [F.concat(F.lit(f"utm_{n}="), F.url_encode(v)) for n, v in (("source", source), ("medium", medium), ("campaign", campaign))]
    return F.concat(url, F.lit("?"), F.concat_ws("&", *parts))


def filled(template: str, fields: dict[str, Column]) -> Column:
    parts, at = [], 0
    while (a := template.find("{", at)) >= 0:
        b = template.index("}", a)
        parts += [F.lit(template[at:a]), fields[template[a + 1 : b]]]
        at = b + 1
    return F.concat(*parts, F.lit(template[at:]))


def lead_figure(body: Column) -> Column:
    found = F.regexp_extract(F.coalesce(body, F.lit("")), ascii_words(LEAD), 0)
    return F.when(found != "", found)


def channel_texts(articles: DataFrame, site: str, formats: dict[str, Format] = FORMATS) -> DataFrame:
    """(slug, channel, text) of ``articles`` (slug, title, subtitle, points, body) for each channel.

    The channels are a fixed list, so rows are exploded, not joined. Missing parts count as empty.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    points = [text(F.get("points", i)) for i in (0, 1)]
    second = F.get(F.split("body", "\n\n"), 1)
    hook = F.array_join(F.slice(F.split(second, r"\. "), 1, 2), ". ")
    safe = lambda c: F.replace(F.replace(F.replace(text(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lead = lead_figure(F.col("body"))
    fields = {
        "title": text(F.col("title")), "subtitle": text(F.col("subtitle")), "point1": points[0], "point2": points[1], "hook": F.coalesce(F.when(hook != "", hook), text(F.col("subtitle"))),
        "lead": F.when(lead.isNotNull(), F.concat(lead, F.lit(" — "))).otherwise(""), "site": F.lit(site), "safe_title": safe(F.col("title")), "safe_points": safe(F.array_join("points", "\n\n")),
    }
    made = []
    for channel, f in formats.items():
        link = tracked(F.concat(F.lit(f"https://{site}/news/"), "slug"), F.lit(channel), F.lit("social"), F.col("slug"))
        own = fields | {"link": link}
        core = filled(f.core, own)
        if f.most:
            core = truncate_words(core, f.most, F.lit(f.reserved) + (F.length(link) if f.with_link else 0))
        made.append(F.struct(F.lit(channel).alias("channel"), F.concat(filled(f.head, own), core, filled(f.tail, own)).alias("text")))
    return articles.select("slug", F.explode(F.array(*made)).alias("v")).select("slug", "v.channel", "v.text")


def brief_score(terms: list[str], title: Column, other: Column) -> Column:
    """Three for each term in the title, one for each that only stands elsewhere; terms are substrings."""
    low, rest = F.lower(title), F.lower(other)
    return sum((F.when(F.contains(low, F.lit(t)), 3).when(F.contains(rest, F.lit(t)), 1).otherwise(0) for t in terms), F.lit(0))


def brief_sources(ranked: DataFrame, most: int = 8) -> DataFrame:
    """(source_id, article, url) of the first ``most`` distinct URLs of ``ranked`` (rank, place, article, url).

    ``ranked`` has the few articles that were chosen, so its rows are few.
    """
    safe = ranked.where(F.col("url").rlike("^https?://"))
    first = safe.groupBy("url").agg(F.min(F.struct("rank", "place", "article")).alias("f")).orderBy("f").limit(most)
    return first.select(F.concat(F.lit("S"), F.row_number().over(W.orderBy("f")).cast("string")).alias("source_id"), F.col("f.article").alias("article"), "url")


def brief_bounded(brief: Column, sources: Column) -> Column:
    """Whether a brief of 400 to 600 words names only its numbered sources, one at least, and no address."""
    text = F.coalesce(brief, F.lit(""))
    refs = F.regexp_extract_all(text, F.lit(ascii_words(r"\bS([0-9]+)\b")), F.lit(1))
    known = F.forall(refs, lambda r: r.try_cast("long").between(1, sources))
    words = F.size(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}][\p{L}\p{N}’'-]*)"), F.lit(1)))
    return (F.size(refs) > 0) & F.coalesce(known, F.lit(False)) & words.between(400, 600) & ~text.rlike(r"(?i)https?://")


#: Fixed value: the form of a slug; its day must be a real one.
SLUG = r"^(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])-[a-z0-9]+(?:-[a-z0-9]+)*$"
LONGEST_SLUG = 80


def slug_valid(slug: Column) -> Column:
    return F.coalesce((F.length(slug) <= LONGEST_SLUG) & slug.rlike(SLUG) & F.try_to_date(F.substring(slug, 1, 10), "yyyy-MM-dd").isNotNull(), F.lit(False))


def bounded(text: Column, least: int, most: int) -> Column:
    """Trimmed text of ``least`` characters or more, untrimmed of ``most`` or fewer, without control characters."""
    return F.coalesce((F.length(F.trim(text)) >= least) & (F.length(text) <= most) & ~text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"), F.lit(False))


def first_error(*checks: tuple[Column, str]) -> Column:
    """The message of the first check that fails, else null."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(message)) for ok, message in checks])


def submission(urls: DataFrame, host: str, most: int = 10_000) -> DataFrame:
    """(request, urls, verdict) of ``urls`` (request, url): none, too many, off the host, or valid."""
    on_host = F.coalesce(F.regexp_extract("url", r"^https?://([^/?#]+)", 1) == host, F.lit(False))
    rows = urls.groupBy("request").agg(F.count("url").alias("urls"), F.count_if(~on_host & F.col("url").isNotNull()).alias("off"))
    return rows.select("request", "urls", F.when(F.col("urls") == 0, "empty").when(F.col("urls") > most, "too many").when(F.col("off") > 0, "off host").otherwise("valid").alias("verdict"))


@F.pandas_udf(StringType())
def draft_json(text: pd.Series) -> pd.Series:
    """The last complete JSON object in a model's answer that is a draft or a refusal, as JSON; else null."""
    decoder = json.JSONDecoder()

    def objects(s: str) -> Iterator[dict]:
        at = s.find("{")
        while at >= 0:
            try:
                yield decoder.raw_decode(s, at)[0]
            except ValueError:
                pass
            at = s.find("{", at + 1)

    def last(s):
        found = None
        for x in objects(s or ""):
            if x.get("skip") is True or (isinstance(x.get("title"), str) and isinstance(x.get("body"), str) and isinstance(x.get("tldr"), list)):
                found = x
        return None if found is None else json.dumps(found, ensure_ascii=False, sort_keys=True)

    return text.map(last)


def cited_text(body: Column) -> Column:
    """What stands between cite tags, two blanks apart."""
    found = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"(?is)(<cite[^>]*>.*?</cite>)"), F.lit(1))
    return F.array_join(F.transform(found, lambda m: F.regexp_replace(m, "<[^>]+>", "")), "  ")


def without_cites(body: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(body, F.lit("")), r"(?i)</?cite[^>]*>", ""), "(?i)&nbsp;", " "))


def string_hash(text: Column) -> Column:
    """The 32-bit polynomial string hash (factor 31) of ASCII text, absolute."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    wrapped = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31))
    return F.abs(wrapped)
