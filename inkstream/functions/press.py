"""Press mail: subjects, decks, tags, links and relevance as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks before a subject that say nothing.
PREFIXES = ("RE:", "FW:", "FWD:", "PRESS RELEASE:", "FOR IMMEDIATE RELEASE:", "PR-", "MEDIA RELEASE:")
PREFIX = "(?i)^(?:" + "|".join(map(re.escape, PREFIXES)) + r")+\s*"
#: Names and terms that a mail is tagged by, in any case; those in ``EXACT`` count in capitals only.
TAGS = (
    "modon", "emaar", "aldar", "nakheel", "damac", "dubai holding", "ifa hotels", "marjan", "sobha", "meraas", "select group", "ellington", "shamal", "arada",
    "hudayriyat", "saadiyat", "palm jebel ali", "palm jumeirah", "wynn", "al marjan", "abu dhabi island", "yas island", "downtown dubai", "dubai marina", "business bay", "jbr",
    "off-plan", "offplan", "villa", "branded residence", "mansion", "penthouse", "hotel", "resort", "casino", "DLD", "RERA", "dxbinteract", "property finder", "bayut", "golden visa", "corporate tax", "vat", "visa",
)
EXACT = ("DLD", "RERA")
#: Weight of a sender's tier, of a tag, and most tags that count.
SENDER_WEIGHT = {"government": 0.35, "developer-tier-1": 0.30, "advisor-tier-1": 0.25, "advisor-tier-2": 0.15, "trade-pub": 0.15, "industry-event": 0.10, "agency": 0.10}
TAG_WEIGHT, MOST_TAGS = 0.05, 6
DECK = 280  # fixed value: most characters of a deck


def clean_subject(subject: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(subject, F.lit("")), PREFIX, ""), r"\s+", " "))


def deck(body: Column, most: int = DECK) -> Column:
    """Whole sentences from the beginning for as long as they fit; the first that doesn't ends it."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(body, F.lit("")), "\r\n", "\n"), "\n+", " ")
    pieces = F.split(text, r"(?<=[.!?])\s+")
    start = F.struct(F.lit("").alias("out"), F.lit(True).alias("open"))

    def add(acc: Column, piece: Column) -> Column:
        longer = F.concat(acc["out"], F.lit(" "), piece)
        fits = acc["open"] & (F.length(longer) <= most)
        return F.struct(F.when(fits, F.trim(longer)).otherwise(acc["out"]).alias("out"), fits.alias("open"))

    return F.aggregate(pieces, start, add, lambda acc: acc["out"])


def whole(term: str) -> str:
    """The pattern of a term between boundaries of ASCII words, which are looked at only where the term itself stands."""
    plain, word = re.escape(term), "[A-Za-z0-9_]"
    before = "<!" if re.match(word, term[0]) else "<="
    after = "!" if re.match(word, term[-1]) else "="
    return f"{plain}(?{before}{word}{plain})(?{after}{word})"


def tags(text: Column, terms: tuple[str, ...] = TAGS, exact: tuple[str, ...] = EXACT) -> Column:
    """The terms that stand in ``text`` as words, in lower case and in the order of the list, each once."""
    found = []
    for t in terms:
        pattern = ("" if t in exact else "(?i)") + whole(t)
        found.append(F.when(F.coalesce(text, F.lit("")).rlike(pattern), F.lit(t.lower())))
    return F.array_distinct(F.filter(F.array(*found), lambda x: x.isNotNull()))


def links(text: Column, most: int = 50) -> Column:
    """The first distinct web addresses of a text, without a full stop or bracket at their end."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(https?://[^\s<>\"')\]]+)"), F.lit(1))
    return F.slice(F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;]+$", ""))), 1, most)


def relevance(tier: Column, n_tags: Column, body: Column, n_links: Column, n_files: Column) -> Column:
    """0 to 1: the sender's tier, up to six tags, a body of sensible length, one to ten links, and any attachment."""
    weight = F.coalesce(*[F.when(tier == k, v) for k, v in SENDER_WEIGHT.items()], F.lit(0.0))
    n = F.length(F.coalesce(body, F.lit("")))
    size = F.when((n > 200) & (n < 6000), 0.1).when(n < 100, -0.1).otherwise(0.0)
    score = weight + F.least(n_tags, F.lit(MOST_TAGS)) * TAG_WEIGHT + size + F.when(n_links.between(1, 10), 0.05).otherwise(0.0) + F.when(n_files > 0, 0.05).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def press_slug(day: Column, subject: Column) -> Column:
    """Day, ``press`` and up to 70 characters of the subject: words, blanks as hyphens."""
    body = F.regexp_replace(F.lower(clean_subject(subject)), r"[^a-z0-9_\s-]", "")
    return F.concat(day, F.lit("-press-"), F.substring(F.regexp_replace(body, r"\s+", "-"), 1, 70))
