"""Whether a draft article and its provenance, JSON values, have the shape that a review takes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstream.functions import shapes
from inkstream.functions.shapes import Anything, Flag, Https, Iso, Items, Number, OneOf, Optional, Record, Text
from inkstream.operators.content import slug_valid

#: Fields of an article, and what some of them may hold.
ARTICLE = (
    "slug", "title", "subtitle", "publishedAt", "modifiedAt", "displayDate", "author", "tier", "category", "market", "tldr", "body", "faq", "citations",
    "heroImage", "cta", "distribution", "metaDescription", "speakableSelector", "semaform",
)
CATEGORIES = ("market-pulse", "launch", "regulatory", "macro", "developer-corporate", "infrastructure", "policy")
MARKETS = ("Dubai", "Abu Dhabi", "Ras Al Khaimah", "UAE", "GCC")
NETWORKS = ("linkedin", "x", "fb", "ig", "threads", "tiktok", "pinterest", "bluesky", "mastodon", "youtube")
REPOSTS = ("medium", "substack", "beehiiv")
ACTIONS = ("Buy", "Watch", "Avoid", "Trim", "Re-rate", "Position")
SELECTOR = r"^[.#][A-Za-z0-9_:\[\].#>+~*=\"' -]+$"
AHEAD_MS = 5 * 60_000

FAQ = Items(Record({"q": Text(1, 500), "a": Text(1, 2000)}), 0, 8)
CITATIONS = Items(Record({"source": Text(1, 200), "url": Https(), "accessedAt": Iso()}, {"tier": Anything()}), 1, 12)
FLAGS = lambda names: Record({}, dict.fromkeys(names, Flag()))
DISTRIBUTION = Record({}, {"postiz": FLAGS(NETWORKS), "repost": FLAGS(REPOSTS), "telegram": Flag(), "discord": Flag()})
VIEWS = Items(Record({"source": Text(1, 240), "view": Text(1, 4000)}, {"role": Text(1, 240)}), 0, 8)
TRADE = Record({"action": OneOf(ACTIONS), "reasoning": Text(1, 4000)}, {"horizon": Text(1, 240)})
LONG = Text(1, 4000)
SEMAFORM = Record({}, {"theTake": LONG, "viewsFrom": VIEWS, "realityCheck": LONG, "whatHappensNext": LONG, "howIdTradeIt": TRADE})
SOURCES = Items(Record({"name": Text(1, 240), "tier": Text(1, 80), "url": Https(), "summary": Text(1, 9000)}, {"publishedAt": Iso()}, closed=False), 0, 24)


@dataclass(frozen=True)
class House:
    """What a newsroom's drafts have in common: who writes, where they lead, and in which zone their day begins."""

    author: str
    cta: str
    tier: str = "news"
    zone_hours: int = 4
    scores: tuple[str, ...] = ("relevance", "sourceTier", "freshness", "angle")


def urls(article: Column) -> Column:
    """Addresses of an article's citations."""
    return shapes.bind(shapes.entries(article), _urls)


def _urls(found: Column) -> Column:
    cited = shapes.items(F.try_element_at(found, F.lit("citations")))
    return F.transform(cited, lambda c: shapes.text_of(F.try_variant_get(c, "$.url", "variant")))


def article_error(article: Column, house: House, now_ms: int) -> Column:
    """The first part of an article (VARIANT) that isn't as it must be, null for none; ``article`` itself if it is no object.

    Parts that depend on one another are tested where the later stands: publishedAt may not lie ahead of ``now_ms`` by
    more than five minutes, modifiedAt not before it, the slug begins with its day (then ``slug day``), citations
    repeat no address (``citations twice``), and the picture lies below the slug.
    """
    return shapes.bind(shapes.entries(article), lambda found: _article_error(found, house, now_ms))


def _article_error(found: Column, house: House, now_ms: int) -> Column:
    at = lambda name: F.try_element_at(found, F.lit(name))
    text = lambda name: shapes.text_of(at(name))
    published, modified = shapes.millis(text("publishedAt")), shapes.millis(text("modifiedAt"))
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor((published + house.zone_hours * 3_600_000) / 86_400_000).cast("int")), "yyyy-MM-dd")
    cover = F.concat(F.lit("/news/"), text("slug"), F.lit("/cover.jpg"))
    hero = Record({"src": Text(1, 4096), "alt": Text(1, 300), "credit": Text(1, 300)}, rule=lambda m: shapes.text_of(F.try_element_at(m, F.lit("src"))) == cover)
    to = rf"(?i)^{_quoted(house.cta)}(?:[?#]|$)"
    cta = Record({"href": Https(), "label": Text(1, 240)}, rule=lambda m: shapes.text_of(F.try_element_at(m, F.lit("href"))).rlike(to))
    once = shapes.bind(_urls(found), lambda cited: F.size(F.array_distinct(cited)) == F.size(cited))
    return shapes.first_failure([
        ("article", found.isNotNull()), ("fields", F.forall(F.map_keys(found), lambda k: k.isin(*ARTICLE))),
        ("slug", slug_valid(text("slug"))), ("title", Text(8, 90).ok(at("title"))), ("subtitle", Text(1, 300).ok(at("subtitle"))),
        ("publishedAt", published.isNotNull()), ("modifiedAt", modified.isNotNull()), ("publishedAt ahead", published <= now_ms + AHEAD_MS),
        ("modifiedAt before", modified >= published), ("slug day", F.substring(text("slug"), 1, 10) == day),
        ("displayDate", Text(1, 80).ok(at("displayDate"))), ("author", text("author") == house.author), ("tier", text("tier") == house.tier),
        ("category", OneOf(CATEGORIES).ok(at("category"))), ("market", Items(OneOf(MARKETS), 1, 5).ok(at("market"))),
        ("tldr", Items(Text(1, 180), 3, 3).ok(at("tldr"))), ("body", Text(100, 80_000).ok(at("body"))), ("faq", FAQ.ok(at("faq"))),
        ("citations", CITATIONS.ok(at("citations"))), ("citations twice", once),
        ("heroImage", hero.ok(at("heroImage"))), ("cta", cta.ok(at("cta"))), ("distribution", DISTRIBUTION.ok(at("distribution"))),
        ("metaDescription", Optional(Text(1, 320)).ok(at("metaDescription"))),
        ("speakableSelector", Optional(Items(Text(1, 160, SELECTOR), 0, 12)).ok(at("speakableSelector"))), ("semaform", Optional(SEMAFORM).ok(at("semaform"))),
    ])


def provenance_error(provenance: Column, article: Column, house: House) -> Column:
    """The first part of a provenance (VARIANT) that isn't as it must be, null for none.

    Fetched texts must be of addresses that the article cites, and a hash that stands beside a text must be its own.
    """
    return shapes.bind(urls(article), lambda cited: shapes.bind(shapes.entries(provenance), lambda found: _provenance_error(found, cited, house)))


def _provenance_error(found: Column, cited: Column, house: House) -> Column:
    at = lambda name: F.try_element_at(found, F.lit(name))

    def bound(m: Column) -> Column:
        text = shapes.text_of(F.try_element_at(m, F.lit("text")))
        own = shapes.text_of(F.try_element_at(m, F.lit("contentHash"))) == F.sha2(text, 256)
        return F.array_contains(cited, shapes.text_of(F.try_element_at(m, F.lit("url")))) & (~F.map_contains_key(m, "contentHash") | F.coalesce(own, F.lit(False)))

    evidence = Record({"url": Https(), "text": Text(80, 9000), "fetchedAt": Iso()}, {"finalUrl": Https()}, closed=False, rule=bound)
    return shapes.first_failure([
        ("provenance", found.isNotNull()), ("clusterId", Text(1, 256, r"^[A-Za-z0-9:_-]+$").ok(at("clusterId"))), ("topic", Text(1, 500).ok(at("topic"))),
        ("score", Number().ok(at("score"))), ("scoreBreakdown", Record(dict.fromkeys(house.scores, Number()), closed=False).ok(at("scoreBreakdown"))),
        ("sources", SOURCES.ok(at("sources"))), ("citedText", Optional(Text(1, 20_000)).ok(at("citedText"))),
        ("fetchedEvidence", Optional(Items(evidence, 0, 12)).ok(at("fetchedEvidence"))),
    ])


def _quoted(text: str) -> str:
    return "".join(f"\\{c}" if c in ".?+*()[]{}|^$\\" else c for c in text)
