"""Entry deduplication, topic clusters and their scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkstream.functions.text import ascii_words, canonical_url, round_half_up, title_tokens
from inkstream.operators import similarity
from inkstream.sources.store import written
from inkstream.sources.views import HOUR_MS

#: Weight of each source tier, from government to industry portal.
TIER_WEIGHT = [1.0, 0.85, 0.80, 0.65, 0.50]
#: Hours since the newest entry and the score below them.
FRESHNESS = [(2, 100), (6, 85), (24, 70), (48, 50), (72, 30)]


#: Share of each partial score in the whole, points of a desk headline, and the angle that suffices alone.
SHARE = {"wealth": 0.30, "source": 0.25, "fresh": 0.20, "angle": 0.25}
DESK_POINTS, LEAST_ANGLE = 15, 24


@dataclass(frozen=True)
class Rules:
    """Dictionaries of one desk; order counts, and terms are matched as substrings of lower-case text."""

    places: tuple[str, ...]
    developers: tuple[str, ...]
    wealth: tuple[str, ...]
    angle: tuple[str, ...]
    excluded: str  # a pattern of headlines that are off topic
    desk: tuple[str, ...] = ()  # terms of a headline that is on topic
    generic: tuple[str, ...] = ()  # places too wide to define a topic
    buckets: tuple[tuple[str, tuple[str, ...]], ...] = ()  # topics of texts without place or developer
    categories: tuple[tuple[str, str], ...] = ()  # category and the pattern of titles that have it
    markets: tuple[tuple[str, str], ...] = ()  # market and the pattern of texts that name it
    no_category: str = "market-pulse"
    no_market: str = "UAE"
    same: float = 0.85
    related: float = 0.45


def by_tier(values: list | tuple, tier: Column) -> Column:
    """The value of a tier from 0 on, null for a null tier."""
    return F.coalesce(*[F.when(tier == i, v) for i, v in enumerate(values)])


def scan_order(tier: str = "tier", published_ms: str = "published_ms", ord_: str = "ord") -> Column:
    """Best tier first, then the newest, then input order; rows without a tier or a time come last."""
    newest = F.coalesce(-F.col(published_ms), F.lit((1 << 63) - 1))
    return F.struct(F.coalesce(F.col(tier).cast("long"), F.lit(1 << 40)).alias("tier"), newest.alias("newest"), F.col(ord_).alias("ord"))


def dedupe_entries(entries: DataFrame, same: float = 0.85) -> DataFrame:
    """Entries that a scan by tier, newest first, then ord keeps.

    An entry goes if a kept one has its canonical URL or a title of Jaccard similarity ``same`` or more. Titles without
    tokens are like no other; a null URL equals none.
    """
    rows = entries.select("ord", scan_order().alias("rank"), canonical_url(F.col("url")).alias("canon"), F.array_sort(title_tokens(F.col("title"))).alias("tokens"))
    keyed = written(rows)
    classes = written(similarity.token_classes(keyed, "rank"))
    pairs = written(similarity.jaccard_pairs(classes, same))
    placed = keyed.join(classes.select("cls", F.col("tokens").alias("t")), F.col("tokens") == F.col("t"), "left")
    kept = similarity.greedy_keep(placed.select("ord", "rank", "cls", "canon"), ["cls", "canon"], pairs)
    return entries.join(kept.select(F.col("ord").alias("k")), F.col("ord") == F.col("k"), "left_semi")


def lower_text() -> Column:
    return F.lower(F.concat_ws(" ", "title", "summary"))


def contains_any(text: Column, terms: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for t in terms:
        found = found | F.contains(text, F.lit(t))
    return found


def _hyphened(name: Column) -> Column:
    return F.regexp_replace(name, r"\s+", "-")


def signature(text: Column, rules: Rules) -> Column:
    """The topic that a text's names define, else null.

    The first specific place counts, with the first developer where there is one; then a developer alone; then the
    first bucket of which the text has a term.
    """
    place = _hyphened(similarity.first_in_dictionary(text, [p for p in rules.places if p not in rules.generic]))
    developer = _hyphened(similarity.first_in_dictionary(text, list(rules.developers)))
    names = [F.concat(developer, F.lit("--"), place), F.concat(F.lit("place--"), place), F.concat(F.lit("dev--"), developer)]
    return F.coalesce(*names, *[F.when(contains_any(text, terms), name) for name, terms in rules.buckets], F.lit(None).cast("string"))


def on_desk(headline: Column, rules: Rules) -> Column:
    """Whether a headline has a term of the desk and isn't off topic."""
    low = F.lower(headline)
    return contains_any(low, rules.desk) & ~low.rlike(ascii_words(rules.excluded))


def headline_clusters(entries: DataFrame, related: float = 0.45) -> DataFrame:
    """(ord, leader): in scan order each entry joins the first leader with a similar title, or leads itself."""
    keyed = written(entries.select("ord", scan_order().alias("rank"), F.array_sort(title_tokens(F.col("title"))).alias("tokens")))
    classes = written(similarity.token_classes(keyed, "rank"))
    found = written(similarity.leaders(classes, similarity.at_least(related)))
    sets = classes.select("cls", F.col("tokens").alias("t")).join(found, "cls")
    return keyed.join(sets, F.col("tokens") == F.col("t"), "left").select("ord", F.coalesce("leader", "ord").alias("leader"))


def hits(terms: tuple[str, ...], text: Column) -> list[Column]:
    """One aggregate for each term: does any entry of the group hold it?"""
    return [F.max(F.contains(text, F.lit(t)).cast("int")) for t in terms]


def freshness(newest_ms: Column, now_ms: int) -> Column:
    age, score = (F.lit(now_ms) - newest_ms) / HOUR_MS, None
    for below, value in FRESHNESS:
        score = F.when(age < below, value) if score is None else score.when(age < below, value)
    return score.otherwise(10)


def topics(entries: DataFrame, rules: Rules) -> DataFrame:
    """Deduplicated ``entries`` with their topic: a signature, or ``topic:`` and a digest of the headline's leader."""
    kept = written(dedupe_entries(entries, rules.same).select("ord", "id", "title", "summary", "tier", "domain", "published_ms").withColumn("sig", signature(lower_text(), rules)))
    alone = kept.where("sig IS NULL")
    lead = headline_clusters(alone, rules.related)
    named = alone.select(F.col("ord").alias("l"), F.concat(F.lit("topic:"), F.substring(F.sha2(F.concat_ws("\n", "id", "title"), 256), 1, 32)).alias("digest"))
    lead = lead.join(named, F.col("leader") == F.col("l")).select(F.col("ord").alias("o"), "digest")
    return kept.join(lead, F.col("ord") == F.col("o"), "left").withColumn("topic", F.coalesce("sig", "digest")).drop("o", "digest")


def cluster_rows(entries: DataFrame, rules: Rules) -> DataFrame:
    """A row for each topic: its headline (of the first entry in scan order), aggregates, names, category and markets.

    Group text is never gathered: each term or pattern is one aggregate that is combined before the shuffle.
    """
    text, title = lower_text(), F.lower("title")
    terms = {"p": rules.places, "d": rules.developers, "u": rules.wealth, "a": rules.angle}
    weight = by_tier(TIER_WEIGHT, F.col("tier"))
    flags = [c.alias(f"{k}{i}") for k, some in terms.items() for i, c in enumerate(hits(some, text))]
    flags += [F.max(title.rlike(ascii_words(p)).cast("int")).alias(f"c{i}") for i, (_, p) in enumerate(rules.categories)]
    flags += [F.max(text.rlike(ascii_words(p)).cast("int")).alias(f"m{i}") for i, (_, p) in enumerate(rules.markets)]
    domain = F.regexp_replace("domain", r"^www\.", "")
    groups = topics(entries, rules).groupBy("topic").agg(
        F.count(F.lit(1)).alias("entries"), F.count_distinct(domain).alias("domains"), F.max(weight).alias("weight"), F.max("published_ms").alias("newest"),
        F.min(F.struct(scan_order().alias("rank"), F.col("title").alias("title"), F.col("sig").isNull().alias("unnamed"))).alias("first"), (F.min("tier") == 0).alias("official"), *flags,
    )
    some = lambda k, names: F.filter(F.array(*[F.when(F.col(f"{k}{i}") == 1, n) for i, n in enumerate(names)]).cast("array<string>"), lambda x: x.isNotNull())
    total = lambda k: sum((F.col(f"{k}{i}") for i in range(len(terms[k]))), F.lit(0))
    category = F.coalesce(*[F.when(F.col(f"c{i}") == 1, n) for i, (n, _) in enumerate(rules.categories)], F.lit(rules.no_category))
    markets = some("m", [n for n, _ in rules.markets])
    return groups.select(
        "topic", "entries", "domains", "weight", "newest", F.col("first.title").alias("headline"), F.col("first.rank").alias("rank"), F.col("first.unnamed").alias("unnamed"),
        F.coalesce("official", F.lit(False)).alias("official"), some("p", rules.places).alias("places"), some("d", rules.developers).alias("developers"),
        F.least(F.lit(100), total("u") * 10).alias("wealth"), F.least(F.lit(100), total("a") * 8).alias("angle"), category.alias("category"),
        F.when(F.size(markets) == 0, F.array(F.lit(rules.no_market))).otherwise(markets).alias("markets"),
    )


def clusters_scored(entries: DataFrame, rules: Rules, now_ms: int, n: int = 30) -> DataFrame:
    """The ``n`` best topic clusters of the deduplicated entries.

    Ties go to the topic formed first: named ones in scan order of their first entries, then headline ones likewise.
    """
    rows = cluster_rows(entries, rules)
    source = F.least(F.lit(100), round_half_up(F.col("weight") * 70 + F.least(F.lit(30), (F.col("domains") - 1) * 15)))
    rows = rows.withColumns({"source": source, "fresh": freshness(F.col("newest"), now_ms), "desk": on_desk(F.col("headline"), rules)})
    mixed = sum((F.col(k) * v for k, v in SHARE.items()), F.lit(0.0))
    rows = rows.withColumn("score", F.least(F.lit(100), round_half_up(mixed) + F.when(F.col("desk"), DESK_POINTS).otherwise(0)))
    named = (F.size("places") > 0) | (F.size("developers") > 0)
    live = rows.where(~F.lower("headline").rlike(ascii_words(rules.excluded)) & (named | F.col("desk") | (F.col("angle") >= LEAST_ANGLE)))
    best = live.orderBy(F.desc("score"), "unnamed", "rank").limit(n)
    whole = [F.col(c).cast("long").alias(c) for c in ("domains", "wealth", "source", "fresh", "angle", "score")]
    lists = [F.array_join(c, ",").alias(c) for c in ("places", "developers", "markets")]
    return best.select("topic", "headline", "entries", *whole, "category", *lists)
