"""Evidence of a draft: what was fetched, which figures it backs and how many publishers a draft needs."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.functions.figures import collapsed, figures, has_stat_signal, norm_numeric
from inkstream.functions.text import ascii_words

LEAST_TEXT = 80  # fixed value: characters of a fetched text that counts


def words_pattern(terms: tuple[str, ...]) -> str:
    """Any of ``terms`` as whole words, in any case; a blank stands for white space."""
    return r"(?i)\b(?:" + "|".join(re.escape(t).replace(r"\ ", r"\s+").replace(r"\-", "[- ]") for t in terms) + r")\b"


@dataclass(frozen=True)
class Lanes:
    """Words and kinds that decide how much evidence a draft needs."""

    #: Words of investment conclusions and forecasts.
    analysis: tuple[str, ...] = (
        "recommend", "recommends", "recommended", "recommendation", "should buy", "should sell", "should avoid", "buy call", "sell call", "undervalued", "overvalued",
        "outperform", "underperform", "guaranteed", "risk-free", "forecast", "forecasts", "forecasted", "projected return", "will rise by", "will fall by", "will increase by", "will decline by",
    )
    #: Words that attribute a statement.
    attribution: tuple[str, ...] = ("according to", "said", "says", "announced", "reported", "confirmed", "stated", "published", "disclosed")
    research_categories: tuple[str, ...] = ("market-pulse", "macro")
    developer_categories: tuple[str, ...] = ("launch", "developer-corporate")


def lane(text: Column, category: Column, tiers: Column, first_party: Column, trade: Column, lanes: Lanes = Lanes()) -> Column:
    """The evidence lane: ``tiers`` of the fetched sources, whether one is the developer's own, whether a trade is named."""
    attributed = text.rlike(ascii_words(words_pattern(lanes.attribution)))
    has = lambda tier: F.coalesce(F.array_contains(tiers, tier), F.lit(False))
    return (
        F.when(text.rlike(ascii_words(words_pattern(lanes.analysis))) | F.coalesce(trade, F.lit(False)), "corroborated-analysis")
        .when(has("government"), "official-update")
        .when(has("national-press"), "fast-news")
        .when(has("institutional-research") & category.isin(*lanes.research_categories) & attributed, "research-release")
        .when(F.coalesce(first_party, F.lit(False)) & category.isin(*lanes.developer_categories) & attributed, "developer-announcement")
        .otherwise("corroborated-analysis")
    )


def publishers_needed(name: Column) -> Column:
    return F.when(name == "corroborated-analysis", 2).otherwise(1)


def fetched(evidence: DataFrame, citations: DataFrame) -> DataFrame:
    """Rows of ``evidence`` (draft, url, text) that the draft cites (draft, url) and that hold enough text."""
    enough = evidence.where(F.length(collapsed(F.col("text"))) >= LEAST_TEXT)
    cited = citations.select(F.col("draft").alias("d"), F.col("url").alias("u")).distinct()
    return enough.join(cited, (F.col("draft") == F.col("d")) & (F.col("url") == F.col("u")), "left_semi")


def unsupported(drafts: DataFrame, evidence: DataFrame) -> DataFrame:
    """(draft, figure): figures of each draft's ``body`` that its evidence (draft, place, text) lacks.

    A draft cites a dozen sources at most, whose texts are joined in order of place. Drafts without figures are left
    out before the join; a draft without evidence keeps all of its figures.
    """
    wanted = drafts.select("draft", figures(F.col("body")).alias("figures")).where(F.size("figures") > 0)
    texts = evidence.join(wanted.select(F.col("draft").alias("w")), F.col("draft") == F.col("w"), "left_semi")
    texts = texts.groupBy(F.col("draft").alias("d")).agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("t"))
    source = norm_numeric(F.array_join(F.col("t.text"), " "))
    rows = wanted.join(texts.select("d", source.alias("source")), F.col("draft") == F.col("d"), "left").select("draft", "source", F.explode("figures").alias("figure"))
    return rows.where(~F.contains(F.coalesce("source", F.lit("")), norm_numeric(F.col("figure")))).select("draft", "figure")


def assess(drafts: DataFrame, citations: DataFrame, evidence: DataFrame, lanes: Lanes = Lanes()) -> DataFrame:
    """(draft, lane, needed, publishers, whitelisted, cited, figures, amber, approved) of each draft.

    ``drafts``: draft, title, subtitle, body, category, trade, gates_ok. ``citations``: draft, url, whitelisted.
    ``evidence``: draft, url, place, text, publisher, tier, first_party. A draft passes if its gates do, all of its
    citations are whitelisted, as many publishers as its lane needs are cited and fetched, every figure is backed, and
    no text shows statistics of which none was read.
    """
    held = fetched(evidence, citations)
    by_draft = held.groupBy(F.col("draft").alias("e")).agg(F.collect_set("tier").alias("tiers"), F.max("first_party").alias("first_party"), F.count_distinct("publisher").alias("publishers"))
    cited = citations.groupBy(F.col("draft").alias("c")).agg(F.count(F.lit(1)).alias("cited"), F.count_if("whitelisted").alias("whitelisted"))
    amber = unsupported(drafts.select("draft", "body"), held.select("draft", "place", "text")).groupBy(F.col("draft").alias("a")).agg(F.count(F.lit(1)).alias("amber"))
    rows = drafts.join(by_draft, F.col("draft") == F.col("e"), "left").join(cited, F.col("draft") == F.col("c"), "left").join(amber, F.col("draft") == F.col("a"), "left")
    text = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("subtitle", F.lit("")), F.coalesce("body", F.lit("")))
    rows = rows.withColumn("lane", lane(text, F.col("category"), F.col("tiers"), F.col("first_party"), F.col("trade"), lanes))
    rows = rows.withColumns({"needed": publishers_needed(F.col("lane")), **{c: F.coalesce(c, F.lit(0)) for c in ("publishers", "cited", "whitelisted", "amber")}, "figures": F.size(figures(F.col("body")))})
    blind = (F.col("figures") == 0) & has_stat_signal(F.col("body"))
    ok = F.col("gates_ok") & (F.col("cited") > 0) & (F.col("cited") == F.col("whitelisted")) & (F.col("whitelisted") >= F.col("needed")) & (F.col("publishers") >= F.col("needed")) & (F.col("amber") == 0) & ~blind
    return rows.select("draft", "lane", "needed", "publishers", "whitelisted", "cited", "figures", "amber", ok.alias("approved"))
