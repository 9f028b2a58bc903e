"""Names in texts, rules of verticals and choices of unlike articles."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from inkstream.functions.text import plain_text
from inkstream.operators import similarity
from inkstream.sources.store import short_batches, written


@F.pandas_udf(StringType())
def decomposed(text: pd.Series) -> pd.Series:
    """Compatibility decomposition, which Spark has no function for."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x))


def padded(text: Column) -> Column:
    """A plain text between blanks, so that phrases can be looked up whole; a combining mark splits its word."""
    return F.concat(F.lit(" "), plain_text(decomposed(text)), F.lit(" "))


def mentions(rows: DataFrame, text: str, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """``rows`` without ``text``, once for each name of which it holds a phrase.

    The dictionary is short and fixed, so names are flags of one scan and not a join.
    """
    short_batches(rows.sparkSession)
    held = padded(F.col(text))
    flags = []
    for name, phrases in aliases.items():
        found = F.lit(False)
        for p in phrases:
            found = found | F.contains(F.col("__held"), F.concat(F.lit(" "), plain_text(F.lit(p)), F.lit(" ")))
        flags.append(F.when(found, F.lit(name)))
    named = F.filter(F.array(*flags), lambda x: x.isNotNull())
    return rows.withColumn("__held", held).withColumn("name", F.explode(named)).drop("__held", text)


@dataclass(frozen=True)
class Vertical:
    name: str
    categories: tuple[int, ...] = ()
    excluded: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    curated: tuple[str, ...] = ()


def verticals(articles: DataFrame, rules: list[Vertical]) -> DataFrame:
    """``articles`` (slug, status, category, title, ...), once for each vertical whose rule they meet.

    In order: research never, curated slugs always, a category always, an excluded word never, else a keyword of the
    title. The rules are few and fixed, so they are flags of one scan.
    """
    title = F.lower("title")
    has = lambda terms: sum((F.contains(title, F.lit(t)).cast("int") for t in terms), F.lit(0)) > 0
    flags = []
    for r in rules:
        meets = F.when(F.col("status").eqNullSafe("research"), False).when(F.col("slug").isin(*r.curated), True).when(F.col("category").isin(*r.categories), True)
        flags.append(F.when(meets.when(has(r.excluded), False).otherwise(has(r.keywords)), F.lit(r.name)))
    return articles.withColumn("vertical", F.explode(F.filter(F.array(*flags), lambda x: x.isNotNull())))


#: Shared words, and the similarity or containment, of near-duplicate headlines.
SHARED, LIKE, CONTAINED = 4, 0.44, 0.72


def near_headlines() -> similarity.Likeness:
    """Enough shared words, and a similarity or a containment of the smaller set that suffices."""
    fewest = lambda n: F.greatest(F.lit(SHARED), F.ceil(n * min(CONTAINED, 2 * LIKE / (1 + LIKE)) - 1e-9))
    like = lambda common, one, two: (common >= SHARED) & ((common / (one + two - common) >= LIKE) | (common / one >= CONTAINED))
    return similarity.Likeness(fewest, lambda n: F.lit(SHARED), like)


def near_pairs(classes: DataFrame, few: int = similarity.DEALT) -> DataFrame:
    """(a, b) of word sets (cls, tokens) that share four words or more and are similar or contained enough.

    Keys that more than ``few`` sets have are dealt into blocks.
    """
    sets = similarity.ranked(classes.select("cls", "tokens").where(F.size("tokens") >= SHARED))
    found = similarity.like_pairs(sets, sets, near_headlines(), dealt=few)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def distinct_articles(titles: DataFrame) -> DataFrame:
    """``titles`` (ord, published_ms, tokens, ...) that a scan from the newest keeps: none is near an earlier kept one.

    Titles without words are like no other; a null time comes last. Cut the result to the first n in the same order
    for what a scan that stops after n would give. Of equal sets with words enough the first alone can be kept.
    """
    rank = F.struct(F.coalesce(-F.col("published_ms"), F.lit((1 << 63) - 1)).alias("newest"), F.col("ord").alias("o"))
    rows = written(titles.withColumn("rank", rank))
    many = F.coalesce(F.size("tokens") >= SHARED, F.lit(False))
    classes = written(similarity.token_classes(rows.where(many), "rank"))
    found = similarity.leaders(classes, near_headlines()).where(F.col("cls") == F.col("leader"))
    first = rows.where(many).join(found.select(F.col("cls").alias("k")), F.col("ord") == F.col("k"), "left_semi")
    return first.union(rows.where(~many)).drop("rank")
