"""Ranking of image candidates and checks of covers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstream.functions.text import plain_text

#: Points of a provider, of a wide shape, of a word found, and what is taken off.
PROVIDER = {"wikimedia": 300, "openverse": 250, "imagen": -1000}
OTHER_PROVIDER, WIDE, WORD, WRONG_SUBJECT, WRONG_PLACE, SOFT = 400, 200, 180, 800, 1200, 350
SHARP, MOST_WIDTH = 1400, 3000
#: Where addresses name the width that is served.
SIZES = (r"(?i)editor_([0-9]{3,5})", r"/([0-9]{3,5})px-", r"(?i)[?&](?:w|width)=([0-9]{3,5})")
UHD = (3840, 2160)
APPROVED = "approved-editorial"


def served_width(url: Column, width: Column) -> Column:
    """The width that an address serves: the largest that it names, never above the image's own, else that."""
    named = F.greatest(*[F.coalesce(F.regexp_extract(F.coalesce(url, F.lit("")), p, 1).try_cast("int"), F.lit(0)) for p in SIZES])
    own = F.coalesce(width, F.lit(0))
    return F.when(named == 0, own).when(own > 0, F.least(named, own)).otherwise(named)


def _holds(text: Column, terms: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for t in terms:
        found = found | F.contains(text, F.lit(t))
    return found


def rank(tokens: tuple[str, ...], junk: tuple[str, ...], off_place: tuple[str, ...]) -> Column:
    """Points of a candidate (url, alt, width, height, source) for a query's words; words of two letters don't count."""
    alt, served = F.lower(F.coalesce("alt", F.lit(""))), served_width(F.col("url"), F.col("width"))
    provider = F.coalesce(*[F.when(F.col("source") == k, v) for k, v in PROVIDER.items()], F.lit(OTHER_PROVIDER))
    shape = F.coalesce(F.col("width") / F.greatest(F.col("height"), F.lit(1)), F.lit(0.0))
    words = sum((F.contains(alt, F.lit(t)).cast("int") for t in tokens if len(t) > 2), F.lit(0)) * WORD
    less = F.when(_holds(alt, junk), WRONG_SUBJECT).otherwise(0) + F.when(_holds(alt, off_place), WRONG_PLACE).otherwise(0) + F.when((served > 0) & (served < SHARP), SOFT).otherwise(0)
    return provider + F.when(shape.between(1.4, 2.1), WIDE).otherwise(0) + F.least(served, F.lit(MOST_WIDTH)) / 12 + words - less


def hold_reasons() -> Column:
    """Names of the checks that a cover (slug, title, src, alt, credit, approval, rights, source_url, width, height) fails."""
    text = lambda c: F.coalesce(c, F.lit(""))
    src, alt, credit, url = (text(F.col(c)) for c in ("src", "alt", "credit", "source_url"))
    own = F.startswith(src, F.concat(F.lit("/news/"), "slug", F.lit("/cover."))) & src.rlike(r"(?i)\.(?:avif|jpe?g|png|webp)$") & ~src.rlike("[?#]")
    told = (F.trim(alt) != "") & (plain_text(alt) != plain_text(F.col("title")))
    named = (plain_text(credit) != "") & ~plain_text(credit).rlike("placeholder|editorial archive|pending|withheld|to be set")
    large = F.coalesce((F.col("width") >= UHD[0]) & (F.col("height") >= UHD[1]), F.lit(False))
    checks = {
        "path": own, "alt": told, "credit": named, "approval": F.col("approval").eqNullSafe(APPROVED), "rights": F.trim(text(F.col("rights"))) != "",
        "source": url.rlike(r"^https://[^/?#@]+(?:[/?#]|$)"), "size": large,
    }
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in checks.items()]), lambda x: x.isNotNull())
