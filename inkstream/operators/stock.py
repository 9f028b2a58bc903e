"""Pictures and sources: what to search for, what may be used, and who stands behind an address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: licences that allow commercial use, anywhere in a licence's name and in any case.
LICENCES = ("CC0", "CC BY", "public domain", "PD")
COMMONS = "Wikimedia Commons"


def usable(pictures: DataFrame, least_width: int | None = None, artist: str = COMMONS) -> DataFrame:
    """``pictures`` (licence, width, artist, ...) under a licence that allows their use, of ``least_width`` at least.

    A licence without a name is none; a missing width is too small. The artist is plain text, ``artist`` where none is named.
    """
    allowed = F.coalesce(F.col("licence"), F.lit("")).rlike("(?i)" + "|".join(LICENCES))
    wide = F.lit(True) if least_width is None else F.coalesce(F.col("width") >= least_width, F.lit(False))
    plain = F.trim(F.regexp_replace(F.when(F.col("artist") != "", F.col("artist")).otherwise(artist), "<[^>]*>", ""))
    return pictures.where(allowed & wide).withColumn("artist", plain)


def picture_query(title: Column, category: Column, market: Column, developers: dict[str, str], areas: dict[str, str], categories: dict[str, str], markets: dict[str, str], last: str) -> Column:
    """What to search for an article: the first developer, else area, that its title names, else its category's, else its market's.

    Names are slugs; one counts as named if it stands in the title in any case, hyphens also as blanks. The
    dictionaries are a newsroom's own, in order of precedence.
    """
    low = F.lower(title)
    named = [F.when(F.contains(low, F.lit(slug.replace("-", " "))) | F.contains(low, F.lit(slug)), F.lit(q)) for part in (developers, areas) for slug, q in part.items()]
    of_category = [F.when(category == name, F.lit(q)) for name, q in categories.items()]
    of_market = [F.when(F.contains(F.lower(market), F.lit(name)), F.lit(q)) for name, q in markets.items()]
    return F.coalesce(*named, *of_category, *of_market, F.lit(last))


#: What to search for once a query has found nothing: by region, the first that it names or else the
#: last; then by what else it names; then for every query.
BROADER_REGIONS = (
    (("abu dhabi",), ("Abu Dhabi skyline aerial", "Abu Dhabi corniche", "Abu Dhabi luxury architecture")),
    (("ras al khaimah", "marjan"), ("Ras Al Khaimah coastline", "RAK Al Marjan island aerial", "Ras Al Khaimah beach resort")),
    ((), ("Dubai skyline aerial", "Dubai Marina sunset", "Dubai luxury architecture")),
)
BROADER_KINDS = (
    (("villa", "mansion"), ("Dubai luxury villa", "UAE luxury home architecture")),
    (("tower", "apartment"), ("Dubai luxury tower", "UAE skyscraper architecture")),
    (("beach", "coastline", "waterfront"), ("Dubai beach resort", "UAE coastline aerial")),
)
BROADER_LAST = ("UAE luxury real estate aerial",)


def broader_queries(query: Column, regions=BROADER_REGIONS, kinds=BROADER_KINDS, last: tuple[str, ...] = BROADER_LAST) -> Column:
    """The wider queries to try after ``query``, in order. A null query names nothing."""
    low = F.lower(F.coalesce(query, F.lit("")))
    names = lambda terms: sum((F.contains(low, F.lit(t)).cast("int") for t in terms), F.lit(0)) > 0
    texts = lambda some: F.array(*[F.lit(x) for x in some]).cast("array<string>")
    region = F.lit(None).cast("array<string>")
    for terms, wider in reversed(regions):
        region = F.when(names(terms), texts(wider)).otherwise(region) if terms else texts(wider)
    return F.concat(region, *[F.when(names(terms), texts(wider)).otherwise(texts(())) for terms, wider in kinds], texts(last))


def hashtags(markets: Column, category: Column, of_market: dict[str, tuple[str, ...]], of_category: dict[str, tuple[str, ...]], brand: str) -> Column:
    """Distinct tags of an article: those of its markets in their order, of its category, and the brand's."""
    texts = lambda some: F.array(*[F.lit(x) for x in some]).cast("array<string>")
    pick = lambda value, table: F.coalesce(*[F.when(value == k, texts(v)) for k, v in table.items()], texts(()))
    return F.array_distinct(F.concat(F.flatten(F.transform(markets, lambda m: pick(m, of_market))), pick(category, of_category), texts((brand,))))


def on_hosts(url: Column, hosts: tuple[str, ...]) -> Column:
    """Whether an address lies on one of ``hosts`` or below it; what is no web address doesn't."""
    host = F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)), r"^www\.", "")
    found = F.lit(False)
    for name in hosts:
        found = found | (host == name) | F.endswith(host, F.lit(f".{name}"))
    return found


def union_of_sources(*registries: tuple[str, DataFrame]) -> DataFrame:
    """(registry, ord, name, url, tier) of registries (ord, name, url, tier): one beside the other, none left out or merged."""
    parts = [df.select(F.lit(name).alias("registry"), "ord", "name", "url", "tier") for name, df in registries]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def area_developers(active: DataFrame, recorded: DataFrame, aliases: DataFrame, most_words: int = 3) -> DataFrame:
    """(area, developer), each once: developers whose list of areas (``active``: developer, areas) has the area, and those
    of whom a phrase (``aliases``: developer, alias) stands whole in a name recorded for it (``recorded``: area, name).

    Phrases have ``most_words`` words at most, so all runs of that many words of a name are joined with them by equality.
    """
    listed = active.select(F.explode("areas").alias("area"), "developer")
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    words = F.split(plain(F.col("name")), " ")
    starts = F.sequence(F.lit(1), F.size(words))
    runs = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.lit(most_words)), lambda n: F.array_join(F.slice(words, i, n), " "))))
    named = recorded.select("area", F.explode(F.array_distinct(runs)).alias("phrase"))
    keys = aliases.select("developer", plain(F.col("alias")).alias("alias")).where("alias <> ''")
    return listed.union(named.join(keys, F.col("phrase") == F.col("alias")).select("area", "developer")).distinct()
