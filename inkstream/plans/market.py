"""Market pulse, currency, sentiment and dimension queries."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkstream.functions.canonical import in_locale
from inkstream.functions.text import aed_compact, round_half_up
from inkstream.operators import pictures
from inkstream.plans.registrar import Registrar
from inkstream.sources import views
from inkstream.sources.store import written
from inkstream.sources.views import load

query = Registrar()

SQM_TO_SQFT = 10.7639  # fixed value
LEAST_ROWS = 3

#: The present of the transaction tables, which end in November 2001.
PULSE_NOW = datetime.date(2001, 11, 15)
STALE_DAYS, AHEAD_DAYS = 21, 1  # fixed values: days within which a latest day is shown

LATEST = views.sql("transactions") + f""", latest AS (SELECT max(day) AS day FROM transactions),
today AS (SELECT t.* FROM transactions t, latest l WHERE t.day = l.day AND worth > 0 AND l.day BETWEEN DATE '{PULSE_NOW}' - {STALE_DAYS} AND DATE '{PULSE_NOW}' + {AHEAD_DAYS})"""


def norm_date(text: Column) -> Column:
    """A day as YYYY-MM-DD: of DD-MM-YYYY the parts, of anything else the first ten characters; not checked further."""
    pattern = r"^([0-9]{2})-([0-9]{2})-([0-9]{4})"
    return F.when(text.rlike(pattern), F.concat_ws("-", *[F.regexp_extract(text, pattern, i) for i in (3, 2, 1)])).otherwise(F.substring(F.coalesce(text, F.lit("")), 1, 10))


def fresh_day(day: Column, now: datetime.date) -> Column:
    """A latest day counts only if it is neither stale nor ahead of the present."""
    age = F.datediff(F.lit(now), day)
    return (age >= -AHEAD_DAYS) & (age <= STALE_DAYS)


def latest_day(spark: SparkSession, sf_dir: str, now: datetime.date = PULSE_NOW) -> DataFrame:
    """Priced transactions of the latest day, which is taken over all rows. The one-row maximum is broadcast."""
    rows = views.transactions(spark, sf_dir)
    last = load(spark, sf_dir, "lineitem").agg(F.max(F.to_date("l_shipdate")).alias("last")).where(fresh_day(F.col("last"), now))
    return rows.join(F.broadcast(last), F.col("day") == F.col("last")).where("worth > 0").drop("last")


@query(LATEST + " SELECT CAST(max(day) AS VARCHAR) AS day, count(*) AS deals, round(sum(worth), 2) AS value, CAST(floor(avg(worth) + 0.5) AS BIGINT) AS average FROM today HAVING count(*) >= 3")
def pulse_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deals, value and mean of the latest day; nothing where fewer than three are priced or the day isn't fresh."""
    day = latest_day(spark, sf_dir)
    out = day.agg(F.max("day").cast("string").alias("day"), F.count(F.lit(1)).alias("deals"), F.round(F.sum("worth"), 2).alias("value"), round_half_up(F.avg("worth")).alias("average"))
    return out.where(F.col("deals") >= LEAST_ROWS)


@query(LATEST + ", p AS (SELECT per_sqm / 10.7639::DOUBLE AS x, row_number() OVER (ORDER BY per_sqm) AS rn, count(*) OVER () AS n FROM today WHERE per_sqm > 0) SELECT CAST(floor(x + 0.5) AS BIGINT) AS median_psf FROM p WHERE rn = n // 2 + 1")
def pulse_median_psf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper median: of n prices the one at place n / 2, counted from nought.

    Prices are counted in exponential bins first; only the bin that holds the place is sorted, by distinct price.
    """
    prices = written(latest_day(spark, sf_dir).where("per_sqm > 0").groupBy("per_sqm").agg(F.count(F.lit(1)).alias("n")))
    bins = prices.groupBy(F.floor(F.log2("per_sqm") * 64).alias("bin")).agg(F.sum("n").alias("n"))
    running = W.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)  # a few thousand bins at any size
    placed = bins.withColumn("upto", F.sum("n").over(running)).withColumn("all", F.sum("n").over(W.partitionBy()))
    hit = placed.where(F.col("upto") > F.floor(F.col("all") / 2)).orderBy("bin").limit(1)
    hit = hit.select("bin", (F.floor(F.col("all") / 2) - F.col("upto") + F.col("n")).alias("skip"))
    inside = prices.join(F.broadcast(hit), F.floor(F.log2("per_sqm") * 64) == F.col("bin"))
    ordered = inside.withColumn("upto", F.sum("n").over(W.orderBy("per_sqm").rowsBetween(W.unboundedPreceding, 0)))
    return ordered.where(F.col("upto") > F.col("skip")).agg(round_half_up(F.min("per_sqm") / SQM_TO_SQFT).alias("median_psf")).where("median_psf IS NOT NULL")


def _top(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    sums = latest_day(spark, sf_dir).where(F.col(key) != "").groupBy(F.col(key).alias("name")).agg(F.round(F.sum("worth"), 2).alias("value"), F.count(F.lit(1)).alias("deals"), F.min(F.struct("l_orderkey", "l_linenumber")).alias("first"))
    return sums.orderBy(F.desc("value"), "first").limit(1).select("name", "value", "deals")


def _top_sql(key: str) -> str:
    return LATEST + f" SELECT {key} AS name, round(sum(worth), 2) AS value, count(*) AS deals FROM today WHERE {key} <> '' GROUP BY {key} ORDER BY value DESC, min(struct_pack(a := l_orderkey, b := l_linenumber)) LIMIT 1"


@query(_top_sql("area"))
def pulse_top_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, "area")


@query(_top_sql("project"))
def pulse_top_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, "project")


@query(views.sql("transactions") + " SELECT area, count(*) AS deals, count(DISTINCT project) AS projects, round(sum(worth), 2) AS value, CAST(max(day) AS VARCHAR) AS last_day FROM transactions GROUP BY area")
def area_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.transactions(spark, sf_dir).groupBy("area", "project").agg(F.count(F.lit(1)).alias("n"), F.sum("worth").alias("w"), F.max("day").alias("d"))
    return rows.groupBy("area").agg(F.sum("n").alias("deals"), F.count("project").alias("projects"), F.round(F.sum("w"), 2).alias("value"), F.max("d").cast("string").alias("last_day"))


#: Currency units for one dirham; the live table overrides them and the dirham stays one.
FALLBACK_RATES = {"AED": 1.0, "USD": 0.2722, "EUR": 0.2492, "GBP": 0.2130, "INR": 22.95, "SGD": 0.3680, "HKD": 2.1130, "CHF": 0.2410, "JPY": 41.20}


def fx_rates(spark: SparkSession, live: DataFrame) -> DataFrame:
    """``live`` (currency, rate) over the fallback; a missing rate is the fallback's, and the dirham's is one."""
    base = spark.createDataFrame(list(FALLBACK_RATES.items()), "currency string, fallback double")
    found = live.where("rate IS NOT NULL").groupBy("currency").agg(F.max("rate").alias("rate"))
    return base.join(found, "currency", "left").select("currency", F.when(F.col("currency") == "AED", 1.0).otherwise(F.coalesce("rate", "fallback")).alias("rate"))


def converted(amount: Column, rate: Column) -> Column:
    """``amount`` times ``rate``; unchanged where that is missing or not above nought."""
    return F.when(rate > 0, amount * rate).otherwise(amount)


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for p in (("AFRICA", "USD"), ("AMERICA", "GBP"), ("ASIA", "AED"), ("EUROPE", "XXX")) for x in p])
    return load(spark, sf_dir, "region").select(names[F.col("r_name")].alias("currency"), (F.col("r_regionkey") * 0.11).alias("rate"))


RATES = f"""WITH live AS (SELECT CASE r_name WHEN 'AFRICA' THEN 'USD' WHEN 'AMERICA' THEN 'GBP' WHEN 'ASIA' THEN 'AED' WHEN 'EUROPE' THEN 'XXX' END AS currency, r_regionkey * 0.11::DOUBLE AS rate FROM region),
base(currency, fallback) AS (VALUES {', '.join(f"('{c}', {r}::DOUBLE)" for c, r in FALLBACK_RATES.items())}),
rates AS (SELECT b.currency, CASE WHEN b.currency = 'AED' THEN 1.0::DOUBLE ELSE coalesce(l.rate, fallback) END AS rate
FROM base b LEFT JOIN (SELECT currency, max(rate) AS rate FROM live WHERE rate IS NOT NULL GROUP BY currency) l ON b.currency = l.currency)"""


@query(RATES + " SELECT * FROM rates")
def fx_rates_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx_rates(spark, _live(spark, sf_dir))


@query(RATES + " SELECT c_custkey, currency, CASE WHEN rate > 0 THEN c_acctbal * rate ELSE c_acctbal END AS amount FROM customer, rates")
def fx_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances in every currency. The rate table, of nine rows, becomes one array that each balance is exploded by."""
    rates = fx_rates(spark, _live(spark, sf_dir)).agg(F.collect_list(F.struct("currency", "rate")).alias("rates"))
    rows = load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").join(F.broadcast(rates)).select("c_custkey", "c_acctbal", F.explode("rates").alias("r"))
    return rows.select("c_custkey", "r.currency", converted(F.col("c_acctbal"), F.col("r.rate")).alias("amount"))


@query("SELECT o_orderkey, CASE WHEN v >= 1e9 THEN printf('AED %.2fB', floor(v / 1e7 + 0.5) / 100) WHEN v >= 1e6 THEN printf('AED %.1fM', floor(v / 1e5 + 0.5) / 10) WHEN v >= 1e3 THEN printf('AED %.0fK', floor(v / 1e3 + 0.5)) ELSE printf('AED %.0f', floor(v + 0.5)) END AS label FROM (SELECT o_orderkey, floor(o_totalprice) * (CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 100000 ELSE 0.001 END)::DOUBLE + 0.013 AS v FROM orders)")
def aed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    scale = F.element_at(F.array(F.lit(1.0), F.lit(1000.0), F.lit(100000.0), F.lit(0.001)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = load(spark, sf_dir, "orders").select("o_orderkey", (F.floor("o_totalprice") * scale + 0.013).alias("v"))
    return rows.select("o_orderkey", aed_compact(F.col("v")).alias("label"))


@query("WITH s AS (SELECT event_type AS channel, sum(value * (event_id % 7)) AS weighted, sum(event_id % 7) AS volume FROM events GROUP BY 1) SELECT channel, CASE WHEN volume > 0 THEN round(weighted / volume, 6) ELSE 0 END AS score, CAST(volume AS BIGINT) AS volume FROM s")
def channel_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of scores weighted by volume; nought without volume."""
    rows = load(spark, sf_dir, "events").select(F.col("event_type").alias("channel"), "value", (F.col("event_id") % 7).alias("volume"))
    sums = rows.groupBy("channel").agg(F.sum(F.col("value") * F.col("volume")).alias("weighted"), F.sum("volume").alias("volume"))
    return sums.select("channel", F.when(F.col("volume") > 0, F.round(F.col("weighted") / F.col("volume"), 6)).otherwise(0.0).alias("score"), "volume")


#: Cut points and names of five bands of a score from -1 to 1; a score must be above a cut point.
BANDS = ((0.4, "bullish"), (0.1, "soft-bullish"), (-0.1, "neutral"), (-0.4, "soft-bearish"))
LOWEST = "bearish"


def score_color(score: Column) -> Column:
    return F.coalesce(*[F.when(score > cut, name) for cut, name in BANDS], F.lit(LOWEST))


BAND = "CASE " + " ".join(f"WHEN s > {cut}::DOUBLE THEN '{name}'" for cut, name in BANDS) + f" ELSE '{LOWEST}' END"


@query(f"SELECT band, count(*) AS n FROM (SELECT {BAND} AS band FROM (SELECT (value - 25)::DOUBLE / 50.0::DOUBLE AS s FROM events)) GROUP BY band")
def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(score_color((F.col("value") - 25) / 50.0).alias("band")).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


#: Map bounds in degrees and the margins, in per cent, within which a mark stays.
LAT, LNG = (24.25, 25.82), (54.15, 55.95)


@query("SELECT s_suppkey, least(97.0, greatest(3.0, (lng - 54.15::DOUBLE) / (55.95::DOUBLE - 54.15::DOUBLE) * 100)) AS x, least(94.0, greatest(6.0, (25.82::DOUBLE - lat) / (25.82::DOUBLE - 24.25::DOUBLE) * 100)) AS y FROM (SELECT s_suppkey, 24.0::DOUBLE + s_suppkey % 200 * 0.01::DOUBLE AS lat, 54.0::DOUBLE + s_suppkey % 220 * 0.01::DOUBLE AS lng FROM supplier)")
def geo_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lng = F.lit(24.0) + F.col("s_suppkey") % 200 * 0.01, F.lit(54.0) + F.col("s_suppkey") % 220 * 0.01
    x = (lng - F.lit(LNG[0])) / (F.lit(LNG[1]) - F.lit(LNG[0])) * 100
    y = (F.lit(LAT[1]) - lat) / (F.lit(LAT[1]) - F.lit(LAT[0])) * 100
    clamp = lambda v, a, b: F.least(F.lit(b), F.greatest(F.lit(a), v))
    return load(spark, sf_dir, "supplier").select("s_suppkey", clamp(x, 3.0, 97.0).alias("x"), clamp(y, 6.0, 94.0).alias("y"))


@query("SELECT n_name FROM nation n WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name <> 'ASIA')")
def fk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key is missing from a dimension (here one without a row that it should have)."""
    known = load(spark, sf_dir, "region").where("r_name <> 'ASIA'").select(F.col("r_regionkey").alias("k"))
    return load(spark, sf_dir, "nation").join(known, F.col("n_regionkey") == F.col("k"), "left_anti").select("n_name")


@query("SELECT n_name, count(c_custkey) AS reports FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY n_name HAVING count(c_custkey) > 0")
def public_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimension rows with at least one matching fact."""
    facts = load(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("reports"))
    return load(spark, sf_dir, "nation").join(facts, F.col("n_nationkey") == F.col("k")).select("n_name", "reports")


@query("SELECT n_name, coalesce(s.n, 0) AS developers, s.n IS NOT NULL AS is_public FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s ON CASE WHEN n_nationkey = 24 THEN 0 ELSE n_nationkey END = s.s_nationkey")
def canonical_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical rows with their public twin, looked up under a remapped key."""
    public = load(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    key = F.when(F.col("n_nationkey") == 24, 0).otherwise(F.col("n_nationkey"))
    return load(spark, sf_dir, "nation").join(public, key == F.col("s_nationkey"), "left").select("n_name", F.coalesce("n", F.lit(0)).alias("developers"), F.col("n").isNotNull().alias("is_public"))


@query("WITH a AS (SELECT DISTINCT p_brand FROM part WHERE p_size < 10), b AS (SELECT DISTINCT p_brand FROM part WHERE p_size > 40) SELECT (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS only_first, (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS only_second")
def set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values only one of two sets has; both nought means that they are equal."""
    part = load(spark, sf_dir, "part")
    a, b = (part.where(c).groupBy("p_brand").agg(F.lit(True).alias(n)) for c, n in (("p_size < 10", "a"), ("p_size > 40", "b")))
    return a.join(b, "p_brand", "full").agg(F.count_if(F.col("b").isNull()).alias("only_first"), F.count_if(F.col("a").isNull()).alias("only_second"))


@query("SELECT p_partkey, o.source, o.url FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY tier, url) AS rn, min(tier) OVER (PARTITION BY p_partkey) AS low FROM (SELECT l_partkey AS p_partkey, l_linenumber AS tier, 'provider-' || l_linenumber AS source, 'img-' || l_orderkey AS url FROM lineitem WHERE l_quantity > 25)) o WHERE tier = low AND rn = 1")
def first_nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of the first provider that has any, for each request."""
    rows = load(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.col("l_partkey").alias("p_partkey"), "l_linenumber", "l_orderkey")
    best = rows.groupBy("p_partkey").agg(F.min(F.struct(F.col("l_linenumber"), F.concat(F.lit("img-"), "l_orderkey").alias("url"))).alias("b"))
    return best.select("p_partkey", F.concat(F.lit("provider-"), "b.l_linenumber").alias("source"), F.col("b.url").alias("url"))


#: An image for each part: its query is the brand, its size and texts follow from the part.
IMAGES = """img AS (SELECT p_partkey, p_brand, lower(p_name || ' ' || p_type) AS alt, 600 + p_size * 60 AS width, 400 + CAST(p_partkey % 40 AS INT) * 40 AS height,
CASE p_partkey % 4 WHEN 0 THEN 'wikimedia' WHEN 1 THEN 'openverse' WHEN 2 THEN 'imagen' ELSE 'unsplash' END AS source, 'https://img.example/' || CASE p_partkey % 3 WHEN 0 THEN 'editor_1024/' WHEN 1 THEN 'x?w=1600' ELSE '' END AS url FROM part)"""
JUNK, OFF = ("brass", "map"), ("copper", "nickel")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    source = F.when(key % 4 == 0, "wikimedia").when(key % 4 == 1, "openverse").when(key % 4 == 2, "imagen").otherwise("unsplash")
    url = F.concat(F.lit("https://img.example/"), F.when(key % 3 == 0, "editor_1024/").when(key % 3 == 1, "x?w=1600").otherwise(""))
    return load(spark, sf_dir, "part").select(
        "p_partkey", "p_brand", F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("alt"), (F.col("p_size") * 60 + 600).alias("width"), ((key % 40).cast("int") * 40 + 400).alias("height"), source.alias("source"), url.alias("url")
    )


RANK = f"""(CASE source WHEN 'wikimedia' THEN 300 WHEN 'openverse' THEN 250 WHEN 'imagen' THEN -1000 ELSE 400 END + CASE WHEN width::DOUBLE / greatest(height, 1) BETWEEN 1.4 AND 2.1 THEN 200 ELSE 0 END + least(served, 3000)::DOUBLE / 12
+ (contains(alt, 'steel')::INT + contains(alt, 'small')::INT) * 180 - CASE WHEN {' OR '.join(f"contains(alt, '{t}')" for t in JUNK)} THEN 800 ELSE 0 END - CASE WHEN {' OR '.join(f"contains(alt, '{t}')" for t in OFF)} THEN 1200 ELSE 0 END - CASE WHEN served > 0 AND served < 1400 THEN 350 ELSE 0 END)"""


@query(
    f"WITH {IMAGES}, s AS (SELECT *, least(width, CASE WHEN contains(url, 'editor_1024') THEN 1024 WHEN contains(url, 'w=1600') THEN 1600 ELSE width END) AS served FROM img), r AS (SELECT p_brand, p_partkey, {RANK} AS rank FROM s) SELECT p_brand, arg_min(p_partkey, struct_pack(a := -rank, b := p_partkey)) AS p_partkey, max(rank) AS rank FROM r GROUP BY p_brand"
)
def best_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image of the highest rank for each query; earlier ones win ties. A maximum, so no group is sorted."""
    rows = images(spark, sf_dir).select("p_brand", "p_partkey", pictures.rank(("steel", "small"), JUNK, OFF).alias("rank"))
    best = rows.groupBy("p_brand").agg(F.max(F.struct("rank", (-F.col("p_partkey")).alias("minus"))).alias("m"))
    return best.select("p_brand", (-F.col("m.minus")).alias("p_partkey"), F.col("m.rank").alias("rank"))


HOLDS = """CASE WHEN p_partkey % 2 = 0 AND p_partkey % 5 > 0 THEN NULL ELSE 'path' END, CASE WHEN p_size > 3 THEN NULL ELSE 'alt' END, CASE WHEN p_partkey % 7 IN (0, 1, 2) THEN 'credit' END, CASE WHEN p_partkey % 3 = 0 THEN 'approval' END,
CASE WHEN p_partkey % 4 = 0 THEN 'rights' END, CASE WHEN p_partkey % 6 IN (0, 1, 2) THEN 'source' END, CASE WHEN NOT (p_size * 100 >= 3840 AND p_size * 60 >= 2160) THEN 'size' END"""


@query(f"SELECT p_partkey, array_to_string(list_filter([{HOLDS}], lambda x: x IS NOT NULL), ',') AS reasons FROM part")
def image_hold_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a cover may not be shown: seven checks, of path, alt text, credit, approval, rights, source and size."""
    key, size = F.col("p_partkey"), F.col("p_size")
    slug = key.cast("string")
    at = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (key % by + 1).cast("int"))
    src = F.concat(F.when(key % 2 == 0, F.lit("/news/")).otherwise("/other/"), slug, F.lit("/cover."), F.when(key % 5 == 0, "gif").otherwise("JPEG"))
    rows = load(spark, sf_dir, "part").select(
        "p_partkey", slug.alias("slug"), F.lit("A Title").alias("title"), src.alias("src"), F.when(size == 1, " ").when(size == 2, "a  title!").when(size == 3, None).otherwise("A quay").alias("alt"),
        at((None, "Pending", "editorial archive", "A. Person", "B", "C", "D"), 7).alias("credit"), F.when(key % 3 != 0, "approved-editorial").alias("approval"), F.when(key % 4 == 0, " ").otherwise("owned").alias("rights"),
        at((None, "http://a.example", "https://u:p@a.example/", "https://a.example/x", "https://a.example", "https://b.example/"), 6).alias("source_url"), (size * 100).alias("width"), (size * 60).alias("height"),
    )
    return rows.select("p_partkey", F.array_join(pictures.hold_reasons(), ",").alias("reasons"))


@query("SELECT c_nationkey AS region, c_custkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_acctbal > 0 THEN 2 ELSE 0 END + CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END DESC, c_name COLLATE \"de\", c_custkey) AS place FROM customer")
def areas_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of each region by computed priority, then by name in a reader's order."""
    priority = F.when(F.col("c_acctbal") > 0, 2).otherwise(0) + F.when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(0)
    order = W.partitionBy("c_nationkey").orderBy(priority.desc(), in_locale(F.col("c_name")), "c_custkey")
    return load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("region"), "c_custkey", "c_name", F.row_number().over(order).alias("place"))


QUERIES, ORACLE_SQL = query.queries, query.sql
