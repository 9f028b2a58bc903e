"""Fixed tables and predicates: networks, rates, bands, days."""

import datetime
import ipaddress
import random

from pyspark.sql import functions as F

from inkstream.plans import market, registry


def test_networks(spark):
    draw = random.Random(1)
    nets = [ipaddress.ip_network(n) for n in registry.BLOCKED_V4]
    ips = [int(x) + d for n in nets for x in (n.network_address, n.broadcast_address) for d in (-1, 0, 1)] + [draw.randrange(1 << 32) for _ in range(300)]
    ips = [i % (1 << 32) for i in ips]
    rows = spark.createDataFrame([(i,) for i in ips], "ip long").select("ip", registry.ipv4_blocked(F.col("ip")).alias("b")).collect()
    assert all(r.b == any(ipaddress.ip_address(r.ip) in n for n in nets) for r in rows)


def test_networks_of_version_6(spark):
    draw = random.Random(2)
    nets = [ipaddress.ip_network(n) for n in registry.BLOCKED_V6]
    ips = [min(max(int(x) + d, 0), (1 << 128) - 1) for n in nets for x in (n.network_address, n.broadcast_address) for d in (-1, 0, 1)] + [draw.randrange(1 << 128) for _ in range(100)]
    texts = [str(ipaddress.IPv6Address(i)) for i in ips] + ["2001:DB8::1", "1:2:3:4:5:6:7:8"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", registry.ipv6_blocked(F.col("t")).alias("b")).collect()
    assert all(r.b == any(ipaddress.ip_address(r.t) in n for n in nets) for r in rows)
    odd = spark.createDataFrame([("",), (None,), ("nonsense",), ("1:2:3",)], "t string").select(registry.ipv6_blocked(F.col("t")).alias("b"))
    assert all(r.b for r in odd.collect())


def test_bands(spark):
    scores = [0.41, 0.4, 0.11, 0.1, -0.09, -0.1, -0.39, -0.4, -1.0]
    rows = spark.createDataFrame([(s,) for s in scores], "s double").select(market.score_color(F.col("s")).alias("b")).collect()
    assert [r.b for r in rows] == ["bullish", "soft-bullish", "soft-bullish", "neutral", "neutral", "soft-bearish", "soft-bearish", "bearish", "bearish"]


def test_rates(spark):
    live = spark.createDataFrame([("USD", 0.3), ("AED", 2.0), ("GBP", 0.0), ("XXX", 1.0), ("JPY", None)], "currency string, rate double")
    rates = {r.currency: r.rate for r in market.fx_rates(spark, live).collect()}
    assert rates == market.FALLBACK_RATES | {"USD": 0.3, "GBP": 0.0}
    row = spark.range(1).select(market.converted(F.lit(5.0), F.lit(0.0)).alias("a"), market.converted(F.lit(5.0), F.lit(None)).alias("b"), market.converted(F.lit(5.0), F.lit(2.0)).alias("c")).first()
    assert tuple(row) == (5.0, 5.0, 10.0)


def test_days(spark):
    texts = ["04-11-2001", "2001-11-04T10:00", "31-02-2001x", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(market.norm_date(F.col("t")).alias("d")).collect()
    assert [r.d for r in rows] == ["2001-11-04", "2001-11-04", "2001-02-31", ""]
    now = datetime.date(2001, 11, 25)
    days = [now - datetime.timedelta(n) for n in (-2, -1, 0, 21, 22)]
    rows = spark.createDataFrame([(d,) for d in days], "d date").select(market.fresh_day(F.col("d"), now).alias("ok")).collect()
    assert [r.ok for r in rows] == [False, True, True, True, False]
