"""Scan orders, ties beyond a few thousand rows, nulls and the topic rules on small entries."""

import hashlib

from inkstream.operators import clusters

SCHEMA = "ord long, id string, title string, summary string, tier int, domain string, url string, published_ms long"
RULES = clusters.Rules(
    places=("palm bay", "dubai"), developers=("acme", "north star"), wealth=("villa",), angle=("yield", "escrow", "launch"), excluded=r"\b(celebrity|net worth)\b",
    desk=("property", "real estate"), generic=("dubai",), buckets=(("regulatory", ("rera",)), ("macro", ("interest rate",))),
    categories=(("launch", r"\b(launch|opening)\b"), ("policy", r"\bvisa\b")), markets=(("Dubai", r"\bdubai\b"),),
)


def entry(ord_, title, tier=1, ms=1000, url=None, summary="", domain="a.example"):
    return (ord_, f"id{ord_}", title, summary, tier, domain, url, ms)


def entries(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def kept(spark, *rows):
    return sorted(r.ord for r in clusters.dedupe_entries(entries(spark, *rows)).collect())


def test_ties_go_by_ord_at_any_distance(spark):
    """Rows that agree in tier and time are told apart by ord, however far apart they stand."""
    same = dict(tier=1, ms=5, url="https://x.example/1")
    assert kept(spark, entry(1, "alpha beta gamma", **same), entry(4097, "other words here", **same), entry(8193, "third thing now", **same)) == [1]


def test_better_tier_and_newer_win(spark):
    rows = [entry(1, "one two three four", tier=2), entry(2, "one two three four", tier=0), entry(3, "five six seven eight", ms=1), entry(4, "five six seven eight", ms=2)]
    assert kept(spark, *rows) == [2, 4]


def test_nulls_settle(spark):
    rows = [entry(1, "one two three four", tier=None, ms=None), entry(2, "one two three four"), entry(3, None), entry(4, "", ms=None), entry(5, None, tier=None)]
    assert kept(spark, *rows) == [2, 3, 4, 5]


def test_kept_neighbours_only(spark):
    """A row that goes doesn't make others go: c is like b, which went for a."""
    a, b, c = "w1 w2 w3 w4 w5 w6 aaa", "w1 w2 w3 w4 w5 w6", "w1 w2 w3 w4 w5 w6 ccc"
    rows = [entry(i, t.replace("w", "word"), ms=100 - i) for i, t in enumerate((a, b, c))]
    assert kept(spark, *rows) == [0, 2]


def test_leaders_go_by_scan_order(spark):
    rows = entries(spark, entry(1, "red green blue", tier=4), entry(2, "red green blue black", tier=0), entry(3, "black white", tier=1))
    assert {r.ord: r.leader for r in clusters.headline_clusters(rows).collect()} == {1: 2, 2: 2, 3: 3}


def test_lone_headline(spark):
    title = "Dubai real estate market records new off-plan demand"
    (row,) = clusters.clusters_scored(entries(spark, entry(7, title)), RULES, 1000).collect()
    assert row.topic == "topic:" + hashlib.sha256(f"id7\n{title}".encode()).hexdigest()[:32]
    assert (row.headline, row.score, row.markets) == (title, 15 + round(0.25 * 60 + 0.2 * 100), "Dubai")


def test_topics(spark):
    rows = [
        entry(1, "Acme opens Palm Bay tower", ms=9), entry(2, "Palm Bay prices", ms=8), entry(3, "North Star results", ms=7), entry(4, "New RERA rule on fees", ms=6),
        entry(5, "Interest rate cut ahead", ms=5), entry(6, "Celebrity buys Palm Bay home", ms=4), entry(7, "Nothing of note happens today", ms=3),
    ]
    found = {r.headline: r.topic for r in clusters.cluster_rows(entries(spark, *rows), RULES).collect()}
    assert found["Acme opens Palm Bay tower"] == "acme--palm-bay"
    assert found["Palm Bay prices"] == "place--palm-bay"  # with the celebrity's, of which it is the first
    assert found["North Star results"] == "dev--north-star"
    assert found["New RERA rule on fees"] == "regulatory" and found["Interest rate cut ahead"] == "macro"
    scored = {r.topic for r in clusters.clusters_scored(entries(spark, *rows), RULES, 1000).collect()}
    assert scored == {"acme--palm-bay", "place--palm-bay", "dev--north-star"}


def test_off_topic_headline_takes_its_cluster_along(spark):
    rows = [entry(1, "Celebrity net worth in Palm Bay", ms=9), entry(2, "Palm Bay villa prices", ms=8)]
    assert clusters.clusters_scored(entries(spark, *rows), RULES, 1000).count() == 0


def test_empty_table(spark):
    assert clusters.clusters_scored(entries(spark), RULES, 1000).count() == 0
