"""Channel texts, briefs, answers, feeds and press mail on small rows."""

import json

import pytest
from pyspark.sql import functions as F

from inkstream.functions import events as E
from inkstream.functions import press as P
from inkstream.functions import text as T
from inkstream.operators import content, entities, pictures
from inkstream.sources import feeds


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_channels(spark):
    rows = spark.createDataFrame(
        [("s", "T & <b>", "Sub title", ["first point", "second", "third"], "Lead at AED 4.25M here.\n\nThe hook. It is. Not this."), ("e", None, None, None, None)],
        "slug string, title string, subtitle string, points array<string>, body string",
    )
    found = {(r.slug, r.channel): r.text for r in content.channel_texts(rows, "site.example").collect()}
    assert len(found) == 26
    assert found["s", "x"] == "AED 4.25M — first point\nhttps://site.example/news/s?utm_source=x&utm_medium=social&utm_campaign=s"
    assert found["s", "linkedin-personal"].startswith("T & <b>\n\nThe hook. It is\n\nfirst point\n\nsecond\n\nRead the full read → https://")
    assert found["s", "telegram"].startswith("<b>T &amp; &lt;b&gt;</b>\n\nfirst point\n\nsecond\n\nthird\n\n<a href=")
    assert found["e", "discord"].startswith("****\n\n\n\nhttps://")


def test_truncation(spark):
    assert one(spark, T.truncate_words(F.lit("a" * 96), 100)) == "a" * 96
    assert one(spark, T.truncate_words(F.lit("aaa " * 30), 100)) == ("aaa " * 24).strip()[:95] + "…"
    assert one(spark, T.truncate_words(F.lit("b" * 200), 100, 6)) == "b" * 90 + "…"


@pytest.mark.parametrize(
    "answer, want",
    [
        ('Here: ```json\n{"title":"a","body":"b","tldr":[]}\n```', {"title": "a", "body": "b", "tldr": []}),
        ('{"tool":"note"} then {"title":"x","body":"{\\"y\\"}","tldr":["z"]}', {"title": "x", "body": '{"y"}', "tldr": ["z"]}),
        ('{"title":"a","body":"b","tldr":[]} {"skip":true}', {"skip": True}),
        ("not json", None), ("{{{", None), (None, None), ('{"title":"a","body":1,"tldr":[]}', None),
    ],
)
def test_answers(spark, answer, want):
    found = spark.createDataFrame([(answer,)], "t string").select(content.draft_json("t").alias("x")).first().x
    assert (found and json.loads(found)) == want


def test_slugs(spark):
    title = "Dubai's property market entered a more selective phase in first half of 2026"
    assert one(spark, T.slugify(F.lit(title))) == "dubai-s-property-market-entered-a-more-selective-phase-in"
    for slug, ok in (("2024-02-29-a-b", True), ("2023-02-29-a", False), ("2024-01-01-", False), ("2024-01-01-" + "a" * 70, False), ("2024-01-01-A", False), (None, False)):
        assert one(spark, content.slug_valid(F.lit(slug).cast("string"))) is ok


def test_briefs(spark):
    words = "word " * 450
    for brief, n, ok in ((words + "S1 S2", 2, True), (words + "S3", 2, False), (words, 2, False), (words + "S1 http://a", 2, False), ("S1", 2, False), (words + "S" + "9" * 30, 2, False), (None, 2, False)):
        assert one(spark, content.brief_bounded(F.lit(brief).cast("string"), F.lit(n))) is ok


def test_distinct_articles(spark):
    rows = [
        (1, 9, ["alpha", "beta", "gamma", "delta"]), (2, 8, ["alpha", "beta", "gamma", "delta", "x1", "x2", "x3", "x4", "x5"]), (3, 7, ["alpha", "beta", "gamma"]), (4, 6, ["alpha", "beta", "gamma"]),
        (5, 5, []), (6, None, ["other"]), (7, 10, ["y1", "y2", "y3", "y4", "y5", "y6"]), (8, 4, ["y1", "y2", "y3", "y4", "z1", "z2"]),
    ]
    frame = spark.createDataFrame(rows, "ord long, published_ms long, tokens array<string>")
    assert sorted(r.ord for r in entities.distinct_articles(frame).collect()) == [1, 3, 4, 5, 6, 7]


def test_mentions_decompose(spark):
    rows = spark.createDataFrame([(1, "Café Palm"), (2, "cafe palm & co"), (3, "scafe"), (4, None), (5, "caf\u00e9ine")], "i int, t string")
    found = sorted((r.i, r.name) for r in entities.mentions(rows, "t", {"cafe": ("cafe",), "split": ("cafe palm",), "and": ("palm and co",)}).collect())
    assert found == [(1, "cafe"), (1, "split"), (2, "and"), (2, "cafe"), (2, "split"), (5, "cafe")]


def test_feeds(spark):
    rss = (
        '<rss><item><title>One - Daily</title><link>https://a/1</link><source url="https://www.daily.example/x">Daily</source><content:encoded><![CDATA[<p>Hi <b>you</b></p>]]></content:encoded></item>'
        "<item><title>No link</title></item><ITEM><title>A &amp;lt; B</title><link>https://a/3</link><guid>g3</guid></ITEM><item><title>Fourth</title><link>https://a/4</link></item><item><title>cut off"
    )
    atom = '<feed xmlns="x"><entry><title>T</title><link rel="self" href="https://a/s"/><link href="https://a/y"/><updated>u</updated></entry></feed>'
    frame = spark.createDataFrame([(1, rss), (2, atom), (3, ""), (4, None)], "feed int, xml string")
    frame = frame.select("*", F.lit("Agg").alias("name"), F.lit("agg.example").alias("domain"), (F.col("feed") == 1).alias("aggregator"))
    found = [(r.feed, r.position, r.id, r.title, r.url, r.summary, r.name, r.domain) for r in feeds.feed_entries(frame, 3).orderBy("feed", "position").collect()]
    assert found == [
        (1, 0, "https://a/1", "One", "https://a/1", "Hi you", "Daily", "daily.example"), (1, 2, "g3", "A < B", "https://a/3", "", "Agg", "agg.example"),
        (2, 0, "https://a/y", "T", "https://a/y", "", "Agg", "agg.example"),
    ]
    for url, ok in (("https://a.b.example/x", True), ("https://b.example:443/", True), ("http://b.example/", False), ("https://u@b.example/", False), ("https://b.example/#f", False), ("https://xb.example/", False), (None, False)):
        assert one(spark, feeds.on_approved_host(F.lit(url).cast("string"), F.lit("b.example"))) is ok


def test_press(spark):
    assert one(spark, P.clean_subject(F.lit("RE:FW: PRESS  RELEASE"))) == "PRESS RELEASE"
    assert one(spark, P.deck(F.lit("One. Two! " + "x" * 300 + ". Three."))) == "One. Two!"
    assert one(spark, P.tags(F.lit("Emaar and dld, DLD; off-plan villas"))) == ["emaar", "off-plan", "dld"]
    assert one(spark, P.links(F.lit("see https://a/x. and (https://a/x) http://b"))) == ["https://a/x", "http://b"]
    assert one(spark, P.relevance(F.lit("government"), F.lit(9), F.lit("x" * 300), F.lit(2), F.lit(1))) == pytest.approx(0.85)
    assert one(spark, P.relevance(F.lit("noise"), F.lit(0), F.lit(None).cast("string"), F.lit(0), F.lit(0))) == 0.0
    assert one(spark, P.press_slug(F.lit("2024-01-02"), F.lit("RE: Big, news_day!"))) == "2024-01-02-press-big-news_day"


def test_events(spark):
    for value, want in ((" Hero CTA ", "hero cta"), ("a@b", None), ("id 1234567", None), ("id 123456", "id 123456"), ("?q", None), ("", None), (None, None)):
        assert one(spark, E.safe_token(F.lit(value).cast("string"))) == want
    for value, want in (("https://own.example/a?q", "/a"), ("https://x.example", "x.example/"), ("/p#f", "/p"), ("mailto:a@b", None), ("javascript:1", None), (None, None)):
        assert one(spark, E.safe_location(F.lit(value).cast("string"), "own.example")) == want
    assert E.snake_case("ctaLevel") == "cta_level"


def test_served_width(spark):
    for url, width, want in (("https://a/editor_1024/x", 4000, 1024), ("https://a/800px-x", None, 800), ("https://a/x?w=1600", 1200, 1200), ("https://a/x", 900, 900), (None, None, 0)):
        assert one(spark, pictures.served_width(F.lit(url).cast("string"), F.lit(width).cast("int"))) == want
