"""Every check of a draft's shape and provenance, each met by one change of a draft that passes."""

import copy
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from inkstream.operators import drafts

HOUSE = drafts.House(author="desk", cta="https://news.example/join")
NOW = 1_735_689_600_000  # 2025-01-01
TEXT = "A sentence of plain words that fills the room which a fetched text must have at the least. "
URL = "https://a.example/report"
ARTICLE = {
    "slug": "2024-12-31-a-quiet-year", "title": "A quiet year", "subtitle": "What it was", "publishedAt": "2024-12-30T20:00:00Z", "modifiedAt": "2024-12-30T20:00:00.5Z",
    "displayDate": "31 December", "author": "desk", "tier": "news", "category": "macro", "market": ["UAE", "GCC"], "tldr": ["one", "two", "three"], "body": TEXT * 2,
    "faq": [{"q": "Why?", "a": "So."}], "citations": [{"source": "A", "url": URL, "accessedAt": "2024-12-30T20:00:00Z", "tier": 1}, {"source": "B", "url": "https://b.example:443/?q=1", "accessedAt": "2024-02-31T24:00:00Z"}],
    "heroImage": {"src": "/news/2024-12-31-a-quiet-year/cover.jpg", "alt": "A quay", "credit": "A. Person"}, "cta": {"href": "https://news.example/join?utm=1", "label": "Join"},
    "distribution": {"postiz": {"x": True}, "repost": {}, "telegram": False}, "metaDescription": "Short", "speakableSelector": [".lead", "#top > p"],
    "semaform": {"theTake": "t", "viewsFrom": [{"source": "s", "view": "v"}], "howIdTradeIt": {"action": "Re-rate", "reasoning": "r"}},
}
PROVENANCE = {
    "clusterId": "c:1_a-b", "topic": "Topic", "score": 7.5, "scoreBreakdown": {"relevance": 1, "sourceTier": 0.5, "freshness": 0, "angle": 2, "more": "x"},
    "sources": [{"name": "A", "tier": "official", "url": URL, "summary": "S", "extra": 1}], "citedText": "words",
    "fetchedEvidence": [{"url": URL, "finalUrl": URL, "text": TEXT, "fetchedAt": "2024-12-30T20:00:00Z", "contentHash": hashlib.sha256(TEXT.encode()).hexdigest()}],
}
GONE = object()
ARTICLE_CHANGES = [
    (("status",), "draft", "fields"), (("slug",), "2024-02-30-a", "slug"), (("slug",), "2024-12-31-A", "slug"), (("slug",), "2024-12-31-" + "a" * 80, "slug"), (("slug",), GONE, "slug"),
    (("title",), " 1234567 ", "title"), (("title",), "x" * 91, "title"), (("title",), "\U0001f600" * 46, "title"), (("title",), 12345678, "title"), (("title",), "A quiet\x07 year", "title"), (("title",), "　A quiet ", "title"),
    (("subtitle",), " ", "subtitle"), (("publishedAt",), "2024-12-30", "publishedAt"), (("publishedAt",), "2024-13-30T20:00:00Z", "publishedAt"), (("modifiedAt",), None, "modifiedAt"),
    (("publishedAt",), "2025-01-01T00:05:00.001Z", "publishedAt ahead"), (("modifiedAt",), "2024-12-30T19:59:59.999Z", "modifiedAt before"), (("publishedAt",), "2024-12-30T19:59:59Z", "slug day"),
    (("displayDate",), "", "displayDate"), (("author",), "other", "author"), (("tier",), "blog", "tier"), (("category",), "sport", "category"), (("market",), [], "market"), (("market",), ["UAE"] * 6, "market"),
    (("market",), ["Mars"], "market"), (("market",), "UAE", "market"), (("tldr",), ["one", "two"], "tldr"), (("tldr", 1), "x" * 181, "tldr"), (("body",), "short", "body"), (("body",), "x" * 80_001, "body"),
    (("faq", 0, "extra"), "x", "faq"), (("faq", 0, "a"), GONE, "faq"), (("faq",), [{"q": "q", "a": "a"}] * 9, "faq"), (("faq",), None, "faq"), (("citations",), [], "citations"), (("citations", 0, "url"), "http://a.example", "citations"),
    (("citations", 0, "url"), "https://u@a.example", "citations"), (("citations", 0, "url"), "https://a.example#x", "citations"), (("citations", 0, "url"), "https://a.example:444/", "citations"), (("citations", 0, "accessedAt"), "now", "citations"),
    (("citations", 1, "url"), URL, "citations twice"), (("heroImage", "src"), "/news/other/cover.jpg", "heroImage"), (("heroImage", "width"), 3, "heroImage"), (("heroImage", "alt"), " ", "heroImage"), (("cta", "href"), "https://news.example/joined", "cta"),
    (("cta", "label"), GONE, "cta"), (("cta",), "x", "cta"), (("distribution", "fax"), True, "distribution"), (("distribution", "telegram"), "yes", "distribution"), (("distribution", "postiz", "x"), 1, "distribution"), (("distribution", "repost"), [], "distribution"),
    (("distribution",), GONE, "distribution"), (("metaDescription",), "", "metaDescription"), (("metaDescription",), None, "metaDescription"), (("speakableSelector", 0), "lead", "speakableSelector"), (("speakableSelector",), [".a"] * 13, "speakableSelector"),
    (("semaform", "mood"), "x", "semaform"), (("semaform", "viewsFrom", 0, "role"), "", "semaform"), (("semaform", "howIdTradeIt", "action"), "Hold", "semaform"), (("semaform",), [], "semaform"),
    (("metaDescription",), GONE, None), (("semaform",), GONE, None), (("speakableSelector",), GONE, None), (("citations", 0, "tier"), GONE, None), (("faq",), [], None), (("distribution",), {}, None),
]
PROVENANCE_CHANGES = [
    (("clusterId",), "a b", "clusterId"), (("topic",), "", "topic"), (("score",), "7", "score"), (("score",), None, "score"), (("scoreBreakdown", "angle"), GONE, "scoreBreakdown"), (("scoreBreakdown", "freshness"), True, "scoreBreakdown"),
    (("sources",), [PROVENANCE["sources"][0]] * 25, "sources"), (("sources", 0, "publishedAt"), "x", "sources"), (("sources", 0, "summary"), "x" * 9001, "sources"), (("citedText",), " ", "citedText"),
    (("fetchedEvidence", 0, "text"), TEXT + "more", "fetchedEvidence"), (("fetchedEvidence", 0, "contentHash"), None, "fetchedEvidence"), (("fetchedEvidence", 0, "url"), "https://c.example/", "fetchedEvidence"), (("fetchedEvidence", 0, "text"), "short", "fetchedEvidence"),
    (("fetchedEvidence", 0, "finalUrl"), "ftp://x", "fetchedEvidence"), (("fetchedEvidence",), [PROVENANCE["fetchedEvidence"][0]] * 13, "fetchedEvidence"), (("fetchedEvidence", 0, "contentHash"), GONE, None), (("fetchedEvidence",), GONE, None), (("sources",), [], None),
]


def changed(base, path, value):
    out = copy.deepcopy(base)
    at = out
    for step in path[:-1]:
        at = at[step]
    if value is GONE:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return out


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(f"a{i}", json.dumps(changed(ARTICLE, p, v)), json.dumps(PROVENANCE)) for i, (p, v, _) in enumerate(ARTICLE_CHANGES)]
    rows += [(f"p{i}", json.dumps(ARTICLE), json.dumps(changed(PROVENANCE, p, v))) for i, (p, v, _) in enumerate(PROVENANCE_CHANGES)]
    rows += [("good", json.dumps(ARTICLE), json.dumps(PROVENANCE)), ("list", "[]", '"x"'), ("none", None, "nope")]
    table = spark.createDataFrame(rows, "id string, a string, p string").select("id", F.try_parse_json("a").alias("a"), F.try_parse_json("p").alias("p"))
    out = table.select("id", drafts.article_error(F.col("a"), HOUSE, NOW).alias("article"), drafts.provenance_error(F.col("p"), F.col("a"), HOUSE).alias("provenance"))
    return {r.id: (r.article, r.provenance) for r in out.collect()}


def test_good_and_shapeless(judged):
    assert judged["good"] == (None, None)
    assert judged["list"] == ("article", "provenance") and judged["none"] == ("article", "provenance")


@pytest.mark.parametrize("i", range(len(ARTICLE_CHANGES)), ids=lambda i: f"{i}-{ARTICLE_CHANGES[i][2]}")
def test_article(judged, i):
    assert judged[f"a{i}"][0] == ARTICLE_CHANGES[i][2]


@pytest.mark.parametrize("i", range(len(PROVENANCE_CHANGES)), ids=lambda i: f"{i}-{PROVENANCE_CHANGES[i][2]}")
def test_provenance(judged, i):
    assert judged[f"p{i}"][1] == PROVENANCE_CHANGES[i][2]
