"""Evidence, citations and gates on small drafts."""

import pytest
from pyspark.sql import functions as F

from inkstream.functions import figures as G
from inkstream.operators import citations, evidence, gates

RECORD = "Registry files for the quarter put the harbour plot at AED 10 million, deed fees included in the sum."
BODY = "The harbour plot went for AED 10 million."
TYPES = (
    "Orders came to AED3.5 billion for 8,000 homes, which is 30 per cent of what is planned.",
    "In its filing the builder lists orders of AED 3.5 billion and 8000 homes, spread over the phases that it opened this spring.",
    "A trade paper that saw the tender puts the share awarded so far at 30% of the plan and names the same two contractors for it.",
)
#: draft, body, category, sources (publisher, tier, first party, text); then lane and verdict.
CASES = {
    "two publishers": (BODY, "macro", [("a", None, False, RECORD), ("b", None, False, RECORD)], "corroborated-analysis", True),
    "newsroom": ("A daily reported that the harbour plot went for AED 10 million.", "market-pulse", [("r", "national-press", False, RECORD)], "fast-news", True),
    "official": ("The registry confirmed a price of AED 10 million for the plot.", "regulatory", [("g", "government", False, RECORD)], "official-update", True),
    "developer": ("Its builder announced that the plot had cost AED 10 million.", "launch", [("d", None, True, RECORD)], "developer-announcement", True),
    "advice": ("We recommend that investors buy now that plots fetch AED 10 million.", "market-pulse", [("r", "national-press", False, RECORD)], "corroborated-analysis", False),
    "one publisher twice": (BODY, "macro", [("a", None, False, RECORD), ("a", None, False, RECORD)], "corroborated-analysis", False),
    "typography": (TYPES[0], "macro", [("a", None, False, TYPES[1]), ("b", None, False, TYPES[2])], "corroborated-analysis", True),
    "unbacked": ("It was AED 11 million.", "macro", [("a", None, False, RECORD), ("b", None, False, RECORD)], "corroborated-analysis", False),
    "nothing fetched": (BODY, "macro", [], "corroborated-analysis", False),
    "too short a text": ("It said AED 10 million.", "macro", [("r", "national-press", False, "AED 10 million")], "corroborated-analysis", False),
}


def test_assessment(spark):
    drafts = [(k, "T", None, c[0], c[1], False, True) for k, c in CASES.items()]
    found = [(k, f"u{i}", i, s[3], s[0], s[1], s[2]) for k, c in CASES.items() for i, s in enumerate(c[2])]
    cited = [(k, f"u{i}", True) for k, c in CASES.items() for i in range(max(1, len(c[2])))]
    rows = evidence.assess(
        spark.createDataFrame(drafts, "draft string, title string, subtitle string, body string, category string, trade boolean, gates_ok boolean"),
        spark.createDataFrame(cited, "draft string, url string, whitelisted boolean"),
        spark.createDataFrame(found, "draft string, url string, place int, text string, publisher string, tier string, first_party boolean"),
    ).collect()
    assert {r.draft: (r.lane, r.approved) for r in rows} == {k: c[3:] for k, c in CASES.items()}


@pytest.mark.parametrize(
    "text, want",
    [
        ("In 2026, 12 homes", []),
        ("from 2023–2024 on", []),
        ("AED 4.25M and $3.9bn, 30 per cent", ["aed 4.25m", "$3.9bn", "30 per cent"]),
        ("5m2 but 5 main roads, 5 m", ["5m", "5 m"]),
        ("1,250 units, 3.5 to 4", ["1,250", "3.5"]),
        ("10-12 floors of 900 sq ft", ["10-12", "900 sq ft"]),
        (None, []),
        ("", []),
    ],
)
def test_figures(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(G.figures(F.col("t")).alias("f")).first()
    assert row.f == want


def test_numeric_forms(spark):
    texts = ["Dhs 1,234,567 or DH 5", "8,000 and 80,00", "30 per cent – 40 percent", "AED3.5 b"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(G.norm_numeric(F.col("t")).alias("n"))
    assert [r.n for r in rows.collect()][:3] == ["aed1234567oraed5", "8000and80,00", "30%-40%"]


def test_gates(spark):
    good = "The thesis rests on 12 deals and escrow — a structural point. " + "word " * 700
    rows = [(0, "Head", good, 1), (1, "H" * 91, "Have you ever seen it? " + good, 0), (2, None, None, None), (3, "x", "\U0001f600 " + good + " synergy **a** **b** **c** **d**", 1)]
    frame = spark.createDataFrame(rows, "i int, title string, body string, listed int")
    found = {r.i: r for r in frame.select("i", *[c.alias(n) for n, c in gates.draft_gates(F.col("title"), F.lit(None).cast("string"), F.col("body"), F.col("listed")).items()]).collect()}
    assert found[0].blocked == 0 and not found[0].gate8 and not found[0].bold
    assert [found[1][f"gate{i}"] for i in range(1, 9)] == [False, False, True, False, True, True, False, False]
    assert [found[2][f"gate{i}"] for i in range(1, 9)] == [False, True, False, True, True, False, True, True]
    assert found[3].gate1 and found[3].gate6 and found[3].bold


def test_voice_gates(spark):
    body = "Absorption of 5 frond plots, escrow paid. " + "word " * 700
    rows = [(0, body, ["a", "b", "c"]), (1, body + " the leverage is there", ["a"]), (2, body + " overleveraged", ["a", "b", "c"]), (3, None, None)]
    frame = spark.createDataFrame(rows, "i int, body string, tldr array<string>")
    found = {r.i: [n for n in r.asDict() if r[n] is True] for r in frame.select("i", *[c.alias(n) for n, c in gates.voice_gates(F.lit("T"), F.lit(None).cast("string"), F.col("body"), F.col("tldr")).items()]).collect()}
    assert found == {0: [], 1: ["banned", "tldr_shape"], 2: [], 3: ["number_first", "body_length", "approved", "tldr_shape"]}


def test_citations(spark):
    rows = [("strong", 0), ("weak", 3), ("two weak", 3), ("two weak", 4), ("none", None), ("mixed", None), ("mixed", 1)]
    cited = spark.createDataFrame([(d, i, t) for i, (d, t) in enumerate(rows)], "draft string, place int, tier int")
    assert {r.draft: r.ok for r in citations.gate(cited).collect()} == {"strong": True, "weak": False, "two weak": True, "none": False, "mixed": True}
    found = {r.draft: (r.label, r.limited) for r in citations.summary(cited).collect()}
    assert found["weak"] == ("Regional press · single source", True)
    assert found["none"] == ("Source links · single source", True)
    assert found["strong"] == ("Official source · single source", False)
    assert found["mixed"] == ("2 sources · national press led", False)
