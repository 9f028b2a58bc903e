"""Like pairs, which tasks count block by block from the rows that have each token."""

import random

import pytest

from inkstream.operators import entities, similarity
from inkstream.sources import views


def jaccard(a, b):
    return len(a & b) / len(a | b) >= 0.45


def headline(a, b):
    common = len(a & b)
    return common >= 4 and (common / len(a | b) >= 0.44 or common / min(len(a), len(b)) >= 0.72)


@pytest.mark.parametrize("alike, like, dealt", [(similarity.at_least(0.45), jaccard, 1000), (similarity.at_least(0.45), jaccard, 7), (entities.near_headlines(), headline, 20)])
def test_blocks_cut_anywhere(spark, monkeypatch, alike, like, dealt):
    """Blocks longer and shorter than what a task holds or compares at once, and columns that go along."""
    monkeypatch.setattr(similarity, "HELD", 9, raising=False)
    monkeypatch.setattr(similarity, "COMPARED", 5, raising=False)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        draw = random.Random(dealt)
        words = [f"w{i}" for i in range(18)]
        sets = {i: set(draw.sample(words, draw.randint(1, 11))) for i in range(130)}
        table = spark.createDataFrame([(i, (f"r{i}", i), sorted(s)) for i, s in sets.items()], "cls long, rank struct<x: string, o: long>, tokens array<string>")
        rows = similarity.ranked(table)
        one, two = rows.where("cls % 3 = 0"), rows.where("cls % 3 > 0")
        pairs = similarity.like_pairs(one, two, alike, of_large=("rank",), dealt=dealt)
        found = sorted((r.a, r.b, r.common, r.na, r.nb, tuple(r["rank"])) for r in pairs.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    smaller = lambda a, b: (len(sets[a]), a) < (len(sets[b]), b)
    want = [(a, b) for a in sets for b in sets if a % 3 == 0 and b % 3 and smaller(a, b) and like(sets[a], sets[b])]
    assert found == sorted((a, b, len(sets[a] & sets[b]), len(sets[a]), len(sets[b]), (f"r{b}", b)) for a, b in want)
    assert len(found) > 50


def test_no_sets_are_intersected_pair_by_pair(spark):
    """Time goes by pairs that meet and tokens that they share, not by a function of two arrays for each."""
    table = spark.createDataFrame([(i, ["a", "b", "c", "d", f"x{i}"]) for i in range(50)], "cls long, tokens array<string>")
    for pairs in (similarity.jaccard_pairs(table, 0.45), entities.near_pairs(table)):
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "array_intersect" not in plan and "arrays_overlap" not in plan
        assert pairs.count() == 50 * 49 // 2


def test_titles_split_no_more_than_they_take(spark):
    """The first words are those of the whole text, whatever blanks stand before, between and behind them."""
    texts = ["", " ", None, "a", " a", "a b\n", "\n a \t b  c ", "a b c", "a b c ", " a b c d", "a\u00a0b c d e", " ".join("x" * i for i in range(1, 40))]
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    for row in table.select(views.first_words("text", 3).alias("found"), views.words("text").alias("all")).collect():
        assert row.found == row.all[:3]
