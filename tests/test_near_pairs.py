"""Near-duplicate headlines: all pairs, and candidates that don't grow with the square of frequent words."""

import random

import pytest

from inkstream.operators import entities


def near(a, b):
    common = len(a & b)
    return common >= 4 and (common / len(a | b) >= 0.44 or common / min(len(a), len(b)) >= 0.72)


@pytest.mark.parametrize("few", [1, 3, 1000])
def test_all_pairs(spark, few):
    """Few words, so that every word, pair and triple is frequent."""
    draw = random.Random(few)
    words = [f"w{i}" for i in range(14)]
    sets = {i: set(draw.sample(words, draw.randint(1, 9))) for i in range(120)}
    sets |= {200: set(words[:4]), 201: set(words[:4]) | {"x"}, 202: set(), 203: set(words)}
    table = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "cls long, tokens array<string>")
    found = sorted((r.a, r.b) for r in entities.near_pairs(table, few).collect())
    assert found == sorted((a, b) for a in sets for b in sets if a < b and near(sets[a], sets[b]))


def test_candidates_of_frequent_words(spark):
    """Titles that share two words and nothing else are never compared, however many they are."""
    rows = [(i, ["the", "of", *(f"u{i}-{j}" for j in range(6))]) for i in range(2000)]
    rows += [(5000 + i, ["the", "of", "old", "quay", f"v{i // 2}", f"x{i}"]) for i in range(10)]
    table = spark.createDataFrame(rows, "cls long, tokens array<string>")
    found = entities.near_pairs(table)
    assert found.count() == 45  # all of the ten share four words of six
    # Joins, last to first: with the texts, and of the keys; nothing makes as many rows as pairs of the 2 000 would be.
    metrics = []
    plan = found._jdf.queryExecution().executedPlan().executedPlan()
    stack = [plan]
    while stack:
        node = stack.pop()
        held = node.metrics()
        if held.contains("numOutputRows"):
            metrics.append(held.apply("numOutputRows").value())
        kids = node.children()
        stack += [kids.apply(i) for i in range(kids.size())]
    assert max(metrics, default=0) < 100_000


def test_titles_are_taken_before_labels_are_joined(spark):
    """No text is shuffled for a title."""
    from inkstream.sources import views

    rows = views.articles(spark, "/root/testdata/sf0.001").select("ord", "title", "status")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" in plan[plan.index("Join"):] and "split(" not in plan[: plan.index("Join")]
