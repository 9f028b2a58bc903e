"""Language-model scores at several orders against plain counts, and mixtures whose sources have many blocks."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from inkstream.llm import lm_scoring, mixing

ROWS = [(1, "the quay the old quay"), (2, "The quay the old quay the"), (3, ""), (4, None), (5, "a b a b a b c"), (6, "unseen words here"), (6, "unseen words here"), (7, "the old quay b a"), (8, "b")]
HELD = {5, 8}


def plain(rows, order):
    texts = [(i, (t or "").lower().split() + ["</s>"]) for i, t in rows]
    counts, train = Counter(), [x for i, x in texts if i not in HELD]
    for x in train:
        padded = ["<s>"] * (order - 1) + x
        for n in range(1, order + 1):
            for j in range(order - 1, len(padded)):
                counts[tuple(padded[j - n + 1 : j + 1])] += 1
        for n in range(1, order):
            counts[("<s>",) * n] += 1
    total = sum(map(len, train))
    types = len({w for x in train for w in x})

    def chance(history, w):
        low = (counts[w,] + 1) / (total + types + 1) if not history else chance(history[1:], w)
        return low if not history else (counts[(*history, w)] + lm_scoring.STRENGTH * low) / (counts[history] + lm_scoring.STRENGTH)

    out = []
    for i, x in texts:
        padded = ["<s>"] * (order - 1) + x
        score = sum(math.log10(chance(tuple(padded[j - order + 1 : j]), padded[j])) for j in range(order - 1, len(padded)))
        base = sum(math.log10((counts[w,] + 1) / (total + types + 1)) for w in x)
        out.append((i, len(x), sum(counts[w,] > 0 for w in x), total, round(base, 6), round(score, 6)))
    return sorted(out)


@pytest.mark.parametrize("order", [2, 3, 4])
@pytest.mark.parametrize("block", [40, 6 << 20])
def test_scores(spark, order, block):
    """In one block and in several, so that totals come from other blocks."""
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    found = lm_scoring.score(docs, F.col("doc_id").isin(*HELD), order, block).collect()
    got = sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in found)
    assert [x[:4] for x in got] == [x[:4] for x in plain(ROWS, order)]
    for a, b in zip(got, plain(ROWS, order)):
        assert a[4:] == pytest.approx(b[4:], abs=2e-5)


def test_mixture_of_many_blocks(spark, monkeypatch):
    """Whole blocks first, in the order of their turns, then part of one, as far as the budget goes."""
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 60)
    draw = random.Random(8)
    rows = [(i, " ".join("w" for _ in range(draw.randint(0, 12))), draw.choice(["a", "a", "a", "a", "a", "b", "b", "c"])) for i in range(600)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), entropy=1.0, passes=3.0).collect()
    assert sorted(r.doc_id for r in found) == [r[0] for r in rows]
    tokens = Counter()
    by_block = defaultdict(list)
    for r in found:
        tokens[r.source] += r["__tokens"]
        if r["__tokens"]:
            by_block[r.source, r["__block"]].append(r)
        else:
            assert r["__copies"] == 1
    weight = {r.source: r["__weight"] for r in found}
    least = min(weight[s] / tokens[s] for s in tokens)
    for s in tokens:
        passes = weight[s] / tokens[s] / least
        whole = math.floor(passes + 1e-9)
        rest = (passes - whole) * tokens[s]
        turns = sorted(b for source, b in by_block if source == s)
        assert len(turns) >= 3
        kinds = []
        for b in turns:
            more = {r["__copies"] - whole for r in by_block[s, b]}
            assert more <= {0, 1}
            kinds.append("all" if more == {1} else "none" if more == {0} else "part")
        assert kinds == sorted(kinds, key=["all", "part", "none"].index) and kinds.count("part") <= 1
        taken = sum(r["__tokens"] * (r["__copies"] - whole) for r in found if r.source == s and r["__tokens"])
        assert rest - 13 <= taken <= rest + 1
