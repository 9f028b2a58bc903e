"""The Jaccard join against all pairs: chains of near copies, stock phrases, very common contents, all sizes."""

import random

import numpy as np
import pytest

from inkstream.llm import jaccard_join
from inkstream.llm.jaccard_join import Rule, bitmap, folded, home_bands, most_common, shingles, tile_keys

SCHEMA = "doc_id long, text string"


def corpus(seed, n=260):
    """Texts of 1 to 700 words: fresh ones, edits of earlier ones (chains), and texts made up mostly of stock phrases."""
    draw = random.Random(seed)
    stock = [" ".join(f"s{k}w{i}" for i in range(30)) for k in range(6)]
    texts = []
    for i in range(n):
        kind = draw.random()
        if texts and kind < 0.45:
            words = draw.choice(texts[-25:]).split()
            for _ in range(max(1, len(words) // draw.choice([30, 60, 120]))):
                at = draw.randrange(len(words))
                words[at : at + draw.randint(0, 1)] = [f"e{draw.randrange(9)}"]
        elif kind < 0.8:
            words = " ".join(draw.sample(stock, draw.randint(1, 5))).split() + [f"x{i}y{j}" for j in range(draw.randint(0, 40))]
        else:
            words = [f"f{draw.randrange(4000)}" for _ in range(draw.choice([1, 3, 6, 20, 80, 250, 700]))]
        texts.append(" ".join(words))
    return texts


def all_pairs(texts, rule):
    sets = [set(shingles(t.encode(), rule.n).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if a and b and rule.den * len(a & b) >= rule.num * len(a | b):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: find(i) for i in range(len(texts))}


@pytest.mark.parametrize("rule, common", [(Rule(), 1), (Rule(2, 60, 100), 1000)])
def test_components_equal_those_of_all_pairs(spark, monkeypatch, rule, common):
    """With ``common`` 1 nearly every shared content counts as very common, so that the salted way is taken."""
    if common == 1:
        monkeypatch.setattr(jaccard_join, "_common_contents", lambda docs, rows, rule: every_content(docs, rule))
    texts = corpus(3)
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)
    found = {r.doc_id: r.component_id for r in jaccard_join.join(docs, rule).collect()}
    assert found == all_pairs(texts, rule)


def every_content(docs, rule):
    keys = []
    for r in docs.collect():
        s = shingles((r.text or "").encode(), rule.n)
        for band in home_bands(len(s), rule) if len(s) else ():
            keys.append(tile_keys(s, band, rule, np.empty(0, np.uint64))[0])
    return np.unique(np.concatenate(keys))


def test_small_blocks_find_the_same(spark, monkeypatch):
    texts = corpus(5)
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    found = {r.doc_id: r.component_id for r in jaccard_join.join(docs, Rule()).collect()}
    assert found == all_pairs(texts, Rule())


def test_bits_bound_the_overlap_from_above():
    draw = np.random.default_rng(1)
    for _ in range(300):
        pool = draw.integers(0, 1 << 63, 900).astype(np.uint64)
        a, b = (np.unique(pool[draw.random(900) < draw.random()]) for _ in range(2))
        if not len(a) or not len(b):
            continue
        x, y = bitmap(a), bitmap(b)
        words = min(len(x), len(y))
        bound = most_common(len(a), folded(x, words), np.array([len(b)]), folded(y, words)[None])
        assert bound[0] >= len(np.intersect1d(a, b))


def test_candidates_grow_with_the_input(spark, monkeypatch):
    """Pairs whose arrays are fetched follow the number of documents, though all share stock phrases."""
    fetched = []
    real = jaccard_join._centre_links
    monkeypatch.setattr(jaccard_join, "_centre_links", lambda docs, pairs, *a: fetched.append(pairs.count()) or real(docs, pairs, *a))
    counts = []
    for n in (250, 1000):
        draw = random.Random(2)
        stock = [" ".join(f"s{k}w{i}" for i in range(12)) for k in range(12)]
        texts = [" ".join([*draw.sample(stock, 5), *(f"d{i}w{j}" for j in range(60))]) for i in range(n)]
        texts += [t + " tail" for t in texts[::10]]
        fetched.clear()
        jaccard_join.join(spark.createDataFrame(list(enumerate(texts)), SCHEMA), Rule()).count()
        counts.append(sum(fetched))
    assert 0 < counts[0] and counts[1] <= 6 * counts[0]
