"""Quality rules, spelling variants and Merkle manifests against plain Python and their SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from compare import duck_rows, spark_rows
from pyspark.sql import functions as F

from inkstream.llm import catalog, merkle, quality_rules, spelling

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, name):
    assert spark_rows(catalog.QUERIES[name](spark, SF)) == duck_rows(catalog.ORACLE_SQL[name], SF)


def plain_figures(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(zip(words, words[1:], words[2:]))
    held = {i + j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(held), len(lines)


TEXTS = [
    None, "", " \t\n\v", "a", "a b c a b c", "a b c d a b c", "x x x x", "l one\nl one\n l one\n\n \n", "# * $ % & | < > ok",
    "é ü\x85ß w \U0001f600 é ü\x85ß w \U0001f600", "one two three " * 4000,
]


def test_figures(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    found = {r.doc_id: tuple(r[n] for n in quality_rules.FIGURES) for r in quality_rules.figures(docs, "doc_id").collect()}
    assert found == {i: plain_figures(x or "") for i, x in enumerate(TEXTS)}


def test_binomial_bounds():
    for n in (1, 5, 40):
        for k in range(n + 1):
            for p in (0.004, 0.2, 0.7):
                direct = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
                assert quality_rules.binomial_cdf(k, n, p) == pytest.approx(direct, abs=1e-12)
            bound = quality_rules.upper_bound(k, n, 0.05)
            assert bound == 1.0 if k == n else quality_rules.binomial_cdf(k, n, bound) == pytest.approx(0.05, abs=1e-6)


def test_certified_cutoffs(spark):
    """Cutoffs stop before the first that the bound can't carry; strata are apart; a small one certifies nothing."""
    rule = (quality_rules.Rule("symbols", "n_symbols", "n_words", (200, 100, 50, 10)),)
    make = lambda lang, n, symbols: [(lang, 100, 500, symbols, 0, 0, 1)] * n
    good = make("en", 2000, 0) + make("en", 200, 20) + make(None, 3000, 0) + make("de", 20, 0)
    rows = spark.createDataFrame(good, "lang string, " + ", ".join(f"{n} long" for n in quality_rules.FIGURES))
    found = {r.stratum: (r.level, r.n, r.rejected) for r in quality_rules.thresholds(rows, rows, "lang", rule, rate=0.05, error=0.1).collect()}
    assert found == {"en": (2, 2200, 0), None: (3, 3000, 0)}
    judged = quality_rules.judge(rows, quality_rules.thresholds(rows, rows, "lang", rule, rate=0.05, error=0.1), "lang", rule)
    assert judged.where("kept").count() == len(good)


def test_false_rejection_holds_on_other_rows(spark):
    """Cutoffs learnt on one half of the good rows reject no more than the rate of the other half."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    found = quality_rules.passed(docs, labels.where("doc_id % 2 = 0"), rate=0.05)
    other = found.join(labels.where("doc_id % 2 = 1"), "doc_id").where("NOT base_failed")
    counts = other.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("kept")).alias("gone")).collect()
    count = {r.quality: (r.n, r.gone) for r in counts}
    assert count[1][1] <= 0.05 * count[1][0]
    assert count[0][1] >= 0.5 * count[0][0]


def apart(a, b):
    """Whether two words differ by exactly one edit."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


@pytest.fixture(scope="module")
def vocabulary():
    random.seed(5)
    words = {"".join(random.choices("abé", k=random.randint(6, 9))) for _ in range(500)}
    words |= {"aaaaaa", "aaaaaaa", "aaaaaaaa", "÷×ÿaaaa", "÷×ÿaaa"}
    return {w: random.randint(5, 400) for w in sorted(words)}


def test_automaton_numbers(vocabulary):
    words = sorted(vocabulary)
    found = spelling.Automaton(words)
    assert [found.walk(found.root, 0, w, 0) for w in words] == list(range(len(words)))
    assert found.walk(found.root, 0, "zzzzzz", 0) == -1
    assert len(found.arcs) < len({w[:i] for w in words for i in range(len(w) + 1)})
    assert spelling.Automaton([]).near("aaaaaa", 3) == set()


@pytest.mark.parametrize("hot", [100_000, 20])
def test_near_pairs(spark, vocabulary, hot):
    """All pairs of one edit, each once, with halves and with hot halves divided."""
    words = spark.createDataFrame(list(vocabulary.items()), "word string, n long")
    found = [(r.word, r.near) for r in spelling.near_pairs(words, hot).collect()]
    assert sorted(found) == sorted((a, b) for a in vocabulary for b in vocabulary if apart(a, b))
    best = {r.word: (r.n_near, r.form, r.form_n) for r in spelling.nearest(words, hot).collect()}
    for a, n in vocabulary.items():
        near = [b for b in vocabulary if apart(a, b)]
        top = min(near, key=lambda b: (-vocabulary[b], b), default=None)
        assert best[a] == (len(near), top, vocabulary.get(top))


def test_roots_follow_chains(spark):
    chain = [(f"w{i}", f"w{i + 1}" if i < 9 else None) for i in range(10)] + [("x", "w3"), ("alone", None)]
    found = {r.word: r.root for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert found == {w: "alone" if w == "alone" else "w9" for w, _ in chain}


def test_words_of_odd_rows(spark):
    rows = [(1, "Worten×÷ worten×÷ x"), (2, None), (3, ""), (None, "WORTEN×÷"), (4, "worten×÷ worten×÷ ÀWORTEN"), (4, "Àworten")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            word = run if doc_id is None or h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]
            expected[word] += len(word) >= 6
    found = {r.word: r.n for r in spelling.count_words(docs, least=1).collect()}
    assert found == {w: n for w, n in expected.items() if n}


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves):
    """Levels of a tree of hex digests, leaves first."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h("".join(last[i : i + 8])) for i in range(0, len(last), 8)])
    return levels


def plain_leaf(row):
    return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def walk(levels, i):
    out = []
    for level in levels[:-1]:
        low = i - i % 8
        out.append(("".join(level[low:i]), "".join(level[i + 1 : low + 8])))
        i //= 8
    return out


@pytest.mark.parametrize("ranges", [100_000, 7, 1])
def test_manifest(spark, monkeypatch, ranges):
    """Every proof, over ranges that cut runs and groups anywhere; repeated rows are leaves of their own."""
    monkeypatch.setattr(merkle, "RANGE_ROWS", ranges)
    random.seed(ranges)
    langs = [None, "de", "en", "en", "en", "fr", "é"]
    size = 150 if ranges < 100_000 else 700
    rows = [(i if i % 17 else None, f"s{i % 3}" if i % 5 else None, langs[i % 7], i * 3 if i % 4 else None, f"Text É {i}" if i % 9 else None) for i in range(size)]
    rows += rows[:10] + [(999_999, "s", "zz", 1, "")]
    random.shuffle(rows)
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, g string, leaf string")
    found = merkle.check(merkle.manifest(docs))
    trees = {}
    for lang in {r[2] for r in rows}:
        own = sorted(((r[0] is not None, r[0] or 0, plain_leaf(r)) for r in rows if r[2] == lang))
        trees[lang] = own, plain_tree([x[2] for x in own])
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    upper = plain_tree([trees[x][1][-1][0] for x in order])
    expected = []
    for g, lang in enumerate(order):
        own, levels = trees[lang]
        for i, (_, doc_id, leaf) in enumerate(own):
            steps = walk(levels, i) + walk(upper, g)
            expected.append((doc_id, leaf, levels[-1][0], upper[-1][0], h("".join(a + b for a, b in steps)), upper[-1][0], True))
    got = [(r.doc_id or 0, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in found.collect()]
    assert sorted(got) == sorted(expected)


def test_tampered_leaf_is_found(spark):
    rows = [(i, "s", "en", 1, f"Text {i}" if i != 5 else None) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    found = {r.doc_id: (r.verified, r.folded_root == r.root) for r in merkle.check(merkle.manifest(docs, F.when(F.col("doc_id") % 5 == 0, F.lower("text")))).collect()}
    assert found == {i: (i % 5 > 0 or i == 5,) * 2 for i in range(20)}


def test_one_document_is_its_own_root(spark):
    docs = spark.createDataFrame([(1, None, None, None, None)], "doc_id long, source string, lang string, n_chars long, text string")
    row = merkle.check(merkle.manifest(docs)).first()
    assert row.leaf == row.subroot == row.root == row.folded_root == h("1:1----") and row.proof_sha256 == h("") and row.verified
