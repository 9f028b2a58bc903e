"""The assignment of media against the scan that it stands for; labels of odd values."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkstream.functions import labels as L
from inkstream.operators import media


def scan(own, candidates):
    given, used = {}, set()
    for article, _, src in sorted(own, key=lambda x: x[1]):
        if src is not None and src not in used:
            given[article] = src
            used.add(src)
    rest = [(article, place, sorted({s: r for a, r, s in reversed(candidates) if a == article}.items(), key=lambda x: x[1])) for article, place, _ in own if article not in given]
    often = Counter(s for _, _, some in rest for s, _ in some)
    for article, _, some in sorted(rest, key=lambda x: (len(x[2]), x[1])):
        free = [s for s, _ in some if s not in used]
        if free:
            given[article] = min(free, key=lambda s: often[s])
            used.add(given[article])
    return given


@pytest.mark.parametrize("seed", [1, 2])
def test_assignment(spark, seed):
    draw = random.Random(seed)
    own = [(i, i, draw.choice([None, None, f"p{draw.randrange(12)}"])) for i in range(40)]
    candidates = [(i, r, f"p{s}") for i in range(40) for r, s in enumerate(draw.sample(range(30), draw.randint(0, 6)))]
    found = media.assign(spark.createDataFrame(own, "article int, place int, src string"), spark.createDataFrame(candidates, "article int, rank int, src string"))
    assert {r.article: r.src for r in found.collect()} == scan(own, candidates)


def test_labels(spark):
    row = spark.range(1).select(
        L.supported_alt(F.lit(" A  title! "), F.lit("a title")).alias("a"), L.supported_alt(F.lit(None).cast("string"), F.lit("t")).alias("b"), L.first_paragraph(F.lit(" x \n\ny")).alias("c"),
        *[c.alias(n) for c, n in zip(L.address(F.lit('"News Room" <NR@Press.Example>')), ("d", "e"))], L.consequence_excerpt(F.lit("a\n\nThe risk is b\n\nc"), F.array(F.lit("p"))).alias("f"),
        L.consequence_excerpt(F.lit(None).cast("string"), F.array(F.lit("p"))).alias("g"), L.voice_excerpt(F.lit("a\n \nb  c\n\n\n\nd\n\ne")).alias("h"),
    ).first()
    assert tuple(row) == ("", "", "x", "News Room", "nr@press.example", "The risk is b", "p", "a b c d")
