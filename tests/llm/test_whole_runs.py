"""Substring deduplication against every run of several sentences."""

import random

from inkstream.llm import substring_dedup
from inkstream.llm.substring_dedup import ALONE, SENTENCES, WORDS, sentences


def every_run(docs):
    """Texts without the sentences that lie in any run, of whatever length, that came before."""
    seen, out = set(), {}
    for i, text in docs:
        pieces = sentences(text.encode())
        split = [tuple(p.lower().split()) for p in pieces]
        gone = set()
        for a in range(len(split)):
            for b in range(a + 1, len(split) + 1):
                n = sum(map(len, split[a:b]))
                if (b - a >= SENTENCES and n >= WORDS) or (b - a == 1 and n >= ALONE):
                    key = tuple(split[a:b])
                    if key in seen:
                        gone.update(range(a, b))
                    seen.add(key)
        out[i] = b"".join(p for k, p in enumerate(pieces) if k not in gone).decode()
    return out


def check(spark, docs):
    found = substring_dedup.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in found} == every_run(docs)


def test_short_sentences_at_the_end(spark):
    long = " ".join(f"w{i}" for i in range(30)) + "."
    passage = "One two three four five six seven. Eight nine. Ten. "
    copy = f"{long} Short end."
    docs = [(1, passage + "Then another way."), (2, "Before it. " + passage + "Something else here."), (3, copy), (4, copy)]
    assert every_run(docs)[4] == "" and "Ten." not in every_run(docs)[2]
    check(spark, docs)


def test_every_run(spark):
    draw = random.Random(3)
    stock = [" ".join(draw.choice("abcdefgh") for _ in range(n)) + "." for n in [1, 1, 2, 3, 4, 6, 7, 8, 12, 24, 25, 30]]
    docs = [(i, " ".join(draw.choice(stock) for _ in range(draw.randint(0, 12)))) for i in range(300)]
    check(spark, docs)
