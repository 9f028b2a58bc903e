"""Quality rules whose cutoffs are chosen under a proven bound on false rejection.

Each rule compares a figure of a text with cutoffs that grow stricter. Rows labelled as good are the holdout: they choose
nothing but the cutoffs, whose grids are fixed beforehand. For each stratum and rule the cutoffs are tested in order from
the most lenient, each by an exact binomial test that the rule rejects more than its part of the allowed rate; the first
that fails ends the sequence, which needs no correction within it, and Bonferroni's correction covers all sequences. With
probability 1 - ``error`` every stratum then loses at most ``rate`` of its good rows to all rules together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.llm.common import doc_rows, materialize, ship, sliced, table, texts

SYMBOLS = b"#*$%&|<>"
RATE = 0.02  # good rows that the rules may reject in a stratum
ERROR = 0.1  # chance that any stratum loses more
FEW = 10_000  # strata up to this count are broadcast
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


@dataclass(frozen=True)
class Rule:
    """Rejects where 100 * ``figure`` is above (or below) a cutoff times ``of``; cutoffs go from lenient to strict."""

    name: str
    figure: str
    of: str
    cutoffs: tuple[int, ...]
    above: bool = True

    def rejects(self, cutoff: int | Column) -> Column:
        have, bound = F.col(self.figure) * 100, F.col(self.of) * cutoff
        return have > bound if self.above else have < bound


RULES = (
    Rule("symbols", "n_symbols", "n_words", (300, 200, 150, 100, 80, 60, 50, 40, 30, 20, 10, 5)),
    Rule("repeated lines", "n_dup_lines", "n_lines", (90, 80, 70, 60, 50, 45, 40, 35, 30, 25, 20)),
    Rule("repeated words", "n_repeat_words", "n_words", (50, 45, 40, 35, 30, 25, 20, 15)),
    Rule("long words", "word_chars", "n_words", (1500, 1200, 1000, 900, 850, 800, 750, 700, 650, 600)),
    Rule("short words", "word_chars", "n_words", (150, 200, 250, 300, 325, 350, 375, 400, 425, 450), above=False),
)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three that occurs twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    size = len(seen)
    pair = ids[:-2] * size + ids[1:-1]
    if size >= 1 << 20:  # keep the key of three within 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair * size + ids[2:]
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    often = count[back] > 1
    held = np.zeros(n, bool)
    for shift in range(3):
        held[shift : shift + n - 2] |= often
    return int(held.sum())


def figures_of(text: bytes) -> tuple[int, ...]:
    """The values named by ``FIGURES``. Words are what white space (bytes 9 to 13 and 32) divides."""
    words = text.split()
    chars = len(b"".join(words).decode())
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines)


def figures(docs: DataFrame, *keep: str) -> DataFrame:
    """The ``keep`` columns of ``docs`` and the figures of its whole texts; a null text is an empty one."""
    ship(docs.sparkSession)
    rows = doc_rows(docs, *keep, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            found = [figures_of(x) for x in texts(batch)]
            yield table(**{c: batch.column(c) for c in keep}, **{n: pa.array(v, pa.int64()) for n, v in zip(FIGURES, zip(*found))})

    kept = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return rows.mapInArrow(run, kept + ", ".join(f"{n} long" for n in FIGURES))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def binomial_cdf(k: int, n: int, p: float) -> float:
    """Chance of at most ``k`` of ``n``, summed from the ``k``-th term down until terms no longer count."""
    if k >= n:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total = term
    for i in range(k, 0, -1):
        term *= i * (1 - p) / ((n - i + 1) * p)
        total += term
        if i < n * p and term <= total * 1e-17:
            break
    return min(total, 1.0)


def upper_bound(k: int, n: int, error: float) -> float:
    """The exact (Clopper-Pearson) upper confidence bound of a rate of which ``k`` of ``n`` were seen."""
    low, high = k / n if n else 0.0, 1.0
    for _ in range(60 if k < n else 0):
        mid = (low + high) / 2
        low, high = (mid, high) if binomial_cdf(k, n, mid) > error else (low, mid)
    return high


def thresholds(rows: DataFrame, good: DataFrame, stratum: str, rules: tuple[Rule, ...] = RULES, rate: float = RATE, error: float = ERROR) -> DataFrame:
    """stratum, rule (its place), level, n, rejected and bound: the strictest certified cutoff of each rule, where there is one.

    ``rows`` holds the figures and the stratum of all rows, of which ``strata`` are counted for the correction; ``good``
    those of labelled good rows. A null stratum is one of its own. ``bound`` is the upper bound of the rate at which the
    rule rejects good rows there. Each stratum's counts, few whatever its size, are one group.
    """
    strata = max(1, rows.groupBy(stratum).agg(F.lit(1).alias("one")).count())
    each, chance = rate / len(rules), error / (len(rules) * strata)
    levels = F.array(*[F.struct(F.lit(r).alias("rule"), sum((F.lit(0) + rule.rejects(c).cast("int") for c in rule.cutoffs), F.lit(0)).alias("hit")) for r, rule in enumerate(rules)])
    counts = good.select(F.col(stratum).alias("stratum"), F.explode(levels).alias("x")).groupBy("stratum", "x.rule", "x.hit").agg(F.count(F.lit(1)).alias("n"))
    sizes = tuple(len(r.cutoffs) for r in rules)
    kind = rows.schema[stratum].dataType.simpleString()

    def choose(found: pd.DataFrame) -> pd.DataFrame:
        out = []
        for rule, size in enumerate(sizes):
            own = found[found["rule"] == rule]
            n = int(own["n"].sum())
            # A row beyond h of the cutoffs is beyond the h strictest ones.
            hits = dict(zip(own["hit"].tolist(), own["n"].tolist()))
            best = None
            for level in range(size):
                k = sum(c for h, c in hits.items() if h >= size - level)
                if n == 0 or binomial_cdf(k, n, each) > chance:
                    break
                best = (found["stratum"].iloc[0], rule, level, n, k, upper_bound(k, n, chance))
            out += [best] if best else []
        return pd.DataFrame(out, columns=["stratum", "rule", "level", "n", "rejected", "bound"])

    return counts.groupBy("stratum").applyInPandas(choose, f"stratum {kind}, rule int, level int, n long, rejected long, bound double")


def judge(rows: DataFrame, chosen: DataFrame, stratum: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``rows`` with base_failed, and kept: false where the base or a certified rule of the row's stratum rejects it."""
    plan = chosen.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "level"))).alias("levels"))
    plan = materialize(plan.withColumnRenamed("stratum", "plan_of"))
    plan = F.broadcast(plan) if plan.count() <= FEW else plan
    joined = rows.join(plan, F.col(stratum).eqNullSafe(F.col("plan_of")), "left")
    rejected = F.lit(False)
    for r, rule in enumerate(rules):
        cutoff = F.get(F.array(*[F.lit(c) for c in rule.cutoffs]), F.try_element_at("levels", F.lit(r)))
        rejected = rejected | F.coalesce(rule.rejects(cutoff), F.lit(False))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected).drop("plan_of", "levels")


def passed(docs: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, rate: float = RATE, error: float = ERROR) -> DataFrame:
    """doc_id, lang, the figures, base_failed and kept for each row of ``docs``, by cutoffs certified for each lang.

    ``labels`` (doc_id, quality) name the holdout: rows that the base keeps and whose labels, nulls aside, are all 1; a
    document without a label, or with a null doc_id, is in none. Repeated rows count as often as they occur. Where a
    stratum has too few good rows to certify any cutoff (with the defaults and four strata about 1 320 for each rule)
    its rows are judged by the base alone. Texts without words, null ones too, fail the base.
    """
    rows = materialize(figures(docs, "doc_id", "lang"))
    marks = labels.groupBy(F.col("doc_id").alias("marked")).agg(F.min("quality").alias("least")).where("least = 1")
    good = rows.where(~base_failed()).join(marks, F.col("doc_id") == F.col("marked")).drop("marked", "least")
    return judge(rows, thresholds(rows, good, "lang", rules, rate, error), "lang", rules)
