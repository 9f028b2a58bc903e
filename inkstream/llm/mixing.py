"""Temperature mixing of sources.

A source's weight is its share of all tokens to the power a, normalised. The exponent is bisected until the weights
reach a target entropy, or until no source needs more passes than a limit. Weights are realised as token budgets: whole
passes over a source and one part of a pass, taken from a permutation of its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkstream.llm.common import fresh, materialize

BLOCK_TOKENS = 1 << 20
WAYS = 32  # exponents tried at once


def tokens_of(text: Column) -> Column:
    """White-space separated words; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def shares(docs: DataFrame) -> DataFrame:
    """source, docs, tokens and share of each source. A null source is a source of its own; ones without tokens have share 0."""
    sums = materialize(docs.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens")))
    total = max(1, sums.agg(F.sum("tokens").alias("n")).first().n or 0)
    return sums.select("*", (F.col("tokens") / F.lit(float(total))).alias("share"))


def exponent(table: DataFrame, entropy: float | None = None, passes: float | None = None) -> float:
    """The largest exponent in 0 to 1 that meets the targets.

    ``entropy``: the weights have at least this share of the entropy of equal weights. ``passes``: the least exponent at
    which a budget that covers the most reduced source once asks for at most so many passes of any other. Where both are
    given, the passes have precedence. Each round aggregates all candidates in one job, so sources stay distributed.
    """
    p = F.col("share")
    live = table.where("share > 0")
    count = live.count()
    if count < 2:
        return 1.0

    def search(good, low: float, high: float) -> float:
        """``good`` holds from ``low`` up to some point."""
        for _ in range(5):
            step = (high - low) / WAYS
            tried = [low + step * (i + 1) for i in range(WAYS)]
            row = live.agg(*[good(a).alias(f"g{i}") for i, a in enumerate(tried)]).first()
            ok = [i for i in range(WAYS) if row[i]]
            low, high = (tried[ok[-1]] if ok else low), (tried[ok[-1] + 1] if ok and ok[-1] + 1 < WAYS else high if ok else tried[0])
            if high <= low:
                break
        return low

    def spread(a: float) -> Column:
        total = F.sum(F.pow(p, F.lit(a)))
        return F.log(total) - a * F.sum(F.pow(p, F.lit(a)) * F.log(p)) / total >= F.lit(entropy) * F.log(F.lit(float(count)))

    def frugal(b: float) -> Column:
        """Passes needed at exponent 1 - b, in ratio to those of the largest source: (p / largest) ** -b at most."""
        return F.pow(F.min(p) / F.max(p), F.lit(-b)) <= F.lit(passes)

    best = 1.0 if entropy is None else search(spread, 0.0, 1.0)
    return best if passes is None else max(best, 1.0 - search(frugal, 0.0, 1.0))


def mix(docs: DataFrame, entropy: float | None = 0.9, passes: float | None = 2.0, seed: int = 0) -> DataFrame:
    """All columns of ``docs`` with tokens, weight, copies, block and place.

    The budget is the least that takes every document once: the most reduced source gets one pass. Every other source
    gets budget * weight tokens: ``copies`` of all its documents, and one more of those whose block comes first in the
    source's permutation until the rest of its budget is used; of the block in which it ends, documents in hashed order.
    Documents without tokens are taken once. ``place`` orders a pass: block by block in permuted order. The added
    columns come last, as __tokens, __weight, __copies, __block and __place; where ``docs`` has one of these names the
    added one has more underscores.
    """
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("source"), tokens_of(F.col("text")).alias("n_tokens"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"))
    slim = materialize(rows.select("source", "n_tokens", "h"))
    table = shares(slim)
    a = exponent(table, entropy, passes)
    power = F.when(F.col("share") > 0, F.pow("share", F.lit(a))).otherwise(0.0)
    powers = table.withColumn("power", power)
    sums = powers.agg(F.sum("power").alias("total"), F.min(F.when(F.col("share") > 0, F.col("power") / F.col("share"))).alias("least")).first()
    weights = powers.withColumn("weight", F.col("power") / F.lit(max(1e-300, sums.total or 0.0)))
    want = F.when(F.col("share") > 0, F.col("power") / F.col("share")).otherwise(F.lit(sums.least or 1.0))
    weights = weights.withColumn("passes", F.greatest(F.lit(1.0), F.round(want / F.lit(sums.least or 1.0), 9)))
    plan = materialize(weights.select(F.col("source").alias("s"), "weight", F.floor("passes").cast("int").alias("whole"), F.floor((F.col("passes") - F.floor("passes")) * F.col("tokens")).cast("long").alias("rest"), F.ceil(F.greatest(F.lit(1), F.col("tokens")) / BLOCK_TOKENS).alias("blocks")))
    block = F.floor(F.pmod(F.col("h"), F.lit(1 << 40)) / F.lit(float(1 << 40)) * F.col("blocks")).cast("long")
    blocks = slim.join(plan, F.col("source").eqNullSafe(F.col("s"))).withColumn("block", block)
    blocks = blocks.groupBy("s", "block").agg(F.sum("n_tokens").alias("tokens"), F.first("rest").alias("rest"))
    order = W.partitionBy("s").orderBy(F.xxhash64(F.lit(seed), "s", "block"), "block")
    taken = blocks.withColumn("turn", F.row_number().over(order)).withColumn("before", F.sum("tokens").over(order) - F.col("tokens"))
    taken = materialize(taken.select("s", "block", "turn", F.least(F.greatest(F.col("rest") - F.col("before"), F.lit(0)), F.col("tokens")).alias("take"), F.col("tokens").alias("block_tokens")))
    plan_of_block = taken.join(plan, taken["s"].eqNullSafe(plan["s"])).select(taken["s"].alias("s"), "block", "turn", "take", "block_tokens", "weight", "whole", "blocks")
    plan_of_block = materialize(plan_of_block)
    marked = rows.join(plan.select("s", "blocks"), F.col("source").eqNullSafe(F.col("s"))).withColumn("b", block).drop("s", "blocks")
    marked = marked.join(plan_of_block, F.col("source").eqNullSafe(F.col("s")) & (F.col("b") == F.col("block")))
    part = (F.col("take") > 0) & (F.col("take") < F.col("block_tokens"))
    edge = marked.where(part).select("s", "block", "h", "n_tokens")
    edge = edge.groupBy("s", "block", "h").agg(F.sum("n_tokens").alias("t"))
    inside = W.partitionBy("s", "block").orderBy("h")
    edge = materialize(edge.withColumn("upto", F.sum("t").over(inside)).select(F.col("s").alias("es"), F.col("block").alias("eb"), F.col("h").alias("eh"), "upto"))
    marked = marked.join(edge, part & F.col("source").eqNullSafe(F.col("es")) & (F.col("b") == F.col("eb")) & (F.col("h") == F.col("eh")), "left")
    more = F.when(F.col("n_tokens") == 0, 0).when(F.col("take") == 0, 0).when(F.col("take") == F.col("block_tokens"), 1).otherwise((F.col("upto") <= F.col("take")).cast("int"))
    ends = {
        "__tokens": F.col("n_tokens"), "__weight": F.col("weight"), "__copies": F.when(F.col("n_tokens") == 0, 1).otherwise(F.col("whole") + more).cast("int"),
        "__block": F.col("turn"), "__place": F.pmod(F.xxhash64("h"), F.lit(1 << 40)),
    }
    return marked.select(*[F.col(f"row.`{c}`").alias(c) for c in names], *[x.alias(fresh(n, names)) for n, x in ends.items()])
