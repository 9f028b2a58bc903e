"""Connected components of a link table, without bringing links or components to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.llm.common import materialize, release


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node`` and ``root``, the smallest node reachable, for each node of ``links`` (a, b).

    Alternating star contraction: every node's larger neighbours, then its smaller ones, are tied to its smallest
    neighbour, until the links are stars. Each round is a written table, and its groups are aggregated before they are
    shuffled, so a node with very many links is no single task. Null ends and loops are left out.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(most_rounds):
        last = edges
        edges = materialize(_star(_star(edges, larger=True), larger=False))
        release(last)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the links did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Tie each node's larger (else smaller) neighbours to the smallest node among it and its neighbours."""
    both = edges.union(edges.select("v", "u")) if larger else edges
    low = both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("n"), F.least("u", "v").alias("low"))
    tied = both.join(low, F.col("u") == F.col("n"))
    if larger:
        out = tied.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("low").alias("v")).union(low.select("n", "low"))
    return out.where("u <> v").distinct()
