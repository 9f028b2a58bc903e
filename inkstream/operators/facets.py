"""Counts of facet values under a selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALL = "All"


def _met(name: str, chosen: str | None, many: bool) -> Column:
    if chosen in (None, ALL):
        return F.lit(True)
    found = F.array_contains(name, chosen) if many else F.col(name).cast("string") == chosen
    return F.coalesce(found, F.lit(False))


def selected(rows: DataFrame, scalars: list[str], array: str | None, chosen: dict[str, str]) -> DataFrame:
    """``rows`` that meet the chosen value of every facet; ``All``, or none chosen, lets every row pass."""
    met = F.lit(True)
    for name in [*scalars, *([array] if array else [])]:
        met = met & _met(name, chosen.get(name), name == array)
    return rows.where(met)


def counts(rows: DataFrame, scalars: list[str], array: str | None, chosen: dict[str, str]) -> DataFrame:
    """(facet, value, n, picked) for every value of every facet: the rows that the *other* facets' choices leave.

    One pass: a grouping set for each facet. Where there is an array facet, a row is there once for each distinct value
    of it, of which only the first counts for the scalar facets. Values are text; a null is a value of a scalar facet,
    and an empty or null array has none. Values that the others' choices leave no row are told with 0.
    """
    facets = [*scalars, *([array] if array else [])]
    met = {f: _met(f, chosen.get(f), f == array) for f in facets}
    flags = []
    for facet in facets:
        others = F.lit(True)
        for name in facets:
            others = others & met[name] if name != facet else others
        flags.append(others.cast("long").alias(f"__m_{facet}"))
    values = [F.col(s).cast("string").alias(f"__v_{s}") for s in scalars]
    if array:
        slim = rows.select(*values, *flags, F.posexplode_outer(F.array_distinct(array)).alias("__pos", f"__v_{array}"))
    else:
        slim = rows.select(*values, *flags, F.lit(0).alias("__pos"))
    first = F.coalesce(F.col("__pos"), F.lit(0)) == 0
    sets = [[F.col(f"__v_{f}")] for f in facets]
    of = {f: F.sum(F.col(f"__m_{f}") if f == array else F.when(first, F.col(f"__m_{f}")).otherwise(0)).alias(f"__n_{f}") for f in facets}
    real = F.sum(F.col("__pos").isNotNull().cast("long")).alias("__real")
    ids = [F.grouping(f"__v_{f}").alias(f"__g_{f}") for f in facets]
    grouped = slim.groupingSets(sets, *[F.col(f"__v_{f}") for f in facets]).agg(*of.values(), real, *ids)
    pick = lambda kind: F.coalesce(*[F.when(F.col(f"__g_{f}") == 0, F.col(f"__{kind}_{f}")) for f in facets])
    name = F.coalesce(*[F.when(F.col(f"__g_{f}") == 0, F.lit(f)) for f in facets])
    out = grouped.select(name.alias("facet"), pick("v").alias("value"), F.coalesce(pick("n"), F.lit(0)).alias("n"), "__real")
    if array:
        out = out.where((F.col("facet") != array) | (F.col("__real") > 0))
    picked = F.lit(False)
    for f in facets:
        if chosen.get(f) not in (None, ALL):
            picked = picked | ((F.col("facet") == f) & F.col("value").eqNullSafe(F.lit(chosen[f])))
    return out.select("facet", "value", "n", picked.alias("picked"))
