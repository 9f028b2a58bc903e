"""What a draft's citations amount to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.operators.clusters import TIER_WEIGHT, by_tier

#: The weight that suffices alone, and the sources that suffice together.
STRONG, SEVERAL = 0.8, 2
#: Weight of each tier, and its name, where one leads a summary.
LEAD_WEIGHT = (5, 4, 4, 3, 2)
LEAD_NAME = ("Official source", "National press", "Institutional research", "Regional press", "Industry source")
NONE_REGISTERED = "no registered source"
UNCORROBORATED = "one weak source"


def gate(cited: DataFrame) -> DataFrame:
    """(draft, hits, top, ok, reason) from (draft, tier); a null tier is an unregistered source."""
    weight = by_tier(TIER_WEIGHT, F.col("tier"))
    rows = cited.groupBy("draft").agg(F.count("tier").alias("hits"), F.coalesce(F.max(weight), F.lit(0.0)).alias("top"))
    weak = (F.col("top") < STRONG) & (F.col("hits") < SEVERAL)
    reason = F.when(F.col("hits") == 0, NONE_REGISTERED).when(weak, UNCORROBORATED)
    return rows.select("draft", "hits", "top", reason.isNull().alias("ok"), reason.alias("reason"))


def summary(cited: DataFrame) -> DataFrame:
    """(draft, sources, lead, label, limited) from (draft, place, tier): the lead is of the highest weight, then first."""
    weight = by_tier(LEAD_WEIGHT, F.col("tier"))
    best = F.max(F.when(F.col("tier").isNotNull(), F.struct(weight.alias("w"), (-F.col("place")).alias("p"), F.col("tier").alias("tier"))))
    rows = cited.groupBy("draft").agg(F.count(F.lit(1)).alias("sources"), best.alias("best")).withColumn("lead", F.col("best.tier"))
    name = F.coalesce(by_tier(LEAD_NAME, F.col("lead")), F.lit("Source links"))
    label = F.when(F.col("sources") == 1, F.concat(name, F.lit(" · single source"))).otherwise(F.concat(F.col("sources").cast("string"), F.lit(" sources · "), F.lower(name), F.lit(" led")))
    limited = (F.col("sources") < 2) & F.coalesce(F.col("lead") >= 3, F.lit(True))
    return rows.select("draft", "sources", "lead", label.alias("label"), limited.alias("limited"))
