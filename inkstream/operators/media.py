"""Media for articles, no picture twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.sources.store import written


def assign(own: DataFrame, candidates: DataFrame) -> DataFrame:
    """(article, src): what a scan would give that first hands out own media, then candidates.

    ``own``: article, place, src (null for none); of articles with the same own picture the first keeps it. The others
    go by their number of candidates (article, rank, src), fewest first, then by place; each takes, of its candidates
    that are still free, the one that the fewest of them have, then the first ranked. As all pictures prefer articles
    in the same order, that is what offers and refusals in rounds end in: every article asks for its best picture that
    hasn't refused it, and a picture refuses all but the first that asks. Rounds end when no picture refuses; each that
    doesn't end takes a candidate from an article, so they do end.
    """
    kept = own.where(F.col("src").isNotNull()).groupBy("src").agg(F.min(F.struct("place", "article")).alias("f")).select(F.col("f.article").alias("article"), "src")
    kept = written(kept)
    open_ = own.join(kept.select(F.col("article").alias("k")), F.col("article") == F.col("k"), "left_anti").select("article", "place")
    wanted = candidates.join(open_.withColumnRenamed("article", "o"), F.col("article") == F.col("o")).drop("o").dropDuplicates(["article", "src"])
    often = wanted.groupBy(F.col("src").alias("s")).agg(F.count(F.lit(1)).alias("often"))
    many = wanted.groupBy(F.col("article").alias("a")).agg(F.count(F.lit(1)).alias("many"))
    ranked = wanted.join(often, F.col("src") == F.col("s")).join(many, F.col("article") == F.col("a"))
    ranked = ranked.select("article", "src", F.struct("many", "place").alias("turn"), F.struct("often", "rank", F.col("src").alias("last")).alias("liking"))
    left = written(ranked.join(kept.select(F.col("src").alias("k")), F.col("src") == F.col("k"), "left_anti"))
    while True:
        asked = left.groupBy("article", "turn").agg(F.min("liking").alias("best")).select("article", "turn", F.col("best.last").alias("src"))
        held = asked.groupBy(F.col("src").alias("h")).agg(F.min("turn").alias("first"))
        refused = left.join(held, (F.col("src") == F.col("h")) & (F.col("turn") > F.col("first")), "left")
        if refused.where("h IS NOT NULL").isEmpty():
            return kept.union(asked.select("article", "src"))
        left = written(refused.where("h IS NULL").drop("h", "first"))
