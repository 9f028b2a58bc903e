"""Runs and drafts as JSON files: partitioned writes that replace only what they touch, with a log from the same pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from inkstream.sources.store import written

LOG = "fetch-log"
SLOTS = 64  # parts of the draft store; a save writes the parts of its slugs again


def _replace(rows: DataFrame, folder: str, *by: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).json(folder)


def save_run(clusters: DataFrame, folder: str, day: str, **figures: Column) -> dict:
    """Write a run's ``clusters`` below ``folder`` in the part of its ``day``, and its log beside; other days stay.

    The log holds the rows written and ``figures``, aggregates observed while they are written, so nothing is read
    twice. A day that is saved again is replaced, log and all.
    """
    seen = Observation()
    watched = clusters.withColumn("run_day", F.lit(day)).observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in figures.items()])
    _replace(watched, f"{folder}/clusters", "run_day")
    log = {"run_day": day, **seen.get}
    kinds = ", ".join(f"{n} {'string' if n == 'run_day' else 'double' if isinstance(v, float) else 'bigint'}" for n, v in log.items())
    _replace(clusters.sparkSession.createDataFrame([tuple(log.values())], kinds), f"{folder}/{LOG}", "run_day")
    return log


def read_runs(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Clusters of all runs with their ``run_day``, which a filter prunes to its folders."""
    return spark.read.schema(f"{schema}, run_day string").json(f"{folder}/clusters")


def read_logs(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, run_day string").json(f"{folder}/{LOG}")


def _slot() -> Column:
    return F.pmod(F.xxhash64("slug"), F.lit(SLOTS)).alias("slot")


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def save_drafts(drafts: DataFrame, folder: str) -> None:
    """Keep ``drafts`` (slug, saved_ms, ...) by slug: the last save wins, of equal times the one with the largest other columns.

    Slugs lie in ``SLOTS`` parts. Only the parts that hold a slug of ``drafts`` are read, joined with the new rows and
    written again; the others' files aren't touched. A null slug is left out.
    """
    spark = drafts.sparkSession
    others = [c for c in drafts.columns if c not in ("slug", "saved_ms")]
    new = written(drafts.where("slug IS NOT NULL").select("*", _slot()))
    if _exists(spark, folder):
        held = spark.read.schema(new.schema).json(folder)
        slots = [r.slot for r in new.select("slot").distinct().collect()]  # ``SLOTS`` at most
        new = new.unionByName(held.where(F.col("slot").isin(slots)))
    last = new.groupBy("slot", "slug").agg(F.max(F.struct("saved_ms", *others)).alias("d"))
    _replace(written(last.select("slug", "d.saved_ms", *[f"d.{c}" for c in others], "slot")), folder, "slot")


def read_drafts(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All drafts below ``folder``; none where there is no folder yet."""
    if not _exists(spark, folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(folder)
