"""Records stored in buckets of their id, looked up through an index."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.sources.store import shared_root

BUCKETS = 32
FEW = 1000  # entries up to this count are looked up by value, which reads only their buckets


def store(records: DataFrame, buckets: int = BUCKETS) -> str:
    """Write ``records`` (id, ...) as a table in buckets by id, sorted in each, and give its name."""
    name = f"records_{uuid.uuid4().hex}"
    path = f"{shared_root(records.sparkSession)}/{name}"
    placed = records.repartition(buckets, "id").sortWithinPartitions("id")
    placed.write.format("parquet").bucketBy(buckets, "id").sortBy("id").option("path", path).saveAsTable(name)
    return name


def indexed_range(index: DataFrame, low, high) -> DataFrame:
    """Entries of ``index`` (id, score) with a score from ``low`` to ``high``, both included."""
    return index.where(F.col("score").between(low, high))


def multi_get(index: DataFrame, table: str) -> DataFrame:
    """The records of ``index`` (id, score) that ``table`` holds, with their score; ids without a record give no row.

    The table keeps its buckets: only the index is shuffled (or broadcast, where Spark finds it small) to meet them.
    """
    records = index.sparkSession.table(table)
    wanted = index.select(F.col("id").alias("wanted"), "score")
    return wanted.join(records, F.col("wanted") == F.col("id")).drop("wanted")


def by_ids(spark: SparkSession, table: str, ids: list) -> DataFrame:
    """The records of a few ids; only the files of their buckets are read."""
    return spark.table(table).where(F.col("id").isin(ids))


def get(index: DataFrame, table: str) -> DataFrame:
    """``multi_get`` for a request of a few ids, whose values prune the table to their buckets; more are joined."""
    entries = index.select("id").limit(FEW + 1).collect()
    if len(entries) > FEW:
        return multi_get(index, table)
    records = by_ids(index.sparkSession, table, [r.id for r in entries])
    ids = index.select(F.col("id").alias("wanted"), "score")
    return records.join(F.broadcast(ids), F.col("wanted") == F.col("id")).drop("wanted")
