"""Corpus pipeline: toxicity, near duplicates, repeated passages, source mixing, byte-level BPE."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.llm import byte_bpe, jaccard_join, mixing, substring_dedup, toxicity
from inkstream.llm.common import fresh, materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from ``labels``, doesn't reject."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group that five-word shingles link at a similarity of 0.8 or more.

    Documents without words, and those with a null doc_id and no link, are groups of their own. Where rows repeat a kept
    doc_id, all of them stay; where they repeat that of a row that goes, each goes by its own text.
    """
    groups = jaccard_join.join(docs, jaccard_join.Rule(n=5, num=80, den=100), "key")
    name = fresh("gone", docs.columns)
    later = groups.where("doc_id <> component_id OR (doc_id IS NULL AND component_id IS NOT NULL)")
    gone = materialize(later.select(F.col("key").alias(name)).distinct())
    return docs.join(gone, jaccard_join.row_key() == F.col(name), "left_anti")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the sentences that repeat earlier ones; n_chars follows the text. Emptied documents go."""
    out = substring_dedup.deduplicate(docs)
    removed = F.col(out.columns[-1])
    length = F.when(removed > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    columns = [length if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return out.where((removed == 0) | (F.length(F.trim("text")) > 0)).select(*columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: once at least, and the smaller sources up to twice."""
    out = mixing.mix(docs)
    copies = F.col(out.columns[len(docs.columns) + 2])
    times = F.explode(F.sequence(F.lit(1), copies)).alias(fresh("copy", docs.columns))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], times).select(*[F.col(f"`{c}`") for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's ids and of the bytes they decode to."""
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Model scores, sentence runs and BPE merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each but the last written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
