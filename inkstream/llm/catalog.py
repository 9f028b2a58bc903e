"""The queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.llm import avi, byte_bpe, jaccard_join, lm_scoring, merkle, mixing, oracle, order_minhash, quality_rules, spelling, substring_dedup, token_files, toxicity, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the sentences that repeat earlier ones, and how many it had and lost. Null texts stay null."""
    out = substring_dedup.deduplicate(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__sentences").alias("n_sentences"), F.col("__removed").alias("n_removed"), "text")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and component under links of 0.9 over three-word shingles. Texts without words link with nothing."""
    return jaccard_join.join(_read(spark, sf_dir, "documents"), jaccard_join.Rule(n=3, num=90, den=100))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, length and checksum of every document's ids, read back from bit-packed files. A null text has the end id alone."""
    docs = _read(spark, sf_dir, "documents")
    return token_files.token_files(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1).drop("file")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document's ids and of the bytes they decode to. A null text is an empty one."""
    docs = _read(spark, sf_dir, "documents")
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record as read back from archives: the response of the smallest page_id, or a revisit of it. Null html is empty."""
    return warc.archive(_read(spark, sf_dir, "pages")).drop("url")


def op10_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, digests and feature of every text stored as motion JPEG and read back. A null text is an empty one."""
    media = avi.media_column(_read(spark, sf_dir, "documents"), "doc_id")
    return avi.features(media, "doc_id", "n_bytes")


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited one, and their likeness. A null text is an empty one; equal texts have equal ones."""
    return order_minhash.fingerprints(_read(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of every document, learnt from those that are not held out. A null text has the end token alone."""
    return lm_scoring.score(_read(spark, sf_dir, "documents"), lm_scoring.held_out(F.col("doc_id")))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its source's weight and how often the mix takes it. A null source is one; texts without tokens are taken once."""
    out = mixing.mix(_read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "source", *[F.col(f"__{c}").alias(n) for c, n in (("tokens", "n_tokens"), ("weight", "weight"), ("copies", "copies"), ("block", "block"), ("place", "place"))])


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score and verdict, learnt from labels outside the held-out fold. Null and empty texts have a score too."""
    return toxicity.scored(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's figures, and whether the base and the cutoffs certified on ``labels`` keep it."""
    return quality_rules.passed(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of ``documents`` with its more frequent form and the root to which forms lead."""
    return spelling.variants(_read(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and root; where 3 divides the crc32 of its doc_id a lower-cased text is checked."""
    docs = _read(spark, sf_dir, "documents")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return merkle.check(merkle.manifest(docs, F.when(chosen, lowered)))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_token_files": op3_token_files,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_warc": op5_warc,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_mixing": op7_mixing,
    "op8_toxicity": op8_toxicity,
    "op9_order_minhash": op9_order_minhash,
    "op10_avi": op10_avi,
    "op11_quality_rules": op11_quality_rules,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op5_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        o AS (SELECT payload_digest, min(page_id) AS original FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT page_id, payload_bytes, p.payload_digest,
               CASE WHEN original IS NULL OR original = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN original <> page_id THEN original END AS refers_to
        FROM p LEFT JOIN o ON p.payload_digest = o.payload_digest
    """,
    "op11_quality_rules": oracle.quality_rules_sql(),
    "op12_spelling_variants": oracle.spelling_variants_sql(),
    "op13_merkle_manifest": oracle.merkle_manifest_sql(),
}
