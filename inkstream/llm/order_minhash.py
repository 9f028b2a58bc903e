"""Order MinHash fingerprints, sensitive to edit distance.

The k-mers of a text are numbered by occurrence, so that repeats count. Each numbered k-mer has a random rank; the rank
space is cut into ``SLOTS`` slots. In every slot the ``LENGTH`` k-mers of smallest rank are kept in the order in which
they stand in the text, and the hash of that tuple is the slot's part of the fingerprint. One pass over the ranks thus
serves all slots. Two fingerprints are as alike as the share of filled slots in which they agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.llm.common import doc_rows, partitions, ship, sliced, table

K = 5
SLOTS = 64
LENGTH = 2
FIRST = -(1 << 63)
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def kmers(codes: np.ndarray) -> np.ndarray:
    """Hash of each k-mer; a shorter text is one k-mer."""
    n = len(codes) - K + 1
    if n < 1:
        codes, n = np.pad(codes, (0, K - len(codes))), 1
    h = np.zeros(n, np.uint64)
    for j in range(K):
        h = h * ODD + codes[j : j + n]
    return mix(h)


def fingerprint(text: str) -> np.ndarray:
    """``SLOTS`` 16-bit values; a text without characters has 0 in all."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    if not len(codes):
        return np.zeros(SLOTS, np.uint16)
    h = kmers(codes)
    where = np.arange(len(h), dtype=np.uint64)
    position = np.argsort(h, kind="stable")  # equal k-mers meet, in text order
    kmer = h[position]
    start = np.ones(len(h), bool)
    start[1:] = kmer[1:] != kmer[:-1]
    occurrence = where - np.maximum.accumulate(np.where(start, where, np.uint64(0)))
    rank = mix(kmer * ODD + occurrence + np.uint64(1))
    shift = np.uint64(64 - (SLOTS - 1).bit_length())
    likely = 12 * LENGTH * SLOTS
    best = None
    if len(h) > 2 * likely:  # enough to rank those that are small in their slot
        inside = rank << np.uint64((SLOTS - 1).bit_length())
        best = np.flatnonzero(inside < np.uint64(int(likely / len(h) * 2**64)))
        if np.bincount((rank[best] >> shift).astype(np.int64), minlength=SLOTS).min() < LENGTH:
            best = None
    if best is None:
        best = np.arange(len(h))
    best = best[np.argsort(rank[best], kind="stable")]
    slot = (rank[best] >> shift).astype(np.int64)
    first = np.searchsorted(slot, np.arange(SLOTS + 1))
    value = np.zeros(SLOTS, np.uint64)
    chosen = np.stack([best[np.minimum(first[:-1] + i, len(best) - 1)] for i in range(LENGTH)])
    thin = np.flatnonzero(np.diff(first) < LENGTH)
    if len(thin):
        own = mix(rank[None, :] ^ mix(thin.astype(np.uint64) + np.uint64(1))[:, None])
        least = np.argsort(own, axis=1, kind="stable")[:, :LENGTH]
        chosen[:, thin] = least.T if len(h) >= LENGTH else least[:, [0] * LENGTH].T
    order = np.argsort(position[chosen], axis=0, kind="stable")
    for row in np.take_along_axis(kmer[chosen], order, 0):
        value = mix(value * ODD + row + np.uint64(1))
    return (value % np.uint64(65535) + np.uint64(1)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of slots filled in either in which both agree; two empty texts are alike."""
    filled = (a > 0) | (b > 0)
    n = int(filled.sum())
    return float((a[filled] == b[filled]).sum() / n) if n else 1.0


def with_next(docs: DataFrame, groups: int) -> DataFrame:
    """Rows (bucket, tail, doc_id, text) sorted so that each row is followed by that of the next doc_id.

    Buckets are ranges of doc_id that begin at rows of the table; a bucket's first row is also sent, as ``tail``, to
    the end of the bucket before, and the first of all to the end of the last. Only the cuts come to the driver.
    """
    docs = doc_rows(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(FIRST)).alias("key"))
    spread = [i / groups for i in range(groups)]
    row = docs.agg(F.min("key").alias("low"), F.percentile_approx("key", spread, 20 * groups).alias("cuts")).first()
    cuts = np.array(sorted({row.low, *row.cuts}) if row.low is not None else [0], np.int64)

    @F.pandas_udf("struct<bucket: int, before: int>")
    def place(key: pd.Series) -> pd.DataFrame:
        k = key.to_numpy(np.int64)
        bucket = np.maximum(np.searchsorted(cuts, k, "right") - 1, 0)
        return pd.DataFrame({"bucket": bucket, "before": np.where(cuts[bucket] == k, (bucket - 1) % len(cuts), -1)})

    placed = docs.withColumn("at", place("key"))
    own = F.struct(F.col("at.bucket").alias("bucket"), F.lit(False).alias("tail"))
    tail = F.struct(F.col("at.before").alias("bucket"), F.lit(True).alias("tail"))
    copies = placed.select("key", "doc_id", "text", F.explode(F.when(F.col("at.before") >= 0, F.array(own, tail)).otherwise(F.array(own))).alias("to"))
    return copies.select("to.bucket", "to.tail", "key", "doc_id", "text").repartition(partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket", "tail", "key", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of each text, of the text with its last quarter replaced from the next document, and likenesses.

    The next document is that of the next doc_id (rows of equal doc_id: in order of their texts; null: before all), and
    after the last one the first. A null text counts as empty.
    """
    ship(docs.sparkSession)

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = text = mark = doc_id = None
        for batch in sliced(batches, "text"):
            out = []
            for row in batch.to_pylist():
                if row["bucket"] == bucket and mark is not None:
                    following = fingerprint(row["text"])
                    n = len(text) // 4
                    edited = text[: len(text) - n] + row["text"][:n]
                    new = fingerprint(edited) if n else mark
                    out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), mark.astype(">u2").tobytes().hex(), new.astype(">u2").tobytes().hex(), likeness(mark, new), likeness(mark, following)))
                elif row["tail"]:
                    continue
                else:
                    following = fingerprint(row["text"])
                bucket, doc_id, text, mark = row["bucket"], row["doc_id"], row["text"], None if row["tail"] else following
            columns = zip(*out) if out else ((),) * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield table(**{name: pa.array(c, kind) for name, c, kind in zip(NAMES, columns, kinds)})

    return with_next(docs, 4 * partitions(docs.sparkSession)).mapInArrow(marks, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


NAMES = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
