"""Substring deduplication over sliding runs of sentences.

For each sentence the shortest runs of enough words that begin and that end there are hashed; they cover every longer run. Within a task only the first occurrence of a hash
goes on; the others are already known to be repeats. First occurrences are matched globally, and the sentences that any
repeat covers are cut from their documents. The first occurrence, by doc_id and place, stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.llm.common import fresh, materialize, partitions, ship, sliced, table, texts
from inkstream.llm.jaccard_join import mix

SENTENCES = 2  # fewest sentences of a run
WORDS = 8  # fewest words of a run
ALONE = 25  # a sentence of so many words is a run by itself
FIRST = -(1 << 63)
#: A sentence ends after a stop that white space follows, or at a line's end; white space belongs to what it follows.
BOUNDARY = re.compile(rb"(?<=[.!?])\s+|\s*\n\s*|(?<=\xe3\x80\x82)|(?<=\xef\xbc\x81)|(?<=\xef\xbc\x9f)")


def sentences(text: bytes) -> list[bytes]:
    """Consecutive pieces that make up ``text``."""
    cuts = [0, *(m.end() for m in BOUNDARY.finditer(text)), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:]) if a < b]


def runs(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First sentence, length and hash of the shortest runs: the fewest sentences that begin, and that end, at each sentence.

    Any run of several sentences with enough words is covered by such runs that lie inside it: a sentence too near its end
    for one that begins there is in the one that ends with the run's last sentence.
    """
    words = [x.lower().split() for x in pieces]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(w)) for w in words), np.uint64, len(words))
    total = np.concatenate([[0], np.cumsum(counts)])
    first = np.flatnonzero(counts > 0)
    length = np.maximum(np.searchsorted(total, total[first] + WORDS) - first, SENTENCES)
    length = np.where(counts[first] >= ALONE, 1, length)
    last = np.flatnonzero((counts > 0) & (counts < ALONE))  # before a longer one every sentence begins a run
    begin = np.minimum(np.searchsorted(total, total[last + 1] - WORDS, "right") - 1, last + 1 - SENTENCES)
    ahead = np.full(len(pieces), 0)
    ahead[first] = length
    new = begin >= 0
    new[new] = ahead[begin[new]] != (last + 1 - begin)[new]
    inside = first + length <= len(pieces)
    first, length = np.concatenate([first[inside], begin[new]]), np.concatenate([length[inside], (last + 1 - begin)[new]])
    value = np.zeros(len(first), np.uint64)
    for j in range(int(length.max(initial=0))):
        on = length > j
        value[on] = mix(value[on] * np.uint64(0x9E3779B97F4A7C15) + h[first[on] + j] + np.uint64(1))
    return first, length, value


def _spans(docs: DataFrame, parts: int) -> DataFrame:
    """Packed first occurrences by part of the hash space (spans), and packed repeats (part -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(held, axis=1)
            hashes, doc, key, at = rows[0].view(np.uint64), rows[1], rows[2], rows[3]
            order = np.lexsort((at, key, doc, hashes))
            rows, hashes, key, at = rows[:, order], hashes[order], key[order], at[order]
            new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
            own = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            again = ~new & ((key != key[own]) | (at != at[own]))  # a row that occurs twice is one row
            part = (hashes >> np.uint64(32)) % np.uint64(parts)
            kept = rows[:, new]
            by = np.argsort(part[new], kind="stable")
            cuts = np.searchsorted(part[new][by], np.arange(parts + 1, dtype=np.uint64)).tolist()
            for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if a < b:
                    yield table(part=pa.array([p], pa.int32()), spans=pa.array([kept[:, by[a:b]].tobytes()], pa.binary()))
            repeats = rows[2:, again]
            for a in range(0, repeats.shape[1], 100_000):
                yield table(part=pa.array([-1], pa.int32()), spans=pa.array([repeats[:, a : a + 100_000].tobytes()], pa.binary()))

        for batch in sliced(batches, "text"):
            for text, doc_id, key in zip(texts(batch), batch.column("doc_id").to_pylist(), batch.column("key").to_pylist()):
                first, length, value = runs(sentences(text))
                if len(first):
                    held.append(np.stack([value.view(np.int64), np.full(len(first), FIRST if doc_id is None else doc_id), np.full(len(first), key), first * 1024 + length]))
                    size += len(first)
            if size > 500_000:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return docs.mapInArrow(run, "part int, spans binary")


def _match(rows: pd.DataFrame) -> pd.DataFrame:
    """Occurrences that come after another of the same hash."""
    found = np.concatenate([np.frombuffer(x, np.int64).reshape(4, -1) for x in rows["spans"]], axis=1)
    hashes, doc, key, at = found
    order = np.lexsort((at, key, doc, hashes))
    hashes, key, at = hashes[order], key[order], at[order]
    new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
    own = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    again = (key != key[own]) | (at != at[own])
    return pd.DataFrame({"key": key[again], "at": at[again]})


def repeats(docs: DataFrame) -> DataFrame:
    """``key`` and the repeated runs (first sentence * 1024 + sentences) of each document that has any."""
    spark = docs.sparkSession
    size = docs.select(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    parts = max(partitions(spark), size // (16 << 20))
    spans = materialize(_spans(docs, parts))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("spans").to_pylist():
                key, at = np.frombuffer(x, np.int64).reshape(2, -1)
                yield table(key=pa.array(key), at=pa.array(at))

    local = spans.where("part < 0").select("spans").mapInArrow(unpack, "key long, at long")
    far = spans.where("part >= 0").repartition(parts, "part").groupBy("part").applyInPandas(_match, "key long, at long")
    return local.union(far).groupBy("key").agg(F.collect_set("at").alias("runs"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, its text without repeated sentences, and __sentences and __removed counts at the end.

    Rows that agree in doc_id and text are one document and are cut alike. A null text stays null, an empty one empty;
    a null doc_id comes before all others. A document may lose all its text. Where ``docs`` has a column of the counts'
    names, theirs have more underscores.
    """
    ship(docs.sparkSession)
    names = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != "text"}
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], "text", F.xxhash64("doc_id", "text").alias("key"))
    cut = materialize(repeats(renamed.select(F.col(names["doc_id"]).alias("doc_id"), "text", "key")).withColumnRenamed("key", "cut"))
    joined = renamed.join(cut, F.col("key") == F.col("cut"), "left").drop("key", "cut")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            out, counts, lost = [], [], []
            for text, runs_of in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("runs").to_pylist()):
                pieces = sentences(text or b"")
                gone = np.zeros(len(pieces), bool)
                for at in runs_of or ():
                    gone[at // 1024 : at // 1024 + at % 1024] = True
                counts.append(len(pieces))
                lost.append(int(gone.sum()))
                out.append(text if not lost[-1] else b"".join(p for p, g in zip(pieces, gone.tolist()) if not g))
            kept = {c: batch.column(c) for c in batch.schema.names if c not in ("text", "runs")}
            yield table(**kept, text=pa.array(out, pa.binary()).cast(pa.string()), sentences=pa.array(counts, pa.int64()), removed=pa.array(lost, pa.int64()))

    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in joined.schema if f.name not in ("text", "runs"))
    done = joined.mapInArrow(apply, f"{fields}text string, sentences long, removed long")
    ends = [F.col(c).alias(fresh(f"__{c}", docs.columns)) for c in ("sentences", "removed")]
    return done.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns], *ends)
