"""Byte-level BPE by rank files: overlapping chunk pre-tokenisation, piece encoding and byte decoding.

A text is cut into chunks that overlap. Each chunk is split into pre-tokens on its own; where the boundary lists of two
neighbours meet inside their overlap, they are the same from there on, as a split depends only on where it starts and on
what follows. Texts of one chunk need no stitching and no shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.llm.common import doc_rows, partitions, ship, sliced, table, texts

CHUNK = 1 << 16  # code points that a chunk owns
OVERLAP = 1 << 10  # code points read beyond them
LOOK = 2  # boundaries this near to a chunk's cut end may depend on what was cut off
SHORT = 64  # bytes of a pre-token up to which those of one length are merged together
BATCH = 1 << 20  # bytes of text whose pre-tokens are encoded together


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encodes pre-tokens by merging the adjacent pair of lowest rank, and remembers up to ``limit`` of them."""

    def __init__(self, path: str, pattern: str, limit: int = 65_536):
        import regex

        self.ranks, self.limit, self.known = load_ranks(path), limit, {}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.bytes_of[rank] = piece
        self.pattern = regex.compile(pattern)
        self.none = len(self.bytes_of)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        halves = ((get(x[:i]), get(x[i:]), r) for get in [self.ranks.get] for x, r in self.ranks.items() for i in range(1, len(x)))
        pairs = sorted((a << 32 | b, r) for a, b, r in halves if a is not None and b is not None)
        self.pairs, self.merged = np.array([*pairs, ((1 << 63) - 1, self.none)], np.int64).T.copy()

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token. Neighbours are linked and pairs wait in a heap, so long pre-tokens stay near linear."""
        ranks, n = self.ranks, len(piece)
        if piece in ranks:
            return [ranks[piece]]
        left, right, end = list(range(-1, n - 1)), list(range(1, n + 1)), list(range(1, n + 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j >= n or end[j] != stop:
                continue
            alive[j], end[i], right[i] = False, stop, right[j]
            if right[i] < n:
                left[right[i]] = i
                if (r := ranks.get(piece[i : end[right[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[right[i]]))
            if left[i] >= 0 and (r := ranks.get(piece[left[i] : stop])) is not None:
                heapq.heappush(heap, (r, left[i], stop))
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the tokens that pairs of ids make; ``none`` where they make none."""
        pairs = left << 32 | right
        at = np.searchsorted(self.pairs, pairs)
        return np.where(self.pairs[at] == pairs, self.merged[at], self.none)

    def merge_alike(self, pieces: list[bytes]) -> Iterator[tuple[int, bytes]]:
        """Index and packed ids of ``pieces`` of one length, none of which is a token; all take their next merge at once.

        A merge takes one token from a row, so the rows that go on stay equally long.
        """
        ids = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8).reshape(len(pieces), -1)]
        ranks, at = self.rank_of(ids[:, :-1], ids[:, 1:]), np.arange(len(pieces))
        while True:
            first, n = ranks.argmin(1), ids.shape[1]
            low = ranks[np.arange(len(at)), first]
            done = low == self.none
            if done.any():
                packed = ids[done].astype("<u4").tobytes()
                yield from zip(at[done].tolist(), (packed[i : i + 4 * n] for i in range(0, len(packed), 4 * n)))
                ids, ranks, at, first, low = (x[~done] for x in (ids, ranks, at, first, low))
            if not len(at):
                return
            ids[np.arange(len(at)), first] = low
            places = np.arange(n)
            ids = ids[places != first[:, None] + 1].reshape(-1, n - 1)
            ranks = ranks[places[:-1] != first[:, None]].reshape(-1, n - 2)
            for side in (first - 1, first):
                some = np.flatnonzero((side >= 0) & (side < n - 2))
                i = side[some]
                ranks[some, i] = self.rank_of(ids[some, i], ids[some, i + 1])

    def learn(self, pieces: Iterable[str]) -> None:
        """Make the ids of all of ``pieces`` known."""
        known, alike = self.known, defaultdict(list)
        for piece in set(pieces).difference(known):
            raw = piece.encode()
            if raw in self.ranks or len(raw) > SHORT:
                ids = self.merge(raw)
                known[piece] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                alike[len(raw)].append((piece, raw))
        for group in alike.values():
            known.update((group[i][0], ids) for i, ids in self.merge_alike([raw for _, raw in group]))

    def encode_all(self, texts: list[list[str]]) -> list[bytes]:
        """Ids of each text, given as its pre-tokens, as little-endian unsigned 32-bit integers."""
        if len(self.known) > self.limit:
            self.known.clear()
        self.learn(chain.from_iterable(texts))
        return [b"".join(map(self.known.__getitem__, pieces)) for pieces in texts]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def ends(self, text: str) -> np.ndarray:
        """Where each pre-token of ``text`` ends."""
        return np.cumsum([len(x) for x in self.pattern.findall(text)], dtype=np.int64)


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def stitch(own: Codec, text: str, chunks: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
    """Pre-token ends of ``text`` from those of its chunks (start, stop, ends), all offsets in ``text``.

    Where a chunk and the true boundaries before it share one, they agree from there on. A chunk that shares none, as
    inside a very long pre-token, is split again from the last true boundary.
    """
    true, at = [np.zeros(1, np.int64)], 0
    for start, stop, ends in chunks:
        if not (start in true[-1] or len(np.intersect1d(true[-1], ends, assume_unique=True))):
            ends = at + own.ends(text[at:stop])
        safe = ends if stop == len(text) else ends[ends <= stop - LOOK]
        new = safe[safe > at]
        if len(new):
            true.append(new)
            at = int(new[-1])
    return np.concatenate(true[1:]) if len(true) > 1 else np.empty(0, np.int64)


def encode(docs: DataFrame, path: str, pattern: str, *keep: str) -> DataFrame:
    """``keep`` columns of each document with ``ids`` (little-endian unsigned 32-bit integers) and ``decoded`` bytes.

    A null or empty text has no ids. Repeated rows each give a row. Texts may be of any length.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    docs = doc_rows(docs, *keep, "text")
    kept = docs.select(*keep).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in sliced(batches, "text", BATCH):
            ids = own.encode_all([own.pattern.findall(x.decode()) for x in texts(batch)])
            yield table(**{c: batch.column(c) for c in keep}, ids=pa.array(ids, pa.binary()), decoded=pa.array(map(own.decode, ids), pa.binary()))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in sliced(batches, "text"):
            parts, starts = [x.decode() for x in texts(batch)], batch.column("start").to_pylist()
            yield table(
                **{c: batch.column(c) for c in ("row", *keep, "start")},
                stop=pa.array([s + len(x) for x, s in zip(parts, starts)], pa.int64()),
                owned=pa.array([x[:CHUNK] for x in parts], pa.string()),
                ends=pa.array([(own.ends(x) + s).tobytes() for x, s in zip(parts, starts)], pa.binary()),
            )

    def join_up(rows: pd.DataFrame) -> pd.DataFrame:
        own = codec(path, pattern)
        rows = rows.sort_values("start")
        text = "".join(rows["owned"])
        ends = stitch(own, text, [(s, e, np.frombuffer(x, np.int64)) for s, e, x in zip(rows["start"], rows["stop"], rows["ends"])])
        cuts = [0, *ends.tolist()]
        (ids,) = own.encode_all([[text[a:b] for a, b in zip(cuts, cuts[1:])]])
        return rows.iloc[:1][list(keep)].assign(ids=[ids], decoded=[own.decode(ids)])

    schema = f"{fields}, ids binary, decoded binary"
    long = F.coalesce(F.length("text"), F.lit(0)) > CHUNK + OVERLAP
    chunked = (
        docs.where(long)
        .withColumn("row", F.expr("uuid()"))
        .withColumn("start", F.explode(F.sequence(F.lit(0), F.length("text").cast("long") - 1, F.lit(CHUNK)).cast("array<long>")))
        .withColumn("text", F.col("text").substr(F.col("start").cast("int") + 1, F.lit(CHUNK + OVERLAP)))
        .repartition(partitions(spark), "row", "start")
        .mapInArrow(split, f"row string, {fields}, start long, stop long, owned string, ends binary")
    )
    stitched = chunked.groupBy("row").applyInPandas(join_up, schema)
    return docs.where(~long).mapInArrow(short, schema).unionByName(stitched)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digest columns of ``encode``: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    coded = encode(docs, path, pattern, "doc_id")
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
