"""Language-model scores from a weighted backoff automaton.

The model has n-grams of up to ``order`` tokens of the training documents, smoothed with a Dirichlet prior:
P(w | h) = (c(hw) + S P(w | h')) / (c(h) + S), where h' is h without its first token, down to add-one unigrams. As an
automaton, each history is a state, a seen token an arc, and the failure arc of a state costs S / (c(h) + S) and leads
to h'. The counts are never in one place: tasks count their block of documents, counts are summed by parts of the hash
space, and each block gets back the totals of its own n-grams, from which it builds the part of the automaton that its
texts can enter. Texts are traversed once from left to right, all documents of a block abreast.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.llm.common import doc_rows, materialize, partitions, ship, sliced, table, texts
from inkstream.llm.jaccard_join import mix

STRENGTH = 4.0
PART_BYTES = 16 << 20  # text to a part of the hash space, so that parts grow in number and not in size
END = 1  # hash of the end token
START = 2  # hash of the place before the first token
ODD = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _Hashes()


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def tokens(batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of texts one after the other, each with its end token, and each text's number of tokens."""
    parts = []
    for x in batch:
        words = x.lower().split()
        part = np.empty(len(words) + 1, np.uint64)
        part[:-1] = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
        part[-1] = END
        parts.append(part)
    return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))


def grams(flat: np.ndarray, sizes: np.ndarray, order: int) -> list[np.ndarray]:
    """Hash of the n-gram that ends at each token, for n from 1 to ``order``; before a text stand start tokens."""
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    value, out = mix(flat + np.uint64(1)), []
    out.append(value)
    for n in range(1, order):
        before = np.full(len(flat), START, np.uint64)
        on = np.flatnonzero(place >= n)
        before[on] = flat[on - n]
        value = mix(value * ODD + before)
        out.append(value)
    return out


def starts(order: int) -> list[np.uint64]:
    """Hash of n start tokens, for n from 1 to ``order`` - 1."""
    value, out = mix(np.array([START + 1], np.uint64)), []
    for _ in range(1, order):
        out.append(value[0])
        value = mix(value * ODD + np.uint64(START))
    return out


class Block:
    """The tokens of some documents and the distinct n-grams among them, single tokens apart from longer ones."""

    def __init__(self, data: list[bytes], train: np.ndarray, order: int):
        self.order = order
        self.flat, self.sizes = tokens(data)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.train = np.repeat(train, self.sizes)
        found = grams(self.flat, self.sizes, order)
        self.words, at = np.unique(found[0], return_inverse=True)
        n = len(self.flat)
        edge = np.array(starts(order), np.uint64)
        self.longer, rest = np.unique(np.concatenate([*found[1:], edge]), return_inverse=True)
        self.at = [at, *(rest[i * n : (i + 1) * n] for i in range(order - 1))]
        self.edge = rest[(order - 1) * n :]
        self.docs_trained = int(train.sum())

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences in training documents of ``words`` and of ``longer``, where start tokens count once a document."""
        words = np.bincount(self.at[0][self.train], minlength=len(self.words))
        longer = np.zeros(len(self.longer), np.int64)
        for at in self.at[1:]:
            longer += np.bincount(at[self.train], minlength=len(longer))
        longer[self.edge] += self.docs_trained
        return words, longer

    def score(self, words: np.ndarray, longer: np.ndarray, n_tokens: int, n_types: int) -> list[tuple[int, int, float, float]]:
        """Tokens, known tokens, base score and score of each document, given the corpus totals of its n-grams."""
        arcs, fails = self._automaton(words, longer, n_tokens, n_types)
        base = np.log10((words + 1) / (n_tokens + n_types + 1))[self.at[0]]
        known = words[self.at[0]] > 0
        total = self._traverse(words, longer, arcs, fails)
        return list(zip(self.sizes.tolist(), np.add.reduceat(known, self.first, dtype=np.int64).tolist(), np.add.reduceat(base, self.first).tolist(), total.tolist()))

    def _automaton(self, words: np.ndarray, longer: np.ndarray, n_tokens: int, n_types: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each n: log10 weight of the arc of each distinct n-gram, and of the failure arc of each n-token history.

        An arc's weight needs that of the same token one state down, so states are filled from the root upwards.
        """
        arcs = [np.log10((words + 1) / (n_tokens + n_types + 1))]
        fails = [np.log10(STRENGTH / (words + STRENGTH))]
        opening = np.zeros(len(self.flat), bool)
        opening[self.first] = True
        below = (words + 1) / (n_tokens + n_types + 1)
        for n in range(2, self.order + 1):
            at = self.at[n - 1]
            example = np.zeros(len(longer), np.int64)
            example[at] = np.arange(len(at))
            used = np.zeros(len(longer), bool)
            used[at] = True
            where = example[used]
            history = np.where(opening[where], longer[self.edge[n - 2]], (words if n == 2 else longer)[self.at[n - 2][where - 1]])
            chance = np.zeros(len(longer))
            chance[used] = (longer[used] + STRENGTH * below[self.at[n - 2][where]]) / (history + STRENGTH)
            with np.errstate(divide="ignore"):
                arcs.append(np.log10(chance))
            fails.append(np.log10(STRENGTH / (longer + STRENGTH)))
            below = chance
        return arcs, fails

    def _traverse(self, words: np.ndarray, longer: np.ndarray, arcs: list[np.ndarray], fails: list[np.ndarray]) -> np.ndarray:
        """Walk every document from left to right; ``level`` is the number of tokens in the history of its state.

        A token is taken at the highest state that has an arc for it; each failure arc on the way costs its weight.
        """
        by = np.argsort(-self.sizes, kind="stable")
        first, sizes = self.first[by], self.sizes[by]
        total = np.zeros(len(by))
        level = np.full(len(by), self.order - 1)
        counts = [words, *[longer] * (self.order - 1)]
        trained = longer[self.edge[0]] > 0 if self.order > 1 else False
        if not trained:
            level[:] = 0
        active = len(by)
        for t in range(int(sizes.max(initial=0))):
            while active and sizes[active - 1] <= t:
                active -= 1
            at = first[:active] + t
            state = level[:active]
            taken = np.zeros(active, np.int64)
            gained = np.zeros(active)
            open_ = np.ones(active, bool)
            for n in range(self.order, 0, -1):
                here = open_ & (state >= n - 1)
                index = self.at[n - 1][at]
                hit = here & (counts[n - 1][index] > 0) if n > 1 else here
                gained[hit] += arcs[n - 1][index[hit]]
                taken[hit] = n
                open_ &= ~hit
                if n > 1:
                    miss = here & ~hit
                    if miss.any():
                        history = self.edge[n - 2] if t == 0 else self.at[n - 2][at[miss] - 1]
                        gained[miss] += fails[n - 2][history] if t or n > 2 else np.log10(STRENGTH / (longer[history] + STRENGTH))
            total[:active] += gained
            reached = np.zeros(active, np.int64)
            for n in range(1, self.order):
                reached = np.where((taken >= n - 1) & (reached == n - 1) & (counts[n - 1][self.at[n - 1][at]] > 0), n, reached)
            level[:active] = reached
        out = np.empty(len(by))
        out[by] = total
        return out


def _packed(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Documents in blocks: one row with the ids, marks and compressed texts of about ``block_bytes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, out, data, held = [], [], [], 0
        for batch in sliced(batches, "text"):
            more = texts(batch)
            ids += batch.column("doc_id").to_pylist()
            out += batch.column("held_out").to_pylist()
            data += more
            held += sum(map(len, more))
            if held >= block_bytes:
                yield _row(ids, out, data)
                ids, out, data, held = [], [], [], 0
        if ids:
            yield _row(ids, out, data)

    return docs.mapInArrow(run, "block long, doc_ids array<bigint>, held_out array<boolean>, sizes array<bigint>, data binary")


def _row(ids: list, out: list, data: list[bytes]) -> pa.RecordBatch:
    packed = pa.compress(b"".join(data), "zstd", asbytes=True)
    return table(block=pa.array([uuid.uuid4().int >> 65], pa.int64()), doc_ids=pa.array([ids], pa.list_(pa.int64())), held_out=pa.array([out], pa.list_(pa.bool_())), sizes=pa.array([list(map(len, data))], pa.list_(pa.int64())), data=pa.array([packed], pa.binary()))


def _open(row: dict, order: int) -> Block:
    sizes = np.array(row["sizes"], np.int64)
    whole = pa.decompress(row["data"], int(sizes.sum()), "zstd", asbytes=True) if sizes.sum() else b""
    ends = np.cumsum(sizes).tolist()
    return Block([whole[e - n : e] for e, n in zip(ends, sizes.tolist())], ~np.array(row["held_out"], bool), order)


def _part_cuts(keys: np.ndarray, parts: int) -> list[int]:
    """Where each part of the hash space begins in sorted keys."""
    edges = np.array([(p << 64) // parts for p in range(parts)], dtype=np.uint64)
    return [*np.searchsorted(keys, edges).tolist(), len(keys)]


def _zip(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), "zstd", asbytes=True)


def _unzip(data: bytes, kind: str, count: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, np.dtype(kind).itemsize * count, "zstd", asbytes=True), kind) if count else np.empty(0, kind)


def _emit(blocks: DataFrame, order: int, parts: int) -> DataFrame:
    """Counts of each block's n-grams, known by 64 bits of hash, by part of the hash space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _open(row, order)
                for longer, (keys, counts) in enumerate(zip((block.words, block.longer), block.counts())):
                    cuts = _part_cuts(keys, parts)
                    some = [(p, a, b) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
                    yield table(
                        part=pa.array([p for p, _, _ in some], pa.int32()), longer=pa.array([bool(longer)] * len(some)), block=pa.array([row["block"]] * len(some), pa.int64()), n=pa.array([b - a for _, a, b in some], pa.int64()),
                        keys=pa.array([keys[a:b].tobytes() for _, a, b in some], pa.binary()), counts=pa.array([_zip(counts[a:b].astype("<u4")) for _, a, b in some], pa.binary()),
                    )

    return blocks.mapInArrow(run, "part int, longer boolean, block long, n long, keys binary, counts binary")


def _sum_up(rows: pd.DataFrame) -> pd.DataFrame:
    """Corpus totals of every block's n-grams in one part, in the order in which the block sent them."""
    keys = np.frombuffer(b"".join(rows["keys"]), "<u8")
    counts = np.concatenate([_unzip(x, "<u4", n) for x, n in zip(rows["counts"], rows["n"])])
    distinct, at = np.unique(keys, return_inverse=True)
    totals = np.bincount(at, counts, minlength=len(distinct)).astype(np.int64)
    ends = np.cumsum(rows["n"].to_numpy())
    back = totals[at]
    kept = [_zip(back[e - n : e]) for e, n in zip(ends.tolist(), rows["n"].tolist())]
    types, all_ = (0, 0) if rows["longer"].iloc[0] else (int((totals > 0).sum()), int(totals.sum()))
    lead = [1, *[0] * (len(rows) - 1)]
    return pd.DataFrame({"block": rows["block"], "part": rows["part"], "longer": rows["longer"], "n": rows["n"], "totals": kept, "types": [types * x for x in lead], "tokens": [all_ * x for x in lead]})


def score(docs: DataFrame, held: Column, order: int = 2, block_bytes: int = 6 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every document.

    The model is learnt from the documents for which ``held`` is false. Texts are lower-cased (A-Z) and split at white
    space; an end token closes each. A null or empty text has only that. Repeated rows are counted and scored as rows.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    blocks = materialize(_packed(docs.select("doc_id", "text", held.alias("held_out")), block_bytes))
    size = blocks.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).first().n or 0
    parts = max(partitions(spark), size // PART_BYTES)
    sent = _emit(blocks, order, parts)
    totals = materialize(sent.repartition(parts, "part", "longer").groupBy("part", "longer").applyInPandas(_sum_up, "block long, part int, longer boolean, n long, totals binary, types long, tokens long"))
    size = totals.agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens")).first()
    types, tokens_ = size.types or 0, size.tokens or 0

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[rows["data"].notna()].iloc[0]
        block = _open(own, order)
        parts_of = rows[rows["totals"].notna()].sort_values("part")
        words, longer = (np.concatenate([np.empty(0, np.int64), *[_unzip(x, "<i8", int(n)) for x, n in zip(p["totals"], p["n"])]]) for p in (parts_of[parts_of["longer"] == False], parts_of[parts_of["longer"] == True]))  # noqa: E712
        found = block.score(words, longer, tokens_, types)
        out = pd.DataFrame(found, columns=["n_tokens", "n_known", "base_score", "score"])
        ids = pd.array([None if x is None or x != x else int(x) for x in own["doc_ids"]], dtype="Int64")
        return out.assign(doc_id=ids, held_out=list(own["held_out"]), train_tokens=tokens_)[["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]]

    back = totals.select("block", "part", "longer", "n", "totals")
    both = blocks.unionByName(back, allowMissingColumns=True)
    return both.groupBy("block").applyInPandas(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
