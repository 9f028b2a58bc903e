"""Exact n-gram Jaccard join over size-banded tiles with hashed bitmap signatures.

1. A document becomes a sorted array of 64-bit shingle hashes. Documents with equal sets are one class, which has a
   size and a bitmap of two bits or more an element.
2. Sizes fall into bands. In a band the hash space is cut into more tiles than a linked pair can differ in, so a linked
   pair has equal contents in many tiles. A class just above a band's lower end also visits the band below.
3. Tile contents are counted over the corpus. Where a pair differs in d elements at most, each of the two has a content
   that both hold among its d + 1 rarest; the more common ones, such as stock phrases, are left out. Contents that a
   bounded sample shows to be very common count as the most common of all and are not even shuffled.
4. The classes that share a rare content form a group around the smallest. Sizes and bitmap bits bound the overlap of
   each member with that centre from above; texts are fetched, and the sorted arrays intersected, for what is left.
5. Members of a group that are still not connected are compared with each other by their bitmaps, in blocks. Those that
   the bits alone would connect are compared by their arrays, again in blocks, once for all groups that they share.
6. Components of the links found, over classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.llm.common import doc_rows, materialize, partitions, release, ship, sliced, table, texts
from inkstream.llm.components import components

BLOCK = 1024  # members of a group that one comparison task holds on each side
SINGLE = 64  # up to this size each shingle is a tile of its own
SAMPLE = 16_000  # about so many classes tell which tile contents are very common; changes cost, never links
COMMON = 1_000  # a content that one class in so many of the sample holds is very common
HELD = 250_000  # tile keys that a task gathers before it sends them on
BROADCAST_ROWS = 500_000  # most rows that are broadcast, of a few longs each


@dataclass(frozen=True)
class Rule:
    """Shingles of ``n`` words; documents link when den * |A and B| >= num * |A or B|, which is more than half."""

    n: int = 5
    num: int = 80
    den: int = 100

    def __post_init__(self):
        if not self.den < 2 * self.num <= 2 * self.den:
            raise ValueError("the similarity asked for must be over a half, and 1 at most")

    def enough(self, common, a, b):
        return self.den * common >= self.num * (a + b - common)

    def apart(self, a: int) -> int:
        """Most elements in which a set of ``a`` and a linked one at least as large differ."""
        b = a * self.den // self.num
        return (a + b) * (self.den - self.num) // (self.den + self.num)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 65_536:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _Hashes()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``n`` words; a text of fewer words is one run. A-Z are lower-cased."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    count = max(1, len(h) - n + 1)
    value = np.full(count, min(n, len(h)), np.uint64)
    for j in range(min(n, len(h))):
        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + h[j : j + count])
    return np.unique(value)


def class_of(s: np.ndarray) -> int:
    """A signed 63-bit number for a set, the same for equal sets; empty sets have -1."""
    return xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s)) >> 1 if len(s) else -1


def bands() -> np.ndarray:
    """Lower ends of the size bands: each half as much again as the one before."""
    ends = [1]
    while ends[-1] < 1 << 40:
        ends.append(max(ends[-1] + 1, ends[-1] * 3 // 2))
    return np.array(ends)


BANDS = bands()


def home_bands(size: int, rule: Rule) -> list[int]:
    """The bands in which a set can meet a linked one, its own first."""
    home = [int(np.searchsorted(BANDS, size, "right")) - 1]
    while home[-1] and size * rule.num <= (int(BANDS[home[-1]]) - 1) * rule.den:
        home.append(home[-1] - 1)  # a linked set may be smaller than this band
    return home


def tile_keys(s: np.ndarray, band: int, rule: Rule, common: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """The set's tile contents in a band, as hashes of (band, tile, content).

    Returned are those that may be among the apart + 1 rarest, how many of them, the most common, are not, and those
    of ``common`` (sorted; held to be the most common of all) that are. Empty tiles stand in where too few are filled.
    """
    upper = int(BANDS[band + 1]) - 1
    most = rule.apart(upper)
    apart = min(most, rule.apart(len(s)))
    mixed = mix(s)
    if upper <= SINGLE:
        filled, content, tiles = s, mixed, 0
    else:
        tiles = most + most // 2 + 2
        tile = ((s >> np.uint64(32)) * np.uint64(tiles)) >> np.uint64(32)  # ascending, as s is
        first = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
        filled, content = tile[first], np.add.reduceat(mixed, first)
    salt = np.uint64(band)
    keys = mix(mix(content + filled) * np.uint64(0x9E3779B97F4A7C15) + salt)
    spare = len(keys) - apart - 1
    if spare < 0:
        empty = np.setdiff1d(np.arange(tiles, dtype=np.uint64), filled)[:-spare]
        keys, spare = np.concatenate([keys, mix(mix(empty) * np.uint64(0x9E3779B97F4A7C15) + salt)]), 0
    if not len(common):
        return keys, spare, keys[:0]
    at = np.minimum(np.searchsorted(common, keys), len(common) - 1)
    known = common[at] == keys
    stay = np.sort(keys[known])[: max(0, int(known.sum()) - spare)]  # of the most common the last by value are left out
    return keys[~known], max(0, spare - int(known.sum())), stay


def bitmap(s: np.ndarray) -> np.ndarray:
    """Two bits or more an element, 256 at least; the low bits of a hash give its place, so that halves can be folded."""
    bits = np.zeros(max(256, 1 << (2 * len(s) - 1).bit_length()), bool)
    bits[(s % np.uint64(len(bits))).astype(np.int64)] = True
    return np.packbits(bits).view(np.uint64)


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows) of as many words."""
    while maps.shape[-1] > words:
        half = maps.shape[-1] // 2
        maps = maps[..., :half] | maps[..., half:]
    return maps


def stacked(maps: list[bytes]) -> np.ndarray:
    """Packed bitmaps of any lengths as rows of the shortest one's."""
    words = min(len(x) for x in maps) // 8
    return np.stack([folded(np.frombuffer(x, np.uint64), words) for x in maps])


def most_common(a, bits_a: np.ndarray, sizes: np.ndarray, bitmaps: np.ndarray) -> np.ndarray:
    """Upper bound of the overlap: each bit that only one has is an element that the other lacks."""
    only_a = np.bitwise_count(bits_a & ~bitmaps).sum(1, dtype=np.int64)
    only_b = np.bitwise_count(bitmaps & ~bits_a).sum(1, dtype=np.int64)
    return np.minimum(a - only_a, sizes - only_b)


def common(a: np.ndarray, b: np.ndarray) -> int:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    return int((large[np.minimum(at, len(large) - 1)] == small).sum())


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Tells rows apart that differ in doc_id, null included, or in text."""
    return F.xxhash64(F.col(doc_id).isNull(), doc_id, text)


def classes(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, key (of the row), n_shingles, class and bitmap of every document; a null text counts as empty."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            sets = [shingles(x, rule.n) for x in texts(batch)]
            maps = [bitmap(s).tobytes() if rule.apart(len(s)) else None for s in sets]
            yield table(doc_id=batch.column("doc_id"), key=batch.column("key"), n_shingles=pa.array(map(len, sets), pa.int64()), **{"class": pa.array(map(class_of, sets), pa.int64())}, bits=pa.array(maps, pa.binary()))

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, key long, n_shingles long, class long, bits binary"
    return doc_rows(docs, "doc_id", "text").withColumn("key", row_key()).mapInArrow(run, schema)


ENTRY = np.dtype([("key", "<u8"), ("member", "<i8"), ("spare", "<u2"), ("band", "u1")])  # of a tile content
COUNTED = np.dtype([*ENTRY.descr, ("count", "<u4")])
HOT = 255  # in place of a band: the content is very common, and what is left out of it is already gone


def _dealt(entries: np.ndarray, part: np.ndarray, parts: int) -> pa.RecordBatch:
    """A row (part, entries) for each part that has some."""
    order = np.argsort(part, kind="stable")
    entries, part = entries[order], part[order]
    cuts = np.searchsorted(part, np.arange(parts + 1)).tolist()
    some = [(p, a, b) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
    return table(part=pa.array([p for p, _, _ in some], pa.int32()), entries=pa.array([entries[a:b].tobytes() for _, a, b in some], pa.binary()))


def _part(x: np.ndarray, parts: int) -> np.ndarray:
    return ((mix(x.astype(np.uint64)) >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)


def _key_part(entries: np.ndarray, parts: int) -> np.ndarray:
    """By key; a very common one goes to any part, by its member."""
    return _part(np.where(entries["band"] == HOT, entries["member"].astype(np.uint64), entries["key"]), parts)


def _joined(rows: pd.DataFrame, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(rows["entries"]), kind)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new run of equal values begins."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return new


def _tiles(docs: DataFrame, rule: Rule, parts: int, common: np.ndarray) -> DataFrame:
    """Tile contents of each class, dealt by content; a class that a task has seen is passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, n = [], 0
        for batch in sliced(batches, "text"):
            for text in texts(batch):
                s = shingles(text, rule.n)
                own = class_of(s)
                if not rule.apart(len(s)) or own in seen:  # links with nothing but its copies
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(own)
                for band in home_bands(len(s), rule):
                    keys, spare, hot = tile_keys(s, band, rule, common)
                    entries = np.empty(len(keys) + len(hot), ENTRY)
                    entries["key"], entries["member"] = np.concatenate([keys, hot]), own
                    entries["spare"], entries["band"] = min(spare, 65535), band
                    entries["band"][len(keys) :] = HOT
                    held.append(entries)
                    n += len(entries)
            if n > HELD:
                entries = np.concatenate(held)
                yield _dealt(entries, _key_part(entries, parts), parts)
                held, n = [], 0
        if n:
            entries = np.concatenate(held)
            yield _dealt(entries, _key_part(entries, parts), parts)

    return doc_rows(docs, "text").mapInArrow(run, "part int, entries binary")


def _regrouped(dealt: DataFrame, parts: int, step, schema: str = "part int, entries binary") -> DataFrame:
    return dealt.repartition(parts, "part").groupBy("part").applyInPandas(step, schema)


def _groups(dealt: DataFrame, parts: int) -> DataFrame:
    """(group, members): the classes that share a content which is among the rarest of each. Equal lists occur once.

    A very common content has several rows, none of which is long.
    """

    def counted(rows: pd.DataFrame) -> pd.DataFrame:
        e = _joined(rows, ENTRY)
        e = e[np.lexsort((e["member"], e["key"]))]
        e = e[_starts(e["key"], e["member"])]
        first = np.flatnonzero(_starts(e["key"]))
        count = np.repeat(np.diff(np.append(first, len(e))), np.diff(np.append(first, len(e))))
        kept = (count > 1) | (e["band"] == HOT)
        out = np.empty(int(kept.sum()), COUNTED)
        for name in ENTRY.names:
            out[name] = e[name][kept]
        out["count"] = count[kept]
        return _dealt(out, _part(out["member"], parts), parts).to_pandas()

    def rarest(rows: pd.DataFrame) -> pd.DataFrame:
        e = _joined(rows, COUNTED)
        e = e[np.lexsort((~e["key"], -e["count"].astype(np.int64), e["band"], e["member"]))]
        first = np.flatnonzero(_starts(e["member"], e["band"]))
        place = np.arange(len(e)) - np.repeat(first, np.diff(np.append(first, len(e))))
        e = e[(place >= e["spare"]) | (e["band"] == HOT)]
        out = np.empty(len(e), ENTRY)
        for name in ENTRY.names:
            out[name] = e[name]
        return _dealt(out, _key_part(out, parts), parts).to_pandas()

    def listed(rows: pd.DataFrame) -> pd.DataFrame:
        e = _joined(rows, ENTRY)
        e = e[np.lexsort((e["member"], e["key"]))]
        e = e[_starts(e["key"], e["member"])]
        found = {}
        first = np.flatnonzero(_starts(e["key"]))
        ends = np.append(first[1:], len(e))
        sums = np.add.reduceat(mix(e["member"].astype(np.uint64)), first) if len(e) else []
        for a, b, key, total, hot in zip(first.tolist(), ends.tolist(), e["key"][first].tolist(), sums, (e["band"][first] == HOT).tolist()):
            if hot:
                for c in range(a, b, BLOCK):
                    found[key, c] = (key, e["member"][c : min(b, c + BLOCK)])
            elif b - a > 1:
                found.setdefault((int(total), 0), (int(total), e["member"][a:b]))
        return pd.DataFrame({"group": np.array([k for k, _ in found.values()], np.uint64).view(np.int64), "hot": [c > 0 for _, c in found], "members": pd.Series([m for _, m in found.values()], dtype=object)})

    counts = _regrouped(dealt, parts, counted)
    chosen = _regrouped(counts, parts, rarest)
    return _regrouped(chosen, parts, listed, "group long, hot boolean, members array<long>")


def _with_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``wanted`` with their row's text, which is smaller to shuffle than its hashes."""
    small = wanted.count() <= BROADCAST_ROWS
    return docs.select(row_key().alias("key"), "text").join(F.broadcast(wanted) if small else wanted, "key").drop("key")


def _common_contents(docs: DataFrame, rows: DataFrame, rule: Rule) -> np.ndarray:
    """Sorted keys of the tile contents that many classes of a bounded sample hold, of which there are few."""
    known = rows.where("bits IS NOT NULL").groupBy("class").agg(F.min("key").alias("key"))
    known = materialize(known)
    step = max(1, known.count() // SAMPLE)
    drawn = known.where(F.pmod(F.xxhash64("class"), F.lit(step)) == 0).select("key")
    least = max(8, min(SAMPLE, drawn.count()) // COMMON)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            for text in texts(batch):
                s = shingles(text, rule.n)
                for band in home_bands(len(s), rule) if len(s) else ():
                    keys = tile_keys(s, band, rule, np.empty(0, np.uint64))[0]
                    yield table(content=pa.array(keys.view(np.int64)))

    found = _with_texts(docs, drawn).mapInArrow(run, "content long").groupBy("content").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    most = found.orderBy(F.desc("n"), "content").limit(4096).select("content").collect()
    release(known)
    return np.sort(np.array([r.content for r in most], np.int64).view(np.uint64))


def _linked(a: np.ndarray, bits_a: np.ndarray, others: list[np.ndarray], sizes: np.ndarray, bitmaps: np.ndarray, rule: Rule) -> Iterator[int]:
    """Which of ``others`` link with ``a``."""
    for i in np.flatnonzero(rule.enough(most_common(len(a), bits_a, sizes, bitmaps), len(a), sizes)).tolist():
        if rule.enough(common(a, others[i]), len(a), len(others[i])):
            yield i


def _may_link(pairs: DataFrame, marks: DataFrame, rule: Rule) -> DataFrame:
    """The rows of ``pairs`` (centre, member, lists) whose sizes and bitmaps let them link."""
    ends = [marks.select(F.col("class").alias(f"{e}_class"), F.col("n").alias(f"{e}_n"), F.col("bits").alias(f"{e}_bits")) for e in ("centre", "member")]
    both = pairs.join(ends[0], F.col("centre") == F.col("centre_class")).where("centre_class IS NOT NULL")
    both = both.join(ends[1], F.col("member") == F.col("member_class"))
    low, high = F.least("centre_n", "member_n"), F.greatest("centre_n", "member_n")
    both = both.where(low * rule.den >= high * rule.num)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = [batch.column(f"{e}_bits").to_pylist() for e in ("centre", "member")]
            sizes = [batch.column(f"{e}_n").to_numpy() for e in ("centre", "member")]
            width = np.array([min(len(x), len(y)) // 8 for x, y in zip(*maps)], np.int64)
            passed = np.zeros(batch.num_rows, bool)
            for words in np.unique(width).tolist():
                at = np.flatnonzero(width == words)
                one, two = (np.stack([folded(np.frombuffer(x[i], np.uint64), words) for i in at]) for x in maps)
                passed[at] = rule.enough(most_common(sizes[0][at], one, sizes[1][at], two), sizes[0][at], sizes[1][at])
            yield batch.select(["centre", "member", "lists"]).filter(pa.array(passed))

    columns = both.select("centre", "member", "lists", "centre_n", "member_n", "centre_bits", "member_bits")
    return columns.mapInArrow(run, "centre long, member long, lists long")


def _with_centre(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Links of each group's members with its centre; rows come sorted so that a centre precedes its members."""
    at, s = None, None
    for batch in sliced(batches, "text"):
        found = []
        sets = [shingles(x, rule.n) for x in texts(batch)]
        for group, salt, member, x in zip(batch.column("group").to_pylist(), batch.column("salt").to_pylist(), batch.column("member").to_pylist(), sets):
            if class_of(x) != member:  # rows of equal keys
                continue
            if member == group:
                at, s = (group, salt), x
            elif at == (group, salt) and rule.enough(common(s, x), len(s), len(x)):  # its bits have been compared
                found.append((group, member))
        yield _pairs(found)


def _among(rows: pd.DataFrame, rule: Rule) -> pd.DataFrame:
    """Links between members of two blocks of a group that lie in different components so far."""
    sets = [shingles(x.encode(), rule.n) for x in rows["text"]]
    own = np.array([class_of(x) for x in sets]) == rows["member"].to_numpy()  # rows of equal keys
    own &= ~rows["member"].where(own).duplicated().to_numpy()
    rows, sets = rows[own], [x for x, kept in zip(sets, own.tolist()) if kept]
    if not len(rows):
        return pd.DataFrame([], columns=["a", "b"], dtype="int64")
    sizes, root, member = np.array([len(x) for x in sets]), rows["root"].to_numpy().copy(), rows["member"].to_numpy()
    maps = stacked([bitmap(x).tobytes() for x in sets])
    left = np.flatnonzero(rows["block"].to_numpy() == rows["one"].to_numpy())
    right = np.flatnonzero(rows["block"].to_numpy() == rows["two"].to_numpy())
    same = rows["one"].iloc[0] == rows["two"].iloc[0]
    links = []
    for i in left.tolist():
        other = right[(root[right] != root[i]) & ((right > i) | (not same))]
        other = other[rule.enough(np.minimum(sizes[other], sizes[i]), sizes[other], sizes[i])]
        for j in _linked(sets[i], maps[i], [sets[k] for k in other], sizes[other], maps[other], rule) if len(other) else ():
            k = other[j]
            if root[k] != root[i]:  # else joined by a link of this block
                links.append((member[i], member[k]))
                root[root == root[k]] = root[i]
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _partners(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Pairs of two blocks of a group that the bits let link across components so far, or as many as connect the same."""
    pairs: list[tuple[int, int]] = []
    for rows in _sets(batches):
        sizes, root, member, block, one, two = (rows.column(c).to_numpy() for c in ("n", "root", "member", "block", "one", "two"))
        maps, tied = stacked(rows.column("bits").to_pylist()), np.arange(len(root))
        left, right = np.flatnonzero(block == one[0]), np.flatnonzero(block == two[0])
        right = right[np.argsort(sizes[right], kind="stable")]
        low, high = np.searchsorted(sizes[right], [-(-sizes[left] * rule.num // rule.den), sizes[left] * rule.den // rule.num + 1])
        for i, a, b in zip(left.tolist(), low.tolist(), high.tolist()):
            other = right[a:b]
            other = other[(root[other] != root[i]) & (tied[other] != tied[i])]
            if len(other):
                for k in other[rule.enough(most_common(sizes[i], maps[i], sizes[other], maps[other]), sizes[i], sizes[other])].tolist():
                    if tied[k] != tied[i]:
                        pairs.append((member[i], member[k]))
                        tied[tied == tied[k]] = tied[i]
        if len(pairs) > 100_000:
            yield _pairs(pairs)
            pairs = []
    yield _pairs(pairs)


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return table(a=pa.array([a for a, _ in found], pa.int64()), b=pa.array([b for _, b in found], pa.int64()))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (group, one, two), by which they come sorted."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in ("group", "one", "two")]
        cuts = [*np.flatnonzero(_starts(*columns)).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            now = tuple(c[a] for c in columns)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _links_among(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    for rows in _sets(batches):
        found = _among(rows.to_pandas(), rule)
        if len(found):
            yield table(a=pa.array(found["a"], pa.int64()), b=pa.array(found["b"], pa.int64()))


def _together(rows: DataFrame) -> DataFrame:
    """Dealt and sorted as ``_sets`` takes them."""
    return rows.repartition(partitions(rows.sparkSession), "group", "one", "two").sortWithinPartitions("group", "one", "two")


def _rooted(pairs: DataFrame, roots: DataFrame, *ends: str) -> DataFrame:
    """``pairs`` with the components, so far, of the named ends; a class without links is one by itself."""
    for end in ends:
        named = roots.select(F.col("node").alias(f"{end}_node"), F.col("root").alias(f"{end}_root"))
        pairs = pairs.join(named, F.col(end) == F.col(f"{end}_node"), "left").withColumn(f"{end}_root", F.coalesce(f"{end}_root", end)).drop(f"{end}_node")
    return pairs


def _blocks(members: DataFrame) -> DataFrame:
    """``members`` (group, member, root, ...), once for each pair of blocks (one, two) of its group that it is in."""
    sizes = members.groupBy(F.col("group").alias("g")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = members.join(sizes, F.col("group") == F.col("g")).withColumn("block", F.pmod(F.xxhash64("member", F.lit(1)), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return placed.withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other")).drop("g", "blocks", "other")


def _centre_links(docs: DataFrame, pairs: DataFrame, first: DataFrame, rule: Rule) -> DataFrame:
    """Links of ``pairs`` (centre, member); centres of large groups are salted."""
    spark = docs.sparkSession
    salts = pairs.groupBy(F.col("centre").alias("g")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("salts"))
    members = pairs.join(salts, F.col("centre") == F.col("g")).select(F.col("centre").alias("group"), F.pmod(F.xxhash64("member"), F.col("salts")).cast("int").alias("salt"), "member")
    centres = salts.select("g", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("g").alias("member"))
    placed = members.union(centres).join(first, F.col("member") == F.col("class")).select("key", "group", "salt", "member")
    rows = _with_texts(docs, materialize(placed)).repartition(partitions(spark), "group", "salt").sortWithinPartitions("group", "salt", F.col("group") != F.col("member"))
    return rows.mapInArrow(partial(_with_centre, rule=rule), "a long, b long")


def links(docs: DataFrame, rows: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) between classes with the same components as all linked pairs; ``rows`` are those of ``classes``."""
    spark = docs.sparkSession
    size = docs.select(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    parts = max(partitions(spark), size // (8 << 20))
    tiles = _tiles(docs, rule, parts, _common_contents(docs, rows, rule))
    groups = materialize(_groups(tiles, parts))
    members = groups.select("group", F.explode("members").alias("member"))
    centres = groups.groupBy(F.col("group").alias("g")).agg(F.min(F.array_min("members")).alias("centre"))
    inside = members.select("member").distinct()
    marks = rows.where("bits IS NOT NULL").groupBy("class").agg(F.min("key").alias("key"), F.first("n_shingles").alias("n"), F.first("bits").alias("bits"))
    marks = materialize(marks.join(inside, F.col("class") == F.col("member"), "left_semi"))  # copies are folded first, however many
    first = marks.select("class", "key")
    pairs = members.join(centres, F.col("group") == F.col("g")).where("member <> centre").groupBy("centre", "member").agg(F.count(F.lit(1)).alias("lists"))
    pairs = materialize(_may_link(pairs, marks, rule))
    best = pairs.groupBy("member").agg(F.max(F.struct("lists", (-F.col("centre")).alias("minus"))).alias("m"))
    best = materialize(best.select((-F.col("m.minus")).alias("centre"), "member"))
    found = materialize(_centre_links(docs, best, first, rule))
    roots = materialize(components(found))
    rest = _rooted(pairs, roots, "centre", "member").where("centre_root <> member_root").select("centre", "member")
    rest = materialize(rest.join(best, ["centre", "member"], "left_anti"))
    more = materialize(_centre_links(docs, rest, first, rule))
    found = found.union(more)
    roots = materialize(components(found))
    # All pairs with a centre are settled. What is left are other pairs of groups that aren't connected yet.
    placed = _rooted(members, roots, "member").withColumnRenamed("member_root", "root")
    unsettled = placed.groupBy(F.col("group").alias("g")).agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high AND n > 2").select("g")
    unsettled = materialize(placed.join(unsettled, F.col("group") == F.col("g"), "left_semi"))
    compared = _blocks(unsettled).join(marks, F.col("member") == F.col("class")).select("group", "member", "root", "block", "one", "two", "n", "bits")
    perhaps = materialize(components(_together(compared).mapInArrow(partial(_partners, rule=rule), "a long, b long")))
    live = _rooted(perhaps.select(F.col("root").alias("group"), F.col("node").alias("member")), roots, "member").withColumnRenamed("member_root", "root")
    todo = _blocks(live).join(first, F.col("member") == F.col("class")).select("key", "group", "member", "root", "block", "one", "two")
    among = _together(_with_texts(docs, materialize(todo))).mapInArrow(partial(_links_among, rule=rule), "a long, b long")
    out = materialize(found.union(materialize(among)))
    release(groups, marks, pairs, best, rest, unsettled, perhaps, more, roots)
    return out


def join(docs: DataFrame, rule: Rule = Rule(), *keep: str) -> DataFrame:
    """doc_id, ``keep`` (key: that of the row), n_shingles, component_id (the smallest doc_id reachable by links) of every document.

    Documents with equal shingle sets are linked. Those without words are linked with nothing and are components of
    their own; a null text counts as empty. Rows that repeat a doc_id are told apart by their texts alone; a document
    with a null doc_id takes part and has the component of its links, null where it has none.
    """
    docs = doc_rows(docs, "doc_id", "text")
    rows = materialize(classes(docs, rule))
    roots = components(links(docs, rows.select("key", "n_shingles", "class", "bits"), rule))
    smallest = rows.where("class >= 0").groupBy("class").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies"))
    tied = smallest.join(roots, F.col("class") == F.col("node"), "left").withColumn("root", F.coalesce("root", "class"))
    lows = tied.where("node IS NOT NULL").groupBy("root").agg(F.min("low").alias("lowest")).withColumnRenamed("root", "r")
    lows = tied.where("node IS NOT NULL OR copies > 1").join(lows, F.col("root") == F.col("r"), "left")
    named = materialize(lows.select(F.col("class").alias("c"), F.coalesce("lowest", "low").alias("component")))
    return rows.join(named, F.col("class") == F.col("c"), "left").select("doc_id", *keep, "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
