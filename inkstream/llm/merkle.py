"""Merkle manifests of a table: leaves in ranges, aligned subtrees inside each range, ragged nodes by coordinate.

Leaves are range-sorted by group and key. Counts of each range's rows by group give every row its place in its group, so
a task knows which runs of eight lie whole in its range and builds the tree above them alone. The nodes left over at a
range's ends are shuffled by (group, level, run) and finished level by level. A proof then needs, beside what its range
can build again, only the few nodes of the runs that reach over the range's ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkstream.llm.common import doc_rows, give_back, materialize, partitions, release, ship, table

ARITY = 8
RANGE_ROWS = 100_000  # leaves of a range, at about 60 bytes each in its task
BATCH = 2000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<before: binary, after: binary>"


def join_digests(digests: list[bytes]) -> bytes:
    """The parent of a run: the hash of its digests as hex text."""
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


def leaf(text: Column) -> Column:
    """Hash of a document's fields, each ``-`` where null, else its bytes, a colon and its value."""
    parts = []
    for name in FIELDS:
        value = text if name == "text" else F.col(f"`{name}`").cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def nodes_at(total: int, level: int) -> int:
    return -(-total // ARITY**level)


def subtrees(start: int, total: int, digests: list[bytes]) -> list[tuple[int, list[bytes], int, int]]:
    """What a range of a group's leaves can build: for each level the first node's place, the nodes, and the ends of those whose parent it builds.

    The last run of a level may be short; it is whole if it ends with the group.
    """
    out, first, nodes, level = [], start, digests, 0
    while nodes:
        count, end = nodes_at(total, level), first + len(nodes)
        if count == 1:
            out.append((first, nodes, first, first))
            break
        low, high = -(-first // ARITY), -(-end // ARITY) if end == count else end // ARITY
        high = max(low, high)
        out.append((first, nodes, low * ARITY, min(high * ARITY, count) if high > low else low * ARITY))
        nodes = [join_digests(nodes[max(0, i * ARITY - first) : (i + 1) * ARITY - first]) for i in range(low, high)]
        first, level = low, level + 1
    return out


@dataclass
class Tree:
    """A built forest: its leaves by range, the ranges' pieces of groups, the nodes no range builds alone, and each group's top."""

    leaves: DataFrame  # pid, g, place, digest, row
    pieces: DataFrame  # pid, g, start, n, total, depth
    nodes: DataFrame  # g, level, idx, digest
    tops: DataFrame  # g, digest
    parts: int


def build(rows: DataFrame, order: list[str]) -> Tree:
    """The trees of ``rows`` (g, digest, row and the ``order`` columns), one for each g, nulls being a group.

    Rows sort by g, by ``order`` (nulls first) and by digest; rows that agree in all are alike and their order means nothing.
    """
    spark = rows.sparkSession
    ship(spark)
    keys = [F.col(c).asc_nulls_first() for c in ("g", *order, "digest")]
    parts = max(partitions(spark), -(-rows.count() // RANGE_ROWS))
    ranged = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    leaves = materialize(ranged.select(F.spark_partition_id().alias("pid"), "g", F.monotonically_increasing_id().alias("place"), "digest", "row"))
    counts = materialize(leaves.groupBy("pid", "g").agg(F.count(F.lit(1)).alias("n")))
    ahead = W.partitionBy("g").orderBy("pid").rowsBetween(W.unboundedPreceding, -1)  # a row for each range of a group
    pieces = counts.select("pid", "g", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"), "n", F.sum("n").over(W.partitionBy("g")).alias("total"))
    depth = F.size(F.filter(F.sequence(F.lit(0), F.lit(20)), lambda k: F.pow(F.lit(float(ARITY)), k) < F.col("total")))
    pieces = materialize(pieces.withColumn("depth", depth))
    work = leaves.drop("row").unionByName(pieces.withColumn("kind", F.lit("piece")), allowMissingColumns=True)
    ragged = materialize(work.repartition(parts, "pid").groupBy("pid").applyInArrow(_ragged, "g string, level int, idx long, digest binary, top boolean"))
    # Upper levels: the nodes of a run come from several ranges, and from the level below.
    depth_of_all = pieces.agg(F.max("depth").alias("d")).first().d or 0
    sizes = pieces.groupBy("g").agg(F.max("total").alias("total"), F.max("depth").alias("depth"))
    sizes = materialize(sizes.where("depth > 0").select(F.col("g").alias("s"), "depth"))
    known, above = [], None
    for level in range(depth_of_all):
        here = ragged.where((F.col("level") == level) & ~F.col("top")).select("g", "level", "idx", "digest")
        if above is not None:
            here = here.unionByName(above.where("NOT top").select("g", "level", "idx", "digest"))
        runs = here.groupBy("g", F.shiftright("idx", 3).alias("idx")).agg(F.array_sort(F.collect_list(F.struct(F.col("idx").alias("i"), "digest"))).alias("run"))
        parent = F.unhex(F.sha2(F.array_join(F.transform("run", lambda x: F.lower(F.hex(x["digest"]))), ""), 256))
        done = runs.join(sizes, F.col("g").eqNullSafe(F.col("s")))
        done = done.select("g", F.lit(level + 1).alias("level"), "idx", parent.alias("digest"), (F.col("depth") == level + 1).alias("top"))
        above = materialize(done)
        known.append(above)
    nodes = ragged
    for found in known:
        nodes = nodes.unionByName(found)
    nodes = materialize(nodes)
    release(counts, ragged, sizes, *known)
    return Tree(leaves, pieces, nodes.where("NOT top").drop("top"), nodes.where("top").select("g", "digest"), parts)


def _split(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, pa.Table]:
    """A range's leaves in order, and its other rows."""
    table = pa.Table.from_batches(list(batches))
    other = pc.is_valid(table.column("kind"))
    return table.filter(pc.invert(other)).sort_by("place"), table.filter(other)


def _slices(leaves: pa.Table, pieces: list[dict]) -> Iterator[tuple[dict, int, int]]:
    """Each piece of a range with the bounds of its leaves; pieces follow one another in the order of the leaves' groups."""
    groups = leaves.column("g").combine_chunks()
    sizes = {p["g"]: p for p in pieces}
    at = 0
    while at < len(groups):
        piece = sizes[groups[at].as_py()]
        yield piece, at, at + piece["n"]
        at += piece["n"]


def _ragged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes that a range builds and whose parents it doesn't, and the tops of groups that lie whole in it."""
    leaves, pieces = _split(batches)
    schema = pa.schema([("g", pa.string()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.binary()), ("top", pa.bool_())])
    out = []
    for piece, a, b in _slices(leaves, pieces.to_pylist()):
        digests = leaves.column("digest").slice(a, b - a).to_pylist()
        for level, (first, nodes, low, high) in enumerate(subtrees(piece["start"], piece["total"], digests)):
            top = nodes_at(piece["total"], level) == 1
            ends = [*range(first, min(low, first + len(nodes))), *range(max(high, first), first + len(nodes))] if low < high else range(first, first + len(nodes))
            out += [(piece["g"], level, i, nodes[i - first], top) for i in ends]
    for at in range(0, len(out), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 50_000]), schema.types)], schema=schema)


def proofs(tree: Tree, tails: DataFrame | None = None) -> DataFrame:
    """``row``, ``leaf``, ``top`` (its group's) and ``steps`` of every leaf: for each level the siblings before and after it.

    ``tails`` (g, root, tail) continues each group's steps above its top; ``root`` is then where they end. A run's
    siblings are the digests, one after the other, that lie left and right of the node.
    """
    level = F.explode(F.sequence(F.lit(0), F.col("depth") - 1)).alias("level")
    at = tree.pieces.where("depth > 0").select("pid", F.col("g").alias("s"), "start", "n", level)
    ends = F.array(F.expr("shiftright(start, 3 * (level + 1))"), F.expr("shiftright(start + n - 1, 3 * (level + 1))"))
    wanted = at.select("pid", "s", F.col("level").alias("l"), F.explode(F.array_distinct(ends)).alias("run"))
    near = (F.col("g").eqNullSafe(F.col("s"))) & (F.col("level") == F.col("l")) & (F.shiftright("idx", 3) == F.col("run"))
    found = wanted.join(tree.nodes, near).select("pid", "g", "level", "idx", "digest")
    pieces = tree.pieces.join(tree.tops.select(F.col("g").alias("t"), F.col("digest").alias("top")), F.col("g").eqNullSafe(F.col("t"))).drop("t")
    if tails is None:
        tails = tree.tops.select("g", F.col("digest").alias("root"), F.array().cast(f"array<{STEP}>").alias("tail"))
    tails = tails.select(F.col("g").alias("t"), "root", "tail")
    pieces = pieces.join(tails, F.col("g").eqNullSafe(F.col("t"))).drop("t")
    row = tree.leaves.schema["row"].dataType.simpleString()
    work = tree.leaves.unionByName(pieces.withColumn("kind", F.lit("piece")), allowMissingColumns=True).unionByName(found.withColumn("kind", F.lit("node")), allowMissingColumns=True)
    schema = f"row {row}, leaf binary, top binary, root binary, steps array<{STEP}>"
    return work.repartition(tree.parts, "pid").groupBy("pid").applyInArrow(_prove, schema)


def _prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    leaves, other = _split(batches)
    known: dict[str | None, dict[tuple[int, int], bytes]] = {}
    nodes = other.filter(pc.equal(other.column("kind"), "node")).select(["g", "level", "idx", "digest"]).to_pydict()
    for g, level, idx, digest in zip(*nodes.values()):
        known.setdefault(g, {})[level, idx] = digest
    step = pa.struct([("before", pa.binary()), ("after", pa.binary())])
    rows = leaves.column("row").combine_chunks()
    pieces = other.filter(pc.equal(other.column("kind"), "piece")).select(["g", "start", "n", "total", "depth", "top", "root", "tail"]).to_pylist()
    for piece, a, b in _slices(leaves, pieces):
        start, total = piece["start"], piece["total"]
        digests = leaves.column("digest").slice(a, b - a).to_pylist()
        local = subtrees(start, total, digests)
        far = known.get(piece["g"], {})

        def siblings(level: int, i: int) -> tuple[bytes, bytes]:
            first, own = local[level][:2] if level < len(local) else (0, [])
            low, high = i - i % ARITY, min(i - i % ARITY + ARITY, nodes_at(total, level))
            if first <= low and high <= first + len(own):
                run = own[low - first : high - first]
            else:
                run = [own[j - first] if first <= j < first + len(own) else far[level, j] for j in range(low, high)]
            return b"".join(run[: i - low]), b"".join(run[i - low + 1 :])

        tail = [(x["before"], x["after"]) for x in piece["tail"]]
        path: list[tuple[int, tuple[bytes, bytes]]] = [(-1, (b"", b""))] * piece["depth"]
        before: list[bytes] = []
        after: list[bytes] = []
        ends = [0]
        done = 0
        for j in range(b - a):
            for level in range(piece["depth"]):
                i = (start + j) >> 3 * level
                if path[level][0] != i:
                    path[level] = i, siblings(level, i)
            steps = [p for _, p in path] + tail
            before += [x for x, _ in steps]
            after += [x for _, x in steps]
            ends.append(len(before))
            if len(ends) > BATCH or j == b - a - 1:
                n = len(ends) - 1
                flat = pa.StructArray.from_arrays([pa.array(before, pa.binary()), pa.array(after, pa.binary())], fields=list(step))
                yield table(
                    row=rows.slice(a + done, n), leaf=pa.array(digests[done : done + n], pa.binary()), top=pa.array([piece["top"]] * n, pa.binary()),
                    root=pa.array([piece["root"]] * n, pa.binary()), steps=pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat),
                )
                before, after, ends, done = [], [], [0], done + n
    give_back()


def fold(leaf: bytes, steps: list[tuple[bytes, bytes]]) -> bytes:
    """The root to which a leaf and its siblings lead."""
    for before, after in steps:
        leaf = hashlib.sha256((before + leaf + after).hex().encode()).digest()
    return leaf


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, tampered, leaf, top (the subroot of the row's lang), root and steps (the proof) for each row of ``docs``.

    Leaves of a lang ascend by doc_id, a null one first; rows with one doc_id by their hash, and rows alike in all
    fields are leaves of their own. Null fields hash as ``-``, empty texts as ``0:``. ``tampered`` is a text to hash in
    place of the row's (null: none) for the digest that ``check`` folds. An empty table has no rows and no root.
    """
    rows = doc_rows(docs, *FIELDS)
    other = F.lit(None).cast("binary") if tampered is None else F.when(tampered.isNotNull(), leaf(tampered))
    rows = materialize(rows.select(F.col("lang").cast("string").alias("g"), "doc_id", leaf(F.col("text")).alias("digest"), F.struct("doc_id", other.alias("tampered")).alias("row")))
    tree = build(rows, ["doc_id"])
    upper = build(tree.tops.select(F.lit("").alias("g"), F.col("g").alias("name"), "digest", F.struct(F.col("g").alias("name")).alias("row")), ["name"])
    tails = proofs(upper).select(F.col("row.name").alias("g"), "root", F.col("steps").alias("tail"))
    out = proofs(tree, materialize(tails))
    return out.select("row.doc_id", "row.tampered", "leaf", "top", "root", "steps")


def check(found: DataFrame) -> DataFrame:
    """Fold each row of ``manifest`` again, from the tampered leaf where there is one.

    doc_id, leaf, subroot, root, proof_sha256 (of the siblings as hex text, in order), folded_root and verified.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            steps_of = batch.column("steps")
            flat, ends = steps_of.flatten(), steps_of.offsets.to_pylist()
            base = ends[0]
            pairs = list(zip(flat.field("before").to_pylist(), flat.field("after").to_pylist()))
            for i, (own, other, root) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("leaf", "tampered", "root")))):
                steps = pairs[ends[i] - base : ends[i + 1] - base]
                proof = hashlib.sha256(b"".join(x + y for x, y in steps).hex().encode()).hexdigest()
                folded = fold(own if other is None else other, steps)
                out.append((proof, folded.hex(), folded == root))
            hexed = {n: pa.array([x.hex() for x in batch.column(c).to_pylist()], pa.string()) for n, c in (("leaf", "leaf"), ("subroot", "top"), ("root", "root"))}
            proof, folded, same = zip(*out) if out else ((), (), ())
            yield table(doc_id=batch.column("doc_id"), **hexed, proof_sha256=pa.array(proof, pa.string()), folded_root=pa.array(folded, pa.string()), verified=pa.array(same, pa.bool_()))

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
