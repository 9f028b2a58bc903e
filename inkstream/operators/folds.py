"""Ordered folds over the commands of a key.

A fold's next result depends on its last one, which windows can't express. Rows are partitioned by key and sorted, and
a task streams over them holding one key's state; a key with very many rows is cut into blocks that tasks fold side by
side. The same step functions serve the streaming twin in ``inkstream.streaming``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkstream.sources.store import written

#: state (None at first), time, argument -> new state, result values after the id
Step = Callable[[object, int, int], tuple[object, tuple]]


BLOCK = 500_000  # rows of a key that one task folds; a key with more is cut into blocks
FREE = 3  # rounds in which every block whose entry has changed is folded again


def fold(rows: DataFrame, step: Step, schema: str, block: int = BLOCK) -> DataFrame:
    """Apply ``step`` to ``rows`` (key, ts_ms, id, arg) of each key in order of time, then id. Null keys are one key.

    A key of up to ``block`` rows is one task's. Longer histories are cut into blocks that are folded side by side from
    a supposed state, and again once the block before has ended in another: most steps forget their entry, as a window,
    lease or gap does, so a few rounds do. After ``FREE`` rounds only blocks whose entry is certain go on, so a step
    that never forgets costs no more than one task after another would.
    """
    rows = rows.select("key", "ts_ms", "id", "arg")
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    sizes = counts.agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("n")).first()
    if not sizes.keys:
        return _plain(rows, step, schema)
    hot = written(counts.select(F.col("key").alias("hot"), F.lit(True).alias("long")))
    marked = rows.join(hot if sizes.keys > FEW_KEYS else F.broadcast(hot), F.col("key").eqNullSafe(F.col("hot")), "left").drop("hot")
    cut = marked.where("long").drop("long").repartitionByRange(max(2, -(-sizes.n // block)), "key", "ts_ms", "id")
    cut = written(cut.withColumn("pid", F.spark_partition_id()))
    return _plain(marked.where("long IS NULL").drop("long"), step, schema).unionByName(_blocks(cut, step, schema))


FEW_KEYS = 10_000


def _plain(rows: DataFrame, step: Step, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = object(), None
        for frame in frames:
            out = []
            for key, ts, row_id, arg in zip(frame["key"], frame["ts_ms"], frame["id"], frame["arg"]):
                key = None if pd.isna(key) else key
                if key != last:
                    last, state = key, None
                state, result = step(state, ts, arg)
                out.append((row_id, *result))
            yield pd.DataFrame(out, columns=names)

    return rows.repartition("key").sortWithinPartitions("key", "ts_ms", "id").mapInPandas(run, schema)


def _blocks(cut: DataFrame, step: Step, schema: str) -> DataFrame:
    """Fold ``cut`` (key, ts_ms, id, arg, pid), whose keys are cut at the ends of ``pid``'s ranges."""
    names = [c.split()[0] for c in schema.split(", ")]
    kind = cut.schema["key"].dataType.simpleString()

    def run(results: bool):
        def fold_pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            last, state, ends = object(), None, []
            for frame in frames:
                out = []
                for key, ts, row_id, arg, pid, entry in zip(*(frame[c] for c in ("key", "ts_ms", "id", "arg", "pid", "entry"))):
                    piece = (None if pd.isna(key) else key, pid)
                    if piece != last:
                        if isinstance(last, tuple):
                            ends.append((*last, json.dumps(state, default=int)))
                        last, state = piece, json.loads(entry)
                    state, result = step(state, ts, arg)
                    if results:
                        out.append((row_id, *result))
                if results:
                    yield pd.DataFrame(out, columns=names)
            if isinstance(last, tuple):
                ends.append((*last, json.dumps(state, default=int)))
            if not results:
                yield pd.DataFrame(ends, columns=["key", "pid", "exit"])

        return fold_pieces

    def apply(entries: DataFrame, results: bool) -> DataFrame:
        """Fold the pieces of ``entries`` (key, pid, entry): a row for each range and key in it, so they are few."""
        known = entries.select(F.col("key").alias("k"), F.col("pid").alias("p"), "entry")
        joined = cut.join(F.broadcast(known), (F.col("pid") == F.col("p")) & F.col("key").eqNullSafe(F.col("k")))
        dealt = joined.drop("k", "p").repartition(parts, "pid").sortWithinPartitions("pid", "key", "ts_ms", "id")
        return dealt.mapInPandas(run(results), schema if results else f"key {kind}, pid int, exit string")

    order = W.partitionBy("key").orderBy("pid")
    pieces = cut.groupBy("key", "pid").agg(F.lit("null").alias("entry")).withColumn("first", F.row_number().over(order) == 1)
    parts = cut.agg(F.count_distinct("pid").alias("n")).first().n
    state = written(pieces.select("key", "pid", "entry", "first", F.lit(None).cast("string").alias("exit"), F.col("first").alias("sure"), F.lit(True).alias("stale")))
    turn = 0
    while True:
        turn += 1
        again = state.where("stale" if turn <= FREE else "stale AND sure")
        ends = apply(again, False).select(F.col("key").alias("k"), F.col("pid").alias("p"), F.col("exit").alias("new"))
        told = state.join(ends, F.col("key").eqNullSafe(F.col("k")) & (F.col("pid") == F.col("p")), "left")
        done = told.select("key", "pid", "entry", "first", F.coalesce("new", "exit").alias("exit"), "sure", (F.col("stale") & F.col("new").isNull()).alias("left"))
        # What a block begins with is what the one before ended with; it is sure if that one was and was folded from it.
        before = lambda c: F.lag(c).over(order)
        moved = done.withColumn("in", F.when(F.col("first"), F.lit("null")).otherwise(before("exit"))).withColumn("held", F.col("sure") & ~F.col("left"))
        moved = moved.withColumn("stale", F.col("left") | (F.col("in") != F.col("entry")))
        firm = F.min(F.when(F.col("stale"), F.col("pid"))).over(W.partitionBy("key"))
        state = written(moved.select("key", "pid", F.col("in").alias("entry"), "first", "exit", (firm.isNull() | (F.col("pid") <= firm)).alias("sure"), "stale"))
        if state.where("stale").isEmpty():
            return apply(state, True)


def limiter(most: int, window_ms: int) -> Step:
    def step(state, ts, arg):
        start, used = state if state and ts - state[0] < window_ms else (ts, 0)
        return (start, used + 1), (used + 1 <= most, used + 1)

    return step


def suppressor(gap_ms: int) -> Step:
    def step(state, ts, arg):
        ok = state is None or ts - state >= gap_ms
        return (ts if ok else state), (ok,)

    return step


def compare_and_set(state, ts, arg):
    """The argument is the version expected, from 0 on; -1 expects whatever it is."""
    version = state or 0
    ok = arg == -1 or arg == version
    return version + ok, (bool(ok), version + ok)


def lease(held_ms: int, failed_ms: int) -> Step:
    def step(state, ts, arg):
        ok = state is None or ts >= state
        until = ts + (failed_ms if arg else held_ms) if ok else state
        return until, (ok, until)

    return step
