"""Ordered folds whose state also changes by itself when a time is reached: leases that run out, receipts that go.

A machine says what a command does, when the state next changes without one, and what that change is. The batch fold
here and the stream in ``inkstream.streaming.timers`` apply the same machine: a change that is due before a key's next
command comes first, and one that no command follows comes when time has passed it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.operators import folds

MINUTE, DAY = 60_000, 86_400_000
State = tuple | None


class Machine:
    """States are tuples of whole numbers, None at first and after the end."""

    def command(self, state: State, ts: int, arg) -> tuple[State, tuple]:
        """The state after a command at ``ts`` and the results of its row."""
        raise NotImplementedError

    def due(self, state: State) -> int | None:
        """When the state next changes by itself."""
        raise NotImplementedError

    def elapse(self, state: State, at: int) -> tuple[State, tuple]:
        """The state after that change and the results of its row."""
        raise NotImplementedError

    def until(self, state: State, ts: int) -> Iterator[tuple[State, int, tuple]]:
        """The changes due at ``ts`` or before it, in order: a command at the very moment finds them done."""
        while state is not None and (at := self.due(state)) is not None and at <= ts:
            state, results = self.elapse(state, at)
            yield state, at, results


@dataclass(frozen=True)
class Lease(Machine):
    """Acquire a key for ``held_ms``, or for ``failed_ms`` where the command says that its work failed."""

    held_ms: int
    failed_ms: int

    def command(self, state: State, ts: int, arg) -> tuple[State, tuple]:
        if state is not None:
            return state, ("held", state[0])
        until = ts + (self.failed_ms if arg else self.held_ms)
        return (until,), ("acquired", until)

    def due(self, state: State) -> int | None:
        return state[0]

    def elapse(self, state: State, at: int) -> tuple[State, tuple]:
        return None, ("expired", at)


STAGES = ("draft", "publishing", "committed", "completed")


@dataclass(frozen=True)
class Publication(Machine):
    """Publication of a draft: commands (kind, claim, sha) 0 claim, 1 commit, 2 complete.

    One claim at a time; after ``stale_ms`` another may resume it, since a commit can be repeated. Commit and complete
    need the claim's token; a commit may be repeated with the same sha, completion while the receipt is kept. The
    draft leaves with completion, its receipt and then its archive after theirs.
    """

    stale_ms: int = 5 * MINUTE
    receipt_ms: int = 30 * DAY
    archive_ms: int = 365 * DAY

    def command(self, state: State, ts: int, arg) -> tuple[State, tuple]:
        stage, claim, started, stale, sha, receipt, archive = state or (0, -1, 0, 0, -1, 0, 0)
        kind, token, new = arg["kind"], arg["claim"], arg["sha"]
        if stage == 0:
            if kind == 0:
                return (1, token, ts, 0, -1, 0, 0), ("publishing", "acquired", ts, None, None)
            return state, ("draft", "conflict", None, None, None)
        same = (stage, claim, started, stale, sha, receipt, archive)
        result = lambda state, said: (state, (STAGES[state[0]], said, state[2], state[5] or None, state[6] or None))
        if stage == 3:
            return result(same, "repeated" if kind == 2 and token == claim and receipt else "gone")
        if kind == 0:
            return result(same, "resumed" if stale else "awaiting" if stage == 2 else "busy")
        if token != claim:
            return result(same, "conflict")
        if kind == 1:
            if stage == 1:
                return result((2, claim, started, 0, new, 0, 0), "committed")
            return result(same, "repeated" if new == sha else "conflict")
        if stage == 1:
            return result(same, "conflict")
        return result((3, claim, started, 0, sha, ts + self.receipt_ms, ts + self.archive_ms), "completed")

    def due(self, state: State) -> int | None:
        stage, _, started, stale, _, receipt, archive = state
        if stage == 1:
            return None if stale else started + self.stale_ms
        return (receipt or archive or None) if stage == 3 else None

    def elapse(self, state: State, at: int) -> tuple[State, tuple]:
        stage, claim, started, _, sha, receipt, archive = state
        if stage == 1:
            return (1, claim, started, 1, sha, 0, 0), ("publishing", "stale", started, None, None)
        if receipt:
            return (3, claim, started, 0, sha, 0, archive), ("completed", "receipt gone", started, None, archive)
        return (3, claim, started, 0, sha, 0, 0), ("completed", "archive gone", started, None, None)


END = (1 << 63) - 1  # id of the row that stands for the end of a key's time


def fold(rows: DataFrame, machine: Machine, schema: str, upto_ms: int, block: int = folds.BLOCK) -> DataFrame:
    """Apply ``machine`` to ``rows`` (key, ts_ms, id, arg), and its own changes up to ``upto_ms``.

    ``schema`` names the results; key, at_ms and id (null for a change without a command) come first. A key's rows go
    by time, then id, streamed through one task that holds its state alone; where a key has more than ``block``, all
    goes through ``folds.fold``, which cuts such keys into blocks. Null keys are one key, and no id is ``END``.
    """
    rows = rows.select("key", "ts_ms", "id", "arg")
    if not rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).isEmpty():
        return _in_blocks(rows, machine, schema, upto_ms, block)
    kind = rows.schema["key"].dataType.simpleString()
    names = ["key", "at_ms", "id", *(c.split()[0] for c in schema.split(", "))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state, seen = None, None, False
        for frame in frames:
            out = []
            for key, ts, row_id, arg in zip(frame["key"], frame["ts_ms"], frame["id"], frame["arg"]):
                key = None if pd.isna(key) else key
                if not seen or key != last:
                    out += [(last, at, None, *r) for _, at, r in machine.until(state, upto_ms)]
                    last, state, seen = key, None, True
                for state, at, results in machine.until(state, ts):
                    out.append((key, at, None, *results))
                state, results = machine.command(state, ts, arg)
                out.append((key, ts, row_id, *results))
            yield _frame(out, names)
        yield _frame([(last, at, None, *r) for _, at, r in machine.until(state, upto_ms)], names)

    ordered = rows.repartition("key").sortWithinPartitions("key", "ts_ms", "id")
    return ordered.mapInPandas(run, f"key {kind}, at_ms long, id long, {schema}")


def _in_blocks(rows: DataFrame, machine: Machine, schema: str, upto_ms: int, block: int) -> DataFrame:
    """The same as an ordered fold whose rows tell all that happens up to them; each key has a last row at ``upto_ms``."""
    fields = [c.split()[0] for c in schema.split(", ")]
    names = ["at_ms", "id", *fields]

    def step(state, ts, row):
        told = []
        for state, at, results in machine.until(state, ts):
            told.append(dict(zip(names, (at, None, *results))))
        if row["id"] != END:
            state, results = machine.command(state, ts, row["arg"])
            told.append(dict(zip(names, (ts, row["id"], *results))))
        return state, (row["key"], told)

    ends = rows.select("key").distinct().select("key", F.lit(upto_ms).cast("long").alias("ts_ms"), F.lit(END).alias("id"), F.lit(None).cast(rows.schema["arg"].dataType).alias("arg"))
    every = rows.select("key", "ts_ms", F.col("id").cast("long").alias("id"), "arg").unionByName(ends)
    every = every.select("key", "ts_ms", "id", F.struct("key", "id", "arg").alias("arg"))
    kind = rows.schema["key"].dataType.simpleString()
    inner = ",".join(f"{c.split()[0]}:{c.split()[1]}" for c in ("at_ms long", "id long", *schema.split(", ")))
    told = folds.fold(every, step, f"last long, key {kind}, told array<struct<{inner}>>", block)
    return told.select("key", F.explode("told").alias("t")).select("key", *[F.col(f"t.{n}").alias(n) for n in names])


def _frame(out: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=names, dtype=object)


def horizon(rows: DataFrame) -> int:
    """The newest time of ``rows``, up to which their state changes are told."""
    return rows.agg(F.max("ts_ms").alias("ts")).first().ts or 0
