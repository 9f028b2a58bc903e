"""Streaming twin of the ordered folds: the same step functions over Structured Streaming state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from inkstream.operators.folds import Step


def fold(rows: DataFrame, step: Step, schema: str, ttl_ms: int | None = None) -> DataFrame:
    """Apply ``step`` to a stream of ``rows`` (key, ts_ms, id, arg), keeping one state for each key between micro-batches.

    Within a micro-batch a key's rows go by time, then id; a row that comes in a later micro-batch is applied when it
    comes. A task holds one key's rows of one micro-batch, which the source's rate limit bounds. Null keys are one key.
    A key's state goes once ``ttl_ms`` of processing time have passed without a row of it; without a limit state stays
    for ever, which is right only where the keys are bounded.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        state = json.loads(held.get[0]) if held.exists else None
        batch = pd.concat(list(frames)).sort_values(["ts_ms", "id"], kind="stable")
        out = []
        for ts, row_id, arg in zip(batch["ts_ms"], batch["id"], batch["arg"]):
            state, result = step(state, int(ts), arg)
            out.append((row_id, *result))
        held.update((json.dumps(state, default=int),))
        if ttl_ms is not None:
            held.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(out, columns=names)

    timeout = GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.select("key", "ts_ms", "id", "arg").groupBy("key").applyInPandasWithState(run, schema, "held string", "append", timeout)


def claim_once(rows: DataFrame, ttl: str) -> DataFrame:
    """The first of the ``rows`` (key, at, ...) of each key within ``ttl`` of event time; ``at`` is a timestamp.

    State is kept for ``ttl`` behind the newest event and then dropped; a row that comes later still may claim anew.
    """
    return rows.withWatermark("at", ttl).dropDuplicatesWithinWatermark(["key"])


def on_time(rows: DataFrame, at: str, now, ahead: str = "5 minutes", behind: str = "21 days") -> DataFrame:
    """Rows whose time ``at`` is neither further ahead of ``now`` (a timestamp column) nor further behind it."""
    return rows.where((F.col(at) <= now + F.expr(f"INTERVAL {ahead}")) & (F.col(at) >= now - F.expr(f"INTERVAL {behind}")))
