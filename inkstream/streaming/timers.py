"""Streaming twin of ``inkstream.operators.timed``: the machine's own changes are event-time timers of its key."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from inkstream.operators.timed import Machine, State

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class _Processor(StatefulProcessor):
    def __init__(self, machine: Machine, names: list[str]) -> None:
        self.machine, self.names = machine, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("state", "held string")

    def _load(self) -> State:
        if not self.held.exists():
            return None
        found = json.loads(self.held.get()[0])
        return None if found is None else tuple(found)

    def _keep(self, state: State) -> None:
        """State and its one timer; a key without state is dropped from the store."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if state is None:
            self.held.clear()
            return
        self.held.update((json.dumps(state, default=int),))
        at = self.machine.due(state)
        if at is not None:
            self.handle.registerTimer(at)

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=self.names, dtype=object)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, out = self._load(), []
        batch = pd.concat(list(rows)).sort_values(["ts_ms", "id"], kind="stable")
        for ts, row_id, arg in zip(batch["ts_ms"], batch["id"], batch["arg"]):
            for state, at, results in self.machine.until(state, int(ts)):
                out.append((key[0], at, None, *results))
            state, results = self.machine.command(state, int(ts), arg)
            out.append((key[0], int(ts), int(row_id), *results))
        self._keep(state)
        yield self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, out = self._load(), []
        # A change may bring another that the watermark has passed too; no second timer would fire for it in this batch.
        for state, at, results in self.machine.until(state, timerValues.getCurrentWatermarkInMs()):
            out.append((key[0], at, None, *results))
        self._keep(state)
        yield self._frame(out)

    def close(self) -> None:
        pass


def fold(rows: DataFrame, machine: Machine, schema: str, late: str = "0 seconds") -> DataFrame:
    """Apply ``machine`` to a stream of ``rows`` (key, ts_ms, id, arg): the rows of ``operators.timed.fold``.

    Within a micro-batch a key's rows go by time, then id. The watermark lies ``late`` behind the newest time; rows
    behind it are dropped, and state changes that it passes are told even if no row of their key comes. A key without
    state takes no room. State is kept in RocksDB, which timers need.
    """
    rows.sparkSession.conf.set(PROVIDER, ROCKS)
    kind = rows.schema["key"].dataType.simpleString()
    names = ["key", "at_ms", "id", *(c.split()[0] for c in schema.split(", "))]
    timed = rows.select("key", "ts_ms", "id", "arg", F.timestamp_millis("ts_ms").alias("at")).withWatermark("at", late)
    processor = _Processor(machine, names)
    return timed.groupBy("key").transformWithStateInPandas(processor, f"key {kind}, at_ms long, id long, {schema}", "Append", "EventTime")
