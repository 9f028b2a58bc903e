"""State that changes by itself: batch and stream tell the same, and a change needs no further row of its key."""

import random

import pytest
from pyspark.sql import functions as F

from inkstream.operators import timed
from inkstream.streaming import timers

LEASE = "outcome string, until_ms long"
PUBLICATION = "state string, outcome string, started_ms long, receipt_ms long, archive_ms long"
KIND = "key string, ts_ms long, id long, arg struct<kind: long, claim: long, sha: long>"


def told(machine, rows, upto):
    """A plain walk over (key, ts, id, arg)."""
    out = []
    for key in {r[0] for r in rows}:
        state = None
        for _, ts, row_id, arg in sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3]):
            for state, at, result in machine.until(state, ts):
                out.append((key, at, None, *result))
            state, result = machine.command(state, ts, arg)
            out.append((key, ts, row_id, *result))
        out += [(key, at, None, *result) for state, at, result in machine.until(state, upto)]
    return sorted(out, key=repr)


def test_publication_rules():
    m = timed.Publication()
    do = lambda state, ts, kind, claim=1, sha=7: m.command(state, ts, {"kind": kind, "claim": claim, "sha": sha})
    state, said = do(None, 0, 1)
    assert state is None and said[1] == "conflict"
    state, said = do(state, 1000, 0)
    assert said == ("publishing", "acquired", 1000, None, None) and m.due(state) == 301_000
    assert do(state, 2000, 0)[1][1] == "busy" and do(state, 2000, 1, claim=2)[1][1] == "conflict" and do(state, 2000, 2)[1][1] == "conflict"
    assert list(m.until(state, 300_999)) == []
    ((state, at, said),) = m.until(state, 301_000)
    assert (at, said[1]) == (301_000, "stale") and do(state, 301_000, 0)[1][1] == "resumed" and m.due(state) is None
    state, said = do(state, 400_000, 1)
    assert said[:2] == ("committed", "committed")
    assert do(state, 1, 1)[1][1] == "repeated" and do(state, 1, 1, sha=8)[1][1] == "conflict" and do(state, 1, 0)[1][1] == "awaiting"
    state, said = do(state, 500_000, 2)
    assert said == ("completed", "completed", 1000, 500_000 + 30 * timed.DAY, 500_000 + 365 * timed.DAY)
    assert do(state, 600_000, 2)[1][1] == "repeated" and do(state, 600_000, 0)[1][1] == "gone"
    changes = list(m.until(state, 500_000 + 400 * timed.DAY))
    assert [(at - 500_000, said[1]) for _, at, said in changes] == [(30 * timed.DAY, "receipt gone"), (365 * timed.DAY, "archive gone")]
    assert do(changes[0][0], 0, 2)[1][1] == "gone"


BASE = 1_700_000_000_000
CASES = {"lease": (timed.Lease(900, 300), LEASE), "publication": (timed.Publication(500, 2000, 5000), PUBLICATION)}


def commands(name, n):
    draw = random.Random(4)
    whole = lambda: {"kind": draw.randrange(3), "claim": draw.randrange(2), "sha": draw.randrange(2)}
    return [(draw.choice(["a", "b", "c", None]), BASE + 97 * i, i, whole()) for i in range(n)]


@pytest.mark.parametrize("name", CASES)
def test_batch_and_stream(spark, tmp_path, name):
    machine, schema = CASES[name]
    arg = "arg.kind = 0" if name == "lease" else "arg"
    last = ("late", BASE + 97 * 90, 1000, {"kind": 0, "claim": 0, "sha": 0})  # a key whose only row no other follows
    rows = [*commands(name, 90), last, ("end", BASE + 97 * 90 + 20_000, 1001, {"kind": 1, "claim": 0, "sha": 0})]
    for k in range(0, len(rows), 30):
        spark.createDataFrame(rows[k : k + 30], KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    upto = BASE + 97 * 90 + 20_000
    plain = [(k, ts, i, (a["kind"] == 0) if name == "lease" else a) for k, ts, i, a in rows]
    want = told(machine, plain, upto)
    batch = spark.createDataFrame(rows, KIND).withColumn("arg", F.expr(arg))
    found = timed.fold(batch, machine, schema, timed.horizon(batch)).collect()
    assert sorted(map(tuple, found), key=repr) == want
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("arg", F.expr(arg))
    out = timers.fold(stream, machine, schema).writeStream.format("memory").queryName(f"timed_{name}").outputMode("append")
    run = out.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    assert run.awaitTermination(240)
    got = sorted(map(tuple, spark.table(f"timed_{name}").collect()), key=repr)
    assert got == want
    assert any(r[0] == "late" and r[2] is None for r in got)


@pytest.mark.parametrize("name", CASES)
def test_blocks(spark, name):
    """A key with more commands than a block has gives the same."""
    machine, schema = CASES[name]
    rows = commands(name, 200)
    arg = "arg.kind = 0" if name == "lease" else "arg"
    table = spark.createDataFrame(rows, KIND).withColumn("arg", F.expr(arg))
    upto = BASE + 97 * 200 + 3000
    plain = [(k, ts, i, (a["kind"] == 0) if name == "lease" else a) for k, ts, i, a in rows]
    found = timed.fold(table, machine, schema, upto, block=15)
    assert sorted(map(tuple, found.collect()), key=repr) == told(machine, plain, upto)


def test_no_rows(spark):
    rows = spark.createDataFrame([], KIND)
    assert timed.fold(rows, timed.Publication(), PUBLICATION, timed.horizon(rows)).count() == 0
