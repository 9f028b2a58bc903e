"""Streams give what the batch folds give."""

import random

import pytest
from pyspark.sql import functions as F

from inkstream.operators import folds
from inkstream.streaming import folds as streams

CASES = {
    "limiter": (folds.limiter(3, 1000), "id long, ok boolean, used long"),
    "suppressor": (folds.suppressor(350), "id long, ok boolean"),
    "compare_and_set": (folds.compare_and_set, "id long, ok boolean, version long"),
    "lease": (folds.lease(500, 100), "id long, ok boolean, until long"),
}


def test_claims_and_late_rows(spark, tmp_path):
    """One claim of a key while its state lives; rows ahead of or behind the present go."""
    import datetime

    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    rows = [("a", at(0)), ("a", at(3)), ("b", at(4)), ("a", at(5))]
    for k, row in enumerate(rows):
        spark.createDataFrame([row], "key string, at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = streams.claim_once(stream, "1 hour").writeStream.format("memory").queryName("claims").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    assert run.awaitTermination(120)
    assert sorted(r.key for r in spark.table("claims").collect()) == ["a", "b"]
    table = spark.createDataFrame([(i, at(m)) for i, m in enumerate((0, 4, 6, -21 * 1440, -21 * 1440 - 1))], "i int, at timestamp")
    assert sorted(r.i for r in streams.on_time(table, "at", F.lit(at(0))).collect()) == [0, 1, 3]


@pytest.mark.parametrize("name", CASES)
def test_stream_equals_batch(spark, tmp_path, name):
    step, schema = CASES[name]
    draw = random.Random(3)
    rows = [(draw.choice(["a", "b", None]), 37 * i, i, draw.randrange(2 if name == "lease" else 4)) for i in range(120)]
    kind = "key string, ts_ms long, id long, arg long"
    for k in range(3):
        spark.createDataFrame(rows[40 * k : 40 * k + 40], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = sorted(map(tuple, folds.fold(spark.createDataFrame(rows, kind), step, schema).collect()))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = streams.fold(stream, step, schema).writeStream.format("memory").queryName(f"stream_{name}").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    assert run.awaitTermination(120)
    assert sorted(map(tuple, spark.table(f"stream_{name}").collect())) == want


def test_suppressor_chain():
    """Rows at 0, 200 and 400 ms: accepted, dropped, accepted."""
    step, state, out = folds.suppressor(350), None, []
    for ts in (0, 200, 400):
        state, (ok,) = step(state, ts, 0)
        out.append(ok)
    assert out == [True, False, True]
