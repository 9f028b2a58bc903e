"""A key with very many rows gives the same in blocks that are folded side by side as in one task."""

import random

import pytest

from inkstream.operators import commands, folds

PLAIN = "key string, ts_ms long, id long, arg long"
RECORD = "key string, ts_ms long, id long, arg struct<kind: long, token: long, retry: long, digest: long, expected: long, delete: long>"
CASES = {
    "limiter": (folds.limiter(3, 1000), "id long, ok boolean, used long", PLAIN), "suppressor": (folds.suppressor(350), "id long, ok boolean", PLAIN),
    "compare_and_set": (folds.compare_and_set, "id long, ok boolean, version long", PLAIN), "lease": (folds.lease(500, 100), "id long, ok boolean, until long", PLAIN),
    "versioned": (commands.versioned, "id long, outcome string, version long", RECORD), "reservation": (commands.reservation(500, 900, 5000), "id long, outcome string, until long", RECORD),
    "ledger": (commands.ledger(200, 3000), "id long, outcome string", RECORD),
}


def rows(kind, n):
    draw = random.Random(9)
    whole = lambda: {"kind": draw.randrange(3), "token": draw.randrange(2), "retry": draw.randrange(2), "digest": draw.randrange(2), "expected": draw.randrange(4), "delete": draw.randrange(2)}
    return [(draw.choice(["hot", "hot", "hot", None, "b"]), 37 * (i // 2), i, draw.randrange(-1, 3) if kind == PLAIN else whole()) for i in range(n)]


@pytest.mark.parametrize("name", CASES)
def test_blocks_equal_one_task(spark, name):
    step, schema, kind = CASES[name]
    table = spark.createDataFrame(rows(kind, 400), kind)
    want = sorted(map(tuple, folds.fold(table, step, schema).collect()))
    assert len(want) == 400
    cut = folds.fold(table, step, schema, block=30)
    assert sorted(map(tuple, cut.collect())) == want
    text = cut._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(pid" in text


def test_hot_key_is_several_tasks(spark):
    table = spark.createDataFrame([("hot", i * 10, i, 0) for i in range(300)], PLAIN)
    out = folds.fold(table, folds.suppressor(35), "id long, ok boolean", block=50)
    sizes = [n for n in out.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect() if n]
    assert sum(sizes) == 300 and len(sizes) >= 3 and max(sizes) <= 200
