"""Bucketed records, dated runs, drafts by slug, JSON of any shape, facets and locale order."""

import itertools
import json
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

from inkstream.functions import canonical
from inkstream.operators import facets
from inkstream.sources import drafts, records


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_records_keep_their_buckets(spark):
    rows = [(i, f"r{i}") for i in range(500) if i % 7]
    table = records.store(spark.createDataFrame(rows, "id long, body string"), 8)
    index = spark.createDataFrame([(i, i * 10) for i in range(500)] + [(None, 55)], "id long, score long")
    found = records.multi_get(records.indexed_range(index, 50, 2000), table)
    assert sorted((r.id, r.score) for r in found.collect()) == [(i, i * 10) for i in range(5, 201) if i % 7]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = plan(records.multi_get(index, table))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert text.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in text
    assert "Exchange" not in text[text.rindex("Sort [id") : text.index("Bucketed: true")]


def test_a_few_ids_prune_buckets(spark):
    table = records.store(spark.createDataFrame([(i, "x") for i in range(200)], "id long, body string"), 16)
    few = records.get(spark.createDataFrame([(3, 1), (999, 2), (3, 9)], "id long, score long"), table)
    assert sorted((r.id, r.score) for r in few.collect()) == [(3, 1), (3, 9)]
    one = records.by_ids(spark, table, [3, 999])
    assert [r.id for r in one.collect()] == [3]
    assert one.rdd.getNumPartitions() < spark.table(table).rdd.getNumPartitions()  # files of two buckets, not of 16
    many = records.get(spark.range(0, 3000).select("id", F.col("id").alias("score")), table)
    assert many.count() == 200


def test_runs_replace_their_day_alone(spark, tmp_path):
    folder = f"file://{tmp_path}/runs"
    make = lambda *rows: spark.createDataFrame(rows, "topic string, n long")
    most = {"most": F.max("n")}
    assert drafts.save_run(make(("a", 1), ("b", 5)), folder, "2024-01-01", **most) == {"run_day": "2024-01-01", "rows": 2, "most": 5}
    drafts.save_run(make(("c", 2)), folder, "2024-01-02", **most)
    first = {p: p.stat().st_mtime_ns for p in Path(tmp_path).rglob("run_day=2024-01-01/*.json")}
    assert len(first) >= 2
    drafts.save_run(make(("d", 3), ("e", 4), ("f", 6)), folder, "2024-01-02", **most)
    assert first == {p: p.stat().st_mtime_ns for p in Path(tmp_path).rglob("run_day=2024-01-01/*.json")}
    runs = drafts.read_runs(spark, folder, "topic string, n bigint")
    assert sorted((r.run_day, r.topic) for r in runs.collect()) == [("2024-01-01", "a"), ("2024-01-01", "b"), *(("2024-01-02", t) for t in "def")]
    assert "PartitionFilters: [isnotnull(run_day" in plan(runs.where("run_day = '2024-01-01'"))
    logs = drafts.read_logs(spark, folder, "rows bigint, most bigint")
    assert sorted((r.run_day, r.rows, r.most) for r in logs.collect()) == [("2024-01-01", 2, 5), ("2024-01-02", 3, 6)]


def test_drafts_keep_the_last_save_of_a_slug(spark, tmp_path):
    folder, schema = f"file://{tmp_path}/drafts", "slug string, saved_ms bigint, body string"
    assert drafts.read_drafts(spark, folder, schema).count() == 0
    make = lambda rows: spark.createDataFrame(rows, schema)
    drafts.save_drafts(make([(f"s{i}", 5, "one") for i in range(300)] + [("s1", 9, "late"), (None, 1, "no slug")]), folder)
    files = {p: p.stat().st_mtime_ns for p in Path(tmp_path).rglob("*.json")}
    drafts.save_drafts(make([("s0", 7, "two"), ("s1", 7, "older"), ("new", 1, "x")]), folder)
    now = {p: p.stat().st_mtime_ns for p in Path(tmp_path).rglob("*.json")}
    assert sum(files[p] != now.get(p) for p in files) <= 3
    found = {r.slug: (r.saved_ms, r.body) for r in drafts.read_drafts(spark, folder, schema).collect()}
    assert len(found) == 301 and found["s0"] == (7, "two") and found["s1"] == (9, "late") and found["new"] == (1, "x") and found["s2"] == (5, "one")


def test_json_of_any_shape(spark):
    value = {"b": [1, {"z": None, "a": {"y": "é\"\\", "x": [True, {}]}}], "a": 2.5, "A": "", "c": {"deep": {"er": [[], [3]]}}}

    def orders(x):
        if isinstance(x, dict):
            for keys in itertools.islice(itertools.permutations(x), 4):
                yield {k: next(iter(orders(x[k]))) for k in keys}
                yield {k: list(orders(x[k]))[-1] for k in keys}
        elif isinstance(x, list):
            yield [list(orders(y))[-1] for y in x]
        else:
            yield x

    texts = [json.dumps(x, indent=i % 3 or None, ensure_ascii=i % 2 == 0) for i, x in enumerate(orders(value))]
    assert len(set(texts)) > 5
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(canonical.canonical_json(F.col("t")).alias("c"), canonical.json_hash(F.col("t")).alias("h")).distinct().collect()
    assert len(rows) == 1 and json.loads(rows[0].c) == value
    assert rows[0].c.startswith('{"A":"","a":2.5,"b":[1,{"a":{"x":')
    odd = [None, "", "nope", "{", '{"a":1,"a":2}', "[1.0, 2.50]", '"s"', "null"]
    found = [r.c for r in spark.createDataFrame([(t,) for t in odd], "t string").select(canonical.canonical_json(F.col("t")).alias("c")).collect()]
    assert found == [None, None, None, None, None, "[1,2.5]", '"s"', "null"]


def test_facets(spark):
    rows = [(i, "abc"[i % 3] if i % 7 else None, i % 4, [x for x in "xyz" if (i * 5 + ord(x)) % 3] * (1 + i % 2) if i % 5 else None) for i in range(60)]
    table = spark.createDataFrame(rows, "i long, kind string, size long, tags array<string>")
    chosen = {"kind": "b", "size": facets.ALL, "tags": "x"}
    met = lambda r, f: {"kind": r[1] == "b", "size": True, "tags": r[3] is not None and "x" in r[3]}[f]
    want = Counter()
    for r in rows:
        for f, values in (("kind", [r[1]]), ("size", [str(r[2])]), ("tags", sorted(set(r[3] or [])))):
            for v in values:
                want[f, v] += all(met(r, g) for g in ("kind", "size", "tags") if g != f)
    found = {(r.facet, r.value): r.n for r in facets.counts(table, ["kind", "size"], "tags", chosen).collect()}
    assert found == dict(want)
    picked = {(r.facet, r.value) for r in facets.counts(table, ["kind", "size"], "tags", chosen).where("picked").collect()}
    assert picked == {("kind", "b"), ("tags", "x")}
    assert sorted(r.i for r in facets.selected(table, ["kind", "size"], "tags", chosen).collect()) == [r[0] for r in rows if met(r, "kind") and met(r, "tags")]
    plain = {(r.facet, r.value): r.n for r in facets.counts(table, ["size"], None, {}).collect()}
    assert plain == {("size", str(s)): 15 for s in range(4)}
    assert facets.counts(table.where("false"), ["kind"], "tags", chosen).count() == 0


def test_locale_order(spark):
    names = ["Zoë", "zoe", "Émile", "Emil", "Ähre", "Zebra", "apple", "Apple", "Straße", "Strasse", "Strab"]
    table = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.n for r in table.orderBy(canonical.in_locale(F.col("n"))).collect()] == ["Ähre", "apple", "Apple", "Emil", "Émile", "Strab", "Strasse", "Straße", "Zebra", "zoe", "Zoë"]
    joined = table.join(spark.createDataFrame([("APPLE",)], "m string"), canonical.in_locale(F.col("n"), canonical.LOCALE_CI) == F.col("m"))
    assert sorted(r.n for r in joined.collect()) == ["Apple", "apple"]
