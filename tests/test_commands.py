"""Command folds on short histories."""

from inkstream.operators import commands, folds


def walk(step, *history):
    state, out = None, []
    for ts, arg in history:
        state, result = step(state, ts, arg)
        out.append(result[0])
    return out


def test_versions():
    step = commands.versioned
    cas = lambda e, d=0: dict(expected=e, delete=d)
    assert walk(step, (0, cas(1)), (1, cas(0)), (2, cas(1)), (3, cas(1)), (4, cas(2, 1)), (5, cas(2)), (6, cas(0))) == ["missing", "created", "updated", "conflict", "deleted", "missing", "created"]


def test_reservation():
    step = commands.reservation(45, 60, 1000)
    do = lambda kind, token, retry=0: dict(kind=kind, token=token, retry=retry)
    got = walk(step, (0, do(0, 1)), (10, do(0, 2)), (20, do(1, 2)), (30, do(1, 1)), (40, do(0, 3)), (50, do(0, 3, 1)), (60, do(2, 3)), (70, do(2, 3)), (2000, do(0, 4)), (2100, do(2, 4)))
    assert got == ["acquired", "held", "conflict", "failed", "held", "acquired", "staged", "conflict", "acquired", "conflict"]


def test_draft():
    step = commands.draft
    do = lambda r, v, h, edit, new=0, claim=0: dict(revision=r, version=v, hash=h, claim=claim, edit=edit, new_hash=new)
    assert walk(step, (0, do(1, 1, 0, 0)), (1, do(1, 1, 0, 0)), (2, do(1, 2, 0, 1, 7)), (3, do(2, 3, 0, 0)), (4, do(2, 3, 7, 0)), (5, do(2, 4, 7, 0, claim=1))) == ["touched", "conflict", "edited", "conflict", "touched", "conflict"]
    state, _ = step(None, 0, do(1, 1, 0, 1, 5))
    assert state == (2, 2, 5, 0, 0)


def test_review():
    do = lambda kind, revision=1, version=1, hash=0, approval=5, valid=1: dict(kind=kind, revision=revision, version=version, hash=hash, new_hash=9, approval=approval, valid=valid)
    got = walk(commands.review, (0, do(4)), (1, do(2)), (2, do(2)), (3, do(3)), (4, do(3, approval=6)), (5, do(1, version=1)), (6, do(1, version=3)), (7, do(3)), (8, do(4, 2, hash=9)), (9, do(3, 2, hash=9, approval=6)), (10, do(2, 2, hash=9)), (11, do(4, 2, hash=9)), (12, do(0, 2, 7, 9)), (13, do(4, 2, hash=9)))
    assert got == ["conflict", "evidence approved", "unchanged", "media approved", "conflict", "conflict", "edited", "conflict", "conflict", "media approved", "evidence approved", "claimed", "conflict", "claimed"]
    state, said = commands.review((1, 3, 0, 5, 5, 1, 0), 0, do(1, version=3, valid=0))
    assert state == (2, 4, 9, 0, 0, 0, 0) and said[1:] == (2, 4, 0, 0, False)
    assert commands.review((2, 4, 9, 5, 5, 0, 0), 0, do(4, 2, hash=9))[1][0] == "conflict"


def test_ledger():
    step = commands.ledger(120, 1000)
    do = lambda kind, digest=1: dict(kind=kind, digest=digest)
    got = walk(step, (0, do(1)), (1, do(0)), (2, do(0)), (3, do(0, 9)), (130, do(0)), (131, do(1)), (132, do(0)), (133, do(2, 9)), (134, do(2)), (135, do(0)), (1200, do(0, 9)))
    assert got == ["refused", "claimed", "busy", "conflict", "claimed", "dispatched", "dispatched", "refused", "completed", "completed", "claimed"]


def test_first_of(spark):
    rows = spark.createDataFrame([(i, 5, "k", "p") for i in range(20)] + [(20, 9, "k", "q"), (21, 1, None, "p"), (22, 1, None, "p")], "id long, ts_ms long, k string, p string")
    found = {r.id: r.outcome for r in commands.first_of(rows, "k", "inserted", "conflict", same="replayed", payload="p").collect()}
    assert found == {0: "inserted", **{i: "replayed" for i in range(1, 20)}, 20: "conflict", 21: "inserted", 22: "inserted"}


def test_structs_pass_through_the_fold(spark):
    rows = spark.createDataFrame([("a", 2, 2, (1, 0)), ("a", 1, 1, (0, 0)), ("b", 1, 3, (1, 0)), ("a", 3, 4, (1, 0))], "key string, ts_ms long, id long, arg struct<expected: long, delete: long>")
    found = {r.id: r.outcome for r in folds.fold(rows, commands.versioned, "id long, outcome string, version long").collect()}
    assert found == {1: "created", 2: "updated", 3: "missing", 4: "conflict"}


def test_ledger_of_evidence(spark):
    cited = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "a"), (3, "a"), (3, "c")], "draft int, url string")
    fetched = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", "x"), (3, "a", "x"), (3, "c", None)], "draft int, url string, text string")
    found = {r.draft: r.ledger for r in commands.evidence_ledger(cited, fetched).collect()}
    assert found[1] and len(found[1]) == 64 and found[2] is None and found[3] is None
