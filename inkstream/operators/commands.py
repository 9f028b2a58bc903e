"""Steps of command folds and commands that need no fold.

A step takes the state (None at first), the time and the command's arguments, and gives the new state and the results.
States are tuples of whole numbers, so that the streaming twin can keep them as JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.operators.folds import Step


def versioned(state, ts, arg):
    """Create, update and delete by expected version; 0 is no record. A delete frees the key."""
    version, expected = state or 0, arg["expected"]
    if not version:
        return (1, ("created", 1)) if expected == 0 else (0, ("missing", 0))
    if expected != version:
        return version, ("conflict", version)
    return (0, ("deleted", 0)) if arg["delete"] else (version + 1, ("updated", version + 1))


def reservation(held_ms: int, failed_ms: int, staged_ms: int) -> Step:
    """Commands 0 acquire, 1 fail and 2 stage a draft under the holder's token; retry takes over what has failed."""

    def step(state, ts, arg):
        holder, stage, until = state or (-1, 0, 0)  # 1 processing, 2 failed, 3 staged
        if arg["kind"] == 0:
            if ts >= until or (stage == 2 and arg["retry"]):
                return (arg["token"], 1, ts + held_ms), ("acquired", ts + held_ms)
            return (holder, stage, until), ("held", until)
        if stage == 1 and ts < until and arg["token"] == holder:
            stage, until, said = (2, ts + failed_ms, "failed") if arg["kind"] == 1 else (3, ts + staged_ms, "staged")
            return (holder, stage, until), (said, until)
        return (holder, stage, until), ("conflict", until)

    return step


def draft(state, ts, arg):
    """Edits (a new revision, no approval left) and touches (a new version) under four expectations."""
    revision, version, content, claim, verified = state or (1, 1, 0, 0, 1)
    if (arg["revision"], arg["version"], arg["hash"], arg["claim"]) != (revision, version, content, claim):
        return (revision, version, content, claim, verified), ("conflict", revision, version, bool(verified))
    if arg["edit"]:
        state = (revision + 1, version + 1, arg["new_hash"], claim, 0)
        return state, ("edited", revision + 1, version + 1, False)
    return (revision, version + 1, content, claim, verified), ("touched", revision, version + 1, bool(verified))


def review(state, ts, arg):
    """Commands on a draft under review: 0 touch, 1 edit, 2 approve evidence, 3 approve media, 4 claim for publication.

    All expect revision and content; touches and edits the version too. An edit starts a new revision: its content is
    validated anew and both approvals go. Evidence may be approved again; media approved is fixed until an edit. A claim
    needs both approvals and valid content, and may be repeated; nothing else changes a claimed draft.
    """
    revision, version, content, evidence, media, valid, claimed = state or (1, 1, 0, 0, 0, 1, 0)
    kind, approval = arg["kind"], arg["approval"]
    said, same = "conflict", (arg["revision"], arg["hash"]) == (revision, content)
    if same and kind == 4:
        if claimed:
            said = "claimed"
        elif evidence and media and valid:
            said, claimed, version = "claimed", 1, version + 1
    elif same and not claimed:
        if kind == 2:
            said, version = ("unchanged", version) if evidence == approval else ("evidence approved", version + 1)
            evidence = approval
        elif kind == 3:
            if not media:
                said, media, version = "media approved", approval, version + 1
            elif media == approval:
                said = "unchanged"
        elif arg["version"] == version:
            version += 1
            said = "touched"
            if kind == 1:
                said, revision, content, evidence, media, valid = "edited", revision + 1, arg["new_hash"], 0, 0, arg["valid"]
    state = (revision, version, content, evidence, media, valid, claimed)
    return state, (said, revision, version, evidence, media, bool(valid))


def ledger(lease_ms: int, ttl_ms: int) -> Step:
    """Commands 0 claim, 1 dispatch, 2 complete of a record bound to a payload digest, gone ``ttl_ms`` after its last change."""

    def step(state, ts, arg):
        kind, digest = arg["kind"], arg["digest"]
        held, stage, lease, gone = state or (-1, 0, 0, 0)
        if not stage or ts >= gone:
            return ((digest, 1, ts + lease_ms, ts + ttl_ms), ("claimed",)) if kind == 0 else (None, ("refused",))
        same = (held, stage, lease, gone)
        if digest != held:
            return same, ("conflict" if kind == 0 else "refused",)
        if kind == 0:
            if stage == 1 and ts >= lease:
                return (held, 1, ts + lease_ms, ts + ttl_ms), ("claimed",)
            return same, (("busy", "dispatched", "completed")[stage - 1],)
        if kind == stage:
            return (held, stage + 1, lease, ts + ttl_ms), (("dispatched", "completed")[kind - 1],)
        return same, ("refused",)

    return step


def first_of(rows: DataFrame, key: str, first: str, later: str, same: str | None = None, payload: str | None = None) -> DataFrame:
    """(id, outcome) of ``rows`` (id, ts_ms, key, payload): the first of a key, and what befalls later ones.

    The first is a minimum joined back, so a key with very many rows is no single task. Rows with a null key are firsts.
    """
    columns = ["ts_ms", "id", *([payload] if payload else [])]
    low = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.min(F.struct(*columns)).alias("__f"))
    joined = rows.join(low, F.col(key) == F.col("__k"), "left")
    outcome = F.when(F.col("__f").isNull() | (F.col("id") == F.col("__f.id")), first)
    if payload:
        outcome = outcome.when(F.col(payload).eqNullSafe(F.col(f"__f.{payload}")), same)
    return joined.select("id", outcome.otherwise(later).alias("outcome"))


def evidence_ledger(cited: DataFrame, fetched: DataFrame) -> DataFrame:
    """(draft, ledger): SHA-256 of the sorted cited URLs with the digests of the texts fetched for them, as JSON.

    ``cited``: draft, url; ``fetched``: draft, url, text, of which the smallest digest counts where a URL has several.
    Null where fewer than two URLs are cited or one has no text. A draft cites a dozen URLs at most.
    """
    wanted = cited.select("draft", "url").distinct()
    texts = fetched.groupBy(F.col("draft").alias("d"), F.col("url").alias("u")).agg(F.min(F.sha2("text", 256)).alias("contentHash"))
    joined = wanted.join(texts, (F.col("draft") == F.col("d")) & (F.col("url") == F.col("u")), "left")
    items = F.array_sort(F.collect_list(F.struct("url", "contentHash")))
    rows = joined.groupBy("draft").agg(items.alias("items"), F.count(F.lit(1)).alias("n"), F.count("contentHash").alias("found"))
    payload = F.to_json(F.transform("items", lambda x: F.struct(x["contentHash"].alias("contentHash"), x["url"].alias("url"))))
    return rows.select("draft", F.when((F.col("n") >= 2) & (F.col("found") == F.col("n")), F.sha2(payload, 256)).alias("ledger"))


def parity(old: DataFrame, new: DataFrame) -> DataFrame:
    """(state, n): records (id, h) of ``old`` that ``new`` lacks, has alike, or has with another hash."""
    other = new.select(F.col("id").alias("i"), F.col("h").alias("g"))
    state = F.when(F.col("i").isNull(), "missing").when(F.col("h").eqNullSafe(F.col("g")), "same").otherwise("collision")
    return old.join(other, F.col("id") == F.col("i"), "left").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def publish_order(drafts: DataFrame, now_ms: int, limit: int, backlog: bool = False, least_hours: int = 12, most_days: int = 21) -> DataFrame:
    """The first ``limit`` (one to ten) of ``drafts`` (id, created_ms, score): the newest, or the best of a backlog's age."""
    limit = max(1, min(10, limit))
    if not backlog:
        return drafts.orderBy(F.desc("created_ms"), "id").limit(limit)
    age = F.lit(now_ms) - F.col("created_ms")
    timely = drafts.where(age.between(max(0, least_hours) * 3_600_000, max(1, most_days) * 86_400_000))
    return timely.orderBy(F.desc("score"), F.desc("created_ms"), "id").limit(limit)
