"""Results of numbered queries and of the pipeline's stages, computed again in plain Python."""

import hashlib
import math
import struct
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from test_contracts import SF, linked_groups, result, words
from test_whole_runs import every_run

import corpus_pipeline
from inkstream.llm import avi, catalog, jaccard_join, mixing, order_minhash, toxicity
from inkstream.llm.common import materialize

M = (1 << 64) - 1


@pytest.fixture(scope="module")
def docs():
    found = duckdb.sql(f"SELECT doc_id, text, source FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    return {i: (t or "", s) for i, t, s in found}


def row_hash(doc_id, text, seed=0):
    h = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
    h = xxhash.xxh64_intdigest(struct.pack("<q", doc_id), h)
    h = xxhash.xxh64_intdigest(text.encode(), h)
    return h - (1 << 64) if h >> 63 else h


def mixture(docs, entropy=0.9, passes=2.0):
    """(weight, copies) of each document whose source has one block only."""
    n = {i: len(words(t)) for i, (t, _) in docs.items()}
    tokens = Counter()
    for i, (_, s) in docs.items():
        tokens[s] += n[i]
    total = tokens.total()
    share = {s: c / total for s, c in tokens.items() if c}

    def spread(a):
        power = [p**a for p in share.values()]
        return -sum(x / sum(power) * math.log(x / sum(power)) for x in power)

    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if spread(middle) >= entropy * math.log(len(share)) else (low, middle)
    a = max(1.0 if spread(1.0) >= entropy * math.log(len(share)) else low, 1 - math.log(passes) / math.log(max(share.values()) / min(share.values())))
    power = {s: p**a for s, p in share.items()}
    want = {s: power[s] / share[s] for s in share}
    least, out = min(want.values()), {}
    for s in share:
        times = max(1.0, want[s] / least)
        rest, used = (times - math.floor(times)) * tokens[s], 0
        for i in sorted((i for i in docs if docs[i][1] == s), key=lambda i: row_hash(i, docs[i][0])):
            used += n[i]
            out[i] = (power[s] / sum(power.values()), math.floor(times) + (n[i] > 0 and used <= rest) if n[i] else 1)
    return out


def test_mixing(spark, docs):
    found = result(spark, "op7_mixing")
    want = mixture(docs)
    assert found.keys() == want.keys()
    for i, r in found.items():
        assert r.weight == pytest.approx(want[i][0], rel=1e-5)
    assert sum(found[i].copies != want[i][1] for i in found) <= 1  # the exponent is searched to 32 ** -5


def test_mixing_exponent(spark):
    table = spark.createDataFrame([(f"s{i}", p) for i, p in enumerate((0.7, 0.2, 0.09, 0.01))], "source string, share double")
    a = mixing.exponent(table, entropy=0.95)
    power = [p**a for p in (0.7, 0.2, 0.09, 0.01)]
    h = -sum(x / sum(power) * math.log(x / sum(power)) for x in power)
    assert h == pytest.approx(0.95 * math.log(4), abs=1e-5)
    b = mixing.exponent(table, entropy=1.0, passes=3.0)
    assert (0.7 / 0.01) ** (1 - b) == pytest.approx(3.0, rel=1e-5)
    assert mixing.exponent(table.limit(1), 0.9, 2.0) == 1.0


def plain_mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M
    return x ^ (x >> 31)


def plain_fingerprint(text):
    odd, k, slots, length = int(order_minhash.ODD), order_minhash.K, order_minhash.SLOTS, order_minhash.LENGTH
    codes = [ord(c) for c in text]
    if not codes:
        return [0] * slots
    codes += [0] * (k - len(codes))
    seen, by_slot = Counter(), defaultdict(list)
    for at in range(len(codes) - k + 1):
        h = 0
        for c in codes[at : at + k]:
            h = (h * odd + c) & M
        h = plain_mix(h)
        rank = plain_mix((h * odd + seen[h] + 1) & M)
        seen[h] += 1
        by_slot[rank >> (64 - (slots - 1).bit_length())].append((rank, at, h))
    out, every = [], [x for some in by_slot.values() for x in some]
    for s in range(slots):
        best = sorted(by_slot[s])[:length]
        if len(best) < length:
            best = sorted(every, key=lambda x: plain_mix(x[0] ^ plain_mix(s + 1)))[:length]
        best = sorted(best + best[:1] * (length - len(best)), key=lambda x: x[1])
        value = 0
        for _, _, h in best:
            value = plain_mix((value * odd + h + 1) & M)
        out.append(value % 65535 + 1)
    return out


def plain_likeness(a, b):
    filled = [(x, y) for x, y in zip(a, b) if x or y]
    return sum(x == y for x, y in filled) / len(filled) if filled else 1.0


def test_order_minhash(spark, docs):
    found, ids = result(spark, "op9_order_minhash"), sorted(docs)
    marks = {i: plain_fingerprint(docs[i][0]) for i in ids if len(docs[i][0]) < 6000}
    checked = 0
    for k, i in enumerate(ids):
        following = ids[(k + 1) % len(ids)]
        if i not in marks or following not in marks:
            continue
        text, n = docs[i][0], len(docs[i][0]) // 4
        edited = plain_fingerprint(text[: len(text) - n] + docs[following][0][:n])
        r = found[i]
        assert r.fingerprint == b"".join(struct.pack(">H", x) for x in marks[i]).hex()
        assert r.edited_fingerprint == b"".join(struct.pack(">H", x) for x in edited).hex()
        assert r.near_edited == pytest.approx(plain_likeness(marks[i], edited)) and r.near_next == pytest.approx(plain_likeness(marks[i], marks[following]))
        checked += 1
    assert checked > 100


def plain_segments(scores):
    found = []

    def split(a, b):
        best = max(((sum(scores[i:j]), i - j, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
        if best[0] > 0:
            found.append((best[0], best[2], best[3] - 1))
            split(a, best[2])
            split(best[3], b)

    split(0, len(scores))
    return found


def test_toxicity_model_and_scores(spark):
    sf = "/root/testdata/sf0.01"
    frame, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(frame, labels)
    known = labels.where("toxic IS NOT NULL").where(~toxicity.held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))
    rows = frame.join(known, "doc_id").where(half == 0).select("text", "toxic").collect()
    tokens, n, held = [Counter(), Counter()], [0, 0], Counter()
    for r in rows:
        bag = Counter(toxicity.WORD.findall((r.text or "").lower()))
        mine = Counter()
        for w, c in bag.items():
            for f in toxicity.features_of(w):
                mine[f] += c
        n[r.toxic] += bag.total()
        tokens[r.toxic].update({f: min(c, toxicity.BURST) for f, c in mine.items()})
        held.update(mine.keys() if r.toxic else ())
    want = {}
    for f in held:
        t, c = tokens[1][f] + toxicity.PRIOR, tokens[0][f] + toxicity.PRIOR
        odds = math.log(t / n[1]) - math.log(c / n[0])
        if held[f] >= toxicity.LEAST_DOCS and odds >= toxicity.LEAST_ODDS and odds / math.sqrt(1 / t + 1 / c) >= toxicity.LEAST_Z:
            want[f] = odds
    assert model.scores.keys() == want.keys()
    assert all(model.scores[f] == pytest.approx(v) for f, v in want.items())
    found = {r.doc_id: r for r in toxicity.scored(frame, labels).collect()}
    checked = 0
    for r in frame.orderBy("doc_id").collect():
        split = toxicity.WORD.findall((r.text or "").lower())
        if len(split) > 60:
            continue
        scores = []
        for w in split:
            f = next((f for f in [f"{w}$", *(w[:k] for k in range(min(toxicity.LONGEST, len(w)), toxicity.SHORTEST - 1, -1))] if f in want), None)
            scores.append(want[f] if f else model.gap)
        base = math.log(model.size * max(1, len(split)))
        values = [model.rate * s - base for s, _, _ in plain_segments(scores)]
        z = model.weights[0] + model.weights[1] * max(values, default=-base) + model.weights[2] * math.log1p(sum(v for v in values if v > 0))
        assert found[r.doc_id].score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6)
        checked += 1
    assert checked > 50


def plain_frames(payload):
    """Luma histogram of each frame of 16 units, from the definition of the inverse cosine transform."""
    units = len(payload) // avi.UNIT
    order = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else -x[0]))
    basis = np.array([[math.cos((2 * x + 1) * u * math.pi / 16) * (math.sqrt(1 / 8) if u == 0 else 0.5) for u in range(8)] for x in range(8)])
    out = []
    for f in range(0, units, avi.FRAME):
        bins = np.zeros(avi.BINS, np.int64)
        for u in range(f, min(f + avi.FRAME, units)):
            block = np.zeros((8, 8))
            for (r, c), b in zip(order, payload[u * avi.UNIT : u * avi.UNIT + 64]):
                block[r, c] = b - 255 if b < 128 else b
            pixel = np.clip(np.rint(basis @ block @ basis.T) + 128, 0, 255).astype(int)
            bins += np.bincount(pixel.ravel() * avi.BINS // 256, minlength=avi.BINS)
        bins[avi.BINS // 2] += 64 * (f + avi.FRAME - min(f + avi.FRAME, units))
        out.append(bins)
    return np.array(out)


def test_avi_feature(spark, docs):
    found = result(spark, "op10_avi")
    for i in sorted(docs)[::7]:
        data = docs[i][0].encode()
        if len(data) > 20_000:
            continue
        payload = data.ljust(max(1, -(-len(data) // 192)) * 192, b" ")
        counts = plain_frames(payload)
        parts = dict(x.split("=") for x in found[i].feature.split(";"))
        assert int(parts["frames"]) == len(counts)
        assert parts["clips"] == ",".join(f"{a / avi.RATE:.2f}-{(b + 1) / avi.RATE:.2f}" for a, b in avi.shots(counts))
        bins = counts.sum(0) * 1000 // counts.sum()
        assert max(abs(int(x) - y) for x, y in zip(parts["bins"].split(","), bins.tolist())) <= 1
        (file,) = avi.write_avi([payload])
        assert found[i].media_sha256 == hashlib.sha256(file).hexdigest() and found[i].media_bytes == len(file)


def test_clips(spark):
    """Two scenes of 30 frames each give two timed clips; a null and an empty text give none and one."""
    scene = ["the quiet harbour lay still ", "üßñé" * 7]
    text = "".join((s * 6000).encode()[: 30 * avi.FRAME * avi.UNIT].decode(errors="ignore") for s in scene)
    rows = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    found = [tuple(r) for r in avi.clips(avi.media_column(rows, "doc_id"), "doc_id").orderBy("doc_id", "clip").collect()]
    own = [r for r in found if r[0] == 1]
    assert [r[2:4] for r in own] == [(0, 29), (30, own[-1][3])]
    assert own[0][4:] == pytest.approx((0.0, 30 / avi.RATE)) and own[1][4] == pytest.approx(30 / avi.RATE)
    assert [r[1:4] for r in found if r[0] == 2] == [(0, 0, 0)]


def test_pipeline(spark):
    """Every stage on what its predecessor kept, each against its plain twin."""
    import tiktoken
    from inkstream.llm.byte_bpe import load_ranks

    frame = spark.read.parquet(f"{SF}/documents.parquet")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    names = frame.columns
    at, text, source = (names.index(c) for c in ("doc_id", "text", "source"))
    stages = dict(corpus_pipeline.STAGES)
    before = rows(frame)

    kept = materialize(stages["toxicity"](spark, frame, SF))
    toxic = {r.doc_id for r in toxicity.scored(frame, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    assert rows(kept) == [r for r in before if r[at] not in toxic]

    before, last = rows(kept), kept
    kept = materialize(stages["jaccard_join"](spark, last, SF))
    group = linked_groups({r[at]: r[text] or "" for r in before}, 5, 80, 100)
    assert rows(kept) == [r for r in before if group[r[at]][1] == r[at]]

    before, last = rows(kept), kept
    kept = materialize(stages["substring_dedup"](spark, last, SF))
    whole = every_run([(r[at], r[text] or "") for r in before])
    assert {r[at]: r[text] or "" for r in rows(kept)} == {r[at]: whole[r[at]] for r in before if whole[r[at]].strip() or whole[r[at]] == (r[text] or "")}

    before, last = rows(kept), kept
    kept = materialize(stages["mixing"](spark, last, SF))
    copies = mixture({r[at]: (r[text] or "", r[source]) for r in before})
    taken = Counter(r[at] for r in rows(kept))
    assert sum(taken[i] != copies[i][1] for i in copies) <= 1 and taken.keys() == copies.keys()

    before, last = rows(kept), kept
    ranks = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in stages["byte_bpe"](spark, last, SF).collect())
    assert found == sorted((r[at], len(library.encode_ordinary(r[text] or "")), hashlib.sha256((r[text] or "").encode()).hexdigest()) for r in before)
