"""The numbered queries on the smallest tables against plain Python over the same rows."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import duckdb
import public_tokenizers
import pytest
from compare import duck_rows, spark_rows

from inkstream.llm import catalog, jaccard_join, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(ASCII_LOWER))


def result(spark, name):
    return {r[0]: r for r in catalog.QUERIES[name](spark, SF).collect()}


@pytest.fixture(scope="module")
def docs():
    found = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    return {i: t or "" for i, t in found}


def linked_groups(docs, n, num, den):
    sets = {}
    for i, text in docs.items():
        w = words(text)
        sets[i] = {tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))} if w else set()
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                    p, q = sorted((find(a), find(b)))
                    root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard_join(spark, docs):
    found = result(spark, "op2_jaccard_join")
    assert {i: (r.n_shingles, r.component_id) for i, r in found.items()} == linked_groups(docs, 3, 90, 100)


def test_near_duplicate_rule(spark, docs):
    rows = jaccard_join.join(spark.read.parquet(f"{SF}/documents.parquet"), jaccard_join.Rule()).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == linked_groups(docs, 5, 80, 100)


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found, start = result(spark, "op3_token_files"), 0
    assert found.keys() == docs.keys()
    for i, text in docs.items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        r = found[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def test_byte_bpe(spark, docs):
    import tiktoken
    from inkstream.llm.byte_bpe import load_ranks

    ranks = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = result(spark, "op4_byte_bpe")
    assert found.keys() == docs.keys()
    for i, text in docs.items():
        ids = library.encode_ordinary(text)
        r = found[i]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_warc(spark):
    assert spark_rows(catalog.QUERIES["op5_warc"](spark, SF)) == duck_rows(catalog.ORACLE_SQL["op5_warc"], SF)


def test_lm_scoring(spark, docs):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    end = object()
    streams = {i: [*words(t), end] for i, t in docs.items()}
    one, two, contexts = Counter(), Counter(), Counter()
    for i, s in streams.items():
        if not held[i]:
            one.update(s)
            pairs = list(zip([None, *s], s))
            two.update(pairs)
            contexts.update(a for a, _ in pairs)
    n, v = sum(one.values()), len(one)
    found = result(spark, "op6_lm_scoring")
    assert found.keys() == docs.keys()
    for i, s in streams.items():
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(s), sum(one[t] > 0 for t in s), n)
        assert r.base_score == pytest.approx(sum(math.log10((one[t] + 1) / (n + 1 * (v + 1))) for t in s), rel=1e-9)
        unigram = lambda t: (one[t] + 1) / (n + v + 1)
        want = sum(math.log10((two[a, b] + 4 * unigram(b)) / (contexts[a] + 4)) for a, b in zip([None, *s], s))
        assert r.score == pytest.approx(want, rel=1e-6)


def test_substring_dedup(spark, docs):
    """Every run of several sentences that came before is cut, whatever its length."""
    from inkstream.llm.substring_dedup import sentences
    from test_whole_runs import every_run

    found, want = result(spark, "op1_substring_dedup"), every_run(list(docs.items()))
    assert {i: r.text or "" for i, r in found.items()} == want
    for i, text in docs.items():
        assert found[i].n_sentences == len(sentences(text.encode()))


def test_mixing(spark, docs):
    found = result(spark, "op7_mixing")
    assert found.keys() == docs.keys()
    tokens, taken, weight = Counter(), Counter(), {}
    for i, r in found.items():
        assert r.n_tokens == len(words(docs[i])) and r.copies >= 1
        tokens[r.source] += r.n_tokens
        taken[r.source] += r.n_tokens * r.copies
        weight[r.source] = r.weight
    assert sum(weight.values()) == pytest.approx(1)
    least = min(weight[s] / (tokens[s] / tokens.total()) for s in weight if tokens[s])
    for s in weight:
        passes = max(1, weight[s] / (tokens[s] / tokens.total()) / least)
        assert passes <= 2 + 1e-6
        longest = max(r.n_tokens for r in found.values() if r.source == s)
        assert tokens[s] * passes - longest - 1 <= taken[s] <= tokens[s] * passes + 1


def test_toxicity(spark, docs):
    found = result(spark, "op8_toxicity")
    assert found.keys() == docs.keys()
    for i, r in found.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    found = catalog.QUERIES["op8_toxicity"](spark, sf).where("held_out")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic IS NOT NULL")
    rows = found.join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    bad, good = ([r for r in rows if r.toxic == k] for k in (1, 0))
    assert len(bad) > 20 and len(good) > 100
    assert sum(r.predicted for r in bad) / len(bad) > 0.8
    assert sum(r.predicted for r in good) / len(good) < 0.05


def test_segments_are_maximal():
    """Greedy recursion: the best segment, then the best left and right of it."""
    import random

    draw = random.Random(1)
    for _ in range(300):
        n = draw.randint(1, 30)
        hits = sorted((i, draw.choice([1.0, 2.5, 0.75])) for i in draw.sample(range(n), draw.randint(0, n)))
        scores = [-0.5] * n
        for i, s in hits:
            scores[i] = s
        want = []

        def split(a, b):
            best = max(((sum(scores[i:j]), i - j, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
            if best[0] > 0:
                want.append((best[0], best[2], best[3] - 1))
                split(a, best[2])
                split(best[3], b)

        split(0, n)
        found = toxicity.maximal(hits, -0.5)
        assert sorted((a, b, round(s, 9)) for s, a, b in found) == sorted((a, b, round(s, 9)) for s, a, b in want)


def test_order_minhash(spark, docs):
    found, ids = result(spark, "op9_order_minhash"), sorted(docs)
    marks = {}
    for k, i in enumerate(ids):
        text, following = docs[i], docs[ids[(k + 1) % len(ids)]]
        n = len(text) // 4
        edited = text[: len(text) - n] + following[:n]
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert marks.setdefault(text, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    long = [r for r in found.values() if r.n_chars > 200]
    assert sum(r.near_edited for r in long) / len(long) > 5 * sum(r.near_next for r in long) / len(long)


def test_avi(spark, docs):
    found = result(spark, "op10_avi")
    assert found.keys() == docs.keys()
    for i, text in docs.items():
        data = text.encode()
        size = max(1, -(-len(data) // 192)) * 192
        payload = data.ljust(size, b" ")
        r = found[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), size, hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:]) and r.media_bytes > 0 and len(r.media_sha256) == 64
