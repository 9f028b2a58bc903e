"""Nulls, empty and long texts, ties, repeated rows, clashing column names and empty tables in every operator."""

import public_tokenizers
import pytest

import corpus_pipeline
from inkstream.llm import catalog
from inkstream.llm.common import materialize

LONG = "one two three four five six seven eight nine ten. Then more words follow here. " * 3000
ROWS = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n", None, None, None), (4, "Word", "en", "a", 4),
    (5, LONG, "en", "b", len(LONG)), (6, LONG, "en", "b", len(LONG)), (6, LONG, "en", "b", len(LONG)),
    (7, "é" * 5000 + " \U0001f600 x", "fr", "c", 5004), (None, "A text without a number. It has two sentences.", "en", "a", 46),
    (8, "A text without a number. It has two sentences.", "en", "a", 46), (9, "x" * 100_000, "de", "a", 100_000),
]
EXTRA = ["bucket", "key", "part", "group", "member", "class", "score", "c0", "row", "s", "b", "block", "h", "u", "v", "word", "n", "g", "digest", "place"]
EXTRA += ["__key", "__cut", "__runs", "__sentences", "__removed", "__copies", "__copy", "__tokens", "__gone", "gone", "copy", "removed", "steps"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
OPERATORS = [n for n in catalog.QUERIES if n not in ("op5_warc", "op12_spelling_variants")]


def tables(spark, folder, rows):
    spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    labels = [(1, 1, 0), (5, 1, 1), (None, None, 1), (8, 0, None)] if rows else []
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    page = "<p>" + "y" * 200
    pages = [(1, None, None), (2, "http://a.example/", ""), (3, "u", page), (4, "u", page), (5, None, page), (6, "u", "short"), (7, "u", "short")] if rows else []
    spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, record_type string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("odd"), ROWS)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("empty"), [])


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, odd, name):
    found = catalog.QUERIES[name](spark, odd).collect()
    ids = [-1 if r.doc_id is None else r.doc_id for r in found]
    assert sorted(ids) == sorted(-1 if r[0] is None else r[0] for r in ROWS)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_empty_tables(spark, empty, name):
    assert catalog.QUERIES[name](spark, empty).count() == 0


def test_odd_pages(spark, odd):
    found = {r.page_id: (r.record_type, r.refers_to) for r in catalog.QUERIES["op5_warc"](spark, odd).collect()}
    assert found == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3), 5: ("revisit", 3), 6: ("response", None), 7: ("response", None)}


def test_odd_groups(spark, odd):
    found = {(r.doc_id, r.n_shingles): r.component_id for r in catalog.QUERIES["op2_jaccard_join"](spark, odd).collect()}
    assert found[1, 0] == 1 and found[2, 0] == 2 and found[3, 0] == 3
    assert {c for (i, _), c in found.items() if i in (5, 6)} == {5}
    assert {c for (i, n), c in found.items() if i in (None, 8)} == {8}


def test_pipeline_stages(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, odd))
        assert docs.columns == columns, name
        for r in docs.select(*EXTRA).distinct().collect():
            assert list(r) == EXTRA, name
    assert docs.count() > 0
    texts = [r.text for r in docs.collect()]
    assert sum(t is not None and t.startswith("one two three") for t in texts) <= 2


def test_pipeline_on_empty_tables(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_long_text_stitches_chunks(spark):
    """Chunks of one text meet; ids equal those of the whole text encoded at once."""
    import hashlib
    import struct

    import tiktoken
    from inkstream.llm import byte_bpe

    text = ("It's 12345 o'clock,  \n\n and été—naïve \t" + "w" * 900 + " ") * 400
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).first()
    ids = library.encode_ordinary(text)
    assert row.n_tokens == len(ids)
    assert row.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
