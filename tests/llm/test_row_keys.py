"""Near copies with a null doc_id, and one doc_id with several texts."""

import corpus_pipeline
from inkstream.llm import jaccard_join

A, B, C, D = (" ".join(f"{x}{i}" for i in range(200)) for x in "abcd")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def near(text):
    return f"{text} tail"


def rows(*pairs):
    return [(i, t, "en", "s", len(t)) for i, t in pairs]


def components(spark, *pairs):
    docs = spark.createDataFrame(rows(*pairs), SCHEMA)
    keyed = docs.select("doc_id", "text", jaccard_join.row_key().alias("key"))
    found = jaccard_join.join(docs, jaccard_join.Rule(), "key").select("key", "component_id")
    return {(r.doc_id, r.text): r.component_id for r in keyed.join(found, "key").collect()}


def test_null_id_takes_part(spark):
    found = components(spark, (None, near(A)), (4, A), (None, B), (5, C), (None, near(near(C))))
    assert found == {(None, near(A)): 4, (4, A): 4, (None, B): None, (5, C): 5, (None, near(near(C))): 5}


def test_one_id_with_two_texts(spark):
    found = components(spark, (1, A), (7, near(A)), (7, B), (9, near(B)), (7, C), (10, near(C)), (11, near(near(C))), (12, D))
    assert found == {(1, A): 1, (7, near(A)): 1, (7, B): 7, (9, near(B)): 7, (7, C): 7, (10, near(C)): 7, (11, near(near(C))): 7, (12, D): 12}


def test_blocks_compare_each_class_with_its_own_text():
    import pandas as pd

    rule = jaccard_join.Rule()
    texts = [A, near(A), B]
    member = [jaccard_join.class_of(jaccard_join.shingles(t.encode(), rule.n)) for t in texts]
    held = pd.DataFrame({"text": [B, A, near(A), A], "member": [member[0], member[0], member[1], member[2]]}).assign(group=member[0], root=lambda x: x["member"], block=0, one=0, two=0)
    found = jaccard_join._among(held, rule)
    assert {frozenset(p) for p in found[["a", "b"]].itertuples(index=False, name=None)} == {frozenset(member[:2])}


def test_pipeline_keeps_clean_row_of_a_shared_id(spark):
    docs = spark.createDataFrame(rows((1, A), (7, near(A)), (7, B), (None, near(A)), (None, C)), SCHEMA)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert {(r.doc_id, r.text) for r in kept} == {(1, A), (7, B), (None, C)}
