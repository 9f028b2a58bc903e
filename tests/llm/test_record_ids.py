"""Record ids of archives: one for each record, and revisits that name the record they refer to."""

from collections import Counter
from pathlib import Path

from inkstream.llm import warc
from inkstream.llm.common import materialize

PAGE = "<p>" + "y" * 200
ROWS = [
    (1, "http://a.example/", PAGE), (1, "http://b.example/", PAGE), (2, "http://c.example/", PAGE),
    (3, "http://d.example/", PAGE + "z"), (3, "http://d.example/", PAGE + "z"), (4, "http://e.example/", PAGE + "z"),
    (5, None, "short"), (5, None, "short"), (6, None, PAGE + "w"), (7, None, PAGE + "w"),
]


def test_record_ids(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    materialize(warc.write_archives(warc.resolve(pages), f"file://{tmp_path}/w"))
    records = []
    for path in Path(f"{tmp_path}/w").glob("*.warc.gz"):
        with open(path, "rb") as stream:
            records += [warc.parse(x)[0] for x in warc.members(stream)]
    assert len(records) == len(ROWS)
    assert max(Counter(r["warc-record-id"] for r in records).values()) == 1
    own = {r["warc-record-id"]: r for r in records}
    revisits = [r for r in records if r["warc-type"] == "revisit"]
    assert sorted(int(r["warc-page-id"]) for r in revisits) == [2, 4, 7]
    for r in revisits:
        if r["warc-page-id"] == "4":  # its original occurs twice: page and url name both
            assert "warc-refers-to" not in r and r["warc-refers-to-target-uri"] == "http://d.example/"
        else:
            target = own[r["warc-refers-to"]]
            assert target["warc-type"] == "response" and target["warc-page-id"] == r["warc-refers-to-page-id"]
            assert target["warc-payload-digest"] == r["warc-payload-digest"] and target["warc-target-uri"] == r["warc-refers-to-target-uri"]
