"""Queries that hand whole texts to Python bound the rows of an Arrow batch, unless the session set them."""

import pytest

from inkstream.plans import catalog
from inkstream.sources.store import BATCH_ROWS


@pytest.mark.parametrize("name", ["draft_json", "entity_mentions", "developer_reports"])
@pytest.mark.parametrize("given, held", [("10000", "1000"), ("77", "77")])
def test_rows_of_a_batch(spark, name, given, held):
    before = spark.conf.get(BATCH_ROWS)
    try:
        spark.conf.set(BATCH_ROWS, given)
        catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert spark.conf.get(BATCH_ROWS) == held
    finally:
        spark.conf.set(BATCH_ROWS, before)
