"""Every query of the library against its DuckDB SQL on the smallest tables."""

import pytest
from compare import duck_rows, spark_rows

from inkstream.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_matches_sql(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    if name not in catalog.ORACLE_SQL:
        df.collect()
        return
    assert sorted(df.columns) == sorted(set(df.columns))
    assert spark_rows(df) == duck_rows(catalog.ORACLE_SQL[name], SF)
