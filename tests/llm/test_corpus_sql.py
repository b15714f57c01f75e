"""Corpus queries against their DuckDB SQL on the given tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tempora.llm import oracles, registry

FOLDER = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not FOLDER.exists(), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    told = con.execute(oracles.oracle_sql()[name]).df()
    made = registry.queries()[name](spark, str(FOLDER)).toPandas()
    columns = sorted(told.columns)
    assert columns == sorted(made.columns)
    key = [c for c in columns if made[c].notna().all()]
    left, right = (f[columns].convert_dtypes().sort_values(key).reset_index(drop=True) for f in (told, made))
    pd.testing.assert_frame_equal(left, right, check_dtype=False, check_exact=False, rtol=0, atol=2e-6)
