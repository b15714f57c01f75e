"""Every registered event query against its DuckDB SQL."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tempora.operators import sequences
from tempora.plans import queries
from tempora.plans.queries import ORACLES, QUERIES

FOLDER = Path("/root/testdata/sf0.001")


def plain(frame):
    def value(v):
        if pd.isna(v):
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)

    columns = sorted(frame.columns)
    return columns, sorted((tuple(map(value, row)) for row in frame[columns].astype(object).itertuples(index=False)), key=str)


@pytest.mark.skipif(not FOLDER.exists(), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    assert plain(QUERIES[name](spark, str(FOLDER)).toPandas()) == plain(con.execute(ORACLES[name]).df())


@pytest.mark.skipif(not FOLDER.exists(), reason="needs the given tables")
def test_mask_rates(spark):
    seqs = sequences.to_sequences(queries.toks(spark, str(FOLDER)))
    rows = sequences.mask_tokens(seqs, 20).selectExpr("explode(arrays_zip(input, target, transform(events, e -> e.code))) AS r").select("r.*").toPandas()
    rows.columns = ["input", "target", "code"]
    hit, ordinary = rows.target != -100, rows.code >= 5
    assert (rows.input[~hit] == rows.code[~hit]).all() and (rows.target[hit] == rows.code[hit]).all() and ordinary[hit].all()
    assert math.isclose(hit.sum() / ordinary.sum(), 0.2, abs_tol=0.05)
    assert math.isclose((rows.input[hit] == 4).mean(), 0.8, abs_tol=0.1)
