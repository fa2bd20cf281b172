"""Some registered queries against DuckDB on the smallest tables, and the entry point's shape."""

import math
from pathlib import Path

import pytest

FOLDER = "/root/testdata/sf0.001"
SOME = ["resample_mean", "asof_join", "anomaly_regions", "score_grouped", "predict", "missing_gaps", "event_contributions", "reimpute_known", "fit_ridge", "missing_ranges"]


def _cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return ""
    return f"{x:.5f}" if isinstance(x, float) else str(x)


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for f in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    ours = entry.queries()[name](spark, FOLDER)
    theirs = con.execute(entry.oracle_sql()[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    rows = sorted(tuple(_cell(r[c]) for c in columns) for r in ours.collect())
    assert rows == sorted(tuple(_cell(v) for v in r) for r in theirs[columns].itertuples(index=False))


def test_every_sql_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
