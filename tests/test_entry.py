"""Driver contract and a DuckDB oracle spot-check at sf0.001."""
import math

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SMOKE

SPOT = ["union_periods", "clean_pipeline", "feature_pipeline", "early_warning", "transition_matrix",
        "group_risk", "collection_date", "family_impact", "stratified_split", "member_decision", "upsert_latest"]


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and set(df.columns) == {"alert_level", "n_socios"}


def test_every_exact_query_has_oracle():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(sql) >= 100


def _norm(df):
    cols = sorted(df.columns)
    def v(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 6)
        return x
    return sorted((tuple(v(r[c]) for c in cols) for r in df[cols].to_dict("records")), key=str)


@pytest.mark.parametrize("name", SPOT)
def test_oracle_spot(spark, name):
    con = duckdb.connect()
    for t in ["customer", "orders", "lineitem", "nation"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    got = entry.queries()[name](spark, SMOKE).toPandas()
    exp = con.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(exp.columns)
    assert _norm(got) == _norm(exp)
