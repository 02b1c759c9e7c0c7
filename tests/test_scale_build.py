"""The shared build of cleaned and featured rows: what keeps its cost down."""

import datetime as dt

from pyspark.sql import functions as F

from memberrisk import schemas as S
from memberrisk import session as sess
from memberrisk.operators import clean as C


def snapshot(spark, rows):
    shape = ("v_ah_cliente long, v_ah_cuenta long, periodo string, fecha_proceso timestamp, "
             + ", ".join(f"{c} double" for c in S.FINANCIAL_COLUMNS) + ", nota string")
    made = [(k, a, p, d, b, *[0.0] * (len(S.FINANCIAL_COLUMNS) - 1), n) for k, a, p, d, b, n in rows]
    return spark.createDataFrame(made, shape)


def test_rows_with_a_key_of_their_own_are_not_aggregated(spark):
    day, later = dt.datetime(2001, 7, 1), dt.datetime(2001, 7, 2)
    rows = [(1, 11, "2001-07", day, 5.0, "old"), (1, 11, "2001-07", later, 1.0, "new"), (1, 11, "2001-07", None, 9.0, "undated"),
            (2, 21, "2001-07", day, 5.0, "one"), (2, 21, "2001-06", day, 5.0, "two"),
            (None, None, "2001-07", day, 1.0, "less"), (None, None, "2001-07", day, 2.0, "more"), (None, 7, None, None, None, "null")]
    found = C.dedup_snapshot(snapshot(spark, rows))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "LeftSemi" in plan
    assert sorted(r["nota"] for r in found.collect()) == ["more", "new", "null", "one", "two"]
    assert found.columns == snapshot(spark, rows).columns
    assert found.where(F.col("nota") == "new").first()["saldo_disponible"] == 1.0


def test_methods_too_large_for_the_jvms_compiler_are_not_generated(spark):
    key, limit = sess.METHOD_LIMIT
    before = spark.conf.get(key)
    try:
        spark.conf.unset(key)
        assert sess.configure(spark).conf.get(key) == limit
        spark.conf.set(key, "9000")  # the submitter's own value stays
        assert sess.configure(spark).conf.get(key) == "9000"
    finally:
        spark.conf.set(key, before)
