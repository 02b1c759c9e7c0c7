"""Skew-safe exact ranks/quantiles equal the single-task pandas answers,
including with one group holding most rows."""
import numpy as np
import pandas as pd

from pyspark.sql import functions as F

from memberrisk.functions import ranking as R


def _data(n=6000, seed=3):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"g": rng.integers(0, 4, n), "v": np.round(rng.normal(0, 5, n), 1), "id": np.arange(n)})
    pdf.loc[pdf.index % 2 == 0, "g"] = 0  # hot group: > half of the rows
    return pdf


def test_row_number_matches_sort(spark):
    pdf = _data()
    df = spark.createDataFrame(pdf).repartition(7)
    got = R.row_number(df, ["v", "id"], by=["g"], num_partitions=6).toPandas().sort_values("id")
    exp = pdf.sort_values(["g", "v", "id"]).groupby("g").cumcount().add(1).sort_index()
    assert (got["rn"].values == exp.values).all()


def test_percent_rank_average_ties(spark):
    pdf = _data()
    df = spark.createDataFrame(pdf)
    got = R.percent_rank_avg(df, "v", "pr").toPandas().sort_values("id")
    assert np.abs(got["pr"].values - pdf["v"].rank(pct=True).values).max() < 1e-12


def test_quantiles_global_and_grouped(spark):
    pdf = _data()
    df = spark.createDataFrame(pdf)
    qs = [0.01, 0.25, 0.5, 0.75, 0.99]
    row = R.quantile_row(df, {"v": qs}).first()
    for q in qs:
        assert abs(row[R.quantile_name("v", q)] - pdf["v"].quantile(q)) < 1e-9
    grouped = R.quantile_row(df, {"v": [0.5]}, by=["g"]).toPandas().set_index("g")["v_q50"]
    exp = pdf.groupby("g")["v"].median()
    assert np.abs(grouped.sort_index().values - exp.sort_index().values).max() < 1e-9


def test_quantile_values_empty_is_none(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert R.quantile_values(df, {"v": [0.5]}).get("v_q50") is None


def test_null_keys_and_previous_rows(spark):
    pdf = _data(900)
    pdf["g"] = pdf["g"].astype("Int64")
    pdf.loc[pdf.index % 5 == 0, "g"] = None
    rows = [(None if pd.isna(g) else int(g), float(v), int(i)) for g, v, i in pdf.itertuples(index=False)]
    df = spark.createDataFrame(rows, "g long, v double, id long").repartition(9)
    got = R.row_number(df, ["v", "id"], by=["g"], num_partitions=7, lag=("id", "prev")).collect()
    assert len(got) == len(rows)
    want = {}
    for g in {r[0] for r in rows}:
        last = None
        for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])), 1):
            want[r[2]] = (n, last)
            last = r[2]
    assert {r["id"]: (r["rn"], r["prev"]) for r in got} == want
    alone = R.row_number(df, ["id"], num_partitions=5).collect()
    assert sorted(r["rn"] for r in alone) == list(range(1, len(rows) + 1)) and all(r["rn"] == r["id"] + 1 for r in alone)


def test_value_bins_keep_the_order(spark):
    values = sorted([0.0, -0.0, 1e-12, -1e-12, 0.5, -0.5, 1.0, 3.7, -3.7, 1e9, -1e9, 1e300, -1e300, float("inf"), float("-inf")])
    df = spark.createDataFrame([(float(v), i) for i, v in enumerate(values)], "v double, i int")
    bins = [r["b"] for r in df.select("i", R.value_bin(F.col("v")).alias("b")).orderBy("i").collect()]
    assert bins == sorted(bins)


def test_nothing_stays_cached(spark):
    df = spark.createDataFrame(_data(500))
    R.row_number(df, ["v", "id"], by=["g"]).count()
    R.percent_rank_avg(df, "v", "pr").count()
    R.quantile_row(df, {"v": [0.5]}).count()
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_no_single_task_window(spark):
    """The ranking plan never uses a window without partition keys on rows."""
    df = spark.createDataFrame(_data())
    for out in (R.row_number(df, ["v", "id"], by=["g"]), R.percent_rank_avg(df, "v", "pr", by=["g"]), R.quantiles(df, ["v"], [0.5])):
        assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()


def test_running_totals_over_slices_without_python_workers(spark):
    """Ordinals, totals and the row before, one group over most slices, in JVM plans alone."""
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": np.where(rng.random(4000) < 0.6, "hot", rng.integers(0, 60, 4000).astype(str)),
                        "o": rng.permutation(4000), "x": rng.integers(-9, 9, 4000)})
    df = spark.createDataFrame(pdf).repartition(5)
    found = R.running(df, ["o"], ["g"], out="at", sums={"total": "x"}, lag=("o", "prev"), num_partitions=16)
    plan = found._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "Python" not in plan
    got = found.toPandas().sort_values(["g", "o"]).reset_index(drop=True)
    want = pdf.sort_values(["g", "o"]).reset_index(drop=True)
    each = want.groupby("g")
    assert (got["at"] == each.cumcount() + 1).all()
    assert (got["total"] == each["x"].cumsum()).all()
    assert got["prev"].fillna(-1).astype(int).tolist() == each["o"].shift().fillna(-1).astype(int).tolist()
    whole = R.running(df, ["o"], out="at", sums={"total": "x"}, num_partitions=9).toPandas().sort_values("o")
    assert whole["at"].tolist() == list(range(1, 4001))
    assert (whole["total"].values == pdf.sort_values("o")["x"].cumsum().values).all()
    assert R.running(df.limit(0), ["o"], ["g"], sums={"total": "x"}).count() == 0


def test_ordered_bits_are_the_doubles_bits(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([np.frombuffer(rng.bytes(8 * 4000), np.float64), 2.0 ** rng.integers(-1074, 1024, 300), -(2.0 ** rng.integers(-1074, 1024, 300)),
                        np.nextafter(2.0 ** np.arange(-1022, 1023, 7), 0), np.nextafter(2.0 ** np.arange(-1022, 1023, 7), np.inf),
                        [0.0, -0.0, 5e-324, -5e-324, 2.0 ** -1022, np.finfo(float).max, -np.finfo(float).max, np.inf, -np.inf, 1.0, 0.1, 1 / 3]])
    x = x[~np.isnan(x)]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, v double")
    got = np.array([r[0] for r in df.select("i", R.ordered_bits(F.col("v")).alias("b")).orderBy("i").select("b").collect()])
    want = np.abs(x).view(np.int64) * np.where(x < 0, -1, 1)
    assert (got == want).all()


def test_a_million_close_scores(spark, monkeypatch):
    """Distinct scores within 1e-6: exact results, and no bin or slice above the limit in a task."""
    monkeypatch.setattr(R, "MOST", 20_000)
    df = spark.range(0, 1_000_000, 1, 8).select(
        F.when(F.col("id") < 300_000, F.lit(0.5)).otherwise(F.lit(0.5) + F.col("id") * F.lit(1e-12)).alias("v"), "id")
    ranked, written = [], R.materialize_small

    def watch(table):
        out = written(table)
        if {"_mr_lo", "_mr_hi", "_mr_n"} <= set(out.columns):
            small = out.where("_mr_lo <> _mr_hi AND _mr_n <= 20000").agg(F.max("_mr_n")).first()[0]
            ranked.append((out.agg(F.max("_mr_n")).first()[0], small))
        return out

    monkeypatch.setattr(R, "materialize_small", watch)
    qs = [0.0, 0.1, 0.299, 0.3, 0.31, 0.5, 0.77, 0.999, 1.0]
    row = R.quantile_row(df, {"v": qs}).first()
    v = np.where(np.arange(1_000_000) < 300_000, 0.5, 0.5 + np.arange(1_000_000) * 1e-12)
    for q in qs:
        assert row[R.quantile_name("v", q)] == np.quantile(v, q, method="linear") or abs(row[R.quantile_name("v", q)] - np.quantile(v, q)) < 1e-15
    assert len(ranked) > 2 and ranked[0][0] > 900_000 and all(small is None or small <= 20_000 for _, small in ranked)
    got = R.percent_rank_avg(df, "v", "pr", num_partitions=8)
    sample = {r["id"]: r["pr"] for r in got.where("id % 99991 = 7 OR id IN (0, 299999, 300000, 999999)").collect()}
    for i, pr in sample.items():
        assert abs(pr - ((1 + 300_000) / 2 if i < 300_000 else i + 1) / 1e6) < 1e-12
    assert got.count() == 1_000_000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan  # the common value does not go by a shuffle of its rows


def test_percent_ranks_keep_rows_nulls_and_groups(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", None], 900), "v": rng.integers(0, 6, 900).astype(float), "id": np.arange(900)})
    pdf.loc[pdf.index % 11 == 0, "v"] = np.nan
    rows = [(g, None if np.isnan(v) else float(v), int(i)) for g, v, i in pdf.itertuples(index=False)]
    df = spark.createDataFrame(rows, "g string, v double, id long")
    got = {r["id"]: r["pr"] for r in R.percent_rank_avg(df, "v", "pr", by=["g"]).collect()}
    want = pdf.groupby(pdf["g"].fillna("-"))["v"].rank(pct=True)
    assert len(got) == 900
    for i, w in enumerate(want):
        assert got[i] is None if np.isnan(w) else abs(got[i] - w) < 1e-12
    assert R.percent_rank_avg(df.limit(0), "v", "pr").count() == 0 and R.quantiles(df.limit(0), ["v"], [0.5]).count() == 0
