"""Exact pruned k-NN and SMOTE against brute force."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from memberrisk.operators import ml as M


def _points(n=400, seed=7):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"_id": np.arange(n), "a": np.round(rng.normal(0, 3, n), 1),
                        "b": np.round(rng.exponential(5, n), 1), "c": rng.integers(0, 3, n).astype(float)})
    pdf.loc[pdf.index % 10 == 0, ["a", "b", "c"]] = [0.0, 0.0, 0.0]   # many duplicates
    pdf.loc[5, ["a", "b", "c"]] = [500.0, 900.0, 2.0]                # far outlier
    return pdf


def _brute(pdf, cols, k):
    x = pdf[cols].to_numpy()
    out = {}
    for i, row in enumerate(x):
        d2 = ((x - row) ** 2).sum(axis=1)
        order = sorted((d2[j], pdf["_id"].iloc[j]) for j in range(len(x)) if j != i)
        out[pdf["_id"].iloc[i]] = [int(j) for _, j in order[:k]]
    return out


def test_minority_knn_exact(spark):
    pdf = _points()
    cols = ["a", "b", "c"]
    got = M.minority_knn(spark.createDataFrame(pdf), cols, 5).toPandas()
    got = {i: list(g.sort_values("nn_rank")["nn_id"]) for i, g in got.groupby("_id")}
    assert got == _brute(pdf, cols, 5)


def test_smote_balances_and_interpolates(spark):
    pdf = _points(200)
    pdf["v_ah_cuenta"] = pdf["_id"]
    pdf["periodo"] = "2001-07"
    pdf["riesgo_alto"] = (pdf["_id"] % 4 == 0).astype(int)
    df = spark.createDataFrame(pdf.drop(columns=["_id"]))
    syn = M.smote(df, ["a", "b"]).toPandas()
    n1, n0 = int(pdf.riesgo_alto.sum()), int((1 - pdf.riesgo_alto).sum())
    assert len(syn) == n0 - n1 and (syn.riesgo_alto == 1).all()
    mins = pdf[pdf.riesgo_alto == 1].sort_values(["v_ah_cuenta", "periodo"]).reset_index(drop=True)
    for r in syn.itertuples():
        x, y = mins.loc[r.base_id], mins.loc[r.nn_id]
        lo_a, hi_a = sorted((x.a, y.a))
        assert lo_a - 1e-9 <= r.a <= hi_a + 1e-9     # synthetic point on the segment


def _mixed(n=3000, seed=3):
    """Several cells and blocks of any setting below: a lattice with ties, copies, a far group, wide columns."""
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"a": np.round(rng.normal(0, 40, n)), "b": np.round(rng.exponential(900, n), 1),
                        "c": rng.integers(0, 4, n).astype(float), "d": rng.normal(0, 1, n)})
    pdf.loc[pdf.index % 7 == 0, ["a", "b", "c", "d"]] = [0.0, 10.0, 1.0, 0.5]
    pdf.loc[pdf.index % 50 == 1, "a"] += 1e6
    pdf.insert(0, "_id", rng.permutation(n))
    return pdf


def _exact(x, ids, k):
    d2 = np.zeros((len(x), len(x)))
    for c in range(x.shape[1]):
        d2 += (x[:, c][:, None] - x[None, :, c]) ** 2
    np.fill_diagonal(d2, np.inf)
    return {int(i): [int(v) for v in ids[np.lexsort((ids, row))[:k]]] for i, row in zip(ids, d2)}


def test_minority_knn_is_exact_over_many_blocks(spark, monkeypatch):
    """Blocks, groups and cells of few points: every search crosses their edges."""
    from memberrisk.operators import neighbours as N
    monkeypatch.setattr(N, "BLOCK", 64)
    monkeypatch.setattr(N, "GROUP", 3)
    pdf = _mixed()
    cols = ["a", "b", "c", "d"]
    got = M.minority_knn(spark.createDataFrame(pdf).repartition(5), cols, 5).toPandas()
    got = {i: list(g.sort_values("nn_rank")["nn_id"]) for i, g in got.groupby("_id")}
    assert got == _exact(pdf[cols].to_numpy(), pdf["_id"].to_numpy(), 5)


def test_smote_uses_every_minority_row(spark):
    """More minority rows than the 20 000 that were the bound: base rows and neighbours come from all of them."""
    m, n = 24_000, 60_000
    df = spark.range(m + n).select(
        F.col("id").alias("v_ah_cuenta"), F.lit("2001-07").alias("periodo"), (F.col("id") < m).cast("int").alias("riesgo_alto"),
        F.when(F.col("id") < m, F.col("id") * 3.0).otherwise(0.0).alias("a"), F.pmod(F.col("id"), F.lit(2)).cast("double").alias("b"))
    syn = M.smote(df, ["a", "b"]).toPandas()
    assert len(syn) == n - m and syn.base_id.max() > 20_000 and syn.nn_id.max() > 20_000
    assert list(syn.synthetic_id) == list(range(n - m))  # in order, however the joins ran
    assert ((syn.base_id - syn.nn_id).abs() <= 5).all()  # points on a line, 3 apart: at most the ends reach 5
    assert ((syn.a >= 3.0 * np.minimum(syn.base_id, syn.nn_id) - 1e-6) & (syn.a <= 3.0 * np.maximum(syn.base_id, syn.nn_id) + 1e-6)).all()
