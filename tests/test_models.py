"""Feature-column selection (P26) and model persistence."""
from pyspark.sql import functions as F

from memberrisk.operators import features as FE
from memberrisk.operators import ml as M
from memberrisk.sources import sinks as SK


def test_feature_columns_deny_list(spark):
    df = spark.createDataFrame([(1, 2, 3.0, 1, 0, "x", 1.0, 0, 5)],
                               "v_ah_cliente long, v_ah_cuenta long, saldo_disponible double, sexo_M int, "
                               "estado_cta_label int, tipo_cuenta string, ecivil_S double, riesgo_alto int, "
                               "oficina_cta int")
    # substring deny-list: sexo_* and estado_cta_label go, ecivil_* and office code stay (Q17)
    assert FE.feature_columns(df) == ["saldo_disponible", "ecivil_S", "oficina_cta"]


def test_model_roundtrip(spark, scratch):
    from pyspark.ml.classification import LogisticRegressionModel
    rows = [(float(i % 7), float(i % 3), 1 if i % 7 > 3 else 0) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, riesgo_alto int")
    rf, lr = M.fit_credit_model(df.withColumn("v_ah_cuenta", F.lit(1)), ["a", "b"])
    SK.save_model(lr, f"{scratch}/lr")
    back = LogisticRegressionModel.load(f"{scratch}/lr")
    assert back.coefficients.toArray().tolist() == lr.coefficients.toArray().tolist()
    scored = M.score_credit(df, (rf, lr), ["a", "b"]).select("score", "grade").collect()
    assert all(0 <= r.score <= 1000 and r.grade in "ABCDE" for r in scored)


def test_drop_label_inputs():
    cols = ["saldo_disponible", "edad", "dias_sin_movimiento", "credito", "ingresos"]
    assert FE.drop_label_inputs(cols) == ["edad", "ingresos"]  # Q16: the label's own inputs go


def test_bundle_of_one_session_scores_in_another(spark, scratch):
    """Saved twice, loaded by a new session: same scores and segments, the last version by default."""
    import numpy as np
    from memberrisk.operators import bundle as B
    from memberrisk.operators.clustering import Centres
    rows = [(i, float(i % 7), float(i % 3), 1 if i % 7 > 3 else 0) for i in range(60)] + [(60, None, float("nan"), 0)]
    df = spark.createDataFrame(rows, "id int, a double, b double, riesgo_alto int")
    rf, lr = M.fit_credit_model(FE.scrub_features(df, ["a", "b"]), ["a", "b"])
    made = B.Bundle(["a", "b"], rf, lr, Centres(("b", "a"), np.array([[0.0, 0.0], [1.0, 2.0]]), 3.5), {"b": (1.0, 2.0), "a": (3.0, 1.5)}, {0: "x", 1: "y"})
    first = B.save(made, f"{scratch}/models", spark)
    second = B.save(made.__class__(made.columns, rf, lr, made.centres, made.moments, {0: "x", 1: "z"}), f"{scratch}/models", spark)
    other = spark.newSession()
    last, old = B.load(other, f"{scratch}/models"), B.load(other, f"{scratch}/models", first)
    assert first != second and last.names == {0: "x", 1: "z"} and old.names == made.names and last.columns == made.columns

    def told(b, s):
        d = s.createDataFrame(rows, "id int, a double, b double, riesgo_alto int")
        scores = {r["id"]: (r["score"], r["grade"], r["probability_default"]) for r in b.score(d).collect()}
        return scores, {r["id"]: (r["cluster_id"], r["cluster_name"], r["a"]) for r in b.assign(d).collect()}

    assert told(old, other) == told(made, spark)
    got = told(old, other)[1]
    assert got[60][2] is None and {c for c, _, _ in got.values()} == {0, 1}


def test_credit_models_are_fitted_side_by_side(spark, monkeypatch):
    """Each waits for the other to begin; the forest keeps its rows' nodes and is the one that a plain fit gives."""
    import threading
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    both, own = threading.Barrier(2, timeout=60), {}
    for kind in (LogisticRegression, RandomForestClassifier):
        own[kind] = kind.fit
        monkeypatch.setattr(kind, "fit", lambda self, *a, _fit=kind.fit: (both.wait(), _fit(self, *a))[1])
    rows = [(float(i % 17), float(i * 7 % 23), int((i % 17 > 8) ^ (i * 7 % 23 > 11))) for i in range(800)]
    df = spark.createDataFrame(rows, "a double, b double, riesgo_alto int").repartition(3, "a").cache()
    rf, lr = M.fit_credit_model(df, ["a", "b"])
    data = M.assemble(df, ["a", "b"]).select("features", F.col("riesgo_alto").cast("double").alias("label"))
    plain = own[RandomForestClassifier](RandomForestClassifier(featuresCol="features", labelCol="label", **M.RF_PARAMS), data)
    assert rf.getCacheNodeIds() and not plain.getCacheNodeIds()
    wrong = [r for r in M.score_credit(df, (rf, lr), ["a", "b"]).select("prediction", "riesgo_alto").collect() if r[0] != r[1]]
    assert rf.getNumTrees == plain.getNumTrees == 200 and len(wrong) < 80
    assert abs(rf.featureImportances.toArray() - plain.featureImportances.toArray()).max() < 0.1
