"""Decision path: overlay first, requests keep their rows, few joins; models keep their identities."""
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SMOKE
from memberrisk import schemas as S
from memberrisk.operators import analyzers as A
from memberrisk.operators import decide as D
from memberrisk.plans import q_analyzers as QA
from memberrisk.plans import q_decide as QD
from memberrisk.plans.pipeline import hub


@pytest.fixture(scope="module")
def h(spark):
    return hub(spark, SMOKE)


def test_one_row_a_request(h):
    assert QD.decisions(h).count() == h.requests().count()
    assert h.requests().groupBy("v_ah_cliente").count().where("count > 1").count() > 0


def test_minors_by_id_alone_stay_blocked(h):
    minors = {r[0] for r in A.minor_ids(QA.validation(h)).collect()}
    rows = [r for r in QD.decisions(h).collect() if r["cliente_id"] in minors]
    assert len(minors) > 0 and len(rows) == 2 * len(minors)
    for r in rows:
        assert not r["elegibilidad_credito"] and "MENOR_EDAD" in r["alertas_activas"] and "age_validation" in r["bloqueos"]
    by_client = {}
    for r in rows:
        by_client.setdefault(r["cliente_id"], set()).add((r["riesgo_global"], r["elegibilidad_credito"], tuple(r["bloqueos"])))
    assert all(len(v) == 1 for v in by_client.values())  # the id alone decides as all fields do


def test_repeated_requests_and_overlay(spark, h):
    client = h.last_period().where("menor_edad = 0").agg(F.min("v_ah_cliente")).first()[0]
    req = spark.createDataFrame([("a", client), ("b", client), ("c", client)], "request_id string, v_ah_cliente long")
    req = req.select(*[F.col(f.name).cast(f.dataType) if f.name in req.columns else F.lit(None).cast(f.dataType).alias(f.name)
                       for f in S.REQUEST_SCHEMA.fields])
    req = req.withColumn("edad", F.when(F.col("request_id") == "c", F.lit(11.0))).withColumn(
        "v_fecha_nac", F.when(F.col("request_id") == "c", F.lit("2000-01-01").cast("timestamp"))).withColumn(
        "fecha_proceso", F.when(F.col("request_id") == "c", F.lit("2011-01-01").cast("timestamp")))
    got = {r["request_id"]: r for r in D.decide(QD.assess(h, req)).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"]["riesgo_global"] == got["b"]["riesgo_global"]
    assert "age_validation" not in got["a"]["bloqueos"] and "age_validation" in got["c"]["bloqueos"]
    assert set(got["a"]["agentes"].asDict()) == set(D.AGENTS) and got["a"]["agentes"]["early_warning"]["alert_score"] is not None


def test_decision_joins(h):
    QD.members(h), QD.products(h), QA.matrix(h)
    plan = QD.decisions(h)._jdf.queryExecution().optimizedPlan().toString()
    joins = re.findall(r"Join LeftOuter", plan)
    assert len(joins) <= 5


def test_early_warning_of_nothing(h):
    empty = QA.adults(h).limit(0)
    assert A.early_warning(empty).count() == 0 and A.alert_metrics(A.early_warning(empty)).first()["total_socios"] == 0


def test_models(spark):
    queries = entry.queries()
    one = queries["model_identities"](spark, SMOKE).first()
    assert one["n_scored"] == one["n_graded"] and one["n_clustered"] == one["n_in_profiles"] and one["n_bad_scores"] == 0 and one["n_k"] == 6
    assert queries["credit_metrics"](spark, SMOKE).first()["auc_roc"] > 0.9
    assert queries["kmeans_search"](spark, SMOKE).agg(F.max("silhouette")).first()[0] > 0.2
    requests = queries["credit_score_requests"](spark, SMOKE)
    assert requests.count() == queries["member_decision"](spark, SMOKE).count()
    assigned = queries["cluster_assign_requests"](spark, SMOKE)
    assert assigned.count() == requests.count() and assigned.where("cluster_name IS NULL").count() == 0
