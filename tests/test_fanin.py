"""Fan-in: a failing analyzer is its own affair; a further analyzer needs no change elsewhere."""
import pytest
from pyspark.sql import functions as F

from conftest import SMOKE
from memberrisk.operators import analyzers as A
from memberrisk.operators import decide as D
from memberrisk.operators import fanin as FI
from memberrisk.plans import analyzer_set as AS
from memberrisk.plans import q_analyzers as QA
from memberrisk.plans import q_decide as QD
from memberrisk.plans.pipeline import Hub, hub


def broken_hub(h, *apart):
    """A hub of its own on the tables of ``h``, but for those named."""
    QD.decisions(h)
    own = Hub(h.spark, SMOKE)
    for name in ("enriched", "cleaned", "featured", "last_period", "requests", "scaled_last", "age_validation", "adults", "early_warning",
                 "states", "transitions", "matrix", "overdebt", "groups", "dates", "family", "product_names"):
        if name not in apart and name in h._memo:
            own.memo(name, lambda name=name: h._memo[name])
    return own


@pytest.fixture(scope="module")
def h(spark):
    return hub(spark, SMOKE)


def in_plan(*args, **kwargs):
    raise ValueError("no such plan\nsecond line")


def at_run_time(df, *args, **kwargs):
    return df.select("v_ah_cliente", "v_ah_cuenta", *[
        F.when(F.col("v_ah_cliente").isNotNull(), F.raise_error(F.lit("broken row"))).cast("double").alias(c)
        for c in ("estimated_dependents", "adjustment_factor", "ingreso_ajustado", "vulnerability_score")])


@pytest.mark.parametrize("broken", [in_plan, at_run_time])
def test_a_failing_analyzer_leaves_the_others(h, monkeypatch, broken):
    own = broken_hub(h, "family")
    monkeypatch.setattr(A, "family_impact", broken)
    made = D.decide(QD.assess(own))
    rows = {r["request_id"]: r for r in made.collect()}
    whole = {r["request_id"]: r for r in QD.decisions(h).collect()}
    assert set(rows) == set(whole) and len(rows) == h.requests().count()
    for i, r in rows.items():
        assert r["agentes"]["family_impact"] is None and r["agentes"]["early_warning"] == whole[i]["agentes"]["early_warning"]
        assert r["riesgo_global"] == whole[i]["riesgo_global"] and "CARGA_FAMILIAR_ALTA" not in r["alertas_activas"]
        assert set(r["agentes_error"]) == {"family_impact"}
    summary = QD.q_run_summary_rules(own)
    assert "family_impact" not in {r["analyzer"] for r in summary.collect()}
    status = {r["analyzer"]: r for r in QD.fan_in(own).status_table(h.spark).collect()}
    assert status["family_impact"]["status"] == "error" and status["family_impact"]["error"]
    assert "second line" not in status["family_impact"]["error"] and status["family_impact"]["n_rows"] is None
    assert {s["status"] for n, s in status.items() if n != "family_impact"} == {"ready"}
    assert FI.summary(QD.fan_in(own)).where("analyzer = 'family_impact' AND status = 'error' AND metric IS NULL").count() == 1


def test_without_age_validation_nobody_is_a_minor(h, monkeypatch):
    own = broken_hub(h, "age_validation", "adults", "early_warning", "states", "transitions", "matrix")
    monkeypatch.setattr(A, "age_validation", in_plan)
    assert QA.adults(own).count() == h.featured().count()
    rows = D.decide(QD.assess(own)).collect()
    assert len(rows) == h.requests().count()
    assert not any("MENOR_EDAD" in r["alertas_activas"] for r in rows)
    status = {r["analyzer"]: r["status"] for r in QD.fan_in(own).status_table(h.spark).collect()}
    assert [n for n, s in status.items() if s != "ready"] == ["age_validation"]


def test_an_answer_that_fails_is_reported(h):
    bad = AS._rules("date_optimization", lambda hub, df: df.select("no_such_column"))
    fan = FI.fit(h, [bad if a.name == bad.name else a for a in AS.RULES], QD.latest(h))
    assert fan.status["date_optimization"].status == "ready"
    rows = D.decide(FI.assess(fan, h.requests())).collect()
    assert fan.status["date_optimization"].status == "error"
    assert {r["dia_pago_sugerido"] for r in rows} == {15}  # the default day, and no action about it
    assert not any(a.startswith("Mover fecha") for r in rows for a in r["acciones_priorizadas"])


def test_a_tenth_analyzer(h):
    """By the protocol alone: stored results, a lookup and an answer of its own."""

    class Idle:
        name, answers = "idle", {"idle_share": "double", "office_rows": "bigint"}

        def fit(self, hub):
            return None

        def stored(self, hub):
            return hub.last_period().groupBy("v_ah_cliente").agg(F.avg((F.col("dias_sin_movimiento") > 30).cast("double")).alias("share"))

        def lookups(self, hub):
            return {"oficina_cta": hub.last_period().groupBy(F.col("oficina_cta").cast("string").alias("o")).agg(F.count("*").alias("office_rows"))
                    .where("o IS NOT NULL")}

        def answer(self, hub, requests):
            return requests.withColumn("idle_share", F.coalesce("k_idle.share", F.lit(0.0)))

        def metrics(self, hub):
            return hub.last_period().agg(F.count("*").alias("n"))

    fan = FI.fit(h, [*AS.RULES, Idle()], QD.latest(h))
    rows = {r["request_id"]: r for r in D.decide(FI.assess(fan, h.requests())).collect()}
    whole = {r["request_id"]: r for r in QD.decisions(h).collect()}
    assert set(rows) == set(whole)
    assert all(rows[i]["riesgo_global"] == whole[i]["riesgo_global"] for i in rows)
    assert {"idle", *D.AGENTS} == set(next(iter(rows.values()))["agentes"].asDict())
    assert any(r["agentes"]["idle"]["office_rows"] for r in rows.values())
    assert FI.summary(fan).where("analyzer = 'idle' AND metric = 'n'").first()["value"] == h.last_period().count()


def test_switched_off_and_empty_set(h):
    off = QD.fan_in(h).without(["credit_scoring"])
    assert {s.analyzer for s in off.status.values() if s.status == "off"} == {"credit_scoring"}
    assert QD.fan_in(h).status["credit_scoring"].status == "ready"
    rows = D.decide(FI.assess(off, h.requests())).collect()
    assert all("credit_scoring" in r["bloqueos"] and not r["elegibilidad_credito"] for r in rows)


def test_decisions_with_models(h):
    """D5 with the fitted models: one row a request, both models' answers in it."""
    rows = QD.model_decisions(h).collect()
    assert len(rows) == h.requests().count() and not any(r["agentes_error"] for r in rows)
    assert all(r["agentes"]["credit_scoring"]["score"] is not None and r["agentes"]["collection_segments"]["cluster_name"] for r in rows)
    summary = {r["analyzer"]: r["status"] for r in QD.q_run_summary(h).collect()}
    assert set(summary) == set(D.AGENTS) and set(summary.values()) == {"ready"}


def test_rows_of_members_do_not_go_through_the_driver(spark, monkeypatch):
    """Tables with a row a member are small here and still not broadcast."""
    write, written = FI.write_table, {}
    latest = write(spark.createDataFrame([(i, float(i)) for i in range(6)], "v_ah_cliente long, edad double"))
    known = write(spark.createDataFrame([(i, i * 10) for i in range(0, 6, 2)], "v_ah_cliente long, x long"))
    one = [FI.Rules(n, {}, lambda hub, df: df, storing=lambda hub: known) for n in ("a", "b")]
    monkeypatch.setattr(FI, "write_table", lambda df, name: (written.setdefault(name, df), write(df, name))[1])
    members = FI.fit(None, one, latest).members
    req = spark.createDataFrame([(1, None), (4, 7.0), (9, None)], "v_ah_cliente long, edad double")
    laid = FI.overlay(req, members)
    states = write(spark.createDataFrame([(i, i, p, s) for i in range(4) for p, s in (("2001-05", "normal"), ("2001-06", "normal"))],
                                   "v_ah_cliente long, v_ah_cuenta long, periodo string, estado_riesgo string"))
    for df, n in ((written["members"], 2), (laid, 1), (A.exclude_minors(latest, known.select("v_ah_cliente")), 1), (A.transitions(states), 1)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == n, plan
    assert {(r["v_ah_cliente"], r["edad"], r["k_a"] and r["k_a"]["x"]) for r in laid.collect()} == {(1, 1.0, None), (4, 7.0, 40), (9, None, None)}
