"""The nine analyzers of the source system as ``fanin.Analyzer``s, and the two with fitted models.

Early warning comes before credit scoring, whose rule form (no model) takes its score from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memberrisk.operators import analyzers as A
from memberrisk.operators import decide as D
from memberrisk.operators import ml as M
from memberrisk.operators.bundle import Bundle
from memberrisk.operators.fanin import Rules
from memberrisk.plans import q_analyzers as QA
from memberrisk.plans import q_ml as QM

STORED = {
    "early_warning": ["alert_score", "alert_level", "estimated_days_to_default"],
    "over_indebtedness": ["is_overindebted", "overindebtedness_score"],
    "family_impact": ["estimated_dependents", "adjustment_factor", "ingreso_ajustado", "vulnerability_score"],
}


def _latest_last(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row per client among latest-period rows (smallest account)."""
    return A.latest_per_client(df.withColumn("periodo", F.lit("last")), cols)


def _stored_or(name: str, adhoc):
    """The member's stored result, else the formula on the request row (Q18/Q19)."""
    def answer(h, df: DataFrame) -> DataFrame:
        columns = adhoc()
        known = F.col(f"k_{name}").isNotNull()
        return df.withColumns({c: F.when(known, F.col(f"k_{name}.{c}")).otherwise(columns[c]) for c in STORED[name]})
    return answer


def _credit_by_rule(h, df: DataFrame) -> DataFrame:
    score, grade = M.score_grade(F.lit(1.0) - F.col("alert_score"))
    has = F.col("alert_score").isNotNull()
    return df.withColumns({"probability_default": F.col("alert_score"), "score": score, "grade": F.when(has, grade),
                           "risk_level": F.when(has, M.risk_level(score))})


def _segment_by_product(h, df: DataFrame) -> DataFrame:
    return df.withColumn("strategy", F.when(F.col("cluster_name").isNull(), F.lit("")).otherwise(M.strategy(F.col("cluster_name"))))


def _products(h) -> dict[str, DataFrame]:
    def of(dimension: str, prefix: str) -> DataFrame:
        return QA.groups(h).where(F.col("dimension") == dimension).select(
            "segment", F.col("risk_score").alias(f"{prefix}_risk_score"), F.col("tasa_riesgo").alias(f"{prefix}_tasa_riesgo"))
    return {"prod_bancario": of("producto", "product"), "oficina_cta": of("oficina", "office"), "tipo_cuenta": of("tipo_cuenta", "type")}


def _product_risk(h, df: DataFrame) -> DataFrame:
    return df.fillna({c: 0.0 for c in D.AGENTS["product_risk"]})


def _roll_rate(h, df: DataFrame) -> DataFrame:
    known = df.withColumn("estado_riesgo", F.col("k_roll_rate.estado_riesgo"))
    return A.transition_lookup(known, QA.matrix(h))


def _dates(h, df: DataFrame) -> DataFrame:
    k = "k_date_optimization"
    return df.withColumns({
        "fecha_sugerida_cobro": F.coalesce(F.col(f"{k}.fecha_sugerida_cobro"), F.lit(A.DEFAULT_COLLECTION_DAY)),
        "alignment_score": F.coalesce(F.col(f"{k}.alignment_score"), F.lit(A.DEFAULT_ALIGNMENT)),
        "dia_movimiento_predominante": F.col(f"{k}.dia_movimiento_predominante")})


def _roll_rate_metrics(h) -> DataFrame:
    return A.deterioration(QA.transitions(h)).agg(
        F.count(F.lit(1)).alias("n_transiciones"), F.sum("n_deteriorated").alias("n_socios_deteriorados"))


def _product_metrics(h) -> DataFrame:
    return (A.group_counts(QA.groups(h)).groupBy().pivot("dimension", ["producto", "oficina", "tipo_cuenta"])
            .agg(F.first("n_groups")).withColumnsRenamed({"producto": "n_productos", "oficina": "n_oficinas",
                                                          "tipo_cuenta": "n_tipos_cuenta"}))


def product_names(h) -> DataFrame:
    """Deterministic segments: product codes named by M17."""
    return QA._table(h, "product_names", lambda: M.cluster_naming(
        QM.scaled_last(h).withColumnRenamed("prod_bancario", "cluster_id")))


def _named_products(h) -> dict[str, DataFrame]:
    return {"prod_bancario": product_names(h).where("cluster_id IS NOT NULL").select(
        F.col("cluster_id").cast("string").alias("segment"), "cluster_name")}


def _overdebt(h) -> DataFrame:
    return _latest_last(QA.overdebt(h).withColumn("is_overindebted", F.col("is_overindebted") == 1), STORED["over_indebtedness"])


def _rules(name: str, answering, **given) -> Rules:
    return Rules(name, D.AGENTS[name], answering, **given)


RULES = (
    _rules("age_validation", lambda h, df: df.withColumns(D.age_adhoc_columns()), fitting=QA.validation,
           measuring=lambda h: A.age_metrics(QA.validation(h))),
    _rules("early_warning", _stored_or("early_warning", A.early_warning_adhoc_columns), fitting=QA.early_warning,
           storing=lambda h: A.latest_per_client(QA.early_warning(h), STORED["early_warning"]),
           measuring=lambda h: A.alert_metrics(QA.early_warning(h))),
    _rules("credit_scoring", _credit_by_rule),
    _rules("roll_rate", _roll_rate, fitting=QA.states, storing=lambda h: A.latest_per_client(QA.states(h), ["estado_riesgo"]),
           measuring=_roll_rate_metrics),
    _rules("over_indebtedness", _stored_or("over_indebtedness", A.over_indebtedness_adhoc_columns), fitting=QA.overdebt,
           storing=_overdebt, measuring=lambda h: A.overdebt_metrics(QA.overdebt(h))),
    _rules("collection_segments", _segment_by_product, fitting=product_names, looking_up=_named_products),
    _rules("product_risk", _product_risk, fitting=QA.groups, looking_up=_products, measuring=_product_metrics),
    _rules("date_optimization", _dates, fitting=QA.dates,
           storing=lambda h: QA.dates(h).select("v_ah_cliente", *D.AGENTS["date_optimization"]),
           measuring=lambda h: A.alignment_metrics(QA.dates(h))),
    _rules("family_impact", _stored_or("family_impact", A.family_impact_adhoc_columns), fitting=QA.family,
           storing=lambda h: _latest_last(QA.family(h), STORED["family_impact"]),
           measuring=lambda h: A.family_metrics(QA.family(h))),
)


# --- with fitted models ----------------------------------------------------------------

def _credit_by_model(h, df: DataFrame) -> DataFrame:
    """The request's own fields over the member's stored ones, scored row by row."""
    answers = list(D.AGENTS["credit_scoring"])
    fields = QM.with_member_features(df.drop(*answers).withColumn("_asked", F.struct(*[F.col(c) for c in df.columns if c not in answers])), QM.model_columns(h))
    return QM.score_requests(h, fields).select("_asked.*", *answers)


def _segment_by_model(h, df: DataFrame) -> DataFrame:
    """The cluster by the request's own features, scaled like the members'."""
    asked = F.struct(*[F.col(c) for c in df.columns if c not in ("cluster_name", "strategy")])
    placed = QM.assign_requests(h, df.drop("cluster_name", "strategy").withColumn("_asked", asked))
    return placed.select("_asked.*", "cluster_name", M.strategy(F.col("cluster_name")).alias("strategy"))


def _fitted_clusters(h) -> DataFrame:
    return QM.clusters(h).select("v_ah_cliente", "cluster_id")


def _cluster_metrics(h) -> DataFrame:
    model, table = QM.kmeans(h)
    return table.orderBy(F.col("silhouette").desc_nulls_last(), "k").limit(1).select(
        F.lit(model.k).alias("optimal_k"), "silhouette", "inertia")


def _credit_metrics(h) -> DataFrame:
    from memberrisk.plans.registry import REGISTRY
    return REGISTRY["credit_metrics"].build(h)


def _fitted_credit(h) -> None:
    QM.credit_models(h)


_MODELS = {
    "credit_scoring": _rules("credit_scoring", _credit_by_model, fitting=_fitted_credit, measuring=_credit_metrics),
    "collection_segments": _rules("collection_segments", _segment_by_model, fitting=_fitted_clusters, measuring=_cluster_metrics),
}
MODELS = tuple(_MODELS.get(a.name, a) for a in RULES)


def bundled(saved: Bundle) -> tuple[Rules, ...]:
    """The analyzers with the models of a loaded bundle: nothing is fitted."""
    def credit(h, df: DataFrame) -> DataFrame:
        answers = list(D.AGENTS["credit_scoring"])
        asked = F.struct(*[F.col(c) for c in df.columns if c not in answers])
        fields = QM.with_member_features(df.drop(*answers).withColumn("_asked", asked), saved.columns)
        return saved.score(fields).select("_asked.*", *answers)

    def segment(h, df: DataFrame) -> DataFrame:
        asked = F.struct(*[F.col(c) for c in df.columns if c not in ("cluster_name", "strategy")])
        own = df.drop("cluster_name", "strategy").withColumn("_asked", asked)
        placed = saved.assign(QM.with_member_features(own, list(saved.centres.columns)))
        return placed.select("_asked.*", "cluster_name", M.strategy(F.col("cluster_name")).alias("strategy"))

    of = {"credit_scoring": _rules("credit_scoring", credit), "collection_segments": _rules("collection_segments", segment)}
    return tuple(of.get(a.name, a) for a in RULES)
