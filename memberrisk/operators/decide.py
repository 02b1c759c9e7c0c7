"""Consolidation: per-member decision (D1-D5), KPIs.

The decision is computed for a whole request table in one job, from the analyzers'
answers that ``fanin`` brings together. What the analyzers stored for a member is one
row of the member table (built once); a request takes it with one left join, then
overlays its own fields on the member's (J5). Formulas for members without history are
columns of the request row, so any number of requests of one member stay rows of their
own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memberrisk.functions import exprs as X
from memberrisk.operators import analyzers as A
from memberrisk.operators import ml as M

# Fixed values of the source system: decision thresholds and message texts.
ELIGIBLE_MIN_SCORE = 350
BLOCK_OVERDEBT_SCORE = 80
DETERIORATION_ALERT = 0.5
FAMILY_ALERT = 60
MAX_ACTIONS = 8
MSG_MINOR = "Bloquear operaciones por minoria de edad."
MSG_OVERDEBT = "Socio sobreendeudado. Evitar incremento de cupo o nuevas operaciones."
MSG_ALERT = "Alerta temprana de mora. Realizar gestion preventiva de cobro."
MSG_DETERIORATION = "Alto riesgo de migracion a peor estado de mora. Realizar contacto telefonico."
MSG_DATE = "Mover fecha de cobro sugerida al dia %d."
MSG_STRATEGY = "Estrategia de cobranza: %s"
RISK_BANDS = ((70, "alto"), (40, "medio"))


def age_adhoc_columns() -> dict[str, Column]:
    """R7b on a request row: derived age (1 decimal) when birth and process dates
    are given, else the age field; blocked when < 18. The as-of date is the
    request's process date (explicit, Q20)."""
    calc = F.when(F.col("v_fecha_nac").isNotNull() & F.col("fecha_proceso").isNotNull(),
                  X.rnd(X.floor_days("fecha_proceso", "v_fecha_nac") / F.lit(365.25), 1))
    real = F.coalesce(calc, F.col("edad"))
    minor = F.coalesce(real < 18, F.lit(False))
    return {"edad_campo": F.col("edad"), "edad_calculada": calc, "edad_real": real, "is_minor": minor, "is_blocked": minor,
            "validation_status": F.when(minor, "BLOQUEADO - Menor de edad").otherwise("APROBADO")}


def age_adhoc(req: DataFrame) -> DataFrame:
    """R7b for a request table."""
    return req.select("v_ah_cliente", *[c.alias(n) for n, c in age_adhoc_columns().items()])


#: The analyzers and what each says of a request (``agentes``).
AGENTS = {
    "age_validation": {"edad_campo": "double", "edad_calculada": "double", "edad_real": "double", "is_minor": "boolean",
                       "is_blocked": "boolean", "validation_status": "string"},
    "credit_scoring": {"score": "bigint", "grade": "string", "probability_default": "double", "risk_level": "string"},
    "early_warning": {"alert_score": "double", "alert_level": "string", "estimated_days_to_default": "bigint"},
    "roll_rate": {"current_state": "string", "prob_deterioro": "double", "most_likely_next_state": "string"},
    "over_indebtedness": {"overindebtedness_score": "double", "is_overindebted": "boolean"},
    "collection_segments": {"cluster_name": "string", "strategy": "string"},
    "product_risk": {"product_risk_score": "double", "product_tasa_riesgo": "double", "office_risk_score": "double",
                     "office_tasa_riesgo": "double", "type_risk_score": "double", "type_tasa_riesgo": "double"},
    "date_optimization": {"fecha_sugerida_cobro": "bigint", "alignment_score": "double", "dia_movimiento_predominante": "bigint"},
    "family_impact": {"estimated_dependents": "double", "adjustment_factor": "double", "ingreso_ajustado": "double",
                      "vulnerability_score": "double"},
}


def decide(fanned: DataFrame) -> DataFrame:
    """D1-D5 on the output of ``fanin.assess``. An analyzer without an answer counts as 0 (Q33):
    no alert, no action of its own, score 0, the easiest segment's channel."""
    c = F.col
    unsegmented = F.map_contains_key("agentes_error", F.lit("collection_segments"))
    segment = F.when(unsegmented, F.lit(M.CLUSTER_NAMES[0])).otherwise(c("cluster_name"))
    minor = F.coalesce(c("is_minor"), F.lit(False))
    score = F.coalesce(c("score"), F.lit(0))
    pdef = F.coalesce(c("probability_default"), F.lit(0.0))
    ew = F.coalesce(c("alert_score"), F.lit(0.0))
    level = F.coalesce(c("alert_level"), F.lit(A.EW_NORMAL))
    rr = F.coalesce(c("prob_deterioro"), F.lit(0.0))
    over = F.coalesce(c("is_overindebted").cast("boolean"), F.lit(False))
    od_score = F.coalesce(c("overindebtedness_score"), F.lit(0.0))
    prod = F.coalesce(c("product_risk_score"), F.lit(0.0))
    day = F.coalesce(c("fecha_sugerida_cobro"), F.lit(A.DEFAULT_COLLECTION_DAY))
    adj = F.coalesce(c("ingreso_ajustado"), F.lit(0.0))
    vul = F.coalesce(c("vulnerability_score"), F.lit(0.0))
    strat = F.coalesce(c("strategy"), F.lit(""))

    eligible = (~minor) & (score >= ELIGIBLE_MIN_SCORE) & (~over) & (adj >= 0)
    global_risk = X.rnd((pdef * 100 + ew * 100 + rr * 100 + prod) / 4, 2)
    alerting = level != A.EW_NORMAL
    alerts = F.array_compact(F.array(
        F.when(minor, F.lit("MENOR_EDAD")), F.when(alerting, F.upper(level)),
        F.when(over, F.lit("SOBREENDEUDAMIENTO")), F.when(rr > DETERIORATION_ALERT, F.lit("DETERIORO")),
        F.when(vul > FAMILY_ALERT, F.lit("CARGA_FAMILIAR_ALTA"))))
    actions = F.slice(F.array_compact(F.array(
        F.when(minor, F.lit(MSG_MINOR)), F.when(over, F.lit(MSG_OVERDEBT)), F.when(alerting, F.lit(MSG_ALERT)),
        F.when(rr > DETERIORATION_ALERT, F.lit(MSG_DETERIORATION)),
        F.when(c("fecha_sugerida_cobro").isNotNull(), F.format_string(MSG_DATE, day.cast("int"))),
        F.when(strat != "", F.format_string(MSG_STRATEGY, strat)))), 1, MAX_ACTIONS)
    blocks = F.array_compact(F.array(
        F.when(minor, F.lit("age_validation")), F.when(od_score >= BLOCK_OVERDEBT_SCORE, F.lit("over_indebtedness")),
        F.when(score < ELIGIBLE_MIN_SCORE, F.lit("credit_scoring"))))
    return fanned.select(
        "request_id", F.col("v_ah_cliente").alias("cliente_id"), global_risk.alias("riesgo_global"),
        eligible.alias("elegibilidad_credito"), M.channel(segment).alias("canal_cobranza"),
        day.cast("long").alias("dia_pago_sugerido"), alerts.alias("alertas_activas"),
        actions.alias("acciones_priorizadas"), blocks.alias("bloqueos"), "agentes", "agentes_error")


def risk_band(global_risk: Column) -> Column:
    """D11."""
    out = F.lit("bajo")
    for cut, name in reversed(RISK_BANDS):
        out = F.when(global_risk >= cut, F.lit(name)).otherwise(out)
    return out


# --- KPIs ---------------------------------------------------------------------------

def kpi_core(last: DataFrame) -> DataFrame:
    """Distinct members, idle>30 rate, alert-feed rows, minors (latest period)."""
    return last.agg(
        F.countDistinct("v_ah_cliente").alias("total_socios"),
        F.coalesce(X.rnd(F.avg((F.col("dias_sin_movimiento") > 30).cast("double")) * 100, 2), F.lit(0.0))
         .alias("tasa_mora_pct"),
        F.count_if(F.col("fuente_alerta") != "sin_alerta").alias("alertas_desvio"),
        F.count_if(F.col("menor_edad") == 1).alias("menores_detectados"))


def idle_buckets(last: DataFrame) -> DataFrame:
    """A27."""
    d = F.col("dias_sin_movimiento")
    return last.agg(F.count_if(d <= 30).alias("sin_mora"), F.count_if((d > 30) & (d <= 60)).alias("mora_30d"),
                    F.count_if((d > 60) & (d <= 90)).alias("mora_60d"), F.count_if(d > 90).alias("mora_90d"))


def idle_shares(buckets: DataFrame) -> DataFrame:
    """Bucket shares in % (total 0 -> 1)."""
    names = ["sin_mora", "mora_30d", "mora_60d", "mora_90d"]
    tot = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    den = F.when(tot == 0, F.lit(1)).otherwise(tot)
    return buckets.select(*[(F.col(n) * 100.0 / den).alias(f"{n}_pct") for n in names])


def alert_kpis(ew: DataFrame) -> DataFrame:
    """Members in alert (rows not normal) and per-level counts."""
    lv = F.col("alert_level")
    return ew.agg(F.count_if(lv != A.EW_NORMAL).alias("socios_en_alerta"),
                  *[F.count_if(lv == x).alias(x) for x in A.EW_LEVEL_ORDER])
