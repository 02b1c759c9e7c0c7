"""Registered consolidation queries: member decision, KPIs, profiles."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from memberrisk import session as sess
from memberrisk.functions import exprs as X
from memberrisk.operators import analyzers as A
from memberrisk.operators import bundle as B
from memberrisk.operators import decide as D
from memberrisk.operators import fanin as FI
from memberrisk.operators import ml as M
from memberrisk.plans import analyzer_set as AS
from memberrisk.plans import q_analyzers as QA
from memberrisk.plans import q_ml as QM
from memberrisk.plans.registry import REGISTRY, register
from memberrisk.sources import sinks as SK

KEYS = ["v_ah_cliente", "v_ah_cuenta", "periodo"]


def latest(h):
    """A member's latest row (smallest account on ties), without the name."""
    f = h.featured().drop("v_ah_nombre")
    return A.latest_per_client(f, [c for c in f.columns if c != "v_ah_cliente"])


def fan_in(h, analyzers=AS.RULES):
    """The analyzers fitted, each under its guard, once a hub and set of analyzers."""
    return h.memo(f"fan_in:{','.join(str(id(a)) for a in analyzers)}", lambda: FI.fit(h, analyzers, latest(h)))


def members(h):
    """The member table: a row a member, with what the analyzers stored."""
    return fan_in(h).members


def products(h):
    """What the analyzers look up by product: a row a product."""
    return fan_in(h).lookups["prod_bancario"]


def assess(h, req=None, analyzers=AS.RULES):
    """Every analyzer's answer for a request table (default: the hub's; a
    streaming micro-batch passes its own)."""
    return FI.assess(fan_in(h, analyzers), h.requests() if req is None else req)


def decisions(h):
    return h.memo("decisions", lambda: D.decide(assess(h)))


def _jsonify(df):
    return df.drop("agentes", "agentes_error").withColumns({c: F.to_json(F.col(c)) for c in ("alertas_activas", "acciones_priorizadas", "bloqueos")
                           if c in df.columns})


_DIST = "floor((epoch_us(fecha_proceso) - epoch_us(v_fecha_nac)) / 86400000000.0)"

_REQ_FIELDS = ("edad", "ingresos", "egresos", "saldo_disponible", "monto_bloq", "credito", "dias_sin_movimiento",
               "tendencia_saldo", "desviacion_maxima", "estado_civil", "sexo", "v_fecha_nac", "fecha_proceso",
               "prod_bancario", "oficina_cta", "tipo_cuenta")


def _per_request(name: str) -> str:
    """An analyzer's SQL over overlaid requests, with the request's id."""
    sql = re.sub(r"\bSELECT (r\.)?v_ah_cliente\b", r"SELECT \1request_id, \1v_ah_cliente", REGISTRY[name].sql)
    return re.sub(r"\bFROM req\b", "FROM reqo", sql)


DEC_CTES = {
    "d_member": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY v_ah_cliente ORDER BY periodo DESC, v_ah_cuenta)
                AS rk FROM featured) WHERE rk = 1""",
    "reqo": "SELECT r.request_id, r.v_ah_cliente, " + ", ".join(f"coalesce(r.{c}, m.{c}) AS {c}" for c in _REQ_FIELDS)
            + " FROM req r LEFT JOIN d_member m ON m.v_ah_cliente = r.v_ah_cliente",
    "ew_lookup": _per_request("lookup_or_default"),
    "od_adhoc": _per_request("over_indebtedness_adhoc"),
    "fam_adhoc": _per_request("family_impact_adhoc"),
    "gpl": _per_request("group_profile_lookup"),
    "dl": _per_request("collection_date_lookup"),
    "cn": REGISTRY["cluster_naming"].sql,
    "d_age": f"""SELECT request_id, coalesce(coalesce(CASE WHEN v_fecha_nac IS NOT NULL AND fecha_proceso IS NOT NULL
                THEN round_even({_DIST} / 365.25, 1) END, edad) < 18, false) AS is_minor FROM reqo""",
    "d_cur": """SELECT r.request_id, coalesce(s.estado_riesgo, 'Regular') AS st FROM reqo r LEFT JOIN (
                SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY v_ah_cliente ORDER BY periodo DESC, v_ah_cuenta)
                AS rk FROM rr_state) WHERE rk = 1) s USING (v_ah_cliente)""",
    "d_rr": """SELECT c.request_id, any_value(c.st) AS current_state, round_even(coalesce(sum(CASE WHEN b.idx > a.idx THEN m.p END), 0.0) + 0.0, 4)
                AS prob_deterioro
             FROM d_cur c JOIN states_dim a ON a.state = c.st LEFT JOIN last_matrix m ON m.state_from = c.st
             LEFT JOIN states_dim b ON b.state = m.state_to GROUP BY c.request_id""",
    "od_k": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY v_ah_cliente ORDER BY v_ah_cuenta) AS rk FROM od)
             WHERE rk = 1""",
    "fam_k": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY v_ah_cliente ORDER BY v_ah_cuenta) AS rk FROM fam)
             WHERE rk = 1""",
    "d_all": """SELECT r.request_id, r.v_ah_cliente, ag.is_minor, e.alert_score AS probability_default,
                CAST(round_even((1.0 - e.alert_score) * 1000, 0) AS BIGINT) AS score, e.alert_score, e.alert_level,
                rr.prob_deterioro,
                CASE WHEN ok.v_ah_cliente IS NOT NULL THEN ok.is_overindebted = 1 ELSE oa.is_overindebted END
                  AS is_overindebted,
                CASE WHEN ok.v_ah_cliente IS NOT NULL THEN ok.overindebtedness_score ELSE oa.overindebtedness_score END
                  AS overindebtedness_score,
                cn.cluster_name,
                CASE WHEN cn.cluster_name IS NULL THEN ''
                     WHEN cn.cluster_name = 'Recuperable fácil' THEN 'Recordatorio SMS/email + llamada amable. Alta probabilidad de pago voluntario.'
                     WHEN cn.cluster_name = 'Negociación' THEN 'Contacto personalizado + oferta de reestructuración. Socio con capacidad pero requiere flexibilidad.'
                     WHEN cn.cluster_name = 'Pre-jurídico' THEN 'Notificación formal + visita domiciliaria. Riesgo medio-alto, requiere acción inmediata.'
                     WHEN cn.cluster_name = 'Castigo potencial' THEN 'Escalamiento a jurídico. Análisis de garantías. Provisión completa recomendada.'
                     ELSE 'Análisis individual requerido.' END AS strategy,
                g.product_risk_score, dl.fecha_sugerida_cobro,
                CASE WHEN fk.v_ah_cliente IS NOT NULL THEN fk.ingreso_ajustado ELSE fa.ingreso_ajustado END AS ingreso_ajustado,
                CASE WHEN fk.v_ah_cliente IS NOT NULL THEN fk.vulnerability_score ELSE fa.vulnerability_score END
                  AS vulnerability_score
             FROM reqo r
             LEFT JOIN d_age ag USING (request_id) LEFT JOIN ew_lookup e USING (request_id)
             LEFT JOIN d_rr rr USING (request_id)
             LEFT JOIN od_k ok ON ok.v_ah_cliente = r.v_ah_cliente LEFT JOIN od_adhoc oa USING (request_id)
             LEFT JOIN cn ON cn.cluster_id = r.prod_bancario
             LEFT JOIN gpl g USING (request_id) LEFT JOIN dl USING (request_id)
             LEFT JOIN fam_k fk ON fk.v_ah_cliente = r.v_ah_cliente LEFT JOIN fam_adhoc fa USING (request_id)""",
    "dec": """SELECT request_id, v_ah_cliente AS cliente_id,
                round_even((coalesce(probability_default, 0.0) * 100 + coalesce(alert_score, 0.0) * 100
                            + coalesce(prob_deterioro, 0.0) * 100 + coalesce(product_risk_score, 0.0)) / 4, 2) AS riesgo_global,
                (NOT coalesce(is_minor, false)) AND coalesce(score, 0) >= 350 AND (NOT coalesce(is_overindebted, false))
                  AND coalesce(ingreso_ajustado, 0.0) >= 0 AS elegibilidad_credito,
                CASE cluster_name WHEN 'Recuperable fácil' THEN 'whatsapp' WHEN 'Negociación' THEN 'llamada'
                     WHEN 'Pre-jurídico' THEN 'llamada' WHEN 'Castigo potencial' THEN 'legal' ELSE 'llamada' END
                  AS canal_cobranza,
                CAST(coalesce(fecha_sugerida_cobro, 15) AS BIGINT) AS dia_pago_sugerido,
                to_json(list_filter([CASE WHEN coalesce(is_minor, false) THEN 'MENOR_EDAD' END,
                          CASE WHEN coalesce(alert_level, 'normal') <> 'normal' THEN upper(alert_level) END,
                          CASE WHEN coalesce(is_overindebted, false) THEN 'SOBREENDEUDAMIENTO' END,
                          CASE WHEN coalesce(prob_deterioro, 0.0) > 0.5 THEN 'DETERIORO' END,
                          CASE WHEN coalesce(vulnerability_score, 0.0) > 60 THEN 'CARGA_FAMILIAR_ALTA' END],
                         lambda x: x IS NOT NULL)) AS alertas_activas,
                to_json(list_filter([CASE WHEN coalesce(is_minor, false) THEN 'Bloquear operaciones por minoria de edad.' END,
                          CASE WHEN coalesce(is_overindebted, false)
                               THEN 'Socio sobreendeudado. Evitar incremento de cupo o nuevas operaciones.' END,
                          CASE WHEN coalesce(alert_level, 'normal') <> 'normal'
                               THEN 'Alerta temprana de mora. Realizar gestion preventiva de cobro.' END,
                          CASE WHEN coalesce(prob_deterioro, 0.0) > 0.5
                               THEN 'Alto riesgo de migracion a peor estado de mora. Realizar contacto telefonico.' END,
                          printf('Mover fecha de cobro sugerida al dia %d.', coalesce(fecha_sugerida_cobro, 15)),
                          CASE WHEN coalesce(strategy, '') <> '' THEN 'Estrategia de cobranza: ' || strategy END],
                         lambda x: x IS NOT NULL)[1:8]) AS acciones_priorizadas,
                to_json(list_filter([CASE WHEN coalesce(is_minor, false) THEN 'age_validation' END,
                          CASE WHEN coalesce(overindebtedness_score, 0.0) >= 80 THEN 'over_indebtedness' END,
                          CASE WHEN coalesce(score, 0) < 350 THEN 'credit_scoring' END],
                         lambda x: x IS NOT NULL)) AS bloqueos
             FROM d_all""",
}
CTES = {**QM.CTES, **DEC_CTES}


def reg(name, sql, **kw):
    return register(name, sql, CTES, **kw)


@reg("member_decision", "SELECT * FROM dec")
def q_member_decision(h):
    return _jsonify(decisions(h))


@reg("eligibility", "SELECT request_id, cliente_id, elegibilidad_credito FROM dec")
def q_eligibility(h):
    return decisions(h).select("request_id", "cliente_id", "elegibilidad_credito")


@reg("global_risk", "SELECT cliente_id, riesgo_global FROM dec")
def q_global_risk(h):
    return decisions(h).select("cliente_id", "riesgo_global")


@reg("channel", "SELECT cliente_id, canal_cobranza FROM dec")
def q_channel(h):
    return decisions(h).select("cliente_id", "canal_cobranza")


@reg("decision_lists", "SELECT cliente_id, alertas_activas, acciones_priorizadas, bloqueos FROM dec")
def q_decision_lists(h):
    return _jsonify(decisions(h).select("cliente_id", "alertas_activas", "acciones_priorizadas", "bloqueos"))


@reg("risk_band", """SELECT cliente_id, riesgo_global, CASE WHEN riesgo_global >= 70 THEN 'alto'
    WHEN riesgo_global >= 40 THEN 'medio' ELSE 'bajo' END AS risk_band FROM dec""")
def q_risk_band(h):
    d = decisions(h)
    return d.select("cliente_id", "riesgo_global", D.risk_band(F.col("riesgo_global")).alias("risk_band"))


@reg("age_validation_adhoc", f"""SELECT v_ah_cliente, edad AS edad_campo, calc AS edad_calculada,
    coalesce(calc, edad) AS edad_real, coalesce(coalesce(calc, edad) < 18, false) AS is_minor,
    coalesce(coalesce(calc, edad) < 18, false) AS is_blocked,
    CASE WHEN coalesce(coalesce(calc, edad) < 18, false) THEN 'BLOQUEADO - Menor de edad' ELSE 'APROBADO' END
      AS validation_status
    FROM (SELECT *, CASE WHEN v_fecha_nac IS NOT NULL AND fecha_proceso IS NOT NULL
                         THEN round_even({_DIST} / 365.25, 1) END AS calc FROM req)""")
def q_age_validation_adhoc(h):
    return D.age_adhoc(h.requests())


@reg("latest_per_client", """SELECT v_ah_cliente, periodo, v_ah_cuenta, saldo_disponible, dias_sin_movimiento FROM (
    SELECT *, row_number() OVER (PARTITION BY v_ah_cliente ORDER BY periodo DESC, v_ah_cuenta) AS rk FROM featured)
    WHERE rk = 1""")
def q_latest_per_client(h):
    return A.latest_per_client(h.featured(), ["periodo", "v_ah_cuenta", "saldo_disponible", "dias_sin_movimiento"])


_OVERLAY = ("edad", "ingresos", "egresos", "saldo_disponible", "monto_bloq", "credito", "dias_sin_movimiento",
            "tendencia_saldo", "desviacion_maxima", "estado_civil", "sexo")


@reg("request_overlay", "SELECT r.v_ah_cliente, " + ", ".join(f"coalesce(r.{c}, s.{c}) AS {c}" for c in _OVERLAY)
     + """ FROM req r LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY v_ah_cliente
        ORDER BY periodo DESC, v_ah_cuenta) AS rk FROM featured) WHERE rk = 1) s USING (v_ah_cliente)""")
def q_request_overlay(h):
    req = h.requests()
    stored = A.latest_per_client(h.featured(), list(_OVERLAY))
    s = stored.select("v_ah_cliente", *[F.col(c).alias(f"_s_{c}") for c in _OVERLAY])  # a row a member
    j = req.join(s, "v_ah_cliente", "left")
    return j.select("v_ah_cliente", *[F.coalesce(F.col(c), F.col(f"_s_{c}")).alias(c) for c in _OVERLAY])


# --- KPIs -----------------------------------------------------------------------------

@reg("kpi_core", """SELECT count(DISTINCT v_ah_cliente) AS total_socios,
    coalesce(round_even(avg(CASE WHEN dias_sin_movimiento > 30 THEN 1.0 ELSE 0.0 END) * 100, 2), 0.0) AS tasa_mora_pct,
    count_if(fuente_alerta <> 'sin_alerta') AS alertas_desvio, count_if(menor_edad = 1) AS menores_detectados
    FROM lastp""")
def q_kpi_core(h):
    return D.kpi_core(h.last_period())


_BUCKETS = """SELECT count_if(dias_sin_movimiento <= 30) AS sin_mora,
    count_if(dias_sin_movimiento > 30 AND dias_sin_movimiento <= 60) AS mora_30d,
    count_if(dias_sin_movimiento > 60 AND dias_sin_movimiento <= 90) AS mora_60d,
    count_if(dias_sin_movimiento > 90) AS mora_90d FROM lastp"""


@reg("idle_buckets", _BUCKETS)
def q_idle_buckets(h):
    return D.idle_buckets(h.last_period())


@reg("idle_shares", f"""SELECT sin_mora * 100.0 / t AS sin_mora_pct, mora_30d * 100.0 / t AS mora_30d_pct,
    mora_60d * 100.0 / t AS mora_60d_pct, mora_90d * 100.0 / t AS mora_90d_pct
    FROM (SELECT *, CASE WHEN sin_mora + mora_30d + mora_60d + mora_90d = 0 THEN 1
                         ELSE sin_mora + mora_30d + mora_60d + mora_90d END AS t FROM ({_BUCKETS}))""")
def q_idle_shares(h):
    return D.idle_shares(D.idle_buckets(h.last_period()))


@reg("alert_kpis", """SELECT count_if(alert_level <> 'normal') AS socios_en_alerta, count_if(alert_level = 'normal') AS normal,
    count_if(alert_level = 'alerta_30d') AS alerta_30d, count_if(alert_level = 'alerta_60d') AS alerta_60d,
    count_if(alert_level = 'alerta_90d') AS alerta_90d FROM ew""")
def q_alert_kpis(h):
    return D.alert_kpis(QA.early_warning(h))


# --- rows-only consolidation with fitted models ---------------------------------------

def model_decisions(h):
    """Decisions with the fitted models' scores and segments."""
    return h.memo("model_decisions", lambda: D.decide(assess(h, analyzers=AS.MODELS)))


@register("member_decision_model", kind="R")
def q_member_decision_model(h):
    return _jsonify(model_decisions(h))


@reg("saved_models", """SELECT (SELECT count(*) FROM req) AS n_requests, (SELECT count(*) FROM req) AS n_same_score,
    (SELECT count(*) FROM req) AS n_same_segment, (SELECT count(*) FROM req) AS n_same_decision""")
def q_saved_models(h):
    """A saved and loaded bundle decides as the models it was saved from."""
    path = f"{sess.ensure_checkpoint_dir(h.spark).rstrip('/')}/tables/bundle-{uuid.uuid4().hex}"
    B.save(QM.bundle(h), path, h.spark)
    loaded = AS.bundled(B.load(h.spark, path))
    told = ("riesgo_global", "elegibilidad_credito", "canal_cobranza", "bloqueos")

    def rows(df, name):
        return df.select("request_id", F.col("agentes.credit_scoring.score").alias(f"{name}_score"),
                         F.col("agentes.collection_segments.cluster_name").alias(f"{name}_segment"), F.struct(*told).alias(f"{name}_told"))

    both = rows(model_decisions(h), "a").join(rows(D.decide(assess(h, analyzers=loaded)), "b"), "request_id")
    return both.agg(F.count(F.lit(1)).alias("n_requests"), *[
        F.count_if(F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).alias(f"n_same_{n}")
        for c, n in (("score", "score"), ("segment", "segment"), ("told", "decision"))])


FAN_IN = ("request_id", "v_ah_cliente", "is_minor", "probability_default", "score", "alert_score", "alert_level",
          "prob_deterioro", "is_overindebted", "overindebtedness_score", "cluster_name", "strategy",
          "product_risk_score", "fecha_sugerida_cobro", "ingreso_ajustado", "vulnerability_score")


@reg("member_fan_in", "SELECT * FROM d_all")
def q_member_fan_in(h):
    return assess(h).select(*FAN_IN)


@reg("minors_stay_blocked", """SELECT d.request_id, d.cliente_id, d.elegibilidad_credito, d.riesgo_global FROM dec d
    JOIN (SELECT DISTINCT v_ah_cliente FROM minors) m ON m.v_ah_cliente = d.cliente_id""")
def q_minors_stay_blocked(h):
    """D5 for minors, asked with all fields or by id alone."""
    minors = A.minor_ids(QA.validation(h)).withColumnRenamed("v_ah_cliente", "cliente_id")
    return decisions(h).join(minors, "cliente_id", "left_semi").select(
        "request_id", "cliente_id", "elegibilidad_credito", "riesgo_global")


_PROFILE = ("edad", "saldo_disponible", "ingresos", "dias_sin_movimiento", "prod_bancario", "oficina_cta", "tipo_cuenta")
_DATES = ("fecha_proceso", "v_fecha_nac")


@reg("member_profile", "SELECT m.v_ah_cliente, m.periodo, " + ", ".join(f"m.{c}" for c in _PROFILE) + ", "
     + ", ".join(f"strftime(m.{c}, '%Y-%m-%dT%H:%M:%S') AS {c}" for c in _DATES) + """,
     a.is_minor, a.score, a.alert_score, a.alert_level, a.prob_deterioro, a.is_overindebted, a.overindebtedness_score,
     a.cluster_name, a.strategy, a.product_risk_score, a.fecha_sugerida_cobro, a.ingreso_ajustado, a.vulnerability_score,
     9 AS n_agents
     FROM d_all a JOIN d_member m ON m.v_ah_cliente = a.v_ah_cliente WHERE a.request_id = 'i' || a.v_ah_cliente""")
def q_member_profile(h):
    """D6 + P29: the latest row of each latest-period member without the name,
    times as text and NaN as null, with the answers of all nine analyzers."""
    df = profiles(h)
    cols = [F.col(f"member.{c}").alias(c) for c in ("periodo", *_PROFILE, *_DATES)]
    keys = F.size(F.json_object_keys(F.to_json("agentes"))).cast("long")
    return SK.serializable(df.select("v_ah_cliente", *cols, *FAN_IN[2:3], "score", *FAN_IN[5:], keys.alias("n_agents")))


def profiles(h):
    """D6 in full: ``member`` (latest row, no name) and ``agentes`` of each member."""
    by_id = h.requests().where(F.col("request_id").startswith("i"))
    return assess(h, by_id)


@register("kpi_row", kind="R")
def q_kpi_row(h):
    """One KPI row: core, buckets, alerts, minors, over-indebted,
    high-risk grade rate and clusters (model parts rows-only)."""
    last = h.last_period()
    core = D.kpi_core(last)
    buckets = D.idle_buckets(last).select(F.to_json(F.struct("*")).alias("distribucion_riesgo"))
    alerts = D.alert_kpis(QA.early_warning(h)).select(
        "socios_en_alerta", F.to_json(F.struct("normal", "alerta_30d", "alerta_60d", "alerta_90d")).alias("distribucion_alerta"))
    minors = A.age_metrics(QA.validation(h)).select("menores_bloqueados")
    over = A.overdebt_metrics(QA.overdebt(h)).select("socios_sobreendeudados")
    grade = REGISTRY["grade_rate"].build(h)
    model, _ = QM.kmeans(h)
    counts = M.channel_counts(QM.clusters(h)).groupBy().pivot("channel", list(M.CHANNEL_NAMES)).agg(F.first("n_socios"))
    chan = counts.select(F.to_json(F.struct(*M.CHANNEL_NAMES)).alias("distribucion_canal"))
    out = core
    for part in (buckets, alerts, minors, over, grade, chan):
        row = X.one_row(part)
        out = out.withColumns({c: row[c] for c in part.columns})
    return out.withColumn("clusters_count", F.lit(model.k if model else 0)) \
              .withColumn("id", F.lit("latest")).withColumn("pipeline_status", F.lit("ready"))


_SUMMARY_SQL = {
    "early_warning": REGISTRY["alert_metrics"].sql, "over_indebtedness": REGISTRY["overdebt_metrics"].sql,
    "age_validation": REGISTRY["age_metrics"].sql, "date_optimization": REGISTRY["alignment_metrics"].sql,
    "family_impact": REGISTRY["family_metrics"].sql,
    "roll_rate": f"""SELECT count(*) AS n_transiciones, sum(n_deteriorated) AS n_socios_deteriorados
                     FROM ({REGISTRY["deterioration"].sql})""",
    "product_risk": f"""SELECT max(CASE WHEN dimension = 'producto' THEN n_groups END) AS n_productos,
                        max(CASE WHEN dimension = 'oficina' THEN n_groups END) AS n_oficinas,
                        max(CASE WHEN dimension = 'tipo_cuenta' THEN n_groups END) AS n_tipos_cuenta
                        FROM ({REGISTRY["group_counts"].sql})""",
}


@reg("run_summary_rules", " UNION ALL ".join(
    f"""SELECT '{name}' AS analyzer, 'ready' AS status, metric, value FROM
        (SELECT * FROM (SELECT CAST(COLUMNS(*) AS DOUBLE) FROM ({sql}))
         UNPIVOT INCLUDE NULLS (value FOR metric IN (COLUMNS(*))))"""
    for name, sql in _SUMMARY_SQL.items()))
def q_run_summary_rules(h):
    """D12 for the analyzers by rule that have headline numbers."""
    return FI.summary(fan_in(h)).where("metric IS NOT NULL")


@register("run_summary", kind="R")
def q_run_summary(h):
    """Status and headline metrics of all nine analyzers as (analyzer, status, metric, value)."""
    return FI.summary(fan_in(h, AS.MODELS))


@reg("run_status", " UNION ALL ".join(
    f"SELECT '{name}' AS analyzer, 'ready' AS status, CAST(NULL AS VARCHAR) AS error, {rows} AS n_rows" for name, rows in {
        "age_validation": "(SELECT count(*) FROM age_val)", "early_warning": "(SELECT count(*) FROM ew)",
        "credit_scoring": "CAST(NULL AS BIGINT)", "roll_rate": "(SELECT count(*) FROM rr_state)",
        "over_indebtedness": "(SELECT count(*) FROM od)", "collection_segments": "(SELECT count(*) FROM cn)",
        "product_risk": "(SELECT count(*) FROM grp)", "date_optimization": "(SELECT count(*) FROM dates)",
        "family_impact": "(SELECT count(*) FROM fam)"}.items()))
def q_run_status(h):
    """What became of each analyzer, and the rows of its result."""
    return fan_in(h).status_table(h.spark).drop("seconds")


def _without(name: str) -> str:
    """The decision's SQL with an analyzer's answers taken away."""
    gone = {"age_validation": ["is_minor"], "early_warning": ["alert_score", "alert_level", "probability_default", "score"],
            "credit_scoring": ["probability_default", "score"], "roll_rate": ["prob_deterioro"],
            "over_indebtedness": ["is_overindebted", "overindebtedness_score"], "collection_segments": ["cluster_name", "strategy"],
            "product_risk": ["product_risk_score"], "date_optimization": ["fecha_sugerida_cobro"],
            "family_impact": ["ingreso_ajustado", "vulnerability_score"]}[name]
    sql = DEC_CTES["dec"].replace("FROM d_all", f"FROM (SELECT * REPLACE ({', '.join(f'NULL AS {c}' for c in gone)}) FROM d_all)")
    if name == "collection_segments":
        sql = sql.replace("CASE cluster_name WHEN", "CASE coalesce(cluster_name, 'Recuperable fácil') WHEN")
    if name == "date_optimization":
        sql = sql.replace("printf('Mover fecha", "CASE WHEN fecha_sugerida_cobro IS NOT NULL THEN printf('Mover fecha").replace(
            "coalesce(fecha_sugerida_cobro, 15)),", "fecha_sugerida_cobro) END,", 1)
    return f"""SELECT '{name}' AS analyzer_off, count(*) AS n_requests, sum(riesgo_global) AS sum_riesgo_global,
        count_if(elegibilidad_credito) AS n_eligible, count_if(canal_cobranza = 'whatsapp') AS n_whatsapp,
        sum(dia_pago_sugerido) AS sum_day, sum(json_array_length(alertas_activas)) AS n_alerts,
        sum(json_array_length(acciones_priorizadas)) AS n_actions, sum(json_array_length(bloqueos)) AS n_blocks FROM ({sql})"""


@reg("decision_without_one", " UNION ALL ".join(_without(a.name) for a in AS.RULES))
def q_decision_without_one(h):
    """The decisions with each analyzer switched off in turn; every request keeps its row."""
    fan, out = fan_in(h), None
    for a in AS.RULES:
        made = D.decide(FI.assess(fan.without([a.name]), h.requests())).agg(
            F.count(F.lit(1)).alias("n_requests"), F.sum("riesgo_global").alias("sum_riesgo_global"),
            F.count_if("elegibilidad_credito").alias("n_eligible"), F.count_if(F.col("canal_cobranza") == "whatsapp").alias("n_whatsapp"),
            F.sum("dia_pago_sugerido").alias("sum_day"),
            *[F.sum(F.size(c)).alias(n) for c, n in (("alertas_activas", "n_alerts"), ("acciones_priorizadas", "n_actions"), ("bloqueos", "n_blocks"))])
        row = made.select(F.lit(a.name).alias("analyzer_off"), "*")
        out = row if out is None else out.unionByName(row)
    return out


# --- remaining inventory items ------------------------------------------------------

_REQ_NUMERIC = ("edad", "ingresos", "egresos", "saldo_disponible", "monto_bloq", "credito", "dias_sin_movimiento",
                "tendencia_saldo", "desviacion_maxima")


@reg("request_defaults", "SELECT v_ah_cliente, " + ", ".join(f"coalesce({c}, 0.0) AS {c}" for c in _REQ_NUMERIC)
     + ", coalesce(estado_civil, 'S') AS estado_civil FROM req")
def q_request_defaults(h):
    """Request fields with their defaults (numeric 0, civil status S)."""
    req = h.requests()
    return req.select("v_ah_cliente", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in _REQ_NUMERIC],
                      F.coalesce(F.col("estado_civil"), F.lit("S")).alias("estado_civil"))


@reg("global_stats", """SELECT quantile_cont(dias_sin_movimiento, 0.99) AS idle_p99,
    quantile_cont(tendencia_saldo, 0.01) AS trend_p01, quantile_cont(tendencia_saldo, 0.99) AS trend_p99,
    quantile_cont(desviacion_maxima, 0.99) AS deviation_p99, quantile_cont(saldo_efectivo, 0.5) AS balance_p50
    FROM adults""")
def q_global_stats(h):
    """Every global percentile of the adult rows in one quantile pass."""
    from memberrisk.functions import ranking as R
    row = R.quantile_row(QA.adults(h), {"dias_sin_movimiento": [0.99], "tendencia_saldo": [0.01, 0.99],
                                       "desviacion_maxima": [0.99], "saldo_efectivo": [0.5]})
    return row.select(F.col("dias_sin_movimiento_q99").alias("idle_p99"), F.col("tendencia_saldo_q1").alias("trend_p01"),
                      F.col("tendencia_saldo_q99").alias("trend_p99"),
                      F.col("desviacion_maxima_q99").alias("deviation_p99"),
                      F.col("saldo_efectivo_q50").alias("balance_p50"))


@reg("quality_counts", """SELECT (SELECT count(*) FROM featured) AS n_rows,
    (SELECT sum(riesgo_alto) FROM featured) AS n_riesgo_alto,
    (SELECT sum(riesgo_alto) * 100.0 / count(*) FROM featured) AS pct_riesgo_alto,
    (SELECT count_if(fuente_alerta <> 'sin_alerta') FROM enriched) AS n_rows_with_alert,
    (SELECT count(*) FROM enriched) AS n_enriched_rows""")
def q_quality_counts(h):
    """Label count and rate, alert-match count (one aggregate per table)."""
    f = h.featured().agg(F.count(F.lit(1)).alias("n_rows"), F.sum("riesgo_alto").alias("n_riesgo_alto"),
                         (F.sum("riesgo_alto") * 100.0 / F.count(F.lit(1))).alias("pct_riesgo_alto"))
    e = h.enriched().agg(F.count_if(F.col("fuente_alerta") != "sin_alerta").alias("n_rows_with_alert"),
                         F.count(F.lit(1)).alias("n_enriched_rows"))
    return f.withColumns({k: X.one_row(e)[k] for k in ("n_rows_with_alert", "n_enriched_rows")})
