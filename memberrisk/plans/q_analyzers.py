"""Registered queries for the rule analyzers, with their DuckDB oracles."""

from __future__ import annotations

import logging

from pyspark.sql import functions as F

from memberrisk.operators import analyzers as A
from memberrisk.plans.pipeline import materialize
from memberrisk.plans.registry import register

# --- shared analyzer stages (memoised per hub) ----------------------------------


def _table(h, name, build):
    """Analyzer output written once as a table (first use), then re-read by
    every query that needs it."""
    return h.memo(name, lambda: materialize(build(), name))


def validation(h):
    return _table(h, "age_validation", lambda: A.age_validation(h.last_period()))


def adults(h):
    """Rows of members who are not minors; all rows when the age analyzer cannot be fitted."""
    def build():
        try:
            minors = A.minor_ids(validation(h))
        except Exception as error:  # noqa: BLE001 - the fan-in reports it as the age analyzer's status
            logging.getLogger(__name__).warning("no age validation, minors stay: %s", error)
            return h.featured()
        return A.exclude_minors(h.featured(), minors)
    return _table(h, "adults", build)


def ew_stats(h):
    return h.memo("ew_stats_row", lambda: A.early_warning_stats(adults(h)))


def early_warning(h):
    return _table(h, "early_warning", lambda: A.early_warning(adults(h), ew_stats(h)))


def states(h):
    return _table(h, "states", lambda: A.risk_states(adults(h), ew_stats(h)["dias_sin_movimiento_q99"]))


def transitions(h):
    return _table(h, "transitions", lambda: A.transitions(states(h)))


def matrix(h):
    return _table(h, "matrix", lambda: A.transition_matrix(transitions(h)))


def overdebt(h):
    return _table(h, "overdebt", lambda: A.over_indebtedness(h.last_period()))


def groups(h):
    return _table(h, "groups", lambda: A.group_risk(h.last_period()))


def dates(h):
    return _table(h, "dates", lambda: A.collection_dates(h.featured()))


def family(h):
    return _table(h, "family", lambda: A.family_impact(h.last_period()))


# --- oracle CTEs -------------------------------------------------------------------

DAYS_NAC = "floor((epoch_us(fecha_proceso) - epoch_us(v_fecha_nac)) / 86400000000.0)"

CTES = {
    "lastp": "SELECT * FROM featured WHERE periodo = (SELECT max(periodo) FROM featured)",
    "age_calc": f"""SELECT *, CASE WHEN v_fecha_nac IS NOT NULL AND fecha_proceso IS NOT NULL
                    THEN round_even({DAYS_NAC} / 365.25, 1) END AS calc FROM lastp""",
    "age_flags": """SELECT *, coalesce(calc, edad) AS real_age,
                coalesce(edad IS NOT NULL AND calc IS NOT NULL AND abs(edad - calc) > 2, false) AS inc_age,
                coalesce(menor_edad IS NOT NULL AND coalesce(calc, edad) IS NOT NULL
                         AND menor_edad <> CASE WHEN coalesce(calc, edad) < 18 THEN 1 ELSE 0 END, false) AS inc_flag
             FROM age_calc""",
    "age_val": """SELECT v_ah_cliente, v_ah_cuenta, edad AS edad_campo, calc AS edad_calculada, real_age AS edad_real,
                coalesce(real_age < 18, false) AS is_minor, coalesce(real_age < 18, false) AS is_blocked,
                inc_age OR inc_flag AS is_inconsistent,
                CASE WHEN inc_flag THEN coalesce(d_age, '') || ' | menor_edad=' || CAST(menor_edad AS VARCHAR)
                                        || ' pero edad=' || CAST(real_age AS VARCHAR)
                     ELSE d_age END AS inconsistency_detail
             FROM (SELECT *, CASE WHEN inc_age THEN printf('Campo dice %s, calculada %.1f (diff=%.1f)',
                                  CAST(edad AS VARCHAR), calc, abs(edad - calc)) END AS d_age FROM age_flags)""",
    "minors": "SELECT DISTINCT v_ah_cliente FROM age_val WHERE is_blocked",
    "adults": "SELECT f.* FROM featured f WHERE NOT EXISTS (SELECT 1 FROM minors m WHERE m.v_ah_cliente = f.v_ah_cliente)",
    "ew_par": """SELECT CASE WHEN m = 0 OR m IS NULL THEN 1.0 ELSE m END AS m, lo, hi,
                CASE WHEN hi <> lo THEN hi - lo ELSE 1.0 END AS rng,
                CASE WHEN v = 0 OR v IS NULL THEN 1.0 ELSE v END AS v
             FROM (SELECT quantile_cont(dias_sin_movimiento, 0.99) AS m, quantile_cont(tendencia_saldo, 0.01) AS lo,
                          quantile_cont(tendencia_saldo, 0.99) AS hi, quantile_cont(desviacion_maxima, 0.99) AS v
                   FROM adults)""",
    "ew_c": """SELECT a.v_ah_cliente, a.v_ah_cuenta, a.periodo,
                (CASE WHEN a.dias_sin_movimiento > p.m THEN p.m ELSE a.dias_sin_movimiento END) / p.m AS inact,
                1.0 - ((CASE WHEN a.tendencia_saldo > p.hi THEN p.hi WHEN a.tendencia_saldo < p.lo THEN p.lo
                             ELSE a.tendencia_saldo END) - p.lo) / p.rng AS bal,
                (CASE WHEN a.desviacion_maxima > p.v THEN p.v ELSE a.desviacion_maxima END) / p.v AS dev
             FROM adults a CROSS JOIN ew_par p""",
    "ew": """SELECT v_ah_cliente, v_ah_cuenta, periodo, s AS alert_score_raw, round_even(s, 4) AS alert_score,
                CASE WHEN s >= 0.75 THEN 'alerta_90d' WHEN s >= 0.5 THEN 'alerta_60d' WHEN s >= 0.3 THEN 'alerta_30d'
                     ELSE 'normal' END AS alert_level,
                CAST(round_even(CASE WHEN (1.0 - s) * 120 < 0 THEN 0.0 ELSE (1.0 - s) * 120 END, 0) AS BIGINT)
                  AS estimated_days_to_default,
                round_even(inact, 4) AS inactivity_component, round_even(bal, 4) AS balance_component,
                round_even(dev, 4) AS deviation_component
             FROM (SELECT *, 0.4 * inact + 0.3 * bal + 0.3 * dev AS s FROM ew_c)""",
    "states_dim": """SELECT * FROM (VALUES ('Excelente', 0), ('Bueno', 1), ('Regular', 2), ('Riesgoso', 3),
                ('Crítico', 4)) AS t(state, idx)""",
    "rr_rank": """SELECT v_ah_cliente, v_ah_cuenta, periodo, dias_sin_movimiento,
                (CAST(rank() OVER (ORDER BY saldo_efectivo) - 1 AS DOUBLE)
                   + (CAST(count(*) OVER (PARTITION BY saldo_efectivo) AS DOUBLE) + 1.0) / 2.0)
                / count(*) OVER () AS saldo_norm
             FROM adults""",
    "rr_state": """SELECT v_ah_cliente, v_ah_cuenta, periodo, saldo_norm, comp AS composite,
                CASE WHEN comp >= 0.8 THEN 'Excelente' WHEN comp >= 0.6 THEN 'Bueno' WHEN comp >= 0.4 THEN 'Regular'
                     WHEN comp >= 0.2 THEN 'Riesgoso' ELSE 'Crítico' END AS estado_riesgo
             FROM (SELECT r.*, 0.6 * r.saldo_norm
                     + 0.4 * (1.0 - (CASE WHEN r.dias_sin_movimiento > p.m THEN p.m ELSE r.dias_sin_movimiento END) / p.m)
                     AS comp FROM rr_rank r CROSS JOIN ew_par p)""",
    "pairs": """SELECT period_from, period_to FROM (
                SELECT periodo AS period_from, lead(periodo) OVER (ORDER BY periodo) AS period_to
                FROM (SELECT DISTINCT periodo FROM rr_state)) WHERE period_to IS NOT NULL""",
    "trans": """SELECT s.v_ah_cliente, p.period_from, p.period_to, s.estado_riesgo AS state_from,
                d.estado_riesgo AS state_to
             FROM rr_state s JOIN pairs p ON s.periodo = p.period_from
             JOIN rr_state d ON d.v_ah_cliente = s.v_ah_cliente AND d.periodo = p.period_to""",
    "tcount": """SELECT period_from, period_to, state_from, state_to, count(*) AS n FROM trans GROUP BY ALL""",
    "matrix": """SELECT g.period_from, g.period_to, g.state_from, g.state_to, CAST(coalesce(c.n, 0) AS BIGINT) AS n,
                round_even(CASE WHEN sum(coalesce(c.n, 0)) OVER w > 0
                                THEN coalesce(c.n, 0) / sum(coalesce(c.n, 0)) OVER w ELSE 0.0 END, 4) AS p
             FROM (SELECT DISTINCT t.period_from, t.period_to, a.state AS state_from, b.state AS state_to
                   FROM trans t CROSS JOIN states_dim a CROSS JOIN states_dim b) g
             LEFT JOIN tcount c USING (period_from, period_to, state_from, state_to)
             WINDOW w AS (PARTITION BY g.period_from, g.period_to, g.state_from)""",
    "last_matrix": "SELECT * FROM matrix WHERE period_to = (SELECT max(period_to) FROM matrix)",
    "dist": """SELECT estado_riesgo, count(*) AS n_socios FROM rr_state
             WHERE periodo = (SELECT max(periodo) FROM rr_state) GROUP BY estado_riesgo""",
    "od": """SELECT v_ah_cliente, v_ah_cuenta, score AS score_raw, round_even(score, 2) AS overindebtedness_score,
                CASE WHEN score >= 60 THEN 1 ELSE 0 END AS is_overindebted, flujo_neto, ratio_ingreso_egreso,
                ratio_bloqueo, credit AS tiene_credito
             FROM (SELECT *, CASE WHEN raw * 100 > 100 THEN 100.0 WHEN raw * 100 < 0 THEN 0.0 ELSE raw * 100 END AS score
                   FROM (SELECT *, coalesce(credito, 0.0) AS credit,
                      (0.3 * CASE WHEN ratio_ingreso_egreso < 1.0 THEN 1.0 WHEN ratio_ingreso_egreso < 1.2 THEN 0.7
                                  WHEN ratio_ingreso_egreso < 1.5 THEN 0.4 ELSE 0.1 END
                       + 0.25 * CASE WHEN ratio_bloqueo > 1.0 THEN 1.0 ELSE ratio_bloqueo END
                       + 0.25 * CASE WHEN flujo_neto < 0 THEN 1.0 WHEN flujo_neto < 100 THEN 0.5 ELSE 0.1 END
                       + 0.2 * CASE WHEN tendencia_saldo < -50 THEN 1.0 WHEN tendencia_saldo < 0 THEN 0.5 ELSE 0.1 END)
                      * CASE WHEN coalesce(credito, 0.0) = 1 THEN 1.2 ELSE 1.0 END AS raw
                   FROM lastp))""",
    "grp_in": """SELECT CAST(prod_bancario AS VARCHAR) AS prod_bancario, CAST(oficina_cta AS VARCHAR) AS oficina_cta,
                tipo_cuenta, riesgo_alto, saldo_disponible, dias_sin_movimiento FROM lastp""",
    "grp_raw": """SELECT 'producto' AS dimension, prod_bancario AS segment, count(*) AS n, avg(riesgo_alto) AS rate,
                avg(saldo_disponible) AS avg_saldo, avg(dias_sin_movimiento) AS avg_inact
             FROM grp_in WHERE prod_bancario IS NOT NULL GROUP BY prod_bancario
             UNION ALL
             SELECT 'oficina', oficina_cta, count(*), avg(riesgo_alto), avg(saldo_disponible), avg(dias_sin_movimiento)
             FROM grp_in WHERE oficina_cta IS NOT NULL GROUP BY oficina_cta
             UNION ALL
             SELECT 'tipo_cuenta', tipo_cuenta, count(*), avg(riesgo_alto), avg(saldo_disponible), avg(dias_sin_movimiento)
             FROM grp_in WHERE tipo_cuenta IS NOT NULL GROUP BY tipo_cuenta""",
    "grp": """SELECT dimension, segment, n AS n_socios,
                round_even(n / (SELECT count(*) FROM lastp) * 100, 2) AS concentracion_pct,
                round_even(rate * 100, 2) AS tasa_riesgo, round_even(avg_saldo, 2) AS avg_saldo,
                round_even(avg_inact, 1) AS avg_dias_inactivo,
                round_even(rate * 40 + least(avg_inact / 90, 1.0) * 30
                    + CASE WHEN p75 = 0 OR p75 IS NULL THEN CASE WHEN avg_saldo > 0 THEN 0.0 ELSE 30.0 END
                           ELSE (1.0 - least(avg_saldo / p75, 1.0)) * 30 END, 2) AS risk_score
             FROM grp_raw CROSS JOIN (SELECT quantile_cont(saldo_disponible, 0.75) AS p75 FROM lastp)
             WHERE n >= 5""",
    "dt_day": """SELECT v_ah_cliente, d, row_number() OVER (PARTITION BY v_ah_cliente ORDER BY cnt DESC, d) AS rk FROM (
                SELECT v_ah_cliente, dayofmonth(fecha_ultmov) AS d, count(*) AS cnt FROM featured
                WHERE fecha_ultmov IS NOT NULL GROUP BY ALL)""",
    "dt_base": """SELECT f.v_ah_cliente, coalesce(m.d, 15) AS day, sum(v12h) AS s12, sum(v24h) AS s24, sum(v48h) AS s48,
                coalesce(max(desviacion_maxima), 0.0) AS dev
             FROM featured f LEFT JOIN (SELECT * FROM dt_day WHERE rk = 1) m USING (v_ah_cliente)
             GROUP BY f.v_ah_cliente, m.d""",
    "dates": """SELECT v_ah_cliente, CAST(day AS BIGINT) AS dia_movimiento_predominante,
                CASE WHEN s12 > 0 THEN '12h' WHEN s24 > 0 THEN '24h' WHEN s48 > 0 THEN '48h' ELSE 'sin_actividad' END
                  AS ventana_actividad,
                round_even(desf, 4) AS desfase_score,
                greatest(0.0, round_even(1.0 - desf * 0.7 - least(dev / 30, 1.0) * 0.3, 4)) AS alignment_score,
                CAST(CASE WHEN day <= 10 THEN 5 WHEN day <= 20 THEN day + 3 ELSE least(day + 5, 28) END AS BIGINT)
                  AS fecha_sugerida_cobro,
                dev AS desviacion_maxima
             FROM (SELECT *, CASE WHEN day <= 10 THEN 0.2 WHEN day <= 20 THEN 0.5 ELSE 0.8 END AS desf FROM dt_base)""",
    "fam_dep": """SELECT *, round_even(
                  CASE WHEN upper(estado_civil) IN ('C', 'U') THEN 1.0 ELSE 0.0 END
                  + coalesce(CASE WHEN upper(estado_civil) IN ('C', 'U', 'D', 'V') THEN
                        CASE WHEN edad >= 25 AND edad <= 35 THEN 1.5 WHEN edad > 35 AND edad <= 50 THEN 2.0
                             WHEN edad > 50 AND edad <= 65 THEN 1.0 WHEN edad > 65 THEN 0.3 ELSE 0.0 END
                     WHEN upper(estado_civil) = 'S' THEN
                        CASE WHEN edad >= 30 AND edad <= 50 THEN 0.5 ELSE 0.0 END
                     ELSE 0.0 END, 0.0), 1) AS dep
             FROM lastp""",
    "fam": """SELECT v_ah_cliente, v_ah_cuenta, round_even(ing, 2) AS ingresos_original, dep AS estimated_dependents,
                round_even(factor, 4) AS adjustment_factor, round_even(ing * factor, 2) AS ingreso_ajustado,
                round_even(ing * factor - egr, 2) AS flujo_ajustado,
                round_even(least(100.0, dep * 20 + CASE WHEN ing < 500 AND dep > 1 THEN 30.0 ELSE 0.0 END), 2)
                  AS vulnerability_score,
                coalesce(estado_civil, '') AS estado_civil, edad, coalesce(sexo, '') AS sexo
             FROM (SELECT *, coalesce(ingresos, 0.0) AS ing, coalesce(egresos, 0.0) AS egr,
                          greatest(0.6, 1.0 - dep * 0.1) AS factor FROM fam_dep)""",
    "req": """SELECT 'm' || v_ah_cliente AS request_id, v_ah_cliente, edad, ingresos, egresos, saldo_disponible, monto_bloq, credito, dias_sin_movimiento,
                tendencia_saldo, desviacion_maxima, estado_civil, sexo, v_fecha_nac, fecha_proceso,
                CAST(prod_bancario AS INTEGER) AS prod_bancario, CAST(oficina_cta AS INTEGER) AS oficina_cta, tipo_cuenta
             FROM (SELECT *, row_number() OVER (PARTITION BY v_ah_cliente ORDER BY v_ah_cuenta) AS rk FROM lastp)
             WHERE rk = 1
             UNION ALL
             SELECT DISTINCT 'i' || v_ah_cliente, v_ah_cliente, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
                NULL, NULL, NULL, NULL, NULL, NULL FROM lastp
             UNION ALL
             SELECT 'c' || c_custkey, -(c_custkey + 1), CAST(15 + (c_custkey * 13) % 60 AS DOUBLE), round_even(abs(c_acctbal) * 0.1, 2),
                round_even(abs(c_acctbal) * 0.05, 2), NULL, NULL, NULL, CAST((c_custkey * 37) % 150 AS DOUBLE),
                NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
             FROM customer""",
}


def reg(name, sql, **kw):
    return register(name, sql, CTES, **kw)


# --- age validation ------------------------------------------------------------------

@reg("age_validation", "SELECT * FROM age_val")
def q_age_validation(h):
    return validation(h)


@reg("exclude_minors", "SELECT v_ah_cliente, v_ah_cuenta, periodo FROM adults")
def q_exclude_minors(h):
    return adults(h).select("v_ah_cliente", "v_ah_cuenta", "periodo")


@reg("minor_list", "SELECT v_ah_cliente FROM minors")
def q_minor_list(h):
    return A.minor_ids(validation(h))


@reg("blocked_minors_top", """SELECT v_ah_cliente, v_ah_cuenta, edad_real, edad_campo, edad_calculada FROM age_val
    WHERE is_blocked ORDER BY v_ah_cliente, v_ah_cuenta LIMIT 50""")
def q_blocked_minors_top(h):
    return (validation(h).where("is_blocked").orderBy("v_ah_cliente", "v_ah_cuenta").limit(50)
            .select("v_ah_cliente", "v_ah_cuenta", "edad_real", "edad_campo", "edad_calculada"))


@reg("inconsistencies_top", """SELECT v_ah_cliente, v_ah_cuenta, edad_campo, edad_calculada, inconsistency_detail
    FROM age_val WHERE is_inconsistent ORDER BY v_ah_cliente, v_ah_cuenta LIMIT 50""")
def q_inconsistencies_top(h):
    return (validation(h).where("is_inconsistent").orderBy("v_ah_cliente", "v_ah_cuenta").limit(50)
            .select("v_ah_cliente", "v_ah_cuenta", "edad_campo", "edad_calculada", "inconsistency_detail"))


@reg("age_metrics", """SELECT count(*) AS total_socios, count_if(is_blocked) AS menores_bloqueados,
    CASE WHEN count(*) > 0 THEN round_even(count_if(is_blocked) / count(*) * 100, 2) ELSE 0.0 END AS pct_menores,
    count_if(is_inconsistent) AS inconsistencias_detectadas,
    CASE WHEN count(*) > 0 THEN round_even(count_if(is_inconsistent) / count(*) * 100, 2) ELSE 0.0 END
      AS pct_inconsistencias,
    coalesce(round_even(avg(edad_real), 1), 0.0) AS edad_promedio,
    coalesce(round_even(median(edad_real), 1), 0.0) AS edad_mediana FROM age_val""")
def q_age_metrics(h):
    return A.age_metrics(validation(h))


@reg("age_histogram", """SELECT b.bucket_order, b.age_group, count(v.edad_real) AS n_socios
    FROM (VALUES (0, '<18', 0, 18), (1, '18-24', 18, 25), (2, '25-34', 25, 35), (3, '35-44', 35, 45),
                 (4, '45-54', 45, 55), (5, '55-64', 55, 65), (6, '65-74', 65, 75), (7, '75+', 75, 150))
         AS b(bucket_order, age_group, lo, hi)
    LEFT JOIN age_val v ON v.edad_real >= b.lo AND v.edad_real < b.hi
    GROUP BY b.bucket_order, b.age_group""")
def q_age_histogram(h):
    return A.age_histogram(validation(h))


# --- early warning --------------------------------------------------------------------

@reg("early_warning", """SELECT v_ah_cliente, v_ah_cuenta, periodo, alert_score, alert_level, estimated_days_to_default,
    inactivity_component, balance_component, deviation_component FROM ew""")
def q_early_warning(h):
    return early_warning(h).drop("alert_score_raw")


@reg("alert_levels", "SELECT alert_level, count(*) AS n_socios FROM ew GROUP BY alert_level")
def q_alert_levels(h):
    return A.alert_level_counts(early_warning(h))


@reg("alert_metrics", """SELECT count(*) AS total_socios, count_if(alert_level = 'normal') AS n_normal,
    count_if(alert_level = 'alerta_30d') AS n_alerta_30d, count_if(alert_level = 'alerta_60d') AS n_alerta_60d,
    count_if(alert_level = 'alerta_90d') AS n_alerta_90d, avg(alert_score_raw) AS mean_alert_score,
    count_if(alert_score_raw >= 0.75) AS high_risk_count,
    avg(CASE WHEN alert_score_raw >= 0.75 THEN 1.0 ELSE 0.0 END) * 100 AS high_risk_pct,
    median(alert_score_raw) AS median_alert_score FROM ew""")
def q_alert_metrics(h):
    return A.alert_metrics(early_warning(h))


@reg("alert_percentiles", """SELECT quantile_cont(alert_score_raw, 0.25) AS p25, quantile_cont(alert_score_raw, 0.5) AS p50,
    quantile_cont(alert_score_raw, 0.75) AS p75, quantile_cont(alert_score_raw, 0.9) AS p90,
    quantile_cont(alert_score_raw, 0.95) AS p95 FROM ew""")
def q_alert_percentiles(h):
    return A.alert_percentiles(early_warning(h))


@reg("top_alerts", """SELECT v_ah_cliente, periodo, alert_score, alert_level, estimated_days_to_default FROM ew
    ORDER BY alert_score DESC, v_ah_cliente, periodo, v_ah_cuenta LIMIT 20""")
def q_top_alerts(h):
    return A.top_alerts(early_warning(h))


_EW_ADHOC = """0.4 * least(coalesce(dias_sin_movimiento, 0.0) / 120, 1.0)
    + 0.3 * CASE WHEN coalesce(tendencia_saldo, 0.0) >= 0 THEN 0.5 ELSE 0.8 END
    + 0.3 * least(coalesce(desviacion_maxima, 0.0) / 30, 1.0)"""
_LEVEL = """CASE WHEN {s} >= 0.75 THEN 'alerta_90d' WHEN {s} >= 0.5 THEN 'alerta_60d' WHEN {s} >= 0.3 THEN 'alerta_30d'
    ELSE 'normal' END"""


@reg("early_warning_adhoc", f"""SELECT v_ah_cliente, round_even(s, 4) AS alert_score, {_LEVEL.format(s='s')} AS alert_level,
    CAST(trunc((1.0 - s) * 120) AS BIGINT) AS estimated_days_to_default FROM (SELECT *, {_EW_ADHOC} AS s FROM req)""")
def q_early_warning_adhoc(h):
    return A.early_warning_adhoc(h.requests())


@reg("lookup_or_default", f"""SELECT r.v_ah_cliente, e.alert_score IS NOT NULL AS from_history,
    coalesce(e.alert_score, round_even(r.s, 4)) AS alert_score,
    CASE WHEN e.alert_score IS NOT NULL THEN e.alert_level ELSE {_LEVEL.format(s='r.s')} END AS alert_level,
    CASE WHEN e.alert_score IS NOT NULL THEN e.estimated_days_to_default ELSE CAST(trunc((1.0 - r.s) * 120) AS BIGINT) END
      AS estimated_days_to_default
    FROM (SELECT *, {_EW_ADHOC} AS s FROM req) r
    LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY v_ah_cliente
                                    ORDER BY periodo DESC, v_ah_cuenta) AS rk FROM ew) WHERE rk = 1) e
      ON e.v_ah_cliente = r.v_ah_cliente""")
def q_lookup_or_default(h):
    return A.early_warning_lookup(h.requests(), early_warning(h))


# --- roll rate -------------------------------------------------------------------------

@reg("avg_percent_rank", "SELECT v_ah_cliente, v_ah_cuenta, periodo, saldo_norm FROM rr_state")
def q_avg_percent_rank(h):
    return states(h).select("v_ah_cliente", "v_ah_cuenta", "periodo", "saldo_norm")


@reg("risk_state", "SELECT v_ah_cliente, v_ah_cuenta, periodo, composite, estado_riesgo FROM rr_state")
def q_risk_state(h):
    return states(h).select("v_ah_cliente", "v_ah_cuenta", "periodo", "composite", "estado_riesgo")


@reg("period_pairs", """SELECT period_from, period_to, count(*) AS n_joined_rows FROM trans GROUP BY ALL""")
def q_period_pairs(h):
    return transitions(h).groupBy("period_from", "period_to").agg(F.sum("n").alias("n_joined_rows"))


@reg("transition_matrix", "SELECT * FROM matrix")
def q_transition_matrix(h):
    return matrix(h)


@reg("state_distribution", "SELECT * FROM dist")
def q_state_distribution(h):
    return A.state_distribution(states(h))


@reg("state_projection", """SELECT m.state_to AS estado_riesgo,
    CAST(round_even(sum(coalesce(d.n_socios / (SELECT sum(n_socios) FROM dist), 0.0) * m.p)
         * (SELECT sum(n_socios) FROM dist), 0) AS BIGINT) AS n_projected
    FROM last_matrix m LEFT JOIN dist d ON d.estado_riesgo = m.state_from GROUP BY m.state_to""")
def q_state_projection(h):
    return A.state_projection(states(h), matrix(h))


@reg("deterioration", """SELECT period_from, period_to, count_if(b.idx > a.idx) AS n_deteriorated
    FROM trans t JOIN states_dim a ON a.state = t.state_from JOIN states_dim b ON b.state = t.state_to
    GROUP BY period_from, period_to""")
def q_deterioration(h):
    return A.deterioration(transitions(h))


@reg("top_deteriorated", """SELECT * FROM (SELECT t.period_from, t.period_to,
        row_number() OVER (PARTITION BY t.period_from, t.period_to ORDER BY t.v_ah_cliente, a.idx, b.idx) AS rank_in_pair,
        t.v_ah_cliente, t.state_from, t.state_to
    FROM trans t JOIN states_dim a ON a.state = t.state_from JOIN states_dim b ON b.state = t.state_to
    WHERE b.idx > a.idx) WHERE rank_in_pair <= 20""")
def q_top_deteriorated(h):
    return A.top_deteriorated(transitions(h))


_TL_SQL = """SELECT s.v_ah_cliente, s.v_ah_cuenta, s.estado_riesgo AS current_state,
        coalesce(w.pe, 0.0) AS p_excelente, coalesce(w.pb, 0.0) AS p_bueno, coalesce(w.pr, 0.0) AS p_regular,
        coalesce(w.pg, 0.0) AS p_riesgoso, coalesce(w.pc, 0.0) AS p_critico, w.state_from IS NOT NULL AS seen,
        d.idx AS cur_idx
    FROM (SELECT * FROM rr_state WHERE periodo = (SELECT max(periodo) FROM rr_state)) s
    JOIN states_dim d ON d.state = s.estado_riesgo
    LEFT JOIN (SELECT state_from, max(CASE WHEN state_to = 'Excelente' THEN p END) AS pe,
                      max(CASE WHEN state_to = 'Bueno' THEN p END) AS pb,
                      max(CASE WHEN state_to = 'Regular' THEN p END) AS pr,
                      max(CASE WHEN state_to = 'Riesgoso' THEN p END) AS pg,
                      max(CASE WHEN state_to = 'Crítico' THEN p END) AS pc
               FROM last_matrix GROUP BY state_from) w ON w.state_from = s.estado_riesgo"""


@reg("transition_lookup", f"""SELECT v_ah_cliente, v_ah_cuenta, current_state, p_excelente, p_bueno, p_regular,
    p_riesgoso, p_critico FROM ({_TL_SQL})""")
def q_transition_lookup(h):
    cur = A.latest(states(h)).select("v_ah_cliente", "v_ah_cuenta", "estado_riesgo")
    return A.transition_lookup(cur, matrix(h)).select("v_ah_cliente", "v_ah_cuenta", "current_state", "p_excelente",
                                                     "p_bueno", "p_regular", "p_riesgoso", "p_critico")


@reg("deterioration_prob", f"""SELECT v_ah_cliente, v_ah_cuenta, current_state,
    round_even(CASE WHEN cur_idx < 1 THEN p_bueno ELSE 0 END + CASE WHEN cur_idx < 2 THEN p_regular ELSE 0 END
      + CASE WHEN cur_idx < 3 THEN p_riesgoso ELSE 0 END + CASE WHEN cur_idx < 4 THEN p_critico ELSE 0 END
      + 0.0, 4) AS prob_deterioro,
    CASE WHEN NOT seen THEN current_state
         WHEN p_excelente = greatest(p_excelente, p_bueno, p_regular, p_riesgoso, p_critico) THEN 'Excelente'
         WHEN p_bueno = greatest(p_excelente, p_bueno, p_regular, p_riesgoso, p_critico) THEN 'Bueno'
         WHEN p_regular = greatest(p_excelente, p_bueno, p_regular, p_riesgoso, p_critico) THEN 'Regular'
         WHEN p_riesgoso = greatest(p_excelente, p_bueno, p_regular, p_riesgoso, p_critico) THEN 'Riesgoso'
         ELSE 'Crítico' END AS most_likely_next_state
    FROM ({_TL_SQL})""")
def q_deterioration_prob(h):
    cur = A.latest(states(h)).select("v_ah_cliente", "v_ah_cuenta", "estado_riesgo")
    return A.transition_lookup(cur, matrix(h)).select("v_ah_cliente", "v_ah_cuenta", "current_state",
                                                     "prob_deterioro", "most_likely_next_state")


# --- over-indebtedness -------------------------------------------------------------------

@reg("over_indebtedness", """SELECT v_ah_cliente, v_ah_cuenta, overindebtedness_score, is_overindebted, flujo_neto,
    ratio_ingreso_egreso, ratio_bloqueo, tiene_credito FROM od""")
def q_over_indebtedness(h):
    return overdebt(h).drop("score_raw")


@reg("overdebt_metrics", """SELECT count(*) AS total_socios, sum(is_overindebted) AS socios_sobreendeudados,
    avg(score_raw) AS mean_score, count_if(flujo_neto < 0) AS socios_flujo_negativo,
    count_if(score_raw < 30) AS bajo_0_30, count_if(score_raw >= 30 AND score_raw < 60) AS medio_30_60,
    count_if(score_raw >= 60 AND score_raw < 80) AS alto_60_80, count_if(score_raw >= 80) AS critico_80_100,
    median(score_raw) AS median_score,
    CASE WHEN count(*) > 0 THEN round_even(sum(is_overindebted) / count(*) * 100, 2) ELSE 0.0 END AS pct_sobreendeudados
    FROM od""")
def q_overdebt_metrics(h):
    return A.overdebt_metrics(overdebt(h))


@reg("top_overdebt", """SELECT v_ah_cliente, overindebtedness_score, flujo_neto, ratio_ingreso_egreso FROM od
    ORDER BY overindebtedness_score DESC, v_ah_cliente, v_ah_cuenta LIMIT 20""")
def q_top_overdebt(h):
    return A.top_overdebt(overdebt(h))


@reg("over_indebtedness_adhoc", """SELECT v_ah_cliente, round_even(least(score, 100.0), 2) AS overindebtedness_score,
    score >= 60 AS is_overindebted, flow AS flujo_neto, round_even(ratio, 4) AS ratio_ingreso_egreso,
    CASE WHEN score >= 80 THEN 'crítico' WHEN score >= 60 THEN 'alto' WHEN score >= 30 THEN 'medio' ELSE 'bajo' END
      AS risk_level
    FROM (SELECT *, (0.3 * CASE WHEN ratio < 1.0 THEN 1.0 WHEN ratio < 1.2 THEN 0.7 ELSE 0.1 END
                     + 0.25 * least(rb, 1.0)
                     + 0.25 * CASE WHEN flow < 0 THEN 1.0 WHEN flow < 100 THEN 0.5 ELSE 0.1 END
                     + 0.2 * 0.3) * CASE WHEN cred = 1 THEN 1.2 ELSE 1.0 END * 100 AS score
          FROM (SELECT v_ah_cliente, coalesce(ingresos, 0.0) / (coalesce(egresos, 0.0) + 1) AS ratio,
                       coalesce(ingresos, 0.0) - coalesce(egresos, 0.0) AS flow,
                       coalesce(monto_bloq, 0.0) / (coalesce(saldo_disponible, 0.0) + 1) AS rb,
                       coalesce(credito, 0.0) AS cred FROM req))""")
def q_over_indebtedness_adhoc(h):
    return A.over_indebtedness_adhoc(h.requests())


# --- product risk ------------------------------------------------------------------------

@reg("group_risk", "SELECT * FROM grp")
def q_group_risk(h):
    return groups(h)


@reg("hhi", """SELECT dimension, round_even(sum(pow(n_socios / t, 2)) * 10000, 2) AS hhi FROM (
    SELECT *, sum(n_socios) OVER (PARTITION BY dimension) AS t FROM grp WHERE dimension IN ('producto', 'oficina'))
    GROUP BY dimension""")
def q_hhi(h):
    return A.hhi(groups(h))


@reg("group_counts", "SELECT dimension, count(*) AS n_groups FROM grp GROUP BY dimension")
def q_group_counts(h):
    return A.group_counts(groups(h))


@reg("top_segments", """SELECT * FROM grp ORDER BY risk_score DESC,
    CASE dimension WHEN 'producto' THEN 0 WHEN 'oficina' THEN 1 ELSE 2 END,
    TRY_CAST(segment AS DOUBLE) NULLS LAST, segment LIMIT 10""")
def q_top_segments(h):
    return A.top_segments(groups(h))


@reg("group_profile_lookup", """SELECT r.v_ah_cliente, r.prod_bancario, r.oficina_cta, r.tipo_cuenta,
    coalesce(p.risk_score, 0.0) AS product_risk_score, coalesce(p.tasa_riesgo, 0.0) AS product_tasa_riesgo,
    coalesce(o.risk_score, 0.0) AS office_risk_score, coalesce(o.tasa_riesgo, 0.0) AS office_tasa_riesgo,
    coalesce(t.risk_score, 0.0) AS type_risk_score, coalesce(t.tasa_riesgo, 0.0) AS type_tasa_riesgo
    FROM req r
    LEFT JOIN (SELECT * FROM grp WHERE dimension = 'producto') p ON p.segment = CAST(r.prod_bancario AS VARCHAR)
    LEFT JOIN (SELECT * FROM grp WHERE dimension = 'oficina') o ON o.segment = CAST(r.oficina_cta AS VARCHAR)
    LEFT JOIN (SELECT * FROM grp WHERE dimension = 'tipo_cuenta') t ON t.segment = r.tipo_cuenta""")
def q_group_profile_lookup(h):
    return A.group_profile_lookup(h.requests(), groups(h))


@reg("segment_report", """SELECT segment AS prod_bancario, n_socios, tasa_riesgo AS tasa_mora_pct,
    risk_score / 100.0 AS score_riesgo FROM grp WHERE dimension = 'producto'""")
def q_segment_report(h):
    return A.segment_report(groups(h))


@reg("segment_tags", """SELECT segment AS prod_bancario, n_socios, tasa_riesgo AS tasa_mora_pct,
    risk_score / 100.0 AS score_riesgo,
    CASE WHEN risk_score / 100.0 >= 0.8 THEN 'Crítico' WHEN risk_score / 100.0 >= 0.5 THEN 'Alto'
         WHEN risk_score / 100.0 >= 0.2 THEN 'Medio' ELSE 'Bajo' END AS risk_tag
    FROM grp WHERE dimension = 'producto'""")
def q_segment_tags(h):
    return A.segment_tags(A.segment_report(groups(h)))


# --- collection dates ------------------------------------------------------------------------

@reg("collection_date", "SELECT * FROM dates")
def q_collection_date(h):
    return dates(h)


@reg("movement_day_mode", "SELECT v_ah_cliente, dia_movimiento_predominante FROM dates")
def q_movement_day_mode(h):
    return dates(h).select("v_ah_cliente", "dia_movimiento_predominante")


@reg("activity_window", "SELECT v_ah_cliente, ventana_actividad FROM dates")
def q_activity_window(h):
    return dates(h).select("v_ah_cliente", "ventana_actividad")


@reg("collection_day_histogram", """SELECT CAST(fecha_sugerida_cobro AS VARCHAR) AS value, count(*) AS n_socios,
    'day' AS distribution FROM dates GROUP BY fecha_sugerida_cobro
    UNION ALL SELECT ventana_actividad, count(*), 'window' FROM dates GROUP BY ventana_actividad""")
def q_collection_day_histogram(h):
    return A.collection_day_histogram(dates(h))


@reg("alignment_metrics", """SELECT count(*) AS total_socios, round_even(avg(alignment_score), 4) AS avg_alignment_score,
    count_if(alignment_score < 0.5) AS socios_desalineados,
    (SELECT fecha_sugerida_cobro FROM dates GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS dia_cobro_mas_comun,
    quantile_cont(alignment_score, 0.25) AS p25, quantile_cont(alignment_score, 0.5) AS p50,
    quantile_cont(alignment_score, 0.75) AS p75,
    CASE WHEN count(*) > 0 THEN round_even(count_if(alignment_score < 0.5) / count(*) * 100, 2) ELSE 0.0 END
      AS pct_desalineados
    FROM dates""")
def q_alignment_metrics(h):
    return A.alignment_metrics(dates(h))


@reg("bottom_alignment", """SELECT v_ah_cliente, alignment_score, dia_movimiento_predominante, fecha_sugerida_cobro
    FROM dates ORDER BY alignment_score, v_ah_cliente LIMIT 20""")
def q_bottom_alignment(h):
    return A.bottom_alignment(dates(h))


@reg("collection_date_lookup", """SELECT r.v_ah_cliente, d.fecha_sugerida_cobro IS NOT NULL AS from_history,
    coalesce(d.fecha_sugerida_cobro, 15) AS fecha_sugerida_cobro, coalesce(d.alignment_score, 0.5) AS alignment_score,
    d.dia_movimiento_predominante FROM req r LEFT JOIN dates d USING (v_ah_cliente)""")
def q_collection_date_lookup(h):
    return A.collection_date_lookup(h.requests(), dates(h))


# --- family impact ------------------------------------------------------------------------

@reg("dependents", "SELECT v_ah_cliente, v_ah_cuenta, estimated_dependents FROM fam")
def q_dependents(h):
    return family(h).select("v_ah_cliente", "v_ah_cuenta", "estimated_dependents")


@reg("family_impact", "SELECT * FROM fam")
def q_family_impact(h):
    return family(h)


@reg("family_metrics", """SELECT count(*) AS total_socios, round_even(avg(estimated_dependents), 2) AS avg_estimated_dependents,
    round_even(avg(adjustment_factor), 4) AS avg_adjustment_factor,
    round_even(avg(vulnerability_score), 2) AS avg_vulnerability_score,
    count_if(vulnerability_score >= 60) AS high_vulnerability_count,
    CASE WHEN count(*) > 0 THEN round_even(count_if(vulnerability_score >= 60) / count(*) * 100, 2) ELSE 0.0 END
      AS pct_high_vulnerability FROM fam""")
def q_family_metrics(h):
    return A.family_metrics(family(h))


@reg("dependents_histogram", """SELECT count_if(estimated_dependents = 0) AS "0_deps",
    count_if(estimated_dependents > 0 AND estimated_dependents <= 1) AS "1_dep",
    count_if(estimated_dependents > 1 AND estimated_dependents <= 2) AS "2_deps",
    count_if(estimated_dependents > 2) AS "3_plus_deps" FROM fam""")
def q_dependents_histogram(h):
    return A.dependents_histogram(family(h))


@reg("impact_by_civil_status", """SELECT estado_civil, count(*) AS n_socios,
    round_even(avg(estimated_dependents), 2) AS avg_dependents, round_even(avg(adjustment_factor), 4) AS avg_factor,
    round_even(avg(vulnerability_score), 2) AS avg_vulnerability FROM fam GROUP BY estado_civil""")
def q_impact_by_civil_status(h):
    return A.impact_by_civil_status(family(h))


@reg("top_vulnerable", """SELECT v_ah_cliente, vulnerability_score, estimated_dependents, adjustment_factor,
    ingresos_original, ingreso_ajustado FROM fam ORDER BY vulnerability_score DESC, v_ah_cliente, v_ah_cuenta LIMIT 20""")
def q_top_vulnerable(h):
    return A.top_vulnerable(family(h))


@reg("family_impact_adhoc", """SELECT v_ah_cliente, dep AS estimated_dependents, round_even(factor, 4) AS adjustment_factor,
    round_even(ing, 2) AS ingreso_original, round_even(ing * factor, 2) AS ingreso_ajustado,
    round_even(least(100.0, dep * 20), 2) AS vulnerability_score
    FROM (SELECT *, greatest(0.6, 1.0 - dep * 0.1) AS factor FROM (
      SELECT v_ah_cliente, coalesce(ingresos, 0.0) AS ing,
        round_even(CASE WHEN upper(coalesce(estado_civil, 'S')) IN ('C', 'U') THEN 1.0 ELSE 0.0 END
          + CASE WHEN upper(coalesce(estado_civil, 'S')) IN ('C', 'U', 'D', 'V') THEN
                 CASE WHEN coalesce(edad, 0.0) >= 25 AND coalesce(edad, 0.0) <= 35 THEN 1.5
                      WHEN coalesce(edad, 0.0) > 35 AND coalesce(edad, 0.0) <= 50 THEN 2.0
                      WHEN coalesce(edad, 0.0) > 50 AND coalesce(edad, 0.0) <= 65 THEN 1.0
                      WHEN coalesce(edad, 0.0) > 65 THEN 0.3 ELSE 0.0 END
                 WHEN upper(coalesce(estado_civil, 'S')) = 'S' THEN
                 CASE WHEN coalesce(edad, 0.0) >= 30 AND coalesce(edad, 0.0) <= 50 THEN 0.5 ELSE 0.0 END
                 ELSE 0.0 END, 1) AS dep
      FROM req))""")
def q_family_impact_adhoc(h):
    return A.family_impact_adhoc(h.requests())
