"""DuckDB oracle SQL, written independently of the Spark code.

``base_ctes()`` rebuilds the fixture snapshot and alerts from the driver
tables and then the whole load -> clean -> feature chain as CTEs; every
oracle query is ``WITH <base>, <extra> SELECT ...``. DuckDB evaluates only
the CTEs a query references.
"""

from __future__ import annotations

import collections
import re

NUMERIC = ("saldo_disponible", "monto_bloq", "ult_tasa_int", "tiene_bloqueos",
           "bloqueo_encaje", "v24h", "val_de_creditos", "val_de_debitos",
           "cooplinea", "tarjetas", "credito", "edad", "certificadosvalor",
           "ingresos", "egresos", "menor_edad", "v12h", "v48h", "v72h_difer",
           "int_hoy", "int_acumulado", "saldo_int_decim")
MONEY = ("saldo_disponible", "monto_bloq", "val_de_creditos", "val_de_debitos",
         "ingresos", "egresos", "certificadosvalor")
ABSENT_NUMERIC = ("ult_tasa_int", "tiene_bloqueos", "bloqueo_encaje", "v72h_difer",
                  "int_hoy", "int_acumulado", "saldo_int_decim")


def _days(a: str, b: str) -> str:
    return f"floor((epoch_us({a}) - epoch_us({b})) / 86400000000.0)"


def _parse_ts(c: str) -> str:
    t = f"regexp_replace(trim({c}), '\\s+', ' ', 'g')"
    return f"coalesce(try_strptime({t}, '%b %d %Y %I:%M%p'), TRY_CAST({t} AS TIMESTAMP))"


def _raw_ts(c: str) -> str:
    return f"strftime(CAST({c} AS TIMESTAMP), '%b %-d %Y %-I:%M%p')"


FIXTURE = {
    "periods": """SELECT * FROM (VALUES ('2001-05', DATE '2001-05-01'), ('2001-06', DATE '2001-06-01'),
                  ('2001-07', DATE '2001-07-01')) AS t(periodo, d)""",
    "mv": """SELECT o.o_custkey AS k, CAST(l.l_shipdate AS DATE) AS ship,
                CAST(l.l_extendedprice AS DECIMAL(15,2)) AS amt, l.l_returnflag AS rf,
                l.l_linestatus AS ls, o.o_orderpriority AS pri
             FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
             WHERE l.l_shipdate < TIMESTAMP '2001-07-01 00:00:00'""",
    "act": """SELECT p.periodo, m.k, min(m.ship) AS aper, max(m.ship) AS ultmov,
                CAST(sum(CASE WHEN m.ship >= p.d - 90 THEN m.amt END) AS DOUBLE) AS s90,
                CAST(sum(CASE WHEN m.ship >= p.d - 365 AND m.rf <> 'R' THEN m.amt END) AS DOUBLE) AS inc365,
                CAST(sum(CASE WHEN m.ship >= p.d - 365 AND m.rf = 'R' THEN m.amt END) AS DOUBLE) AS egr365,
                max(CASE WHEN m.ship >= p.d - 365 AND m.pri IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS urgent,
                CAST(sum(CASE WHEN m.ship >= p.d - 30 AND m.ls = 'F' THEN m.amt END) AS DOUBLE) AS cred30,
                CAST(sum(CASE WHEN m.ship >= p.d - 30 AND m.ls = 'O' THEN m.amt END) AS DOUBLE) AS deb30,
                count(CASE WHEN m.ship >= p.d - 1 THEN 1 END) AS n1,
                count(CASE WHEN m.ship >= p.d - 3 THEN 1 END) AS n3,
                count(CASE WHEN m.ship >= p.d - 10 THEN 1 END) AS n10
             FROM mv m JOIN periods p ON m.ship < p.d
             GROUP BY p.periodo, m.k""",
    "snap_typed": """SELECT c.c_custkey AS v_ah_cliente, c.c_custkey * 10 + a.a AS v_ah_cuenta, p.periodo,
                c.c_name AS v_ah_nombre,
                p.d - dup.x AS fecha_proceso, x.aper AS fecha_aper, x.ultmov AS fecha_ultmov,
                CASE WHEN c.c_custkey % 31 = 0 THEN NULL
                     ELSE DATE '2001-07-01' - CAST(floor((15 + c.c_custkey % 65) * 365.25) + c.c_custkey % 300 AS INTEGER)
                END AS v_fecha_nac,
                p.d - CAST(c.c_custkey % 400 AS INTEGER) AS fecha_actualizacion,
                (c.c_acctbal + 0.005 * coalesce(x.s90, 0.0)) * (CASE WHEN a.a = 1 THEN 1.0 ELSE 0.4 END)
                  + CASE WHEN dup.x = 1 THEN 100.0 ELSE 0.0 END AS saldo_disponible,
                CASE WHEN c.c_custkey % 5 = 0 THEN 0.3 * abs(c.c_acctbal) ELSE 0.0 END AS monto_bloq,
                0.05 * (CASE WHEN c.c_acctbal > 0 THEN c.c_acctbal ELSE 0.0 END) AS certificadosvalor,
                CASE WHEN c.c_custkey % 11 = 0 THEN NULL ELSE 0.002 * coalesce(x.inc365, 0.0) END AS ingresos,
                CASE WHEN c.c_custkey % 13 = 0 THEN NULL ELSE 0.004 * coalesce(x.egr365, 0.0) END AS egresos,
                coalesce(x.cred30, 0.0) AS val_de_creditos, coalesce(x.deb30, 0.0) AS val_de_debitos,
                CAST(coalesce(x.urgent, 0) AS DOUBLE) AS credito, 0.0 AS menor_edad,
                CASE WHEN c.c_custkey % 3 = 0 THEN 1.0 ELSE 0.0 END AS cooplinea,
                CASE WHEN c.c_custkey % 4 >= 2 THEN CAST(c.c_custkey % 4 AS DOUBLE) ELSE 0.0 END AS tarjetas,
                CAST(coalesce(x.n1, 0) AS DOUBLE) AS v12h, CAST(coalesce(x.n3, 0) AS DOUBLE) AS v24h,
                CAST(coalesce(x.n10, 0) AS DOUBLE) AS v48h,
                CASE WHEN c.c_custkey % 17 = 0 THEN NULL
                     WHEN c.c_custkey % 29 = 0 THEN CAST(25 + c.c_custkey % 65 AS DOUBLE)
                     ELSE CAST(15 + c.c_custkey % 65 AS DOUBLE) END AS edad,
                CASE WHEN c.c_custkey IN (1, 2, 3) THEN 99 ELSE c.c_nationkey END AS oficina_cta,
                CASE WHEN c.c_custkey % 41 = 0 THEN NULL
                     ELSE CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2
                          WHEN 'FURNITURE' THEN 3 WHEN 'HOUSEHOLD' THEN 4 WHEN 'MACHINERY' THEN 5 END
                END AS prod_bancario,
                CASE c.c_custkey % 10 WHEN 0 THEN 'I' WHEN 1 THEN 'c' WHEN 9 THEN 'X' ELSE 'A' END AS estado_cta,
                c.c_mktsegment AS tipo_cuenta,
                CASE WHEN c.c_custkey % 37 = 0 THEN NULL WHEN c.c_custkey % 4 = 0 THEN 'f'
                     WHEN c.c_custkey % 2 = 0 THEN 'F' ELSE ' M' END AS sexo,
                CASE c.c_custkey % 6 WHEN 0 THEN 'S' WHEN 1 THEN 'C' WHEN 2 THEN 'D' WHEN 3 THEN 'V'
                     WHEN 4 THEN 'u' END AS estado_civil,
                n.n_name AS nacionalidad
             FROM customer c
             LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
             CROSS JOIN periods p
             JOIN (SELECT 1 AS a UNION ALL SELECT 2) a ON a.a = 1 OR c.c_custkey % 7 = 0
             JOIN (SELECT 0 AS x UNION ALL SELECT 1) dup
               ON dup.x = 0 OR (c.c_custkey % 19 = 0 AND p.periodo = '2001-07')
             LEFT JOIN act x ON x.k = c.c_custkey AND x.periodo = p.periodo""",
    "snap_raw": """SELECT CAST(v_ah_cliente AS VARCHAR) AS v_ah_cliente, CAST(v_ah_cuenta AS VARCHAR) AS v_ah_cuenta,
                periodo, v_ah_nombre,
                """ + ", ".join(f"{_raw_ts(c)} AS {c}" for c in
                                ("fecha_proceso", "fecha_aper", "fecha_ultmov", "v_fecha_nac", "fecha_actualizacion")) + """,
                CASE WHEN v_ah_cliente % 23 = 0 THEN 'n/a' ELSE CAST(saldo_disponible AS VARCHAR) END AS saldo_disponible,
                """ + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in
                                ("monto_bloq", "certificadosvalor", "ingresos", "egresos", "val_de_creditos",
                                 "val_de_debitos", "credito", "menor_edad", "cooplinea", "tarjetas", "v12h",
                                 "v24h", "v48h", "edad", "oficina_cta", "prod_bancario")) + """,
                estado_cta, tipo_cuenta, sexo, estado_civil, nacionalidad
             FROM snap_typed""",
    "ord_n": """SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS od,
                row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n
             FROM orders""",
    "alert_dev": """SELECT a.k, max(abs(date_diff('day', b.od, a.od) - 240) / 10.0) AS g
             FROM ord_n a JOIN ord_n b ON a.k = b.k AND b.n = a.n - 1 GROUP BY a.k""",
    "alerts_raw": """SELECT k AS cliente,
                CASE WHEN k % 47 = 0 THEN 'not a dict' WHEN k % 53 = 0 THEN NULL
                     ELSE '{5: ' || CAST(k % 31 AS VARCHAR) || '.0, 6: ' || CAST((k * 7) % 30 AS VARCHAR) || '.0}'
                END AS dias_por_mes, g AS desviacion_maxima, 'desviados' AS fuente_alerta
             FROM alert_dev WHERE k % 3 <> 0
             UNION ALL
             SELECT k,
                CASE WHEN k % 47 = 0 THEN 'not a dict' WHEN k % 53 = 0 THEN NULL
                     ELSE '{5: ' || CAST(k % 31 AS VARCHAR) || '.0, 6: ' || CAST((k * 7) % 30 AS VARCHAR) || '.0}'
                END, g + 1.5, 'desviados_3_mas'
             FROM alert_dev WHERE k % 6 = 1""",
}

LOAD = {
    "alerts_vals": """SELECT *,
                CASE WHEN regexp_full_match(coalesce(dias_por_mes, ''),
                        '\\{\\s*(\\d+\\s*:\\s*-?[0-9.]+\\s*(,\\s*\\d+\\s*:\\s*-?[0-9.]+\\s*)*)?\\}')
                     THEN list_transform(regexp_extract_all(dias_por_mes, ':\\s*(-?[0-9.]+)', 1), lambda v: CAST(v AS DOUBLE))
                     ELSE []::DOUBLE[] END AS vals
             FROM alerts_raw""",
    "alerts_feat": """SELECT cliente, dias_por_mes, desviacion_maxima, fuente_alerta,
                CAST(len(vals) AS BIGINT) AS meses_actividad,
                coalesce(list_max(vals), 0.0) AS max_dias_mes, coalesce(list_min(vals), 0.0) AS min_dias_mes
             FROM alerts_vals""",
    "alerts_d": """SELECT * EXCLUDE (rk) FROM (
                SELECT *, row_number() OVER (PARTITION BY cliente
                    ORDER BY desviacion_maxima DESC NULLS LAST, fuente_alerta DESC) AS rk
                FROM alerts_feat) WHERE rk = 1""",
    "typed": """SELECT TRY_CAST(TRY_CAST(trim(v_ah_cliente) AS DOUBLE) AS BIGINT) AS v_ah_cliente,
                TRY_CAST(TRY_CAST(trim(v_ah_cuenta) AS DOUBLE) AS BIGINT) AS v_ah_cuenta,
                periodo, v_ah_nombre,
                """ + ", ".join(f"{_parse_ts(c)} AS {c}" for c in
                                ("fecha_proceso", "fecha_aper", "fecha_ultmov")) + """,
                CAST(NULL AS TIMESTAMP) AS fecha_ult_capi,
                """ + ", ".join(f"{_parse_ts(c)} AS {c}" for c in ("v_fecha_nac", "fecha_actualizacion")) + """,
                """ + ", ".join((f"CAST(NULL AS DOUBLE) AS {c}" if c in ABSENT_NUMERIC
                                 else f"TRY_CAST(trim({c}) AS DOUBLE) AS {c}") for c in NUMERIC) + """,
                TRY_CAST(TRY_CAST(trim(oficina_cta) AS DOUBLE) AS INTEGER) AS oficina_cta,
                TRY_CAST(TRY_CAST(trim(prod_bancario) AS DOUBLE) AS INTEGER) AS prod_bancario,
                upper(trim(estado_cta)) AS estado_cta, upper(trim(tipo_cuenta)) AS tipo_cuenta,
                upper(trim(sexo)) AS sexo, upper(trim(estado_civil)) AS estado_civil,
                upper(trim(nacionalidad)) AS nacionalidad
             FROM snap_raw""",
    "enriched": """SELECT t.*, coalesce(a.desviacion_maxima, 0.0) AS desviacion_maxima,
                coalesce(a.meses_actividad, 0) AS meses_actividad,
                coalesce(a.max_dias_mes, 0.0) AS max_dias_mes, coalesce(a.min_dias_mes, 0.0) AS min_dias_mes,
                coalesce(a.fuente_alerta, 'sin_alerta') AS fuente_alerta
             FROM typed t LEFT JOIN alerts_d a ON t.v_ah_cliente = a.cliente""",
}

_REAL_AGE = f"round_even({_days('fecha_proceso', 'v_fecha_nac')} / 365.25, 0)"

CLEAN = {
    "inc_seg": """SELECT oficina_cta, prod_bancario, median(ingresos) AS m FROM enriched
             WHERE oficina_cta IS NOT NULL AND prod_bancario IS NOT NULL GROUP BY oficina_cta, prod_bancario""",
    "c1": """SELECT e.* REPLACE (coalesce(e.ingresos, s.m) AS ingresos) FROM enriched e
             LEFT JOIN inc_seg s ON e.oficina_cta = s.oficina_cta AND e.prod_bancario = s.prod_bancario""",
    "c2": """SELECT * REPLACE (coalesce(ingresos, (SELECT median(ingresos) FROM c1), 0.0) AS ingresos) FROM c1""",
    "c3": """SELECT * REPLACE (CASE WHEN egresos IS NULL AND ingresos > 0 THEN 0.0 ELSE egresos END AS egresos) FROM c2""",
    "egr_seg": """SELECT oficina_cta, median(egresos) AS m FROM c3 WHERE oficina_cta IS NOT NULL GROUP BY oficina_cta""",
    "c4": """SELECT c.* REPLACE (coalesce(c.egresos, s.m, 0.0) AS egresos) FROM c3 c
             LEFT JOIN egr_seg s ON c.oficina_cta = s.oficina_cta""",
    "c5": f"""SELECT * REPLACE (coalesce(edad, {_REAL_AGE}) AS edad) FROM c4""",
    "c6": """SELECT * REPLACE (""" + ", ".join(
        [f"coalesce({c}, 0.0) AS {c}" for c in NUMERIC]
        + ["coalesce(oficina_cta, 0) AS oficina_cta", "coalesce(prod_bancario, 0) AS prod_bancario"]) + """) FROM c5""",
    "c7": f"""SELECT * REPLACE (CASE WHEN abs(coalesce(edad, 0.0) - {_REAL_AGE}) > 2 THEN {_REAL_AGE}
                                   ELSE edad END AS edad) FROM c6""",
    "c8": """SELECT * REPLACE (CASE WHEN edad < 18 THEN 1 ELSE 0 END AS menor_edad) FROM c7""",
    "caps": "SELECT " + ", ".join(f"quantile_cont({c}, 0.99) AS cap_{c}" for c in MONEY) + " FROM c8",
    "c9": """SELECT c8.* REPLACE (""" + ", ".join(
        f"CASE WHEN {c} > cap_{c} THEN cap_{c} ELSE {c} END AS {c}" for c in MONEY) + """) FROM c8 CROSS JOIN caps""",
    "c10": """SELECT *, CASE estado_cta WHEN 'A' THEN 0 WHEN 'I' THEN 1 WHEN 'C' THEN 2 ELSE -1 END AS estado_cta_label,
                CASE WHEN sexo = 'M' THEN 1 ELSE 0 END AS sexo_M, CASE WHEN sexo = 'F' THEN 1 ELSE 0 END AS sexo_F,
                CASE WHEN estado_civil = 'S' THEN 1 ELSE 0 END AS ecivil_S,
                CASE WHEN estado_civil = 'C' THEN 1 ELSE 0 END AS ecivil_C,
                CASE WHEN estado_civil = 'D' THEN 1 ELSE 0 END AS ecivil_D,
                CASE WHEN estado_civil = 'V' THEN 1 ELSE 0 END AS ecivil_V,
                CASE WHEN estado_civil = 'U' THEN 1 ELSE 0 END AS ecivil_U
             FROM c9""",
    "cleaned": """SELECT * EXCLUDE (rk) FROM (
                SELECT *, row_number() OVER (PARTITION BY v_ah_cliente, v_ah_cuenta, periodo
                    ORDER BY fecha_proceso DESC NULLS LAST, """ + ", ".join(f"{c} DESC" for c in MONEY) + """) AS rk
                FROM c10) WHERE rk = 1""",
}


def _safe_div(num: str, den: str) -> str:
    return f"({num}) / coalesce(CASE WHEN ({den}) <> 0 THEN ({den}) END, 1.0)"


def _clip_days(a: str, b: str) -> str:
    d = _days(a, b)
    return f"CAST(CASE WHEN {d} IS NULL OR {d} < 0 THEN 0 ELSE {d} END AS DOUBLE)"


FEATURES = {
    "f1": f"""SELECT *, {_safe_div('ingresos', 'egresos + 1')} AS ratio_ingreso_egreso,
                ingresos - egresos AS flujo_neto, saldo_disponible - monto_bloq AS saldo_efectivo,
                {_safe_div('monto_bloq', 'saldo_disponible + 1')} AS ratio_bloqueo,
                {_safe_div('certificadosvalor', 'saldo_disponible + 1')} AS ratio_certificados_saldo,
                {_clip_days('fecha_proceso', 'fecha_aper')} AS antiguedad_cuenta_dias,
                {_clip_days('fecha_proceso', 'fecha_ultmov')} AS dias_sin_movimiento,
                {_clip_days('fecha_proceso', 'fecha_actualizacion')} AS dias_desde_actualizacion,
                CASE WHEN v24h > 0 THEN 1 ELSE 0 END AS actividad_24h,
                CASE WHEN v12h > 0 THEN 1 ELSE 0 END AS actividad_12h,
                val_de_creditos + val_de_debitos AS volumen_total,
                {_safe_div('val_de_creditos', 'val_de_debitos + 1')} AS ratio_creditos_debitos
             FROM cleaned""",
    "f_ord": """SELECT *, row_number() OVER (PARTITION BY v_ah_cliente ORDER BY periodo, v_ah_cuenta) - 1 AS ox
             FROM f1""",
    "f_trend": """SELECT *,
                coalesce(saldo_disponible - lag(saldo_disponible) OVER w, 0.0) AS delta_saldo_mensual,
                CASE WHEN count(*) OVER c < 2 OR min(saldo_disponible) OVER c = max(saldo_disponible) OVER c THEN 0.0
                     ELSE coalesce(round_even(regr_slope(saldo_disponible, CAST(ox AS DOUBLE)) OVER c, 6), 0.0)
                END AS tendencia_saldo
             FROM f_ord
             WINDOW w AS (PARTITION BY v_ah_cliente ORDER BY ox), c AS (PARTITION BY v_ah_cliente)""",
    "f_demo": """SELECT * EXCLUDE (ox),
                CASE WHEN edad IS NULL THEN 0.0 WHEN edad >= 0 AND edad < 18 THEN 0.0
                     WHEN edad >= 18 AND edad < 30 THEN 1.0 WHEN edad >= 30 AND edad < 45 THEN 2.0
                     WHEN edad >= 45 AND edad < 60 THEN 3.0 WHEN edad >= 60 AND edad < 75 THEN 4.0
                     WHEN edad >= 75 AND edad < 150 THEN 5.0 ELSE 0.0 END AS grupo_etario,
                CASE WHEN edad < 18 THEN 1 ELSE 0 END AS es_menor,
                CASE WHEN credito = 1 THEN 1 ELSE 0 END AS tiene_credito_activo,
                CASE WHEN tarjetas > 0 THEN 1 ELSE 0 END AS tiene_tarjeta,
                CASE WHEN cooplinea > 0 THEN 1 ELSE 0 END AS usa_cooplinea,
                coalesce(cooplinea, 0.0) + coalesce(tarjetas, 0.0) AS productos_digitales
             FROM f_trend""",
    "featured": """SELECT *, CASE WHEN saldo_disponible < (SELECT quantile_cont(saldo_disponible, 0.25) FROM f_demo)
                    AND dias_sin_movimiento > 60 AND credito = 1 THEN 1 ELSE 0 END AS riesgo_alto
             FROM f_demo""",
}


def base_ctes() -> dict[str, str]:
    out: dict[str, str] = {}
    for part in (FIXTURE, LOAD, CLEAN, FEATURES):
        out.update(part)
    return out


def _names(sql: str, known: dict[str, str]) -> list[str]:
    """CTEs that ``sql`` names, as often as it names them."""
    return [w for w in re.findall(r"[A-Za-z_]\w*", sql) if w in known]


def with_base(extra: dict[str, str] | None, final: str) -> str:
    """``final`` behind the CTEs that it needs, in their order. One that is named more than
    once is materialised: inlined, the decision's would be planned anew for each use."""
    ctes = base_ctes()
    ctes.update(extra or {})
    used, todo = collections.Counter(), [final]
    while todo:
        for name in _names(todo.pop(), ctes):
            used[name] += 1
            if used[name] == 1:
                todo.append(ctes[name])
    body = ",\n".join(f"{name} AS {'MATERIALIZED ' if used[name] > 1 else ''}(\n{sql}\n)" for name, sql in ctes.items() if used[name])
    return f"WITH {body}\n{final}" if body else final
