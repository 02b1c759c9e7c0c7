"""Registered queries for sources, load, cleaning and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from memberrisk import schemas as S
from memberrisk.functions import exprs as X
from memberrisk.operators import clean as C
from memberrisk.operators import features as FE
from memberrisk.operators import load as L
from memberrisk.plans.registry import register

K = "v_ah_cliente, v_ah_cuenta, periodo"
KEYS = list(S.KEYS)

# --- sources / load ----------------------------------------------------------


@register("union_periods", f"""SELECT periodo, count(*) AS n_rows, count(DISTINCT v_ah_cliente) AS n_clients,
    count(DISTINCT v_ah_cuenta) AS n_accounts FROM typed GROUP BY periodo""")
def union_periods(h):
    return h.typed().groupBy("periodo").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("v_ah_cliente").alias("n_clients"),
        F.countDistinct("v_ah_cuenta").alias("n_accounts"))


@register("source_row_counts", """SELECT 'snapshot' AS source, count(*) AS n_rows FROM snap_raw
    UNION ALL SELECT 'alerts', count(*) FROM alerts_raw
    UNION ALL SELECT 'alerts_dedup', count(*) FROM alerts_d""")
def source_row_counts(h):
    def cnt(df, name):
        return df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("source"), "n_rows")
    return (cnt(h.snapshot_raw(), "snapshot").unionByName(cnt(h.alerts_raw(), "alerts"))
            .unionByName(cnt(h.alerts(), "alerts_dedup")))


@register("parse_dates", f"""SELECT {K}, fecha_proceso, fecha_aper, fecha_ultmov, v_fecha_nac,
    fecha_actualizacion FROM typed""")
def parse_dates(h):
    return h.typed().select(*KEYS, "fecha_proceso", "fecha_aper", "fecha_ultmov", "v_fecha_nac",
                            "fecha_actualizacion")


_NUM_OUT = ", ".join(c for c in S.NUMERIC_COLUMNS)


@register("coerce_numeric", f"SELECT {K}, {_NUM_OUT}, oficina_cta, prod_bancario FROM typed")
def coerce_numeric(h):
    return h.typed().select(*KEYS, *S.NUMERIC_COLUMNS, "oficina_cta", "prod_bancario")


@register("normalize_strings", f"SELECT {K}, estado_cta, tipo_cuenta, sexo, estado_civil, nacionalidad FROM typed")
def normalize_strings(h):
    return h.typed().select(*KEYS, *S.STRING_COLUMNS)


@register("parse_month_map", """SELECT cliente, fuente_alerta, CAST(len(vals) AS BIGINT) AS n_entries,
    coalesce(list_sum(vals), 0.0) AS value_sum FROM alerts_vals""")
def parse_month_map(h):
    m = L.parse_month_map("dias_por_mes")
    return h.alerts_raw().select(
        "cliente", "fuente_alerta", F.size(m).alias("n_entries"),
        F.aggregate(F.map_values(m), F.lit(0.0), lambda acc, v: acc + v).alias("value_sum"))


@register("map_features", """SELECT cliente, fuente_alerta, meses_actividad, max_dias_mes, min_dias_mes
    FROM alerts_feat""")
def map_features(h):
    return L.map_features(h.alerts_raw()).select("cliente", "fuente_alerta", "meses_actividad",
                                                 "max_dias_mes", "min_dias_mes")


@register("dedup_alerts", """SELECT cliente, fuente_alerta, desviacion_maxima, meses_actividad,
    max_dias_mes, min_dias_mes FROM alerts_d""")
def dedup_alerts(h):
    return h.alerts().select("cliente", "fuente_alerta", "desviacion_maxima", "meses_actividad",
                             "max_dias_mes", "min_dias_mes")


@register("enrich_alerts", f"""SELECT {K}, desviacion_maxima, meses_actividad, max_dias_mes, min_dias_mes,
    fuente_alerta FROM enriched""")
def enrich_alerts(h):
    return h.enriched().select(*KEYS, "desviacion_maxima", "meses_actividad", "max_dias_mes",
                               "min_dias_mes", "fuente_alerta")


# --- cleaning ---------------------------------------------------------------


def _stage(h, upto: str):
    """Cleaning chain of the enriched table up to (and including) ``upto``."""
    return h.clean_stage(upto)


@register("impute_income", f"SELECT {K}, ingresos FROM c2")
def impute_income(h):
    return _stage(h, "income").select(*KEYS, "ingresos")


@register("impute_egress", f"SELECT {K}, ingresos, egresos FROM c4")
def impute_egress(h):
    return _stage(h, "egress").select(*KEYS, "ingresos", "egresos")


@register("impute_age", f"SELECT {K}, edad FROM c5")
def impute_age(h):
    return _stage(h, "age").select(*KEYS, "edad")


@register("fill_residual", f"SELECT {K}, {_NUM_OUT}, oficina_cta, prod_bancario FROM c6")
def fill_residual(h):
    return _stage(h, "fill").select(*KEYS, *S.NUMERIC_COLUMNS, "oficina_cta", "prod_bancario")


@register("age_consistency", f"SELECT {K}, edad FROM c7")
def age_consistency(h):
    return _stage(h, "consistency").select(*KEYS, "edad")


@register("minor_flag", f"SELECT {K}, edad, menor_edad FROM c8")
def minor_flag(h):
    return _stage(h, "minor").select(*KEYS, "edad", "menor_edad")


_MONEY = ", ".join(S.FINANCIAL_COLUMNS)


@register("cap_outliers", f"SELECT {K}, {_MONEY} FROM c9")
def cap_outliers(h):
    return _stage(h, "caps").select(*KEYS, *S.FINANCIAL_COLUMNS)


@register("label_encode", f"SELECT {K}, estado_cta, estado_cta_label FROM c10")
def label_encode(h):
    return _stage(h, "encode").select(*KEYS, "estado_cta", "estado_cta_label")


@register("one_hot", f"""SELECT {K}, sexo, estado_civil, sexo_M, sexo_F, ecivil_S, ecivil_C, ecivil_D,
    ecivil_V, ecivil_U FROM c10""")
def one_hot(h):
    return _stage(h, "encode").select(*KEYS, "sexo", "estado_civil", "sexo_M", "sexo_F", "ecivil_S",
                                      "ecivil_C", "ecivil_D", "ecivil_V", "ecivil_U")


@register("code_labels", """SELECT estado_cta, estado_civil,
    CASE estado_cta WHEN 'A' THEN 'Activa' WHEN 'I' THEN 'Inactiva' WHEN 'C' THEN 'Cerrada' END AS estado_cta_desc,
    CASE estado_civil WHEN 'S' THEN 'Soltero/a' WHEN 'C' THEN 'Casado/a' WHEN 'D' THEN 'Divorciado/a'
         WHEN 'V' THEN 'Viudo/a' WHEN 'U' THEN 'Unión libre' END AS estado_civil_desc,
    count(*) AS n_rows
    FROM cleaned GROUP BY ALL""")
def code_labels(h):
    return (C.code_labels(h.cleaned())
            .groupBy("estado_cta", "estado_civil", "estado_cta_desc", "estado_civil_desc")
            .agg(F.count(F.lit(1)).alias("n_rows")))


@register("dedup_snapshot", f"SELECT {K}, fecha_proceso, saldo_disponible FROM cleaned")
def dedup_snapshot(h):
    return h.cleaned().select(*KEYS, "fecha_proceso", "saldo_disponible")


_CLEAN_OUT = ["v_ah_cliente", "v_ah_cuenta", "periodo", "fecha_proceso", "fecha_aper", "fecha_ultmov",
              "v_fecha_nac", "fecha_actualizacion", *S.NUMERIC_COLUMNS, "oficina_cta", "prod_bancario",
              *S.STRING_COLUMNS, "desviacion_maxima", "meses_actividad", "max_dias_mes", "min_dias_mes",
              "fuente_alerta", "estado_cta_label", "sexo_M", "sexo_F", "ecivil_S", "ecivil_C",
              "ecivil_D", "ecivil_V", "ecivil_U"]


@register("clean_pipeline", f"SELECT {', '.join(_CLEAN_OUT)} FROM cleaned")
def clean_pipeline(h):
    return h.cleaned().select(*_CLEAN_OUT)


# --- features -----------------------------------------------------------------


@register("safe_divide", f"""SELECT {K}, ratio_ingreso_egreso, ratio_bloqueo, ratio_certificados_saldo,
    ratio_creditos_debitos FROM featured""")
def safe_divide(h):
    return h.featured().select(*KEYS, "ratio_ingreso_egreso", "ratio_bloqueo", "ratio_certificados_saldo",
                               "ratio_creditos_debitos")


@register("financial_features", f"""SELECT {K}, ratio_ingreso_egreso, flujo_neto, saldo_efectivo,
    ratio_bloqueo, ratio_certificados_saldo FROM featured""")
def financial_features(h):
    return FE.financial_features(h.cleaned()).select(
        *KEYS, "ratio_ingreso_egreso", "flujo_neto", "saldo_efectivo", "ratio_bloqueo", "ratio_certificados_saldo")


@register("temporal_features", f"""SELECT {K}, antiguedad_cuenta_dias, dias_sin_movimiento,
    dias_desde_actualizacion FROM featured""")
def temporal_features(h):
    return FE.temporal_features(h.cleaned()).select(
        *KEYS, "antiguedad_cuenta_dias", "dias_sin_movimiento", "dias_desde_actualizacion")


@register("transaction_features", f"""SELECT {K}, actividad_24h, actividad_12h, volumen_total,
    ratio_creditos_debitos FROM featured""")
def transaction_features(h):
    return FE.transaction_features(h.cleaned()).select(
        *KEYS, "actividad_24h", "actividad_12h", "volumen_total", "ratio_creditos_debitos")


@register("balance_delta", f"SELECT {K}, saldo_disponible, delta_saldo_mensual FROM featured")
def balance_delta(h):
    return FE.trend_features(h.cleaned()).select(*KEYS, "saldo_disponible", "delta_saldo_mensual")


@register("balance_trend", "SELECT DISTINCT v_ah_cliente, tendencia_saldo FROM featured")
def balance_trend(h):
    return FE.trend_table(h.cleaned()).select(S.CLIENT, "tendencia_saldo").distinct()


@register("age_bucket", f"SELECT {K}, edad, grupo_etario, es_menor FROM featured")
def age_bucket(h):
    return h.featured().select(*KEYS, "edad", "grupo_etario", "es_menor")


@register("product_flags", f"""SELECT {K}, tiene_credito_activo, tiene_tarjeta, usa_cooplinea,
    productos_digitales FROM featured""")
def product_flags(h):
    return FE.demographic_features(h.cleaned()).select(
        *KEYS, "tiene_credito_activo", "tiene_tarjeta", "usa_cooplinea", "productos_digitales")


@register("risk_label", f"SELECT {K}, saldo_disponible, dias_sin_movimiento, credito, riesgo_alto FROM featured")
def risk_label(h):
    return h.featured().select(*KEYS, "saldo_disponible", "dias_sin_movimiento", "credito", "riesgo_alto")


FEATURE_OUT = ["ratio_ingreso_egreso", "flujo_neto", "saldo_efectivo", "ratio_bloqueo",
               "ratio_certificados_saldo", "antiguedad_cuenta_dias", "dias_sin_movimiento",
               "dias_desde_actualizacion", "actividad_24h", "actividad_12h", "volumen_total",
               "ratio_creditos_debitos", "delta_saldo_mensual", "tendencia_saldo", "grupo_etario",
               "es_menor", "tiene_credito_activo", "tiene_tarjeta", "usa_cooplinea", "productos_digitales",
               "riesgo_alto"]


@register("feature_pipeline", f"SELECT {K}, {', '.join(FEATURE_OUT)} FROM featured")
def feature_pipeline(h):
    return h.featured().select(*KEYS, *FEATURE_OUT)


CLUSTER_FEATURES = ["saldo_efectivo", "dias_sin_movimiento", "flujo_neto", "antiguedad_cuenta_dias",
                    "productos_digitales", "ratio_ingreso_egreso", "volumen_total", "ratio_bloqueo"]


@register("scrub_features", f"""SELECT {K}, """ + ", ".join(
    f"CASE WHEN isnan({c}) OR isinf({c}) OR {c} IS NULL THEN 0.0 ELSE CAST({c} AS DOUBLE) END AS {c}"
    for c in FEATURE_OUT) + " FROM featured")
def scrub_features(h):
    return FE.scrub_features(h.featured(), FEATURE_OUT).select(*KEYS, *FEATURE_OUT)


@register("cluster_features", """SELECT v_ah_cliente, v_ah_cuenta, """ + ", ".join(
    f"CASE WHEN isnan({c}) OR isinf({c}) OR {c} IS NULL THEN 0.0 ELSE CAST({c} AS DOUBLE) END AS {c}"
    for c in CLUSTER_FEATURES) + " FROM featured WHERE periodo = (SELECT max(periodo) FROM featured)")
def cluster_features(h):
    last = h.last_period()
    return FE.scrub_features(last, CLUSTER_FEATURES).select("v_ah_cliente", "v_ah_cuenta", *CLUSTER_FEATURES)


@register("latest_period", """SELECT v_ah_cliente, v_ah_cuenta, periodo, saldo_disponible FROM featured
    WHERE periodo = (SELECT max(periodo) FROM featured)""")
def latest_period(h):
    return h.last_period().select("v_ah_cliente", "v_ah_cuenta", "periodo", "saldo_disponible")


@register("floor_days", f"""SELECT {K}, CAST(floor((epoch_us(fecha_proceso) - epoch_us(fecha_ultmov)) / 86400000000.0)
    AS BIGINT) AS raw_days FROM cleaned""")
def floor_days(h):
    return h.cleaned().select(*KEYS, X.floor_days("fecha_proceso", "fecha_ultmov").alias("raw_days"))
