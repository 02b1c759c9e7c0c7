"""Feature operators (P18-P27, W1, W2): financial, temporal, transactional,
trend, demographic features and the proxy risk label.

The trend features need each client's rows in (period, account) order. They
use the skew-safe exact row number (no per-client window) with the previous
row's balance for the month-over-month delta, and a grouped ``regr_slope``
(partially aggregated) for the least-squares slope.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memberrisk import schemas as S
from memberrisk.functions import exprs as X
from memberrisk.functions import ranking as R

RISK_BALANCE_PERCENTILE = 25
RISK_IDLE_DAYS = 60
RISK_REQUIRES_CREDIT = True
AGE_BINS = (0, 18, 30, 45, 60, 75, 150)
TREND_DECIMALS = 6


def financial_features(df: DataFrame) -> DataFrame:
    """P19."""
    saldo, bloq = F.col("saldo_disponible"), F.col("monto_bloq")
    return df.withColumns({
        "ratio_ingreso_egreso": X.safe_divide(F.col("ingresos"), F.col("egresos") + 1),
        "flujo_neto": F.col("ingresos") - F.col("egresos"),
        "saldo_efectivo": saldo - bloq,
        "ratio_bloqueo": X.safe_divide(bloq, saldo + 1),
        "ratio_certificados_saldo": X.safe_divide(F.col("certificadosvalor"), saldo + 1),
    })


def temporal_features(df: DataFrame) -> DataFrame:
    """P20: account age, idle days, data staleness (days >= 0, null -> 0)."""
    return df.withColumns({
        "antiguedad_cuenta_dias": X.days_clipped("fecha_proceso", "fecha_aper").cast("double"),
        "dias_sin_movimiento": X.days_clipped("fecha_proceso", "fecha_ultmov").cast("double"),
        "dias_desde_actualizacion": X.days_clipped("fecha_proceso", "fecha_actualizacion").cast("double"),
    })


def transaction_features(df: DataFrame) -> DataFrame:
    """P21."""
    cred = F.coalesce(F.col("val_de_creditos"), F.lit(0.0))
    deb = F.coalesce(F.col("val_de_debitos"), F.lit(0.0))
    return df.withColumns({
        "actividad_24h": X.flag(F.col("v24h") > 0),
        "actividad_12h": X.flag(F.col("v12h") > 0),
        "volumen_total": cred + deb,
        "ratio_creditos_debitos": X.safe_divide(cred, deb + 1),
    })


def trend_table(df: DataFrame) -> DataFrame:
    """W1 + W2 per (client, account, period): balance delta to the client's
    previous row (first row -> 0) and the least-squares slope of the
    client's balances over the row ordinal (n < 2 or constant -> 0). One
    range shuffle numbers the rows and brings the previous balance; the slope
    is pre-aggregated per client."""
    base = df.select(*S.KEYS, "saldo_disponible")
    num = R.row_number(base, ["periodo", "v_ah_cuenta"], by=[S.CLIENT], out="_ord", lag=("saldo_disponible", "_prev"))
    y, x = F.col("saldo_disponible"), (F.col("_ord") - 1).cast("double")
    slope = num.groupBy(S.CLIENT).agg(
        F.count(F.lit(1)).alias("_n"), F.min(y).alias("_lo"), F.max(y).alias("_hi"),
        F.regr_slope(y, x).alias("_slope"))
    flat = (F.col("_n") < 2) | (F.col("_lo") == F.col("_hi"))
    slope = slope.select(S.CLIENT, F.when(flat, F.lit(0.0))
                         .otherwise(F.coalesce(X.rnd(F.col("_slope"), TREND_DECIMALS), F.lit(0.0)))
                         .alias("tendencia_saldo"))
    delta = num.select(*S.KEYS, F.coalesce(y - F.col("_prev"), F.lit(0.0)).alias("delta_saldo_mensual"))
    return X.join_null_safe(delta, slope, [S.CLIENT])


def trend_features(df: DataFrame) -> DataFrame:
    cols = df.columns
    out = X.join_null_safe(df, trend_table(df), S.KEYS)
    return out.select(*cols, "delta_saldo_mensual", "tendencia_saldo")


def age_bucket(c: str = "edad"):
    """[0,18,30,45,60,75,150) -> 0..5, outside or null -> 0."""
    e = F.col(c)
    out = F.lit(0.0)
    for i in range(len(AGE_BINS) - 2, -1, -1):
        out = F.when((e >= AGE_BINS[i]) & (e < AGE_BINS[i + 1]), F.lit(float(i))).otherwise(out)
    return F.when(e.isNull(), F.lit(0.0)).otherwise(out)


def demographic_features(df: DataFrame) -> DataFrame:
    """P22 + P23."""
    return df.withColumns({
        "grupo_etario": age_bucket("edad"),
        "es_menor": X.flag(F.col("edad") < 18),
        "tiene_credito_activo": X.flag(F.col("credito") == 1),
        "tiene_tarjeta": X.flag(F.col("tarjetas") > 0),
        "usa_cooplinea": X.flag(F.col("cooplinea") > 0),
        "productos_digitales": F.coalesce(F.col("cooplinea"), F.lit(0.0)) + F.coalesce(F.col("tarjetas"), F.lit(0.0)),
    })


def risk_label(df: DataFrame) -> DataFrame:
    """Balance below the global p25 AND idle > 60 days AND active credit."""
    q = RISK_BALANCE_PERCENTILE / 100.0
    p25 = R.quantile_values(df, {"saldo_disponible": [q]})[R.quantile_name("saldo_disponible", q)]
    cond = (F.col("saldo_disponible") < F.lit(p25)) & (F.col("dias_sin_movimiento") > RISK_IDLE_DAYS)
    if RISK_REQUIRES_CREDIT:
        cond = cond & (F.col("credito") == 1)
    return df.withColumn("riesgo_alto", X.flag(cond))


def feature_pipeline(df: DataFrame) -> DataFrame:
    """P25: P19, P20, P21, W1+W2, P22, P23, P24."""
    df = financial_features(df)
    df = temporal_features(df)
    df = transaction_features(df)
    df = trend_features(df)
    df = demographic_features(df)
    return risk_label(df)


# --- model-input helpers ------------------------------------------------------

# Fixed values of the source system: substrings of columns that are no features.
FEATURE_DENY_PATTERNS = (
    "v_ah_cliente", "v_ah_cuenta", "v_ah_nombre", "cliente",
    "fecha_", "v_fecha_", "periodo", "tipo_cuenta", "nacionalidad",
    "estado_cta", "sexo", "estado_civil", "fuente_alerta",
    "riesgo_alto",
)


def feature_columns(df: DataFrame) -> list[str]:
    """Numeric columns whose name contains none of the deny-list
    substrings (driver-side schema inspection only)."""
    numeric = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, numeric)
            and not any(p in f.name for p in FEATURE_DENY_PATTERNS)]


#: Inputs of the proxy label (P24); a model that sees them learns the rule itself (Q16).
LABEL_INPUTS = ("saldo_disponible", "dias_sin_movimiento", "credito")


def drop_label_inputs(columns: list[str]) -> list[str]:
    """P26 variant (Q16): the feature columns without the label's own inputs."""
    return [c for c in columns if c not in LABEL_INPUTS]


def scrub_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """+-inf / NaN / null -> 0.0 on the model columns."""
    return df.withColumns({c: X.finite_or_zero(c) for c in columns})
