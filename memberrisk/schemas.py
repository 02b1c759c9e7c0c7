"""Column contracts of the snapshot, alert and output tables.

Input column names are the data contract of the source system and are kept
verbatim (Spanish); everything we add is listed here once.
"""

from __future__ import annotations

from pyspark.sql import types as T

KEYS = ("v_ah_cliente", "v_ah_cuenta", "periodo")
CLIENT = "v_ah_cliente"

# The source system's column names, codes and labels.
DATE_COLUMNS = ("fecha_proceso", "fecha_aper", "fecha_ultmov", "fecha_ult_capi",
                "v_fecha_nac", "fecha_actualizacion")

# numeric coercion list of the cleaner (P5), in its order
NUMERIC_COLUMNS = (
    "saldo_disponible", "monto_bloq", "ult_tasa_int", "tiene_bloqueos",
    "bloqueo_encaje", "v24h", "val_de_creditos", "val_de_debitos",
    "cooplinea", "tarjetas", "credito", "edad", "certificadosvalor",
    "ingresos", "egresos", "menor_edad", "v12h", "v48h", "v72h_difer",
    "int_hoy", "int_acumulado", "saldo_int_decim",
)
INT_COLUMNS = ("oficina_cta", "prod_bancario")
STRING_COLUMNS = ("estado_cta", "tipo_cuenta", "sexo", "estado_civil", "nacionalidad")
TEXT_COLUMNS = ("v_ah_nombre",)

# money columns capped at p99 (A3)
FINANCIAL_COLUMNS = ("saldo_disponible", "monto_bloq", "val_de_creditos", "val_de_debitos",
                     "ingresos", "egresos", "certificadosvalor")

NO_ALERT = "sin_alerta"

# fixed code tables of the source system
ACCOUNT_STATE_CODES = {"A": 0, "I": 1, "C": 2}
ACCOUNT_STATE_LABELS = {"A": "Activa", "I": "Inactiva", "C": "Cerrada"}
CIVIL_STATUS_LABELS = {"S": "Soltero/a", "C": "Casado/a", "D": "Divorciado/a",
                       "V": "Viudo/a", "U": "Unión libre"}
SEX_CODES = ("M", "F")


def snapshot_schema() -> T.StructType:
    """Typed snapshot after conform (one row per member-account-period)."""
    fields = [T.StructField("v_ah_cliente", T.LongType()),
              T.StructField("v_ah_cuenta", T.LongType()),
              T.StructField("periodo", T.StringType()),
              T.StructField("v_ah_nombre", T.StringType())]
    fields += [T.StructField(c, T.TimestampType()) for c in DATE_COLUMNS]
    fields += [T.StructField(c, T.DoubleType()) for c in NUMERIC_COLUMNS]
    fields += [T.StructField(c, T.IntegerType()) for c in INT_COLUMNS]
    fields += [T.StructField(c, T.StringType()) for c in STRING_COLUMNS]
    return T.StructType(fields)


def raw_snapshot_schema() -> T.StructType:
    """CSV edge: every column read as string."""
    return T.StructType([T.StructField(f.name, T.StringType()) for f in snapshot_schema().fields
                         if f.name != "periodo"])


ALERT_RAW_SCHEMA = T.StructType([
    T.StructField("cliente", T.LongType()),
    T.StructField("dias_por_mes", T.StringType()),
    T.StructField("desviacion_maxima", T.DoubleType()),
])

ALERT_TAGGED_SCHEMA = T.StructType([*ALERT_RAW_SCHEMA.fields, T.StructField("fuente_alerta", T.StringType())])

REQUEST_SCHEMA = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("v_ah_cliente", T.LongType()),
    T.StructField("edad", T.DoubleType()),
    T.StructField("ingresos", T.DoubleType()),
    T.StructField("egresos", T.DoubleType()),
    T.StructField("saldo_disponible", T.DoubleType()),
    T.StructField("monto_bloq", T.DoubleType()),
    T.StructField("credito", T.DoubleType()),
    T.StructField("dias_sin_movimiento", T.DoubleType()),
    T.StructField("tendencia_saldo", T.DoubleType()),
    T.StructField("desviacion_maxima", T.DoubleType()),
    T.StructField("estado_civil", T.StringType()),
    T.StructField("sexo", T.StringType()),
    T.StructField("v_fecha_nac", T.TimestampType()),
    T.StructField("fecha_proceso", T.TimestampType()),
    T.StructField("prod_bancario", T.IntegerType()),
    T.StructField("oficina_cta", T.IntegerType()),
    T.StructField("tipo_cuenta", T.StringType()),
])
