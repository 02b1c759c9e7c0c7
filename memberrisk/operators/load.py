"""Load-side operators: parsing, typing, alert preparation and enrichment.

P2 date parse, P3/P4 map literal, P5 numeric coercion, P6 string
normalisation, conform (fixed schema, absent optional columns as typed
nulls), S4/U1 period union, W5 alert dedup, J1 alert enrichment.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memberrisk import schemas as S

RAW_TS_FORMAT = "MMM d yyyy h:mma"


def parse_timestamp(c: str | Column) -> Column:
    """``May 1 2026 12:00AM`` (blanks collapsed) or ISO text -> TIMESTAMP; bad -> null."""
    x = F.col(c) if isinstance(c, str) else c
    text = F.regexp_replace(F.trim(x.cast("string")), r"\s+", " ")
    return F.coalesce(F.try_to_timestamp(text, F.lit(RAW_TS_FORMAT)),
                      F.try_to_timestamp(text)).cast("timestamp")


def parse_dates(df: DataFrame, columns: Iterable[str] = S.DATE_COLUMNS) -> DataFrame:
    """Parse the date columns that are present; absent columns are ignored."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: parse_timestamp(c) for c in present})


def parse_id(c: str) -> Column:
    """P5 for ids: blanks trimmed, ``12`` or ``12.0`` -> 12, else null. Snapshot and
    alert ids go through it, so both sides of J1 read an id alike."""
    text = f"trim(cast(`{c}` as string))"
    return F.expr(f"coalesce(try_cast({text} as bigint), try_cast(try_cast({text} as double) as bigint))")


def rejected_rows(typed: DataFrame) -> DataFrame:
    """Q11: typed snapshot rows without a client id, which no analyzer can use."""
    return typed.where(F.col("v_ah_cliente").isNull())


def coerce_numeric(df: DataFrame) -> DataFrame:
    """P5: numeric text -> DOUBLE (codes -> INT), anything unparsable -> null."""
    conv = {c: F.expr(f"try_cast(trim(cast(`{c}` as string)) as double)")
            for c in S.NUMERIC_COLUMNS if c in df.columns}
    conv.update({c: F.expr(f"try_cast(try_cast(trim(cast(`{c}` as string)) as double) as int)")
                 for c in S.INT_COLUMNS if c in df.columns})
    conv.update({key: parse_id(key) for key in ("v_ah_cliente", "v_ah_cuenta") if key in df.columns})
    return df.withColumns(conv)


def normalize_strings(df: DataFrame) -> DataFrame:
    """Trim + upper of the code columns; null stays null."""
    return df.withColumns({c: F.upper(F.trim(F.col(c))) for c in S.STRING_COLUMNS if c in df.columns})


def conform(df: DataFrame) -> DataFrame:
    """Fixed snapshot schema: every contract column present with its type
    (absent optional columns become typed nulls); extra columns are kept."""
    schema = S.snapshot_schema()
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns
            else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    extra = [F.col(c) for c in df.columns if c not in schema.fieldNames()]
    return df.select(*cols, *extra)


def type_snapshot(raw: DataFrame) -> DataFrame:
    """Raw string layer -> typed, conformed snapshot (P2 + P5 + P6 + conform)."""
    return conform(normalize_strings(coerce_numeric(parse_dates(raw))))


def union_periods(frames: dict[str, DataFrame]) -> DataFrame:
    """Tag each period frame with ``periodo`` and union by name
    (columns absent in one period become null)."""
    out = None
    for period, frame in frames.items():
        tagged = frame.withColumn("periodo", F.lit(period))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError("no snapshot period available")
    return out


# --- alerts -----------------------------------------------------------------

def parse_month_map(c: str | Column) -> Column:
    """Python dict literal ``{3: 31.0, 4: 30.0}`` -> map<string,double>;
    null, empty or malformed text -> empty map."""
    x = F.col(c) if isinstance(c, str) else c
    parsed = F.from_json(x, "map<string,double>", {"allowUnquotedFieldNames": "true"})
    return F.coalesce(parsed, F.create_map().cast("map<string,double>"))


def map_features(df: DataFrame, column: str = "dias_por_mes") -> DataFrame:
    """Months with activity, max and min days per month (0 when empty)."""
    m = parse_month_map(column)
    vals = F.map_values(m)
    return df.withColumns({
        "meses_actividad": F.size(m).cast("long"),
        "max_dias_mes": F.coalesce(F.array_max(vals), F.lit(0.0)),
        "min_dias_mes": F.coalesce(F.array_min(vals), F.lit(0.0)),
    })


def dedup_alerts(alerts: DataFrame) -> DataFrame:
    """One alert row per client, the one with the highest deviation
    (null deviation last; ties -> larger source name).

    An aggregate (``max_by``) instead of a per-client window: partial
    aggregation keeps a hot client to one row per map task."""
    cols = [c for c in alerts.columns if c != "cliente"]
    best = F.max_by(F.struct(*[F.col(c) for c in cols]),
                    F.struct(F.col("desviacion_maxima").isNotNull(), F.col("desviacion_maxima"),
                             F.col("fuente_alerta")))
    return alerts.groupBy("cliente").agg(best.alias("_a")).select("cliente", "_a.*")


def prepare_alerts(alerts_raw: DataFrame) -> DataFrame:
    """S3 output -> map features -> W5."""
    return dedup_alerts(map_features(alerts_raw))


ALERT_COLUMNS = ("desviacion_maxima", "meses_actividad", "max_dias_mes", "min_dias_mes", "fuente_alerta")


def enrich_alerts(snapshot: DataFrame, alerts: DataFrame, snapshot_key: str = "v_ah_cliente",
                  alert_key: str = "cliente") -> DataFrame:
    """Left-enrich with the deduplicated alerts, drop the right key, fill
    (no alert -> 0 / 'sin_alerta'). Alerts hold one row per client; the join
    is planned by AQE (broadcast when the runtime size is small, otherwise a
    shuffle join with skew splitting)."""
    right = alerts.select(F.col(alert_key).alias("_alert_key"), *ALERT_COLUMNS)
    joined = snapshot.join(right, F.col(snapshot_key) == F.col("_alert_key"), "left").drop("_alert_key")
    return joined.withColumns({
        "desviacion_maxima": F.coalesce(F.col("desviacion_maxima"), F.lit(0.0)),
        "meses_actividad": F.coalesce(F.col("meses_actividad"), F.lit(0)).cast("long"),
        "max_dias_mes": F.coalesce(F.col("max_dias_mes"), F.lit(0.0)),
        "min_dias_mes": F.coalesce(F.col("min_dias_mes"), F.lit(0.0)),
        "fuente_alerta": F.coalesce(F.col("fuente_alerta"), F.lit(S.NO_ALERT)),
    })
