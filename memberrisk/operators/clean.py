"""Cleaning operators (P8-P17, A1-A3, W4), in the order of the source cleaner.

Segment and global medians and the p99 caps come from the skew-safe exact
quantile operator (`functions.ranking`), each as one small table that is
joined back (AQE broadcasts it when small; a 1-row global table is
broadcast explicitly).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memberrisk import schemas as S
from memberrisk.functions import exprs as X
from memberrisk.functions import ranking as R


def _keep_order(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns)


def impute_income(df: DataFrame) -> DataFrame:
    """A1: null income <- median of its (office, product) segment, then the
    global median of the filled column, then 0. Null segment keys get no
    segment median (pandas drops null group keys)."""
    cols = df.columns
    seg_keys = ["oficina_cta", "prod_bancario"]
    valid = df.where(F.col("oficina_cta").isNotNull() & F.col("prod_bancario").isNotNull())
    seg = R.materialize_small(R.quantile_row(valid, {"ingresos": [0.5]}, by=seg_keys)
                              .withColumnRenamed("ingresos_q50", "_seg_med"))
    step = df.join(seg, seg_keys, "left").withColumn(
        "ingresos", F.coalesce(F.col("ingresos"), F.col("_seg_med"))).drop("_seg_med")
    glob = R.quantile_values(step, {"ingresos": [0.5]})["ingresos_q50"]
    out = step.withColumn("ingresos", F.coalesce(F.col("ingresos"), F.lit(glob).cast("double"), F.lit(0.0)))
    return _keep_order(out, cols)


def zero_egress_rule(df: DataFrame) -> DataFrame:
    """Null egress with positive income -> 0."""
    return df.withColumn("egresos", F.when(F.col("egresos").isNull() & (F.col("ingresos") > 0), F.lit(0.0))
                         .otherwise(F.col("egresos")))


def impute_egress(df: DataFrame) -> DataFrame:
    """P9 then A2: remaining null egress <- office median, then 0."""
    cols = df.columns
    step = zero_egress_rule(df)
    seg = R.materialize_small(
        R.quantile_row(step.where(F.col("oficina_cta").isNotNull()), {"egresos": [0.5]}, by=["oficina_cta"])
        .withColumnRenamed("egresos_q50", "_seg_med"))
    out = step.join(seg, ["oficina_cta"], "left").withColumn(
        "egresos", F.coalesce(F.col("egresos"), F.col("_seg_med"), F.lit(0.0)))
    return _keep_order(out, cols)


def derived_age(decimals: int = 0):
    """Age from birth and process date: round-half-even(days / 365.25)."""
    return X.rnd(X.floor_days("fecha_proceso", "v_fecha_nac") / F.lit(365.25), decimals)


def impute_age(df: DataFrame) -> DataFrame:
    """P10: null age <- derived age (0 decimals)."""
    return df.withColumn("edad", F.coalesce(F.col("edad"), derived_age(0)))


def numeric_fill_columns(df: DataFrame) -> list[str]:
    numeric = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType, T.DecimalType)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, numeric) and f.name not in ("v_ah_cliente", "v_ah_cuenta")]


def fill_residual(df: DataFrame) -> DataFrame:
    """Every remaining numeric null -> 0 (keys excluded, Q11)."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType))
                           for c in numeric_fill_columns(df)})


def age_consistency(df: DataFrame) -> DataFrame:
    """Replace age by the derived age when they differ by more than 2
    years (a null age counts as 0, Q13)."""
    real = derived_age(0)
    bad = F.coalesce(F.abs(F.coalesce(F.col("edad"), F.lit(0.0)) - real) > 2, F.lit(False))
    return df.withColumn("edad", F.when(bad, real).otherwise(F.col("edad")))


def minor_flag(df: DataFrame) -> DataFrame:
    """Minor flag recomputed from age (< 18), null -> 0."""
    return df.withColumn("menor_edad", X.flag(F.col("edad") < 18))


def cap_outliers(df: DataFrame, percentile: float = 99, columns=S.FINANCIAL_COLUMNS) -> DataFrame:
    """A3: cap each money column at its p99 (all periods together, Q10).
    All caps come from one quantile pass and enter the plan as literals."""
    q = percentile / 100.0
    present = [c for c in columns if c in df.columns]
    caps = R.quantile_values(df, {c: [q] for c in present})
    out = {}
    for c in present:
        cap = caps.get(R.quantile_name(c, q))
        if cap is not None:
            out[c] = F.when(F.col(c) > F.lit(cap), F.lit(cap)).otherwise(F.col(c))
    return df.withColumns(out)


def encode_categoricals(df: DataFrame) -> DataFrame:
    """Account state label (A/I/C -> 0/1/2, else -1), one-hot sex
    (M, F) and civil status (S, C, D, V, U)."""
    state = F.lit(-1)
    for code, value in reversed(list(S.ACCOUNT_STATE_CODES.items())):
        state = F.when(F.col("estado_cta") == code, F.lit(value)).otherwise(state)
    new = {"estado_cta_label": state.cast("int")}
    new.update({f"sexo_{v}": X.flag(F.col("sexo") == v) for v in S.SEX_CODES})
    new.update({f"ecivil_{v}": X.flag(F.col("estado_civil") == v) for v in S.CIVIL_STATUS_LABELS})
    return df.withColumns(new)


def code_labels(df: DataFrame) -> DataFrame:
    """Code -> label dimension columns (account state, civil status)."""
    state = F.create_map(*[F.lit(x) for kv in S.ACCOUNT_STATE_LABELS.items() for x in kv])
    civil = F.create_map(*[F.lit(x) for kv in S.CIVIL_STATUS_LABELS.items() for x in kv])
    return df.withColumns({"estado_cta_desc": F.element_at(state, F.col("estado_cta")),
                           "estado_civil_desc": F.element_at(civil, F.col("estado_civil"))})


def dedup_snapshot(df: DataFrame) -> DataFrame:
    """One row per (client, account, period); latest process date wins
    (null dates last, then larger money values). An aggregate with
    ``max_by`` (partial aggregation) rather than a per-key window.

    Only rows whose key repeats go through the aggregate: the repeated keys are found on
    the keys alone, and where they are few the other rows are not shuffled."""
    cols = [c for c in df.columns if c not in S.KEYS]
    order = F.struct(F.col("fecha_proceso").isNotNull(), F.col("fecha_proceso"),
                     *[F.col(c) for c in S.FINANCIAL_COLUMNS if c in df.columns])
    counts = df.groupBy(*S.KEYS).agg(F.count(F.lit(1)).alias("_n"))
    repeated = R.materialize_small(counts.where(F.col("_n") > 1).select(*S.KEYS))
    best = F.max_by(F.struct(*[F.col(c) for c in cols]), order)
    rows = X.join_null_safe(df, repeated, S.KEYS, "left_semi")
    merged = rows.groupBy(*S.KEYS).agg(best.alias("_row")).select(*S.KEYS, "_row.*")
    once = X.join_null_safe(df, repeated, S.KEYS, "left_anti")
    return once.unionByName(merged.select(*df.columns))


CLEAN_STEPS = (("income", impute_income), ("egress", impute_egress), ("age", impute_age),
               ("fill", fill_residual), ("consistency", age_consistency), ("minor", minor_flag),
               ("caps", cap_outliers), ("encode", encode_categoricals), ("dedup", dedup_snapshot))


def clean(df: DataFrame) -> DataFrame:
    """P5,P6 (already typed) -> A1,P9,A2,P10,P8 -> P11,P12 -> A3 ->
    P13-P15 -> W4."""
    for _, step in CLEAN_STEPS:
        df = step(df)
    return df
