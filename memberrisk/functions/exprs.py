"""Column-expression helpers shared by every operator (all JVM built-ins)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_ts(c: str | Column) -> Column:
    """Timestamp (NTZ or LTZ) -> TIMESTAMP in the session zone (UTC)."""
    return col(c).cast("timestamp")


def floor_days(later: str | Column, earlier: str | Column) -> Column:
    """Whole days between two timestamps, floored (a timedelta's ``days``)."""
    diff = F.unix_micros(to_ts(later)) - F.unix_micros(to_ts(earlier))
    return F.floor(diff / F.lit(MICROS_PER_DAY)).cast("long")


def days_clipped(later: str | Column, earlier: str | Column) -> Column:
    """floor_days clipped at 0, null -> 0 (idle days, account age, staleness)."""
    return F.coalesce(F.greatest(floor_days(later, earlier), F.lit(0)), F.lit(0)).cast("long")


def safe_divide(num: str | Column, den: str | Column) -> Column:
    """num / den where a zero or null denominator is replaced by 1."""
    d = col(den)
    return col(num) / F.coalesce(F.when(d != 0, d), F.lit(1.0))


def flag(cond: Column) -> Column:
    """Boolean -> 0/1 int, null -> 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def rnd(c: str | Column, scale: int = 4) -> Column:
    """Half-even rounding of the binary value: ``rint(x * 10^s) / 10^s``
    (NumPy ``round``; DuckDB ``round_even``). ``bround`` would round the
    decimal string instead and differ on values such as 1.015."""
    x = col(c).cast("double")
    if scale == 0:
        return F.rint(x)
    factor = float(10 ** scale)
    return F.rint(x * F.lit(factor)) / F.lit(factor)


def clip(c: str | Column, lo: str | Column | float | None = None,
         hi: str | Column | float | None = None) -> Column:
    """pandas ``clip``: null stays null (least/greatest would skip it)."""
    x = col(c)
    out = x
    if hi is not None:
        h = hi if isinstance(hi, Column) else F.lit(hi)
        out = F.when(out > h, h).otherwise(out)
    if lo is not None:
        lo_c = lo if isinstance(lo, Column) else F.lit(lo)
        out = F.when(out < lo_c, lo_c).otherwise(out)
    return F.when(x.isNull(), F.lit(None)).otherwise(out)


def finite_or_zero(c: str | Column) -> Column:
    """+-inf / NaN / null -> 0.0 (model input scrub)."""
    x = col(c).cast("double")
    bad = x.isNull() | F.isnan(x) | x.isin(float("inf"), float("-inf"))
    return F.when(bad, F.lit(0.0)).otherwise(x)


def nan_to_null(c: str | Column) -> Column:
    x = col(c)
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)


def join_null_safe(left: DataFrame, right: DataFrame, keys, how: str = "left") -> DataFrame:
    """Join on equal keys where null equals null; the right keys are dropped."""
    named = right.withColumnsRenamed({k: f"_jn_{k}" for k in keys})
    cond = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_jn_{k}"))
        cond = one if cond is None else cond & one
    return left.join(named, cond, how).drop(*[f"_jn_{k}" for k in keys])


def one_row(df: DataFrame) -> Column:
    """A one-row DataFrame as a scalar-subquery struct column: attach global
    statistics to every row without a join (``row["field"]``)."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns])).scalar()
