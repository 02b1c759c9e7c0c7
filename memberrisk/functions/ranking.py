"""Skew-safe exact order statistics: ordinals, ranks and quantiles.

A ``Window.partitionBy(key).orderBy(...)`` sends every row of one key to one
task, and a window without ``partitionBy`` sends the whole table to one task.
Exact percentiles through ``percentile``/``median`` keep one value->count map
per group inside a single task as well. With one key holding a third of the
rows, each of these is a single-task straggler.

*Quantiles* narrow down a radix tree over the ordered bits of the values: the first
level is counted with partial aggregation, and only bins that hold a wanted rank are
looked into, by ranking their values where they are few and by counting them at the
next level where they are many. So values that lie close together, or many rows with
one value, put no more into a task than other data. They interpolate linearly between
``floor(q*(n-1))`` and ``ceil(q*(n-1))``, as pandas' ``quantile`` and DuckDB's
``quantile_cont``.

*Percent ranks* count each value once, add the counts up over range slices, and join the
ranks back; the few common values are joined by broadcast.

*Ordinals* and running totals (``running``, ``row_number``) range-partition the
rows, write them with their slice's number, and run a window inside each slice.
A row a slice says how far a group that runs over slices has come; that is added
back. All of it is JVM expressions; nothing is cached, and the slices are data
once written, so a lost executor or a second reader sees the same cut.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Levels of the radix tree over a double's ordered bits: 16 bins for each doubling, then 4096 in each bin.
SHIFTS = (48, 36, 24, 12, 0)
MOST = 100_000  # rows of a bin that one task may rank
HOT = 64        # a value with more than a HOTth of the rows is common


def _n_partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return num_partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def _as_cols(cols: Iterable[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


# ----------------------------------------------------------------- ordinals
_PID, _RUN, _LAG = "_mr_pid", "_mr_run", "_mr_lag"


def running(df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), out: str = "rn",
            sums: dict[str, str] | None = None, lag: tuple[str, str] | None = None,
            num_partitions: int | None = None) -> DataFrame:
    """``df`` with the row's 1-based ordinal in its ``by`` group, running totals of
    long columns (``sums={"new": "column"}``, the row itself included) and, with
    ``lag=(column, name)``, the column's value in the row before.

    A window runs inside a slice of the range-partitioned, written rows, never over
    a whole group, so a group of any size is spread over its slices. Only groups
    that go over an edge of slices (two a slice at most) need what their earlier
    slices came to: a row for each of their slices, broadcast. ``order`` must be
    unique within ``by`` up to rows that are equal in it; null keys are a group.
    """
    from memberrisk.session import write_table
    sums, keys, order_cols = sums or {}, list(by), _as_cols(order)
    ranged = df.repartitionByRange(_n_partitions(df, num_partitions), *[F.col(k) for k in keys], *order_cols)
    cut = write_table(ranged.withColumn(_PID, F.spark_partition_id()), "slices")

    def inside(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy(_PID, *keys).orderBy(*order_cols)
        so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.select(
            *df.columns, _PID, F.row_number().over(w).cast("long").alias(_RUN),
            *[F.coalesce(F.sum(c).over(so_far), F.lit(0)).cast("long").alias(f"_mr_sum_{n}") for n, c in sums.items()],
            *([F.lag(lag[0]).over(w).alias(_LAG)] if lag else []))

    names = [f"_mr_k{i}" for i in range(len(keys))]
    shape = T.StructType([T.StructField(n, df.schema[k].dataType) for n, k in zip(names, keys)])
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0))
    ends = cut.groupBy(_PID).agg(F.min(key).alias("lo"), F.max(key).alias("hi")).orderBy(_PID).collect()  # a row a slice
    over = {tuple(b["lo"]) for a, b in zip(ends, ends[1:]) if a["hi"] == b["lo"]}
    same = F.lit(True)
    for n, k in zip(names, keys):
        same &= F.col(k).eqNullSafe(F.col(n))
    done = inside(cut)
    if over:
        if keys:
            crossing = df.sparkSession.createDataFrame([tuple(k) for k in over], shape)
            spread = inside(cut.join(F.broadcast(crossing), same, "left_semi"))
        else:
            spread = inside(cut)
        last = spread.groupBy(_PID, *keys).agg(
            F.max(_RUN).alias("_mr_n"), *[F.max_by(f"_mr_sum_{n}", _RUN).alias(f"_mr_t_{n}") for n in sums],
            *([F.max_by(lag[0], _RUN).alias("_mr_value")] if lag else []))
        w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(_PID)  # a row a slice of a group
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        carry = materialize_small(last.select(
            F.col(_PID).alias("_mr_p"), *[F.col(k).alias(n) for n, k in zip(names, keys)], F.sum("_mr_n").over(before).alias("_mr_off"),
            *[F.sum(f"_mr_t_{n}").over(before).alias(f"_mr_off_{n}") for n in sums],
            *([F.lag("_mr_value").over(w).alias("_mr_carry")] if lag else [])))
        done = done.join(F.broadcast(carry), (F.col(_PID) == F.col("_mr_p")) & same, "left")  # two rows a slice at most
    else:
        done = done.withColumns({"_mr_off": F.lit(0), **{f"_mr_off_{n}": F.lit(0) for n in sums}})
        if lag:
            done = done.withColumn("_mr_carry", F.lit(None).cast(df.schema[lag[0]].dataType))

    def add(own: str, off: str) -> Column:
        return (F.col(own) + F.coalesce(F.col(off), F.lit(0))).cast("long")

    extra = [F.when(F.col(_RUN) > 1, F.col(_LAG)).otherwise(F.col("_mr_carry")).alias(lag[1])] if lag else []
    return done.select(*[c for c in df.columns if c != out], add(_RUN, "_mr_off").alias(out),
                       *[add(f"_mr_sum_{n}", f"_mr_off_{n}").alias(n) for n in sums], *extra)


def row_number(df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), out: str = "rn",
               num_partitions: int | None = None, lag: tuple[str, str] | None = None) -> DataFrame:
    """Exact 1-based ``row_number`` within ``by`` without a per-key window (see :func:`running`)."""
    return running(df, order, by, out, lag=lag, num_partitions=num_partitions)


# ------------------------------------------------------- ranks and quantiles
def ordered_bits(v: Column) -> Column:
    """The 64 bits of a double (biased exponent, then fraction) as a long in the order of
    the values; 0 for both zeros. For values that are not null and not NaN."""
    a = F.abs(v)
    guess = F.least(F.greatest(F.floor(F.log2(a)), F.lit(-1074)), F.lit(1023))
    unit = F.pow(F.lit(2.0), guess)  # the logarithm may be off by one next to a power of two
    exponent = F.least(guess - (unit > a).cast("int") + (unit <= a / 2).cast("int"), F.lit(1023))
    small = a < F.lit(2.0 ** -1022)
    fraction = F.when(small, a / F.lit(5e-324)).otherwise((a / F.pow(F.lit(2.0), exponent) - 1) * F.lit(2.0 ** 52))
    bits = F.when(small, F.lit(0).cast("long")).otherwise((exponent + 1023).cast("long")) * F.lit(1 << 52) + fraction.cast("long")
    size = F.when(a == 0, F.lit(0).cast("long")).when(a == F.lit(float("inf")), F.lit(2047 << 52)).otherwise(bits)
    return F.when(v < 0, -size).otherwise(size)


def value_bin(v: Column, shift: int = SHIFTS[0]) -> Column:
    """Order-preserving bin of a double: equal or larger for a larger value."""
    return F.shiftright(ordered_bits(v), shift)


def percent_rank_avg(df: DataFrame, value: str, out: str, by: Sequence[str] = (),
                     num_partitions: int | None = None) -> DataFrame:
    """pandas ``rank(pct=True)`` (average ties): (less + (ties+1)/2) / n.

    Null values get a null rank; n counts non-null values. A value that holds more than a
    ``HOT``th of the rows (there are ``HOT`` at most) meets its rank by broadcast, so no
    task gets all rows of a common value."""
    by = list(by)
    value_rows = df.where(F.col(value).isNotNull())
    counts = value_rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_mr_c"))
    ranked = rank_counts(counts, value, by, "_mr_c", num_partitions)
    totals = materialize_small(ranked.groupBy(*by).agg(F.sum("_mr_c").alias("_mr_total")))
    rows = totals.agg(F.sum("_mr_total")).first()[0] or 0
    total = F.lit(rows) if not by else F.col("_mr_total")
    if by:
        ranked = _null_safe(ranked, totals, by)
    ranks = materialize_small(ranked.select(
        *by, value, "_mr_c", ((F.col("_mr_before") + (F.col("_mr_c") + F.lit(1)) / F.lit(2.0)) / total).cast("double").alias(out)))
    common = ranks.where(F.col("_mr_c") * HOT > rows).drop("_mr_c")  # at most HOT rows
    others = ranks.where(F.col("_mr_c") * HOT <= rows).drop("_mr_c")
    keys = [*by, value]
    hot = _null_safe(df, F.broadcast(common), keys, "inner")
    rest = _null_safe(df, F.broadcast(common), keys, "left_anti")
    nothing = rest.where(F.col(value).isNull()).withColumn(out, F.lit(None).cast("double"))
    met = _null_safe(rest.where(F.col(value).isNotNull()), others, keys, "left")
    shown = [*df.columns, out]
    return hot.select(*shown).unionByName(nothing.select(*shown)).unionByName(met.select(*shown))


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on equal keys, null keys alike; the right side's keys go."""
    names = {k: f"_mr_j{i}" for i, k in enumerate(keys)}
    on = F.lit(True)
    for k, n in names.items():
        on &= F.col(k).eqNullSafe(F.col(n))
    return left.join(right.withColumnsRenamed(names), on, how).drop(*names.values())


def rank_counts(counts: DataFrame, value: str, by: Sequence[str], weight: str, num_partitions: int | None = None) -> DataFrame:
    """``counts`` (a row a value of a group) with ``_mr_before``, the weight of the group's
    smaller values: a running total over range slices, however close the values lie."""
    ranked = running(counts, [value], list(by), out="_mr_at", sums={"_mr_upto": weight}, num_partitions=num_partitions)
    return ranked.select(*counts.columns, (F.col("_mr_upto") - F.col(weight)).alias("_mr_before"))


def quantiles(df: DataFrame, columns: Sequence[str], qs: Sequence[float],
              by: Sequence[str] = (), num_partitions: int | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles of several columns by recursive narrowing.

    The values' ordered bits are a radix tree. Its first level is counted for all rows;
    a bin that holds a wanted rank is ranked by its values if it has at most ``MOST`` rows,
    else its rows alone are counted at the next level, down to single values. Bins of one
    value need no ranking. Levels are ``SHIFTS``; ``MOST`` bounds what a task sorts.

    Returns a long table ``(*by, name, q, value)``; nulls and NaN are skipped
    (pandas semantics). Groups without values produce no row."""
    by = list(by)
    keys = [*by, "name"]
    items = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v"))
                      for c in columns])
    long = (df.select(*by, F.explode(items).alias("_mr_s"))
              .select(*by, F.col("_mr_s.name").alias("name"), F.col("_mr_s.v").alias("v"))
              .where(F.col("v").isNotNull() & ~F.isnan("v")))
    group = Window.partitionBy(*keys)
    counted = [F.count(F.lit(1)).alias("_mr_n"), F.min("v").alias("_mr_lo"), F.max("v").alias("_mr_hi")]
    bins = long.groupBy(*keys, value_bin(F.col("v")).alias("_mr_b")).agg(*counted)
    bins = bins.withColumns({"_mr_off": _before(group.orderBy("_mr_b")), "_mr_total": F.sum("_mr_n").over(group)})
    pos = F.col("q") * (F.col("_mr_total") - 1)
    ranks = F.array(F.struct(F.lit("lo").alias("end"), F.floor(pos).alias("rank")), F.struct(F.lit("hi").alias("end"), F.ceil(pos).alias("rank")))
    wanted = (bins.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs]))).withColumn("_mr_t", F.explode(ranks))
              .select(*keys, "q", "_mr_t.end", "_mr_t.rank", (pos - F.floor(pos)).alias("frac"), "_mr_b", "_mr_off", "_mr_n", "_mr_lo", "_mr_hi"))
    wanted = materialize_small(wanted.where(_holds("_mr_off", "_mr_n")))
    carried, found = [*keys, "q", "end", "rank", "frac"], []
    for shift, finer in zip(SHIFTS, [*SHIFTS[1:], None]):
        one = F.col("_mr_lo") == F.col("_mr_hi")
        found.append(wanted.where(one).select(*carried, F.col("_mr_lo").alias("v")))
        few, many = wanted.where(~one & (F.col("_mr_n") <= MOST)), wanted.where(~one & (F.col("_mr_n") > MOST))
        binned = long.withColumn("_mr_b", value_bin(F.col("v"), shift))
        bin_keys = [*keys, "_mr_b"]
        # At most MOST rows a bin are counted by value and ranked, each bin on its own.
        values = _null_safe(binned, few.select(*bin_keys).distinct(), bin_keys, "left_semi").groupBy(*bin_keys, "v").agg(F.count(F.lit(1)).alias("_mr_n"))
        values = values.withColumn("_mr_in", _before(Window.partitionBy(*bin_keys).orderBy("v")))
        inside = _null_safe(few.drop("_mr_n"), values, bin_keys, "inner").withColumn("_mr_off", F.col("_mr_off") + F.col("_mr_in"))
        found.append(inside.where(_holds("_mr_off", "_mr_n")).select(*carried, "v"))
        if finer is None or not many.limit(1).count():
            break
        children = (_null_safe(binned, many.select(*bin_keys).distinct(), bin_keys, "left_semi")
                    .groupBy(*bin_keys, value_bin(F.col("v"), finer).alias("_mr_child")).agg(*counted))
        children = children.withColumn("_mr_in", _before(Window.partitionBy(*bin_keys).orderBy("_mr_child")))
        next_ = _null_safe(many.drop("_mr_n", "_mr_lo", "_mr_hi"), children, bin_keys, "inner").withColumn("_mr_off", F.col("_mr_off") + F.col("_mr_in"))
        wanted = materialize_small(next_.where(_holds("_mr_off", "_mr_n")).select(
            *carried, F.col("_mr_child").alias("_mr_b"), "_mr_off", "_mr_n", "_mr_lo", "_mr_hi"))
    picked = found[0]
    for part in found[1:]:
        picked = picked.unionByName(part)
    ends = picked.groupBy(*keys, "q").agg(
        F.max(F.when(F.col("end") == "lo", F.col("v"))).alias("_mr_lo"), F.max(F.when(F.col("end") == "hi", F.col("v"))).alias("_mr_hi"),
        F.max("frac").alias("_mr_frac"))
    value = F.col("_mr_lo") + F.col("_mr_frac") * (F.col("_mr_hi") - F.col("_mr_lo"))
    return ends.select(*keys, "q", value.alias("value"))


def _before(ordered) -> Column:
    """Rows in the bins before, in an ordered window of bins."""
    return F.coalesce(F.sum("_mr_n").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))


def _holds(start: str, n: str) -> Column:
    return (F.col(start) <= F.col("rank")) & (F.col("rank") < F.col(start) + F.col(n))


def quantile_row(df: DataFrame, spec: dict[str, Sequence[float]], by: Sequence[str] = (),
                 num_partitions: int | None = None) -> DataFrame:
    """Wide form of :func:`quantiles`: one row per ``by`` group with columns
    ``{column}_q{int(q*100)}`` (e.g. ``saldo_disponible_q99``).

    Without ``by`` the result is exactly one row (nulls when there is no data)
    and is safe to broadcast."""
    by = list(by)
    cols = list(spec)
    qs = sorted({float(q) for v in spec.values() for q in v})
    long = quantiles(df, cols, qs, by, num_partitions)
    aggs = [F.max(F.when((F.col("name") == c) & (F.abs(F.col("q") - float(q)) < 1e-12),
                         F.col("value"))).alias(quantile_name(c, q))
            for c in cols for q in spec[c]]
    if by:
        return long.groupBy(*by).agg(*aggs)
    # global: aggregate over the (tiny) long table; an empty input still yields one row
    return long.agg(*aggs)


def quantile_name(column: str, q: float) -> str:
    pct = q * 100
    label = str(int(round(pct))) if abs(pct - round(pct)) < 1e-9 else str(pct).replace(".", "_")
    return f"{column}_q{label}"


def quantile_values(df: DataFrame, spec: dict[str, Sequence[float]],
                    num_partitions: int | None = None) -> dict[str, float | None]:
    """Global quantiles as Python scalars (one bounded row reaches the driver).

    Used to inject statistics as literals, so the consuming plan does not
    embed (and replay) the statistics' own plan."""
    row = quantile_row(df, spec, num_partitions=num_partitions).first()
    return row.asDict() if row is not None else {}


def materialize_small(df: DataFrame) -> DataFrame:
    """Write a statistics table (per-group quantiles, counts) to the session's
    shared checkpoint folder and read it back, cutting its lineage."""
    from memberrisk.session import write_table
    return write_table(df, "stats")
