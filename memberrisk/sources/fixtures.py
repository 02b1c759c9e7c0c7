"""Member snapshots and alert feeds derived from the driver's TPC-H-style tables.

The reference reads monthly account snapshots and two alert files that are
not shipped. The mapping below (documented in FIXTURES.md §4) turns
``customer``/``orders``/``lineitem`` into the same shapes so that every
operator has data whose size grows with the input tables.

Plan shape: lineitem is scanned once with a pushed-down date filter, joined
to orders on the order key, and reduced per customer with conditional
aggregates for all periods at once (one partial-aggregated shuffle, no
per-period re-scan and no 3x row explosion). Customer rows are then expanded
to (period x account) rows, which is bounded by 3 x 2 per customer.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memberrisk.functions import ranking

# Fixed values of the fixture mapping (FIXTURES.md §4).
PERIODS = (("2001-05", dt.date(2001, 5, 1)),
           ("2001-06", dt.date(2001, 6, 1)),
           ("2001-07", dt.date(2001, 7, 1)))
DUPLICATE_PERIOD = "2001-07"
BIRTH_ANCHOR = dt.date(2001, 7, 1)
SEGMENT_CODES = {"AUTOMOBILE": 1, "BUILDING": 2, "FURNITURE": 3, "HOUSEHOLD": 4, "MACHINERY": 5}
URGENT_PRIORITIES = ("1-URGENT", "2-HIGH")
ACTIVITY_WINDOWS = {"v12h": 1, "v24h": 3, "v48h": 10}
RAW_DATE_FORMAT = "MMM d yyyy h:mma"
ALERT_GAP_TARGET_DAYS = 240

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@dataclass
class Tables:
    spark: SparkSession
    root: str

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.root}/{name}.parquet")
        raise AttributeError(name)


def _d(day: dt.date) -> Column:
    return F.lit(day)


def _amount() -> Column:
    # whole cents as BIGINT: sums are exact and order-independent, and long
    # arithmetic stays in generated code (a DECIMAL(25,2) sum buffer does not).
    # cents / 100.0 is the correctly rounded double of the exact decimal sum.
    return F.rint(F.col("l_extendedprice") * 100).cast("long")


def movements(t: Tables) -> DataFrame:
    """Line items dated by ship date and attributed to the ordering customer."""
    last = max(d for _, d in PERIODS)
    li = (t.lineitem
          .where(F.col("l_shipdate") < F.lit(dt.datetime(last.year, last.month, last.day)).cast("timestamp_ntz"))
          .select("l_orderkey", F.col("l_shipdate").cast("date").alias("ship"),
                  _amount().alias("amt"), "l_returnflag", "l_linestatus"))
    od = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority")
    return li.join(od, li.l_orderkey == od.o_orderkey, "inner").drop("l_orderkey", "o_orderkey")


def _period_aggs(i: int, d: dt.date) -> list[Column]:
    ship, amt = F.col("ship"), F.col("amt")
    before = ship < _d(d)

    def within(days: int) -> Column:
        return before & (ship >= _d(d - dt.timedelta(days=days)))

    def dsum(cond: Column, name: str) -> Column:
        return (F.sum(F.when(cond, amt)).cast("double") / F.lit(100.0)).alias(f"{name}_{i}")

    aggs = [
        F.min(F.when(before, ship)).alias(f"aper_{i}"),
        F.max(F.when(before, ship)).alias(f"ultmov_{i}"),
        dsum(within(90), "s90"),
        dsum(within(365) & (F.col("l_returnflag") != "R"), "inc365"),
        dsum(within(365) & (F.col("l_returnflag") == "R"), "egr365"),
        F.max(F.when(within(365) & F.col("o_orderpriority").isin(*URGENT_PRIORITIES), 1)
              .otherwise(0)).alias(f"urgent_{i}"),
        dsum(within(30) & (F.col("l_linestatus") == "F"), "cred30"),
        dsum(within(30) & (F.col("l_linestatus") == "O"), "deb30"),
    ]
    for name, days in ACTIVITY_WINDOWS.items():
        aggs.append(F.count(F.when(within(days), 1)).alias(f"{name}_{i}"))
    return aggs


def customer_activity(t: Tables) -> DataFrame:
    """One row per customer with the per-period activity aggregates."""
    aggs = [a for i, (_, d) in enumerate(PERIODS) for a in _period_aggs(i, d)]
    return movements(t).groupBy(F.col("o_custkey").alias("k")).agg(*aggs)


def snapshot_typed(t: Tables) -> DataFrame:
    """Typed snapshot rows (before the raw string layer), duplicates included."""
    cust = t.customer.select(F.col("c_custkey").alias("k"), "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    nation = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name"))
    act = customer_activity(t)
    base = cust.join(act, "k", "left").join(nation, "c_nationkey", "left")

    fields = ["periodo", "d", "aper", "ultmov", "s90", "inc365", "egr365", "urgent", "cred30", "deb30",
              *ACTIVITY_WINDOWS]
    per_period = F.array(*[
        F.struct(F.lit(p).alias("periodo"), _d(d).alias("d"),
                 *[F.col(f"{f}_{i}").alias(f) for f in fields[2:]])
        for i, (p, d) in enumerate(PERIODS)])
    k = F.col("k")
    accounts = F.when(k % 7 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = (base.select("k", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "n_name",
                        F.explode(per_period).alias("p"), F.explode(accounts).alias("a"))
                .select("*", *[F.col(f"p.{f}").alias(f) for f in fields]).drop("p"))
    # second copy of the last period for k % 19 == 0: one day older, +100 balance
    dup = F.when((k % 19 == 0) & (F.col("periodo") == DUPLICATE_PERIOD),
                 F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("dup", F.explode(dup))

    a, d = F.col("a"), F.col("d")
    saldo = ((F.col("c_acctbal") + F.lit(0.005) * F.coalesce(F.col("s90"), F.lit(0.0)))
             * F.when(a == 1, F.lit(1.0)).otherwise(F.lit(0.4)))
    saldo = saldo + F.when(F.col("dup") == 1, F.lit(100.0)).otherwise(F.lit(0.0))
    seg = F.col("c_mktsegment")
    prod = F.lit(None).cast("int")
    for name, code in reversed(list(SEGMENT_CODES.items())):
        prod = F.when(seg == name, F.lit(code)).otherwise(prod)
    age_base = F.lit(15) + k % 65
    birth_days = F.floor(age_base.cast("double") * F.lit(365.25)) + k % 300
    out = rows.select(
        k.alias("v_ah_cliente"),
        (k * 10 + a).alias("v_ah_cuenta"),
        F.col("periodo"),
        F.col("c_name").alias("v_ah_nombre"),
        (d - F.col("dup").cast("int")).alias("fecha_proceso"),
        F.col("aper").alias("fecha_aper"),
        F.col("ultmov").alias("fecha_ultmov"),
        F.when(k % 31 == 0, F.lit(None).cast("date"))
         .otherwise(F.date_sub(_d(BIRTH_ANCHOR), birth_days.cast("int"))).alias("v_fecha_nac"),
        F.date_sub(d, (k % 400).cast("int")).alias("fecha_actualizacion"),
        saldo.alias("saldo_disponible"),
        F.when(k % 5 == 0, F.lit(0.3) * F.abs(F.col("c_acctbal"))).otherwise(F.lit(0.0)).alias("monto_bloq"),
        (F.lit(0.05) * F.greatest(F.col("c_acctbal"), F.lit(0.0))).alias("certificadosvalor"),
        F.when(k % 11 == 0, F.lit(None).cast("double"))
         .otherwise(F.lit(0.002) * F.coalesce(F.col("inc365"), F.lit(0.0))).alias("ingresos"),
        F.when(k % 13 == 0, F.lit(None).cast("double"))
         .otherwise(F.lit(0.004) * F.coalesce(F.col("egr365"), F.lit(0.0))).alias("egresos"),
        F.coalesce(F.col("cred30"), F.lit(0.0)).alias("val_de_creditos"),
        F.coalesce(F.col("deb30"), F.lit(0.0)).alias("val_de_debitos"),
        F.coalesce(F.col("urgent"), F.lit(0)).cast("double").alias("credito"),
        F.lit(0.0).alias("menor_edad"),
        F.when(k % 3 == 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("cooplinea"),
        F.when(k % 4 >= 2, (k % 4).cast("double")).otherwise(F.lit(0.0)).alias("tarjetas"),
        *[F.coalesce(F.col(n), F.lit(0)).cast("double").alias(n) for n in ACTIVITY_WINDOWS],
        F.when(k % 17 == 0, F.lit(None).cast("double"))
         .when(k % 29 == 0, (F.lit(25) + k % 65).cast("double"))
         .otherwise(age_base.cast("double")).alias("edad"),
        F.when(k.isin(1, 2, 3), F.lit(99)).otherwise(F.col("c_nationkey")).cast("int").alias("oficina_cta"),
        F.when(k % 41 == 0, F.lit(None).cast("int")).otherwise(prod).alias("prod_bancario"),
        F.element_at(F.array(F.lit("I"), F.lit("c"), F.lit("A"), F.lit("A"), F.lit("A"),
                             F.lit("A"), F.lit("A"), F.lit("A"), F.lit("A"), F.lit("X")),
                     (k % 10 + 1).cast("int")).alias("estado_cta"),
        seg.alias("tipo_cuenta"),
        F.when(k % 37 == 0, F.lit(None).cast("string"))
         .when(k % 4 == 0, F.lit("f")).when(k % 2 == 0, F.lit("F")).otherwise(F.lit(" M")).alias("sexo"),
        F.element_at(F.array(F.lit("S"), F.lit("C"), F.lit("D"), F.lit("V"), F.lit("u"),
                             F.lit(None).cast("string")), (k % 6 + 1).cast("int")).alias("estado_civil"),
        F.col("n_name").alias("nacionalidad"),
    )
    return out


DATE_COLS = ("fecha_proceso", "fecha_aper", "fecha_ultmov", "v_fecha_nac", "fecha_actualizacion")


def snapshot_raw(t: Tables) -> DataFrame:
    """The raw CSV-like layer: every column a string, dates as
    ``Jul 1 2001 12:00AM``, balance ``n/a`` when k % 23 == 0."""
    typed = snapshot_typed(t)
    cols = []
    for f in typed.schema.fields:
        c = F.col(f.name)
        if f.name in DATE_COLS:
            s = F.date_format(c.cast("timestamp"), RAW_DATE_FORMAT)
        elif f.name == "saldo_disponible":
            s = F.when(F.col("v_ah_cliente") % 23 == 0, F.lit("n/a")).otherwise(c.cast("string"))
        else:
            s = c.cast("string")
        cols.append(s.alias(f.name))
    return typed.select(*cols)


def alerts_raw(t: Tables) -> DataFrame:
    """Two alert sources (``desviados``, ``desviados_3_mas``) with the raw
    ``dias_por_mes`` map literal, already tagged with ``fuente_alerta``.

    The gap between consecutive orders needs the previous order of the same
    customer. Instead of a per-customer window (one task per hot customer),
    orders are numbered with the skew-safe exact row number, which brings the
    previous order's date along."""
    od = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("date").alias("od"),
                         "o_orderkey")
    numbered = ranking.row_number(od, ["od", "o_orderkey"], by=["k"], out="n", lag=("od", "prev_od"))
    gaps = numbered.where(F.col("n") > 1).select(
        "k", (F.abs(F.datediff("od", "prev_od") - ALERT_GAP_TARGET_DAYS) / F.lit(10.0)).alias("gap"))
    dev = gaps.groupBy("k").agg(F.max("gap").alias("g"))
    k = F.col("k")
    dias = (F.when(k % 47 == 0, F.lit("not a dict"))
             .when(k % 53 == 0, F.lit(None).cast("string"))
             .otherwise(F.format_string("{5: %d.0, 6: %d.0}", (k % 31).cast("int"), ((k * 7) % 30).cast("int"))))
    one = dev.where(k % 3 != 0).select(k.alias("cliente"), dias.alias("dias_por_mes"),
                                       F.col("g").alias("desviacion_maxima"),
                                       F.lit("desviados").alias("fuente_alerta"))
    three = dev.where(k % 6 == 1).select(k.alias("cliente"), dias.alias("dias_por_mes"),
                                         (F.col("g") + F.lit(1.5)).alias("desviacion_maxima"),
                                         F.lit("desviados_3_mas").alias("fuente_alerta"))
    return one.unionByName(three)
