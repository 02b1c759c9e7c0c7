"""Rule-based analyzers over the featured hub.

Each analyzer is a set of DataFrame functions: a per-row (or per-client)
score table plus metric/report tables derived from it. Global statistics
(p01/p99, p75, p99 idle) are computed once with the skew-safe exact quantile
operator and enter the plans as literals; group statistics use grouped
aggregates with partial aggregation; rankings use the range-partitioned
percent rank; top-k reports use ``orderBy().limit()`` (TakeOrderedAndProject).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memberrisk import schemas as S
from memberrisk.functions import exprs as X
from memberrisk.functions import ranking as R

# ---------------------------------------------------------------------------
# Fixed values of the source system (weights, thresholds, labels)
# ---------------------------------------------------------------------------
EW_WEIGHTS = {"inactivity": 0.4, "balance_trend": 0.3, "deviation": 0.3}
EW_LEVELS = ((0.75, "alerta_90d"), (0.50, "alerta_60d"), (0.30, "alerta_30d"))
EW_NORMAL = "normal"
EW_LEVEL_ORDER = ("normal", "alerta_30d", "alerta_60d", "alerta_90d")
EW_DAYS_HORIZON = 120
EW_ADHOC_IDLE_DENOM = 120
EW_ADHOC_DEV_DENOM = 30

STATES = ("Excelente", "Bueno", "Regular", "Riesgoso", "Crítico")
STATE_CUTS = (0.8, 0.6, 0.4, 0.2)
STATE_WEIGHTS = (0.6, 0.4)

OD_WEIGHTS = (0.30, 0.25, 0.25, 0.20)
OD_CREDIT_MULTIPLIER = 1.2
OD_FLAG = 60
OD_BANDS = (("bajo_0_30", None, 30), ("medio_30_60", 30, 60), ("alto_60_80", 60, 80), ("critico_80_100", 80, None))

GROUP_MIN_ROWS = 5
GROUP_DIMENSIONS = (("producto", "prod_bancario"), ("oficina", "oficina_cta"), ("tipo_cuenta", "tipo_cuenta"))

AGE_HIST_BINS = (0, 18, 25, 35, 45, 55, 65, 75, 150)
AGE_HIST_LABELS = ("<18", "18-24", "25-34", "35-44", "45-54", "55-64", "65-74", "75+")

DEFAULT_COLLECTION_DAY = 15
DEFAULT_ALIGNMENT = 0.5

FAMILY_REDUCTION_PER_DEPENDENT = 0.10
FAMILY_MIN_FACTOR = 0.6
FAMILY_HIGH_VULNERABILITY = 60


def _lit(v) -> Column:
    return F.lit(v)


# ---------------------------------------------------------------------------
# Latest period, minors, adults
# ---------------------------------------------------------------------------

def latest(df: DataFrame) -> DataFrame:
    """Rows of the latest period (1-row max broadcast to the scan)."""
    last = df.agg(F.max("periodo").alias("_last"))
    return df.join(F.broadcast(last), F.col("periodo") == F.col("_last"), "inner").drop("_last")


def age_validation(last: DataFrame) -> DataFrame:
    """R7 over latest-period rows: derived age (1 decimal), real age,
    minor/blocked flags, inconsistency flag and detail text."""
    calc = F.when(F.col("v_fecha_nac").isNotNull() & F.col("fecha_proceso").isNotNull(),
                  X.rnd(X.floor_days("fecha_proceso", "v_fecha_nac") / _lit(365.25), 1))
    campo = F.col("edad")
    real = F.coalesce(calc, campo)
    diff = F.abs(campo - calc)
    inc_age = F.coalesce(campo.isNotNull() & calc.isNotNull() & (diff > 2), _lit(False))
    expected = F.when(real < 18, _lit(1)).otherwise(_lit(0))
    menor = F.col("menor_edad")
    inc_flag = F.coalesce(menor.isNotNull() & real.isNotNull() & (menor.cast("int") != expected), _lit(False))
    detail_age = F.when(inc_age, F.format_string("Campo dice %s, calculada %.1f (diff=%.1f)",
                                                  campo.cast("string"), calc, diff))
    detail_flag = F.concat(F.coalesce(detail_age, _lit("")), _lit(" | menor_edad="),
                           menor.cast("int").cast("string"), _lit(" pero edad="), real.cast("string"))
    detail = F.when(inc_flag, detail_flag).otherwise(detail_age)
    is_minor = F.coalesce(real < 18, _lit(False))
    return last.select(
        "v_ah_cliente", "v_ah_cuenta",
        campo.alias("edad_campo"), calc.alias("edad_calculada"), real.alias("edad_real"),
        is_minor.alias("is_minor"), is_minor.alias("is_blocked"),
        (inc_age | inc_flag).alias("is_inconsistent"), detail.alias("inconsistency_detail"))


def minor_ids(validation: DataFrame) -> DataFrame:
    """Client ids of blocked minors; stays a DataFrame (never collected)."""
    return validation.where("is_blocked").select("v_ah_cliente").distinct()


def exclude_minors(df: DataFrame, minors: DataFrame) -> DataFrame:
    """Every period of every non-minor client (left anti join)."""
    return df.join(minors.hint("merge"), "v_ah_cliente", "left_anti")  # rows of members never go through the driver


def age_metrics(validation: DataFrame) -> DataFrame:
    """A14."""
    med = R.quantile_row(validation, {"edad_real": [0.5]})
    base = validation.agg(
        F.count(F.lit(1)).alias("total_socios"),
        F.count_if("is_blocked").alias("menores_bloqueados"),
        F.count_if("is_inconsistent").alias("inconsistencias_detectadas"),
        F.avg("edad_real").alias("_avg"))
    n = F.col("total_socios")
    return base.withColumn("edad_real_q50", X.one_row(med)["edad_real_q50"]).select(
        "total_socios", "menores_bloqueados",
        F.when(n > 0, X.rnd(F.col("menores_bloqueados") / n * 100, 2)).otherwise(0.0).alias("pct_menores"),
        "inconsistencias_detectadas",
        F.when(n > 0, X.rnd(F.col("inconsistencias_detectadas") / n * 100, 2)).otherwise(0.0)
         .alias("pct_inconsistencias"),
        F.coalesce(X.rnd("_avg", 1), _lit(0.0)).alias("edad_promedio"),
        F.coalesce(X.rnd("edad_real_q50", 1), _lit(0.0)).alias("edad_mediana"))


def age_histogram(validation: DataFrame) -> DataFrame:
    """Counts per age band [0,18,25,...,150); empty bands -> 0."""
    e = F.col("edad_real")
    counts = [F.count_if((e >= lo) & (e < hi)).alias(f"b{i}")
              for i, (lo, hi) in enumerate(zip(AGE_HIST_BINS[:-1], AGE_HIST_BINS[1:]))]
    row = validation.agg(*counts)
    cells = F.array(*[F.struct(_lit(i).alias("bucket_order"), _lit(lab).alias("age_group"),
                               F.col(f"b{i}").alias("n_socios"))
                      for i, lab in enumerate(AGE_HIST_LABELS)])
    return row.select(F.explode(cells).alias("c")).select("c.*")


# ---------------------------------------------------------------------------
# Early warning
# ---------------------------------------------------------------------------

def _level(score: Column) -> Column:
    out = _lit(EW_NORMAL)
    for cut, name in reversed(EW_LEVELS):
        out = F.when(score >= cut, _lit(name)).otherwise(out)
    return out


def early_warning_stats(adults: DataFrame) -> dict:
    return R.quantile_values(adults, {"dias_sin_movimiento": [0.99], "tendencia_saldo": [0.01, 0.99],
                                      "desviacion_maxima": [0.99]})


def early_warning(adults: DataFrame, stats: dict | None = None) -> DataFrame:
    """R1 per row (all periods of adults): weighted inactivity, inverted
    balance trend and deviation, each normalised by global percentiles."""
    st = stats if stats is not None else early_warning_stats(adults)
    m = st["dias_sin_movimiento_q99"] or 1.0
    lo, hi = st["tendencia_saldo_q1"] or 0.0, st["tendencia_saldo_q99"] or 0.0  # null only without rows
    rng = (hi - lo) if hi != lo else 1.0
    v = st["desviacion_maxima_q99"] or 1.0
    inact = X.clip("dias_sin_movimiento", hi=float(m)) / _lit(float(m))
    bal = _lit(1.0) - (X.clip("tendencia_saldo", lo=float(lo), hi=float(hi)) - _lit(float(lo))) / _lit(float(rng))
    dev = X.clip("desviacion_maxima", hi=float(v)) / _lit(float(v))
    w = EW_WEIGHTS
    score = _lit(w["inactivity"]) * inact + _lit(w["balance_trend"]) * bal + _lit(w["deviation"]) * dev
    days = X.rnd(X.clip((_lit(1.0) - score) * EW_DAYS_HORIZON, lo=0.0), 0).cast("long")
    return adults.select(
        "v_ah_cliente", "v_ah_cuenta", "periodo",
        score.alias("alert_score_raw"), X.rnd(score, 4).alias("alert_score"), _level(score).alias("alert_level"),
        days.alias("estimated_days_to_default"), X.rnd(inact, 4).alias("inactivity_component"),
        X.rnd(bal, 4).alias("balance_component"), X.rnd(dev, 4).alias("deviation_component"))


def alert_level_counts(ew: DataFrame) -> DataFrame:
    return ew.groupBy("alert_level").agg(F.count(F.lit(1)).alias("n_socios"))


def alert_metrics(ew: DataFrame) -> DataFrame:
    """A11 (on the unrounded score)."""
    s = F.col("alert_score_raw")
    med = R.quantile_row(ew, {"alert_score_raw": [0.5]})
    base = ew.agg(F.count(F.lit(1)).alias("total_socios"),
                  *[F.count_if(F.col("alert_level") == lv).alias(f"n_{lv}") for lv in EW_LEVEL_ORDER],
                  F.avg(s).alias("mean_alert_score"), F.count_if(s >= 0.75).alias("high_risk_count"),
                  (F.avg((s >= 0.75).cast("double")) * 100).alias("high_risk_pct"))
    return base.withColumn("median_alert_score", X.one_row(med)["alert_score_raw_q50"])


def alert_percentiles(ew: DataFrame) -> DataFrame:
    """p25/50/75/90/95 of the unrounded score."""
    qs = (0.25, 0.50, 0.75, 0.90, 0.95)
    row = R.quantile_row(ew, {"alert_score_raw": qs})
    return row.select(*[F.col(R.quantile_name("alert_score_raw", q)).alias(f"p{int(q * 100)}") for q in qs])


def top_alerts(ew: DataFrame, n: int = 20) -> DataFrame:
    """20 highest (rounded) alert scores; ties by client, period, account."""
    return (ew.orderBy(F.col("alert_score").desc(), "v_ah_cliente", "periodo", "v_ah_cuenta").limit(n)
              .select("v_ah_cliente", "periodo", "alert_score", "alert_level", "estimated_days_to_default"))


def early_warning_adhoc_columns() -> dict[str, Column]:
    """R2 on a request row: fixed denominators; trend >= 0 -> 0.5 else 0.8; days truncated."""
    idle = F.coalesce(F.col("dias_sin_movimiento"), _lit(0.0))
    trend = F.coalesce(F.col("tendencia_saldo"), _lit(0.0))
    dev = F.coalesce(F.col("desviacion_maxima"), _lit(0.0))
    w = EW_WEIGHTS
    score = (_lit(w["inactivity"]) * F.least(idle / EW_ADHOC_IDLE_DENOM, _lit(1.0))
             + _lit(w["balance_trend"]) * F.when(trend >= 0, _lit(0.5)).otherwise(_lit(0.8))
             + _lit(w["deviation"]) * F.least(dev / EW_ADHOC_DEV_DENOM, _lit(1.0)))
    return {"alert_score": X.rnd(score, 4), "alert_level": _level(score),
            "estimated_days_to_default": ((_lit(1.0) - score) * EW_DAYS_HORIZON).cast("long")}


def early_warning_adhoc(req: DataFrame) -> DataFrame:
    """R2 for a request table."""
    return req.select("v_ah_cliente", *[c.alias(n) for n, c in early_warning_adhoc_columns().items()])


def latest_per_client(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per client, the latest period (smallest account on ties);
    ``max_by`` aggregate instead of a per-client window."""
    order = F.struct(F.col("periodo"), -F.col("v_ah_cuenta"))
    best = F.max_by(F.struct(*[F.col(c) for c in columns]), order)
    return df.groupBy("v_ah_cliente").agg(best.alias("_r")).select("v_ah_cliente", "_r.*")


def early_warning_lookup(req: DataFrame, ew: DataFrame) -> DataFrame:
    """Stored score of the client's latest row, else the ad-hoc score of
    the request row. One join; a client may have any number of requests."""
    names = list(early_warning_adhoc_columns())
    stored = latest_per_client(ew, names).withColumnsRenamed({n: f"_k_{n}" for n in names})
    j = req.join(stored, "v_ah_cliente", "left")
    known = F.col("_k_alert_score").isNotNull()
    return j.select("v_ah_cliente", known.alias("from_history"),
                    *[F.when(known, F.col(f"_k_{n}")).otherwise(c).alias(n) for n, c in early_warning_adhoc_columns().items()])


# ---------------------------------------------------------------------------
# Roll rate
# ---------------------------------------------------------------------------

def state_rank(state: Column) -> Column:
    out = _lit(None).cast("int")
    for i, s in reversed(list(enumerate(STATES))):
        out = F.when(state == s, _lit(i)).otherwise(out)
    return out


def risk_states(adults: DataFrame, idle_p99: float | None = None) -> DataFrame:
    """0.6 x average-tie percent rank of effective balance (all rows)
    + 0.4 x inverted idle share (p99-capped); five states."""
    if idle_p99 is None:
        idle_p99 = R.quantile_values(adults, {"dias_sin_movimiento": [0.99]})["dias_sin_movimiento_q99"]
    m = float(idle_p99 or 1.0)
    ranked = R.percent_rank_avg(adults.select("v_ah_cliente", "v_ah_cuenta", "periodo", "saldo_efectivo",
                                              "dias_sin_movimiento"), "saldo_efectivo", "saldo_norm")
    activity = _lit(1.0) - X.clip("dias_sin_movimiento", hi=m) / _lit(m)
    comp = _lit(STATE_WEIGHTS[0]) * F.col("saldo_norm") + _lit(STATE_WEIGHTS[1]) * activity
    state = _lit(STATES[-1])
    for cut, name in reversed(list(zip(STATE_CUTS, STATES[:-1]))):
        state = F.when(comp >= cut, _lit(name)).otherwise(state)
    return ranked.select("v_ah_cliente", "v_ah_cuenta", "periodo", "saldo_norm",
                         comp.alias("composite"), state.alias("estado_riesgo"))


def period_pairs(states: DataFrame) -> DataFrame:
    """Consecutive observed periods (a handful of rows: lead over distinct
    periods in one tiny window)."""
    periods = states.select("periodo").distinct()
    w = Window.orderBy("periodo")
    return (periods.withColumn("period_to", F.lead("periodo").over(w))
                   .where(F.col("period_to").isNotNull())
                   .withColumnRenamed("periodo", "period_from"))


def transitions(states: DataFrame) -> DataFrame:
    """Transitions between consecutive observed periods, joined on client
    (multi-account members multiply, Q27), for all pairs in one job.

    Rows are pre-aggregated to per-(client, period, state) counts before the
    join, so the result holds one row per (pair, client, from, to) with the
    multiplicity ``n = n_from x n_to`` instead of every account pair: a
    client with many accounts no longer produces a quadratic number of rows."""
    pairs = F.broadcast(period_pairs(states))  # one row per observed period (months of history)
    hist = states.groupBy("v_ah_cliente", "periodo", "estado_riesgo").agg(F.count(F.lit(1)).alias("_n"))
    src = hist.select("v_ah_cliente", F.col("periodo").alias("period_from"),
                      F.col("estado_riesgo").alias("state_from"), F.col("_n").alias("_n_from"))
    dst = hist.select("v_ah_cliente", F.col("periodo").alias("period_to"),
                      F.col("estado_riesgo").alias("state_to"), F.col("_n").alias("_n_to"))
    return (src.join(pairs, "period_from").join(dst.hint("merge"), ["v_ah_cliente", "period_to"])
               .select("period_from", "period_to", "v_ah_cliente", "state_from", "state_to",
                       (F.col("_n_from") * F.col("_n_to")).alias("n")))


def transition_matrix(trans: DataFrame) -> DataFrame:
    """Row-normalised matrix per pair with all 5x5 cells (p rounded to 4)."""
    counts = trans.groupBy("period_from", "period_to", "state_from", "state_to").agg(F.sum("n").alias("n"))
    grid_states = F.array(*[_lit(s) for s in STATES])
    pairs = trans.select("period_from", "period_to").distinct()
    grid = (pairs.withColumn("state_from", F.explode(grid_states))
                 .withColumn("state_to", F.explode(grid_states)))
    cells = grid.join(counts, ["period_from", "period_to", "state_from", "state_to"], "left").fillna(0, ["n"])
    tot = Window.partitionBy("period_from", "period_to", "state_from")
    row_total = F.sum("n").over(tot)
    p = F.when(row_total > 0, F.col("n") / row_total).otherwise(_lit(0.0))
    return cells.select("period_from", "period_to", "state_from", "state_to",
                        F.col("n").cast("long").alias("n"), X.rnd(p, 4).alias("p"))


def last_matrix(matrix: DataFrame) -> DataFrame:
    last = matrix.agg(F.max("period_to").alias("_t"))
    return matrix.join(F.broadcast(last), F.col("period_to") == F.col("_t")).drop("_t")


def state_distribution(states: DataFrame) -> DataFrame:
    """State counts of the latest period."""
    return latest(states).groupBy("estado_riesgo").agg(F.count(F.lit(1)).alias("n_socios"))


def state_projection(states: DataFrame, matrix: DataFrame) -> DataFrame:
    """Latest distribution (as shares) x last matrix, back to counts."""
    dist = state_distribution(states)
    total = dist.agg(F.sum("n_socios").alias("_tot"))
    tot = X.one_row(total)["_tot"]
    share = dist.select(F.col("estado_riesgo").alias("state_from"), (F.col("n_socios") / tot).alias("share"))
    proj = (last_matrix(matrix).join(F.broadcast(share), "state_from", "left")
            .groupBy("state_to").agg(F.sum(F.coalesce(F.col("share"), _lit(0.0)) * F.col("p")).alias("_x")))
    return proj.select(
        F.col("state_to").alias("estado_riesgo"), X.rnd(F.col("_x") * tot, 0).cast("long").alias("n_projected"))


def deterioration(trans: DataFrame) -> DataFrame:
    """A10: number of (joined) rows moving to a worse state, per pair."""
    worse = state_rank(F.col("state_to")) > state_rank(F.col("state_from"))
    return trans.groupBy("period_from", "period_to").agg(
        F.coalesce(F.sum(F.when(worse, F.col("n"))), F.lit(0)).cast("long").alias("n_deteriorated"))


def top_deteriorated(trans: DataFrame, n: int = 20) -> DataFrame:
    """First 20 deteriorated rows per pair (client order). Each
    (client, from, to) row stands for ``n`` joined rows, so the first 20
    output rows come from at most the first 20 of them: ``row_number <= 20``
    (planned with a partial WindowGroupLimit before the shuffle), expand by
    multiplicity, rank again."""
    worse = trans.where(state_rank(F.col("state_to")) > state_rank(F.col("state_from")))
    order = ["v_ah_cliente", state_rank(F.col("state_from")), state_rank(F.col("state_to"))]
    w = Window.partitionBy("period_from", "period_to").orderBy(*order)
    head = worse.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    expanded = head.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(n)).cast("int"))))
    w2 = Window.partitionBy("period_from", "period_to").orderBy("_r", "_copy")
    return (expanded.withColumn("rank_in_pair", F.row_number().over(w2)).where(F.col("rank_in_pair") <= n)
                    .select("period_from", "period_to", "rank_in_pair", "v_ah_cliente", "state_from", "state_to"))


def transition_lookup(current: DataFrame, matrix: DataFrame, state_col: str = "estado_riesgo") -> DataFrame:
    """J7 + R4: next-state probabilities from the last matrix (row-stochastic,
    Q1), deterioration probability and most likely next state. Unknown state
    -> Regular; an unseen from-state -> probability 0 and next = current."""
    lm = last_matrix(matrix)
    wide = lm.groupBy("state_from").pivot("state_to", list(STATES)).agg(F.first("p"))
    cur = F.coalesce(F.col(state_col), _lit("Regular"))
    j = current.withColumn("_state", cur).join(F.broadcast(wide), F.col("_state") == F.col("state_from"), "left")
    idx = state_rank(F.col("_state"))
    probs = [F.coalesce(F.col(f"`{s}`"), _lit(0.0)) for s in STATES]
    det = _lit(0.0)
    for i, p in enumerate(probs):
        det = det + F.when(_lit(i) > idx, p).otherwise(_lit(0.0))
    seen = F.col("state_from").isNotNull()
    best = F.greatest(*probs)
    nxt = _lit(None).cast("string")
    for i in range(len(STATES) - 1, -1, -1):
        nxt = F.when(probs[i] == best, _lit(STATES[i])).otherwise(nxt)
    nxt = F.when(seen, nxt).otherwise(F.col("_state"))
    names = ["p_excelente", "p_bueno", "p_regular", "p_riesgoso", "p_critico"]
    return j.select(*[c for c in current.columns if c != state_col], F.col("_state").alias("current_state"),
                    *[p.alias(nm) for p, nm in zip(probs, names)],
                    X.rnd(det, 4).alias("prob_deterioro"), nxt.alias("most_likely_next_state"))


# ---------------------------------------------------------------------------
# Over-indebtedness
# ---------------------------------------------------------------------------

def over_indebtedness(last: DataFrame) -> DataFrame:
    """R5 per latest-period row."""
    r, f, t = F.col("ratio_ingreso_egreso"), F.col("flujo_neto"), F.col("tendencia_saldo")
    s_ratio = F.when(r < 1.0, 1.0).when(r < 1.2, 0.7).when(r < 1.5, 0.4).otherwise(0.1)
    s_block = X.clip("ratio_bloqueo", hi=1.0)
    s_flow = F.when(f < 0, 1.0).when(f < 100, 0.5).otherwise(0.1)
    s_trend = F.when(t < -50, 1.0).when(t < 0, 0.5).otherwise(0.1)
    credit = F.coalesce(F.col("credito"), _lit(0.0))
    mult = F.when(credit == 1, _lit(OD_CREDIT_MULTIPLIER)).otherwise(_lit(1.0))
    w = OD_WEIGHTS
    comp = (_lit(w[0]) * s_ratio + _lit(w[1]) * s_block + _lit(w[2]) * s_flow + _lit(w[3]) * s_trend) * mult
    score = X.clip(comp * 100, lo=0.0, hi=100.0)
    return last.select("v_ah_cliente", "v_ah_cuenta", score.alias("score_raw"),
                       X.rnd(score, 2).alias("overindebtedness_score"),
                       (score >= OD_FLAG).cast("int").alias("is_overindebted"),
                       "flujo_neto", "ratio_ingreso_egreso", "ratio_bloqueo", credit.alias("tiene_credito"))


def overdebt_metrics(od: DataFrame) -> DataFrame:
    """Totals, share, mean/median (unrounded) and the 4-band distribution."""
    s = F.col("score_raw")
    med = R.quantile_row(od, {"score_raw": [0.5]})
    bands = []
    for name, lo, hi in OD_BANDS:
        cond = _lit(True)
        if lo is not None:
            cond = cond & (s >= lo)
        if hi is not None:
            cond = cond & (s < hi)
        bands.append(F.count_if(cond).alias(name))
    base = od.agg(F.count(F.lit(1)).alias("total_socios"), F.sum("is_overindebted").alias("socios_sobreendeudados"),
                  F.avg(s).alias("mean_score"), F.count_if(F.col("flujo_neto") < 0).alias("socios_flujo_negativo"),
                  *bands)
    n = F.col("total_socios")
    return (base.withColumn("median_score", X.one_row(med)["score_raw_q50"])
                .withColumn("pct_sobreendeudados",
                            F.when(n > 0, X.rnd(F.col("socios_sobreendeudados") / n * 100, 2)).otherwise(0.0)))


def top_overdebt(od: DataFrame, n: int = 20) -> DataFrame:
    """T3."""
    return (od.orderBy(F.col("overindebtedness_score").desc(), "v_ah_cliente", "v_ah_cuenta").limit(n)
              .select("v_ah_cliente", "overindebtedness_score", "flujo_neto", "ratio_ingreso_egreso"))


def over_indebtedness_adhoc_columns() -> dict[str, Column]:
    """R6 on a request row (no 0.4 tier, trend term fixed 0.3) with level; flag
    on the uncapped score."""
    ing = F.coalesce(F.col("ingresos"), _lit(0.0))
    egr = F.coalesce(F.col("egresos"), _lit(0.0))
    bloq = F.coalesce(F.col("monto_bloq"), _lit(0.0))
    saldo = F.coalesce(F.col("saldo_disponible"), _lit(0.0))
    cred = F.coalesce(F.col("credito"), _lit(0.0))
    ratio = ing / (egr + 1)
    flow = ing - egr
    rb = bloq / (saldo + 1)
    s_r = F.when(ratio < 1.0, 1.0).when(ratio < 1.2, 0.7).otherwise(0.1)
    s_b = F.least(rb, _lit(1.0))
    s_f = F.when(flow < 0, 1.0).when(flow < 100, 0.5).otherwise(0.1)
    mult = F.when(cred == 1, _lit(OD_CREDIT_MULTIPLIER)).otherwise(_lit(1.0))
    w = OD_WEIGHTS
    score = (_lit(w[0]) * s_r + _lit(w[1]) * s_b + _lit(w[2]) * s_f + _lit(w[3] * 0.3)) * mult * 100
    level = (F.when(score >= 80, "crítico").when(score >= 60, "alto").when(score >= 30, "medio").otherwise("bajo"))
    return {"overindebtedness_score": X.rnd(F.least(score, _lit(100.0)), 2), "is_overindebted": score >= OD_FLAG,
            "flujo_neto": flow, "ratio_ingreso_egreso": X.rnd(ratio, 4), "risk_level": level}


def over_indebtedness_adhoc(req: DataFrame) -> DataFrame:
    """R6 for a request table."""
    return req.select("v_ah_cliente", *[c.alias(n) for n, c in over_indebtedness_adhoc_columns().items()])


# ---------------------------------------------------------------------------
# Product / office / account-type risk
# ---------------------------------------------------------------------------

def group_risk(last: DataFrame) -> DataFrame:
    """A4 for the three dimensions in one pass (GROUPING SETS): rows per
    group, share, label rate, mean balance / idle, risk score; groups with
    fewer than 5 rows dropped; null keys dropped (pandas groupby)."""
    p75 = R.quantile_values(last, {"saldo_disponible": [0.75]})["saldo_disponible_q75"]
    total = last.agg(F.count(F.lit(1)).alias("_tot"))
    keyed = last.select(F.col("prod_bancario").cast("string").alias("prod_bancario"),
                        F.col("oficina_cta").cast("string").alias("oficina_cta"),
                        "tipo_cuenta", "riesgo_alto", "saldo_disponible", "dias_sin_movimiento")
    agg = (keyed.groupingSets([["prod_bancario"], ["oficina_cta"], ["tipo_cuenta"]],
                              "prod_bancario", "oficina_cta", "tipo_cuenta")
                .agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"), F.avg("riesgo_alto").alias("rate"),
                     F.avg("saldo_disponible").alias("avg_saldo"), F.avg("dias_sin_movimiento").alias("avg_inact")))
    dim = (F.when(F.col("gid") == 3, _lit("producto")).when(F.col("gid") == 5, _lit("oficina"))
            .otherwise(_lit("tipo_cuenta")))
    seg = F.coalesce(F.col("prod_bancario"), F.col("oficina_cta"), F.col("tipo_cuenta"))
    if p75 is None or p75 == 0:
        bal_term = F.when(F.col("avg_saldo") > 0, _lit(0.0)).otherwise(_lit(30.0))
    else:
        bal_term = (_lit(1.0) - F.least(F.col("avg_saldo") / _lit(float(p75)), _lit(1.0))) * 30
    risk = F.col("rate") * 40 + F.least(F.col("avg_inact") / 90, _lit(1.0)) * 30 + bal_term
    out = (agg.where(seg.isNotNull() & (F.col("n") >= GROUP_MIN_ROWS))
              .withColumn("_tot", X.one_row(total)["_tot"])
              .select(dim.alias("dimension"), seg.alias("segment"), F.col("n").alias("n_socios"),
                      X.rnd(F.col("n") / F.col("_tot") * 100, 2).alias("concentracion_pct"),
                      X.rnd(F.col("rate") * 100, 2).alias("tasa_riesgo"),
                      X.rnd("avg_saldo", 2).alias("avg_saldo"), X.rnd("avg_inact", 1).alias("avg_dias_inactivo"),
                      X.rnd(risk, 2).alias("risk_score")))
    return out


def hhi(groups: DataFrame) -> DataFrame:
    """A5: Herfindahl x 10 000 over the kept groups of product and office."""
    tot = F.sum("n_socios").over(Window.partitionBy("dimension"))
    shares = groups.where(F.col("dimension").isin("producto", "oficina")).select(
        "dimension", F.pow(F.col("n_socios") / tot, 2).alias("s2"))
    return shares.groupBy("dimension").agg(X.rnd(F.sum("s2") * 10000, 2).alias("hhi"))


def group_counts(groups: DataFrame) -> DataFrame:
    """Kept groups per dimension."""
    return groups.groupBy("dimension").agg(F.count(F.lit(1)).alias("n_groups"))


def _dim_order() -> Column:
    return (F.when(F.col("dimension") == "producto", 0).when(F.col("dimension") == "oficina", 1).otherwise(2))


def top_segments(groups: DataFrame, n: int = 10) -> DataFrame:
    """Segments of all three dimensions by risk score (stable order:
    dimension, then numeric/string key)."""
    key_num = F.expr("try_cast(segment as double)")
    return (groups.orderBy(F.col("risk_score").desc(), _dim_order(), key_num.asc_nulls_last(), "segment").limit(n))


def with_group_profiles(df: DataFrame, groups: DataFrame, dimensions=("producto", "oficina", "tipo_cuenta")) -> DataFrame:
    """Risk and rate columns of the row's groups (null when unknown)."""
    for dim, col, prefix in (("producto", "prod_bancario", "product"), ("oficina", "oficina_cta", "office"),
                             ("tipo_cuenta", "tipo_cuenta", "type")):
        if dim in dimensions:
            # one row per kept segment; AQE broadcasts it when its runtime size is small
            g = groups.where(F.col("dimension") == dim).select(
                F.col("segment").alias("_seg"), F.col("risk_score").alias(f"{prefix}_risk_score"),
                F.col("tasa_riesgo").alias(f"{prefix}_tasa_riesgo"))
            df = df.join(g, F.col(col).cast("string") == F.col("_seg"), "left").drop("_seg")
    return df


def group_profile_lookup(req: DataFrame, groups: DataFrame) -> DataFrame:
    """Product, office and account-type profile of each request, (0,0)
    when the group is unknown or was dropped."""
    out = with_group_profiles(req.select("v_ah_cliente", "prod_bancario", "oficina_cta", "tipo_cuenta"), groups)
    fills = {c: 0.0 for c in out.columns if c.endswith("_risk_score") or c.endswith("_tasa_riesgo")}
    return out.fillna(fills)


def segment_report(groups: DataFrame) -> DataFrame:
    """Product segments for the dashboard (score / 100), worst first."""
    return groups.where(F.col("dimension") == "producto").select(
        F.col("segment").alias("prod_bancario"), "n_socios", F.col("tasa_riesgo").alias("tasa_mora_pct"),
        (F.col("risk_score") / 100.0).alias("score_riesgo")).orderBy(F.col("score_riesgo").desc(), "prod_bancario")


def segment_tags(report: DataFrame) -> DataFrame:
    """Risk tag of a segment score."""
    s = F.col("score_riesgo")
    tag = F.when(s >= 0.8, "Crítico").when(s >= 0.5, "Alto").when(s >= 0.2, "Medio").otherwise("Bajo")
    return report.withColumn("risk_tag", tag)


# ---------------------------------------------------------------------------
# Collection-date optimisation
# ---------------------------------------------------------------------------

def collection_dates(df: DataFrame) -> DataFrame:
    """One grouped aggregate per client over all periods (mode of the
    last-movement day, activity windows, max deviation) + expressions."""
    g = df.groupBy("v_ah_cliente").agg(
        F.mode(F.dayofmonth(F.col("fecha_ultmov")), True).alias("_mode"),
        F.sum("v12h").alias("_v12"), F.sum("v24h").alias("_v24"), F.sum("v48h").alias("_v48"),
        F.max("desviacion_maxima").alias("desviacion_maxima"))
    day = F.coalesce(F.col("_mode"), _lit(DEFAULT_COLLECTION_DAY))
    window = (F.when(F.col("_v12") > 0, "12h").when(F.col("_v24") > 0, "24h").when(F.col("_v48") > 0, "48h")
               .otherwise("sin_actividad"))
    desfase = F.when(day <= 10, 0.2).when(day <= 20, 0.5).otherwise(0.8)
    suggested = F.when(day <= 10, _lit(5)).when(day <= 20, day + 3).otherwise(F.least(day + 5, _lit(28)))
    dev = F.coalesce(F.col("desviacion_maxima"), _lit(0.0))
    align = X.rnd(_lit(1.0) - desfase * 0.7 - F.least(dev / 30, _lit(1.0)) * 0.3, 4)
    return g.select("v_ah_cliente", day.cast("long").alias("dia_movimiento_predominante"),
                    window.alias("ventana_actividad"), X.rnd(desfase, 4).alias("desfase_score"),
                    F.greatest(_lit(0.0), align).alias("alignment_score"),
                    suggested.cast("long").alias("fecha_sugerida_cobro"), dev.alias("desviacion_maxima"))


def collection_day_histogram(dates: DataFrame) -> DataFrame:
    """Suggested-day and activity-window counts (long form)."""
    d = dates.groupBy(F.col("fecha_sugerida_cobro").cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("n_socios")).withColumn("distribution", _lit("day"))
    w = dates.groupBy(F.col("ventana_actividad").alias("value")).agg(
        F.count(F.lit(1)).alias("n_socios")).withColumn("distribution", _lit("window"))
    return d.unionByName(w)


def alignment_metrics(dates: DataFrame) -> DataFrame:
    """A20."""
    a = F.col("alignment_score")
    qs = R.quantile_row(dates, {"alignment_score": [0.25, 0.5, 0.75]})
    base = dates.agg(F.count(F.lit(1)).alias("total_socios"), X.rnd(F.avg(a), 4).alias("avg_alignment_score"),
                     F.count_if(a < 0.5).alias("socios_desalineados"),
                     F.mode(F.col("fecha_sugerida_cobro"), True).alias("dia_cobro_mas_comun"))
    n = F.col("total_socios")
    q = X.one_row(qs)
    return (base.withColumns({"alignment_score_q25": q["alignment_score_q25"], "alignment_score_q50": q["alignment_score_q50"],
                              "alignment_score_q75": q["alignment_score_q75"]})
                .withColumn("pct_desalineados",
                            F.when(n > 0, X.rnd(F.col("socios_desalineados") / n * 100, 2)).otherwise(0.0))
                .withColumnsRenamed({"alignment_score_q25": "p25", "alignment_score_q50": "p50",
                                     "alignment_score_q75": "p75"}))


def bottom_alignment(dates: DataFrame, n: int = 20) -> DataFrame:
    """T5."""
    return (dates.orderBy("alignment_score", "v_ah_cliente").limit(n)
                 .select("v_ah_cliente", "alignment_score", "dia_movimiento_predominante", "fecha_sugerida_cobro"))


def collection_date_lookup(req: DataFrame, dates: DataFrame) -> DataFrame:
    """J4 + R9: stored suggestion, else day 15 / alignment 0.5."""
    j = req.select("v_ah_cliente").join(dates.select("v_ah_cliente", "fecha_sugerida_cobro", "alignment_score",
                                                      "dia_movimiento_predominante"), "v_ah_cliente", "left")
    known = F.col("fecha_sugerida_cobro").isNotNull()
    return j.select("v_ah_cliente", known.alias("from_history"),
                    F.coalesce(F.col("fecha_sugerida_cobro"), _lit(DEFAULT_COLLECTION_DAY)).alias("fecha_sugerida_cobro"),
                    F.coalesce(F.col("alignment_score"), _lit(DEFAULT_ALIGNMENT)).alias("alignment_score"),
                    "dia_movimiento_predominante")


# ---------------------------------------------------------------------------
# Family impact
# ---------------------------------------------------------------------------

def dependents(age: Column, civil: Column) -> Column:
    """Estimated dependents from civil status and age (null age -> no
    age bracket)."""
    e = age
    cs = F.upper(civil)
    partner = F.when(cs.isin("C", "U"), _lit(1.0)).otherwise(_lit(0.0))
    bracket = (F.when((e >= 25) & (e <= 35), 1.5).when((e > 35) & (e <= 50), 2.0)
                .when((e > 50) & (e <= 65), 1.0).when(e > 65, 0.3).otherwise(0.0))
    single = F.when((e >= 30) & (e <= 50), 0.5).otherwise(0.0)
    kids = F.when(cs.isin("C", "U", "D", "V"), bracket).when(cs == "S", single).otherwise(_lit(0.0))
    return X.rnd(partner + F.coalesce(kids, _lit(0.0)), 1)


def family_impact(last: DataFrame) -> DataFrame:
    """R11 per latest-period row."""
    ing = F.coalesce(F.col("ingresos"), _lit(0.0))
    egr = F.coalesce(F.col("egresos"), _lit(0.0))
    dep = F.col("estimated_dependents")
    factor = F.greatest(_lit(FAMILY_MIN_FACTOR), _lit(1.0) - dep * FAMILY_REDUCTION_PER_DEPENDENT)
    adj = ing * factor
    vul = F.least(_lit(100.0), dep * 20 + F.when((ing < 500) & (dep > 1), _lit(30.0)).otherwise(_lit(0.0)))
    base = last.withColumn("estimated_dependents", dependents(F.col("edad"), F.col("estado_civil")))
    return base.select("v_ah_cliente", "v_ah_cuenta", X.rnd(ing, 2).alias("ingresos_original"), dep,
                       X.rnd(factor, 4).alias("adjustment_factor"), X.rnd(adj, 2).alias("ingreso_ajustado"),
                       X.rnd(adj - egr, 2).alias("flujo_ajustado"), X.rnd(vul, 2).alias("vulnerability_score"),
                       F.coalesce(F.col("estado_civil"), _lit("")).alias("estado_civil"), "edad",
                       F.coalesce(F.col("sexo"), _lit("")).alias("sexo"))


def family_metrics(fam: DataFrame) -> DataFrame:
    """A21."""
    n = F.col("total_socios")
    base = fam.agg(F.count(F.lit(1)).alias("total_socios"),
                   X.rnd(F.avg("estimated_dependents"), 2).alias("avg_estimated_dependents"),
                   X.rnd(F.avg("adjustment_factor"), 4).alias("avg_adjustment_factor"),
                   X.rnd(F.avg("vulnerability_score"), 2).alias("avg_vulnerability_score"),
                   F.count_if(F.col("vulnerability_score") >= FAMILY_HIGH_VULNERABILITY).alias("high_vulnerability_count"))
    return base.withColumn("pct_high_vulnerability",
                           F.when(n > 0, X.rnd(F.col("high_vulnerability_count") / n * 100, 2)).otherwise(0.0))


def dependents_histogram(fam: DataFrame) -> DataFrame:
    """A22."""
    d = F.col("estimated_dependents")
    return fam.agg(F.count_if(d == 0).alias("0_deps"), F.count_if((d > 0) & (d <= 1)).alias("1_dep"),
                   F.count_if((d > 1) & (d <= 2)).alias("2_deps"), F.count_if(d > 2).alias("3_plus_deps"))


def impact_by_civil_status(fam: DataFrame) -> DataFrame:
    """A23."""
    return fam.groupBy("estado_civil").agg(
        F.count(F.lit(1)).alias("n_socios"), X.rnd(F.avg("estimated_dependents"), 2).alias("avg_dependents"),
        X.rnd(F.avg("adjustment_factor"), 4).alias("avg_factor"),
        X.rnd(F.avg("vulnerability_score"), 2).alias("avg_vulnerability"))


def top_vulnerable(fam: DataFrame, n: int = 20) -> DataFrame:
    """T4."""
    return (fam.orderBy(F.col("vulnerability_score").desc(), "v_ah_cliente", "v_ah_cuenta").limit(n)
               .select("v_ah_cliente", "vulnerability_score", "estimated_dependents", "adjustment_factor",
                       "ingresos_original", "ingreso_ajustado"))


def family_impact_adhoc_columns() -> dict[str, Column]:
    """R12 on a request row (no +30 term)."""
    ing = F.coalesce(F.col("ingresos"), _lit(0.0))
    dep = dependents(F.coalesce(F.col("edad"), _lit(0.0)), F.coalesce(F.col("estado_civil"), _lit("S")))
    factor = F.greatest(_lit(FAMILY_MIN_FACTOR), _lit(1.0) - dep * FAMILY_REDUCTION_PER_DEPENDENT)
    return {"estimated_dependents": dep, "adjustment_factor": X.rnd(factor, 4), "ingreso_original": X.rnd(ing, 2),
            "ingreso_ajustado": X.rnd(ing * factor, 2), "vulnerability_score": X.rnd(F.least(_lit(100.0), dep * 20), 2)}


def family_impact_adhoc(req: DataFrame) -> DataFrame:
    """R12 for a request table."""
    return req.select("v_ah_cliente", *[c.alias(n) for n, c in family_impact_adhoc_columns().items()])
