"""Machine-learning data operators and models.

Deterministic parts are exact and oracle-checked: the md5-seeded stratified
split, the md5-seeded random over-sampling, confusion-matrix metrics and
rank-sum AUC, standardisation and cluster naming. Fitted models use
``pyspark.ml`` (RandomForest + LogisticRegression soft vote, K-means with a
silhouette search); their outputs are checked rows-only.

Seeded draws: ``draw(tag, i)`` = first 8 hex digits of md5('42|tag|i') / 2^32,
identical in Spark and DuckDB, so sampling is reproducible across engines and
independent of partitioning.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memberrisk.functions import exprs as X
from memberrisk.functions import ranking as R
from memberrisk.operators import clustering, neighbours

SEED = 42
# Fixed values of the source system: split, model and segment settings and the segments' texts.
TEST_SIZE = 0.25
GRADE_CUTS = ((800, "A"), (650, "B"), (500, "C"), (350, "D"))
RF_PARAMS = {"numTrees": 200, "maxDepth": 12, "minInstancesPerNode": 5, "seed": SEED}
LR_C = 1.0
LR_MAX_ITER = 1000
K_RANGE = (3, 8)
KMEANS_RESTARTS = 10
KMEANS_MAX_ITER = 300
DEFAULT_K = 4
CLUSTER_NAMES = ("Recuperable fácil", "Negociación", "Pre-jurídico", "Castigo potencial")
COLLECTION_STRATEGIES = {
    "Recuperable fácil": "Recordatorio SMS/email + llamada amable. Alta probabilidad de pago voluntario.",
    "Negociación": "Contacto personalizado + oferta de reestructuración. Socio con capacidad pero requiere flexibilidad.",
    "Pre-jurídico": "Notificación formal + visita domiciliaria. Riesgo medio-alto, requiere acción inmediata.",
    "Castigo potencial": "Escalamiento a jurídico. Análisis de garantías. Provisión completa recomendada.",
}
DEFAULT_STRATEGY = "Análisis individual requerido."
CHANNELS = {"Recuperable fácil": "whatsapp", "Negociación": "llamada", "Pre-jurídico": "llamada",
            "Castigo potencial": "legal"}
DEFAULT_CHANNEL = "llamada"


SPLIT_DIGITS = 4  # of the md5 key, counted to find a class's cut-off


def draw(tag: str, i: Column) -> Column:
    """Uniform [0, 1) draw from md5('42|tag|i')."""
    h = F.md5(F.concat_ws("|", F.lit(str(SEED)), F.lit(tag), i.cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def split_key() -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(SEED)), F.col("v_ah_cuenta").cast("string"), F.col("periodo")))


# --- M1 / M3 / M4 / A33 -----------------------------------------------------------

def stratified_split(df: DataFrame, label: str = "riesgo_alto", test_size: float = TEST_SIZE) -> DataFrame:
    """M1: in each class the round-half-even(test_size x n_class) rows with
    the smallest (md5 key, account, period) form the test set (exact strata).

    The rows do not move: the class's cut-off key is found by counting the
    first four digits of the keys and ranking only the rows of the digits that
    hold it, and each row is compared with that key."""
    order = ("_k", "v_ah_cuenta", "periodo")
    keyed = df.withColumn("_k", split_key())
    narrow = keyed.select(label, *order).withColumn("_p", F.substring("_k", 1, SPLIT_DIGITS))
    digits = narrow.groupBy(label, "_p").agg(F.count(F.lit(1)).alias("_n"))  # at most 16**4 rows a class
    one = Window.partitionBy(label)
    digits = digits.select(
        label, "_p", "_n", F.sum("_n").over(one).alias("_total"),
        F.coalesce(F.sum("_n").over(one.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    n_test = X.rnd(F.col("_total") * test_size, 0)
    holds = R.materialize_small(digits.where((F.col("_before") < n_test) & (n_test <= F.col("_before") + F.col("_n")))
                                .select(label, "_p", (n_test - F.col("_before")).alias("_rank")))  # one row a class
    near = X.join_null_safe(narrow, F.broadcast(holds), [label, "_p"], "inner")
    rank = F.row_number().over(Window.partitionBy(label).orderBy(*order))
    cut = R.materialize_small(near.withColumn("_rk", rank).where(F.col("_rk") == F.col("_rank"))
                              .select(label, F.struct(*order).alias("_cut")))
    out = X.join_null_safe(keyed, F.broadcast(cut), [label])
    test = F.coalesce(F.struct(*order) <= F.col("_cut"), F.lit(False))
    return out.withColumn("split", F.when(test, "test").otherwise("train")).drop("_k", "_cut")


def class_counts(df: DataFrame, label: str = "riesgo_alto", by: str | None = None) -> DataFrame:
    """A33."""
    keys = [by, label] if by else [label]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))


def random_oversample(train: DataFrame, label: str = "riesgo_alto") -> DataFrame:
    """M3: add (n_majority - n_minority) copies of minority rows picked by
    seeded draws: copy i takes minority row floor(draw('base', i) * m) in
    (account, period) order. Minority = smaller class (ties: label 1)."""
    spark = train.sparkSession
    counts = {r[label]: r["n"] for r in train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return train.withColumn("is_synthetic", F.lit(False)).withColumn("source_rank", F.lit(None).cast("long"))
    minority = min(counts, key=lambda c: (counts[c], -c))
    majority = max(counts, key=lambda c: (counts[c], -c))
    m, need = counts[minority], counts[majority] - counts[minority]
    base = train.withColumn("is_synthetic", F.lit(False)).withColumn("source_rank", F.lit(None).cast("long"))
    if need <= 0:
        return base
    rows = train.where(F.col(label) == minority)
    keys = [c for c in ("v_ah_cliente", "v_ah_cuenta", "periodo") if c in train.columns]
    mins = R.row_number(rows.select(*keys), ["v_ah_cuenta", "periodo"], out="_rn")  # keys alone are ranked
    picks = spark.range(need).select((F.floor(draw("base", F.col("id")) * m) + 1).cast("long").alias("_rn"))
    drawn = picks.join(mins, "_rn").withColumn("_src", F.col("_rn") - 1).drop("_rn")
    copies = (X.join_null_safe(drawn, rows, keys, "inner").withColumn("is_synthetic", F.lit(True))
              .withColumnRenamed("_src", "source_rank"))
    return base.unionByName(copies.select(*base.columns))


def balanced_dataset(df: DataFrame, label: str = "riesgo_alto") -> DataFrame:
    """M4: one frame with ``split`` and ``is_synthetic``: the test split as is,
    the train split balanced by M3."""
    split = stratified_split(df, label)
    test = split.where(F.col("split") == "test").withColumn("is_synthetic", F.lit(False)) \
                .withColumn("source_rank", F.lit(None).cast("long"))
    train = random_oversample(split.where(F.col("split") == "train"), label)
    return train.unionByName(test.select(*train.columns))


# --- M8 / M9 / M11 -------------------------------------------------------------------

def binary_metrics(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """M8: accuracy, precision, recall, F1 (zero division -> 0) and ROC AUC by
    the rank-sum formula with average ranks (ties). One pass over the input:
    everything follows from the class counts of each distinct score."""
    y = F.col(label)
    hist = R.materialize_small(df.groupBy(F.col(score).alias("_s")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(y == 1).alias("_p"), F.count_if(y == 0).alias("_z")))
    yes, no = F.col("_s") >= threshold, F.col("_s") < threshold

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).cast("long")

    conf = hist.agg(total(F.col("_n")).alias("n"), total(F.when(yes, F.col("_p"))).alias("tp"),
                    total(F.when(yes, F.col("_z"))).alias("fp"), total(F.when(no, F.col("_p"))).alias("fn"),
                    total(F.when(no, F.col("_z"))).alias("tn"), total(F.col("_p")).alias("_np"), total(F.col("_z")).alias("_nn"))
    ranked = R.rank_counts(hist.where(F.col("_s").isNotNull()), "_s", [], "_n")
    ranks = ranked.agg(F.sum(F.col("_p") * (F.col("_mr_before") + (F.col("_n") + 1) / F.lit(2.0))).alias("_sum"))
    auc_v = F.when((F.col("_np") > 0) & (F.col("_nn") > 0),
                   (F.col("_sum") - F.col("_np") * (F.col("_np") + 1) / 2.0) / (F.col("_np") * F.col("_nn")))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    f1 = F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)
    return conf.withColumn("_sum", X.one_row(ranks)["_sum"]).select(
        "n", "tp", "fp", "fn", "tn", F.when(F.col("n") > 0, (tp + F.col("tn")) / F.col("n")).alias("accuracy"),
        precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), auc_v.alias("auc_roc"))


def class_report(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """M9: per-class precision/recall/F1/support, macro and weighted averages,
    all from one count of (label, prediction)."""
    counts = R.materialize_small(df.groupBy(F.col(label).alias("y"), (F.col(score) >= threshold).cast("int").alias("pred"))
                                 .agg(F.count(F.lit(1)).alias("n")))  # a row a combination
    y, pred = F.col("y"), F.col("pred")
    rows = []
    for c in (0, 1):
        total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
        rows.append(counts.agg(F.lit(str(c)).alias("class"), total((pred == c) & (y == c)).alias("tp"),
                               total(pred == c).alias("pp"), total(y == c).alias("support")))
    per = rows[0].unionByName(rows[1])
    per = per.select(
        "class", "support",
        F.when(F.col("pp") > 0, F.col("tp") / F.col("pp")).otherwise(0.0).alias("precision"),
        F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0).alias("recall"),
        F.when(F.col("pp") + F.col("support") > 0, 2 * F.col("tp") / (F.col("pp") + F.col("support")))
         .otherwise(0.0).alias("f1"))
    tot = F.sum("support")
    macro = per.agg(F.lit("macro avg").alias("class"), tot.alias("support"), F.avg("precision").alias("precision"),
                    F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))
    weighted = per.agg(F.lit("weighted avg").alias("class"), tot.alias("support"),
                       *[F.when(tot > 0, F.sum(F.col(m) * F.col("support")) / tot).alias(m) for m in ("precision", "recall", "f1")])
    return per.unionByName(macro).unionByName(weighted)


def grade(score: Column) -> Column:
    out = F.lit("E")
    for cut, g in reversed(GRADE_CUTS):
        out = F.when(score >= cut, F.lit(g)).otherwise(out)
    return out


def score_grade(p_no_risk: Column) -> tuple[Column, Column]:
    """score = round-half-even(P(no risk) x 1000), grade A..E."""
    s = X.rnd(p_no_risk * 1000, 0).cast("long")
    return s, grade(s)


def risk_level(score: Column) -> Column:
    """M12 level: alto < 350 <= medio < 650 <= bajo."""
    return F.when(score < 350, "alto").when(score < 650, "medio").otherwise("bajo")


# --- M13 / M17 -------------------------------------------------------------------------

def standardize(df: DataFrame, columns: list[str], like: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population std (std 0 -> 1) of ``like`` (default: the
    rows themselves); one aggregate pass, its one row a scalar subquery."""
    stats = (df if like is None else like).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns],
                                               *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    st = X.one_row(stats)
    scaled = {c: (F.col(c) - st[f"_m_{c}"]) / F.coalesce(F.when(st[f"_s_{c}"] != 0, st[f"_s_{c}"]), F.lit(1.0))
              for c in columns}
    return df.withColumns(scaled)


def cluster_naming(scaled: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Clusters ranked by -mean(scaled effective balance) + mean(scaled
    idle days), best first; the first four get the strategy names, the rest
    ``Segmento i``. Ties by cluster id."""
    scores = scaled.groupBy(cluster).agg(
        (-F.avg("saldo_efectivo") + F.avg("dias_sin_movimiento")).alias("cluster_score"))
    ranked = scores.withColumn("_pos", F.row_number().over(Window.orderBy("cluster_score", cluster)))  # a row a cluster
    names = F.array(*[F.lit(n) for n in CLUSTER_NAMES])
    name = F.when(F.col("_pos") <= len(CLUSTER_NAMES), F.element_at(names, F.col("_pos").cast("int"))) \
            .otherwise(F.concat(F.lit("Segmento "), F.col("_pos").cast("string")))
    return ranked.select(cluster, "cluster_score", F.col("_pos").alias("rank"), name.alias("cluster_name"))


#: The dashboard's channels and the segments that each counts.
CHANNEL_NAMES = ("whatsapp", "llamada", "legal")


def channel_counts(named: DataFrame) -> DataFrame:
    """Members per collection channel. Only the four named segments count;
    a channel without members has 0."""
    cells = F.array(*[F.struct(F.lit(ch).alias("channel"), F.count_if(F.col("cluster_name").isin(
        *[n for n in CLUSTER_NAMES if CHANNELS[n] == ch])).alias("n_socios")) for ch in CHANNEL_NAMES])
    return named.agg(cells.alias("c")).select(F.explode("c").alias("c")).select("c.*")


def cluster_profiles(named: DataFrame) -> DataFrame:
    """Size, share and raw means of each named cluster."""
    total = X.one_row(named.agg(F.count(F.lit(1)).alias("n")))["n"]
    return (named.groupBy("cluster_id", "cluster_name").agg(
        F.count(F.lit(1)).alias("n_socios"), X.rnd(F.avg("saldo_disponible"), 2).alias("avg_saldo"),
        X.rnd(F.avg("ingresos"), 2).alias("avg_ingresos"), X.rnd(F.avg("raw_idle_days"), 1).alias("avg_dias_inactivo"))
        .withColumn("pct_total", X.rnd(F.col("n_socios") / total * 100, 1))
        .withColumn("strategy", strategy(F.col("cluster_name"))))


def strategy(name: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in COLLECTION_STRATEGIES.items() for x in kv])
    return F.coalesce(F.element_at(m, name), F.lit(DEFAULT_STRATEGY))


def channel(name: Column) -> Column:
    """Collection channel by segment name (accented names, Q3)."""
    m = F.create_map(*[F.lit(x) for kv in CHANNELS.items() for x in kv])
    return F.coalesce(F.element_at(m, name), F.lit(DEFAULT_CHANNEL))


# --- fitted models (rows-only) -------------------------------------------------------

def assemble(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="keep").transform(df)


def fit_credit_model(train: DataFrame, columns: list[str], label: str = "riesgo_alto"):
    """M5 + M6: random forest and L2 logistic regression (unscaled inputs,
    regParam = 1 / (C x n_train)) on the balanced training rows, fitted side by side."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    data = assemble(train, columns).select("features", F.col(label).cast("double").alias("label"))
    data = R.materialize_small(data)
    n = data.count()
    # Each row keeps its node in every tree, so a level takes one step in a tree and not the way from its root.
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", probabilityCol="p_rf", rawPredictionCol="raw_rf",
                                    predictionCol="pred_rf", cacheNodeIds=True, checkpointInterval=-1, **RF_PARAMS)
    regression = LogisticRegression(featuresCol="features", labelCol="label", probabilityCol="p_lr",
                                    rawPredictionCol="raw_lr", predictionCol="pred_lr", maxIter=LR_MAX_ITER,
                                    regParam=1.0 / (LR_C * max(n, 1)), elasticNetParam=0.0,
                                    standardization=False)
    with ThreadPoolExecutor(2) as pool:  # the regression's passes are many and short, the forest's few and long
        lr, rf = [f.result() for f in [pool.submit(regression.fit, data), pool.submit(forest.fit, data)]]
    return rf, lr


def score_credit(df: DataFrame, models, columns: list[str]) -> DataFrame:
    """M7 + M11 + M12: soft vote of both probability vectors, score 0-1000
    from P(no risk), grade and level."""
    from pyspark.ml.functions import vector_to_array
    rf, lr = models
    scored = lr.transform(rf.transform(assemble(df, columns)))
    p1 = (vector_to_array("p_rf")[1] + vector_to_array("p_lr")[1]) / 2.0
    scored = scored.withColumn("probability_default", p1)
    s, g = score_grade(F.lit(1.0) - F.col("probability_default"))
    return (scored.withColumn("score", s).withColumn("grade", g)
                  .withColumn("prediction", (F.col("probability_default") > 0.5).cast("int"))
                  .withColumn("risk_level", risk_level(F.col("score")))
                  .drop("features", "p_rf", "raw_rf", "pred_rf", "p_lr", "raw_lr", "pred_lr"))


def feature_importances(rf, columns: list[str], spark, n: int = 10) -> DataFrame:
    """Forest importances as a small table (one row per feature)."""
    imp = rf.featureImportances.toArray().tolist()
    df = spark.createDataFrame([(c, float(v)) for c, v in zip(columns, imp)], "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), "feature").limit(n)


def kmeans_search(features: DataFrame, columns: list[str], k_range=K_RANGE, restarts: int = KMEANS_RESTARTS,
                  max_iter: int = KMEANS_MAX_ITER):
    """All k and restarts in one search (``clustering.search``). Returns
    (best ``Centres``, a row a k with silhouette, its standard error and inertia)."""
    best, table, _ = clustering.search(features, columns, range(k_range[0], k_range[1] + 1), restarts, max_iter, SEED, DEFAULT_K)
    return best, table


# --- M2: SMOTE -------------------------------------------------------------------------

SMOTE_K = 5
SMOTE_SLICE = 250_000  # synthetic rows that a task puts in order, from so many a core on


def minority_knn(points: DataFrame, columns: list[str], k: int, queries: DataFrame | None = None) -> DataFrame:
    """Exact k nearest neighbours (squared Euclidean, ties by id) of the query
    ids (default: all) among the points (``_id`` + features), however many."""
    near = neighbours.nearest(points, columns, k)
    return near if queries is None else near.join(queries.select("_id"), "_id", "left_semi")


def smote(train: DataFrame, columns: list[str], label: str = "riesgo_alto", k: int = SMOTE_K) -> DataFrame:
    """M2: synthetic minority rows until both classes are equal. Synthetic i
    takes base row floor(draw('base', i) * m) of the m rows of the minority class
    (in account, period order), its neighbour of rank 1 + floor(draw('nn', i) * k)
    and gap u = draw('u', i): x + u * (nn - x) on every feature.
    k is reduced to m - 1 when the minority class is small; fewer than 2
    minority rows give no synthetic rows (M3 is the fallback). Returns the
    synthetic rows only (synthetic index, base and neighbour ids, feature
    columns, label)."""
    spark = train.sparkSession
    counts = {r[label]: r["n"] for r in train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    shape = "synthetic_id long, base_id long, nn_id long, " + ", ".join(f"`{c}` double" for c in columns)
    if len(counts) < 2:
        return spark.createDataFrame([], shape + f", `{label}` int")
    minority = min(counts, key=lambda c: (counts[c], -c))
    majority = max(counts, key=lambda c: (counts[c], -c))
    need, m = counts[majority] - counts[minority], counts[minority]
    if need <= 0 or m < 2:
        return spark.createDataFrame([], shape + f", `{label}` int")
    k = min(k, m - 1)
    inner = [f"_x{i}" for i in range(len(columns))]
    rows = train.where(F.col(label) == minority).select(
        "v_ah_cuenta", "periodo", *[F.col(c).cast("double").alias(x) for c, x in zip(columns, inner)])
    pts = R.materialize_small(R.row_number(rows, ["v_ah_cuenta", "periodo"], out="_rn")
                              .select((F.col("_rn") - 1).alias("_id"), *inner))
    near = minority_knn(pts, inner, k).select("_id", "nn_rank", "nn_id")
    i = F.col("id")
    picks = spark.range(need).select(
        i.alias("_syn"), F.floor(draw("base", i) * m).cast("long").alias("_id"),
        (F.floor(draw("nn", i) * k) + 1).cast("int").alias("nn_rank"), draw("u", i).alias("_u"))
    # The neighbours' features go to the pairs, then pairs and picks meet at the base row.
    other = pts.select(F.col("_id").alias("nn_id"), F.array(*inner).alias("_y"))
    pairs = R.materialize_small(near.join(other, "nn_id").join(pts.select("_id", F.array(*inner).alias("_x")), "_id"))
    made = [(F.col("_x")[j] + F.col("_u") * (F.col("_y")[j] - F.col("_x")[j])).alias(c) for j, c in enumerate(columns)]
    # In slices of the index, each in order: what is fitted from the rows does not hang on how the joins ran.
    slices = max(spark.sparkContext.defaultParallelism, need // SMOTE_SLICE)
    at = F.expr(f"CAST(((synthetic_id + 1) * {slices}L - 1) DIV {need}L AS INT)")
    return (picks.join(pairs, ["_id", "nn_rank"])
            .select(F.col("_syn").alias("synthetic_id"), F.col("_id").alias("base_id"), "nn_id", *made)
            .repartitionById(slices, at).sortWithinPartitions("synthetic_id")
            .withColumn(label, F.lit(minority).cast(train.schema[label].dataType)))
