"""Registered ML queries: exact data operators (oracle-checked) and fitted
models (rows-only)."""

from __future__ import annotations

from pyspark.sql import functions as F

from memberrisk.operators import bundle as B
from memberrisk.operators import features as FE
from memberrisk.operators import ml as M
from memberrisk.plans import q_analyzers as QA
from memberrisk.plans.q_prepare import CLUSTER_FEATURES
from memberrisk.plans.registry import REGISTRY, register

KEYS = ["v_ah_cliente", "v_ah_cuenta", "periodo"]


def split(h):
    return h.memo("split", lambda: M.stratified_split(h.featured()))


def balanced(h):
    return h.memo("balanced", lambda: M.balanced_dataset(h.featured()))


def model_columns(h):
    return FE.feature_columns(h.featured())


def smote_train(h):
    """Training split + SMOTE synthetic minority rows on every model column
    (the balanced training set of the source system)."""
    def build():
        cols = model_columns(h)
        train = FE.scrub_features(split(h).where(F.col("split") == "train"), cols)
        syn = M.smote(train, cols)
        return (train.select(*cols, "riesgo_alto").withColumn("is_synthetic", F.lit(False))
                .unionByName(syn.select(*cols, "riesgo_alto").withColumn("is_synthetic", F.lit(True))))
    return h.memo("smote_train", build)


def credit_models(h):
    return h.memo("credit_models", lambda: M.fit_credit_model(smote_train(h), model_columns(h)))


def credit_scores(h):
    def build():
        cols = model_columns(h)
        test = FE.scrub_features(split(h).where(F.col("split") == "test"), cols)
        return M.score_credit(test, credit_models(h), cols)
    return h.memo("credit_scores", build)


def scaled_last(h):
    def build():
        last = FE.scrub_features(h.last_period(), CLUSTER_FEATURES)
        last = last.select(*KEYS, "prod_bancario", "saldo_disponible", "ingresos",
                           F.col("dias_sin_movimiento").alias("raw_idle_days"), *CLUSTER_FEATURES)
        return M.standardize(last, CLUSTER_FEATURES)
    return h.memo("scaled_last", build)


def with_member_features(df, cols):
    """Model inputs of a request row: its own fields over the member's stored
    row (struct ``member`` of ``decide.assess``), nulls and non-finite -> 0."""
    own = set(df.columns)
    stored = set(df.schema["member"].dataType.fieldNames())
    new = {c: F.coalesce(*([F.col(c).cast("double")] if c in own else []),
                         *([F.col(f"member.{c}").cast("double")] if c in stored else [F.lit(None).cast("double")])) for c in cols}
    return FE.scrub_features(df.withColumns(new), cols)


def score_requests(h, df):
    """M12 on rows that hold the model columns."""
    return M.score_credit(df, credit_models(h), model_columns(h))


def assign_requests(h, df):
    """Each request's cluster by its own features, scaled like the members'."""
    model, _ = kmeans(h)
    raw = FE.scrub_features(h.last_period(), CLUSTER_FEATURES)
    rows = with_member_features(df, CLUSTER_FEATURES)
    kept = rows.withColumns({f"_raw_{c}": F.col(c) for c in CLUSTER_FEATURES})
    scaled = M.standardize(kept, CLUSTER_FEATURES, like=raw)
    pred = model.assign(scaled)
    pred = pred.drop(*CLUSTER_FEATURES).withColumnsRenamed({f"_raw_{c}": c for c in CLUSTER_FEATURES})
    names = clusters(h).select("cluster_id", "cluster_name").distinct()
    return pred.join(F.broadcast(names), "cluster_id", "left")  # a row a cluster


def kmeans(h):
    return h.memo("kmeans", lambda: M.kmeans_search(scaled_last(h), CLUSTER_FEATURES))


def clusters(h):
    """Latest-period members with cluster id and name (best K-means model)."""
    def build():
        model, _ = kmeans(h)
        pred = model.assign(scaled_last(h))
        names = M.cluster_naming(pred)
        return pred.join(F.broadcast(names.select("cluster_id", "cluster_name")), "cluster_id")
    return h.memo("clusters", build)


def bundle(h) -> B.Bundle:
    """The fitted models as a bundle."""
    def build():
        rf, lr = credit_models(h)
        best, _ = kmeans(h)
        names = {r["cluster_id"]: r["cluster_name"] for r in clusters(h).select("cluster_id", "cluster_name").distinct().collect()}
        raw = FE.scrub_features(h.last_period(), CLUSTER_FEATURES)
        return B.Bundle(model_columns(h), rf, lr, best, B.moments(raw, CLUSTER_FEATURES), names)
    return h.memo("bundle", build)


ML_CTES = {
    "sp_keyed": """SELECT v_ah_cliente, v_ah_cuenta, periodo, riesgo_alto,
                md5('42|' || CAST(v_ah_cuenta AS VARCHAR) || '|' || periodo) AS k FROM featured""",
    "split": """SELECT v_ah_cliente, v_ah_cuenta, periodo, riesgo_alto,
                CASE WHEN row_number() OVER (PARTITION BY riesgo_alto ORDER BY k, v_ah_cuenta, periodo)
                          <= round_even(count(*) OVER (PARTITION BY riesgo_alto) * 0.25, 0)
                     THEN 'test' ELSE 'train' END AS split FROM sp_keyed""",
    "tr": "SELECT * FROM split WHERE split = 'train'",
    "cls": "SELECT riesgo_alto, count(*) AS n FROM tr GROUP BY riesgo_alto",
    "mino": "SELECT riesgo_alto AS c, n FROM cls ORDER BY n, riesgo_alto DESC LIMIT 1",
    "majo": "SELECT riesgo_alto AS c, n FROM cls ORDER BY n DESC, riesgo_alto LIMIT 1",
    "mins": """SELECT t.*, row_number() OVER (ORDER BY v_ah_cuenta, periodo) - 1 AS rn0 FROM tr t
                WHERE riesgo_alto = (SELECT c FROM mino) AND (SELECT count(*) FROM cls) > 1""",
    "picks": """SELECT CAST(floor(CAST(('0x' || substr(md5('42|base|' || CAST(i AS VARCHAR)), 1, 8)) AS BIGINT)
                      / 4294967296.0 * (SELECT n FROM mino)) AS BIGINT) AS rn0
                FROM (SELECT unnest(range(CAST(greatest((SELECT majo.n - mino.n FROM majo, mino), 0) AS BIGINT))) AS i)""",
    "bal_train": """SELECT v_ah_cliente, v_ah_cuenta, periodo, riesgo_alto, split, false AS is_synthetic,
                CAST(NULL AS BIGINT) AS source_rank FROM tr
                UNION ALL
                SELECT m.v_ah_cliente, m.v_ah_cuenta, m.periodo, m.riesgo_alto, m.split, true, m.rn0
                FROM picks p JOIN mins m ON m.rn0 = p.rn0""",
    "bm_in": """SELECT e.v_ah_cliente, e.v_ah_cuenta, e.periodo, e.alert_score_raw AS s, f.riesgo_alto AS y
                FROM ew e JOIN featured f USING (v_ah_cliente, v_ah_cuenta, periodo)""",
    "sc_in": """SELECT v_ah_cliente, v_ah_cuenta, periodo, prod_bancario, """ + ", ".join(
        f"CASE WHEN isnan({c}) OR isinf({c}) OR {c} IS NULL THEN 0.0 ELSE CAST({c} AS DOUBLE) END AS {c}"
        for c in CLUSTER_FEATURES) + " FROM lastp",
    "scaled": "SELECT v_ah_cliente, v_ah_cuenta, periodo, prod_bancario, " + ", ".join(
        f"({c} - avg({c}) OVER ()) / coalesce(CASE WHEN stddev_pop({c}) OVER () <> 0 THEN stddev_pop({c}) OVER () END, 1.0)"
        f" AS {c}" for c in CLUSTER_FEATURES) + " FROM sc_in",
    "sil": "SELECT row_number() OVER (ORDER BY v_ah_cuenta, v_ah_cliente) AS id, prod_bancario, " + ", ".join(CLUSTER_FEATURES)
           + " FROM scaled WHERE prod_bancario IS NOT NULL",
}
CTES = {**QA.CTES, **ML_CTES}


def reg(name, sql, **kw):
    return register(name, sql, CTES, **kw)


@reg("stratified_split", "SELECT v_ah_cliente, v_ah_cuenta, periodo, riesgo_alto, split FROM split")
def q_stratified_split(h):
    return split(h).select(*KEYS, "riesgo_alto", "split")


@reg("class_counts", """SELECT 'train_before' AS stage, riesgo_alto, count(*) AS n_rows FROM tr GROUP BY riesgo_alto
    UNION ALL SELECT 'train_after', riesgo_alto, count(*) FROM bal_train GROUP BY riesgo_alto
    UNION ALL SELECT 'test', riesgo_alto, count(*) FROM split WHERE split = 'test' GROUP BY riesgo_alto""")
def q_class_counts(h):
    sp = split(h)
    before = M.class_counts(sp.where(F.col("split") == "train")).withColumn("stage", F.lit("train_before"))
    b = balanced(h)
    after = M.class_counts(b.where(F.col("split") == "train")).withColumn("stage", F.lit("train_after"))
    test = M.class_counts(sp.where(F.col("split") == "test")).withColumn("stage", F.lit("test"))
    return before.unionByName(after).unionByName(test)


@reg("random_oversample", """SELECT v_ah_cliente, v_ah_cuenta, periodo, riesgo_alto, is_synthetic, source_rank
    FROM bal_train""")
def q_random_oversample(h):
    return balanced(h).where(F.col("split") == "train").select(*KEYS, "riesgo_alto", "is_synthetic", "source_rank")


@reg("balanced_dataset", """SELECT v_ah_cliente, v_ah_cuenta, periodo, riesgo_alto, split, is_synthetic FROM bal_train
    UNION ALL SELECT v_ah_cliente, v_ah_cuenta, periodo, riesgo_alto, split, false FROM split WHERE split = 'test'""")
def q_balanced_dataset(h):
    return balanced(h).select(*KEYS, "riesgo_alto", "split", "is_synthetic")


def _bm_input(h):
    ew = QA.early_warning(h).select(*KEYS, "alert_score_raw")
    return ew.join(h.featured().select(*KEYS, "riesgo_alto"), KEYS)


@reg("binary_metrics", """SELECT count(*) AS n, count_if(s >= 0.5 AND y = 1) AS tp, count_if(s >= 0.5 AND y = 0) AS fp,
    count_if(s < 0.5 AND y = 1) AS fn, count_if(s < 0.5 AND y = 0) AS tn,
    (count_if(s >= 0.5 AND y = 1) + count_if(s < 0.5 AND y = 0)) / count(*) AS accuracy,
    CASE WHEN count_if(s >= 0.5) > 0 THEN count_if(s >= 0.5 AND y = 1) / count_if(s >= 0.5) ELSE 0.0 END AS precision,
    CASE WHEN count_if(y = 1) > 0 THEN count_if(s >= 0.5 AND y = 1) / count_if(y = 1) ELSE 0.0 END AS recall,
    CASE WHEN count_if(s >= 0.5) + count_if(y = 1) > 0
         THEN 2 * count_if(s >= 0.5 AND y = 1) / (count_if(s >= 0.5) + count_if(y = 1)) ELSE 0.0 END AS f1,
    CASE WHEN count_if(y = 1) > 0 AND count_if(y = 0) > 0 THEN
      (sum(CASE WHEN y = 1 THEN r END) - count_if(y = 1) * (count_if(y = 1) + 1) / 2.0)
        / (count_if(y = 1) * count_if(y = 0)) END AS auc_roc
    FROM (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM bm_in)""")
def q_binary_metrics(h):
    return M.binary_metrics(_bm_input(h), "riesgo_alto", "alert_score_raw")


@reg("class_report", """SELECT * FROM (WITH per AS (
      SELECT CAST(c AS VARCHAR) AS class, count_if(y = c) AS support,
        CASE WHEN count_if(p = c) > 0 THEN count_if(p = c AND y = c) / count_if(p = c) ELSE 0.0 END AS precision,
        CASE WHEN count_if(y = c) > 0 THEN count_if(p = c AND y = c) / count_if(y = c) ELSE 0.0 END AS recall,
        CASE WHEN count_if(p = c) + count_if(y = c) > 0
             THEN 2 * count_if(p = c AND y = c) / (count_if(p = c) + count_if(y = c)) ELSE 0.0 END AS f1
      FROM (SELECT y, CASE WHEN s >= 0.5 THEN 1 ELSE 0 END AS p FROM bm_in) CROSS JOIN (VALUES (0), (1)) AS cl(c)
      GROUP BY c)
    SELECT * FROM per
    UNION ALL SELECT 'macro avg', sum(support), avg(precision), avg(recall), avg(f1) FROM per
    UNION ALL SELECT 'weighted avg', sum(support), sum(precision * support) / sum(support),
                     sum(recall * support) / sum(support), sum(f1 * support) / sum(support) FROM per)""")
def q_class_report(h):
    return M.class_report(_bm_input(h), "riesgo_alto", "alert_score_raw")


@reg("score_grade", """SELECT v_ah_cliente, v_ah_cuenta, periodo, score,
    CASE WHEN score >= 800 THEN 'A' WHEN score >= 650 THEN 'B' WHEN score >= 500 THEN 'C' WHEN score >= 350 THEN 'D'
         ELSE 'E' END AS grade,
    CASE WHEN score < 350 THEN 'alto' WHEN score < 650 THEN 'medio' ELSE 'bajo' END AS risk_level
    FROM (SELECT *, CAST(round_even((1.0 - alert_score_raw) * 1000, 0) AS BIGINT) AS score FROM ew)""")
def q_score_grade(h):
    ew = QA.early_warning(h)
    s, g = M.score_grade(F.lit(1.0) - F.col("alert_score_raw"))
    return ew.select(*KEYS, s.alias("score"), g.alias("grade"), M.risk_level(s).alias("risk_level"))


@reg("standardize", "SELECT v_ah_cliente, v_ah_cuenta, " + ", ".join(CLUSTER_FEATURES) + " FROM scaled")
def q_standardize(h):
    return scaled_last(h).select("v_ah_cliente", "v_ah_cuenta", *CLUSTER_FEATURES)


@reg("cluster_naming", """SELECT cluster_id, cluster_score, rk AS rank,
    CASE rk WHEN 1 THEN 'Recuperable fácil' WHEN 2 THEN 'Negociación' WHEN 3 THEN 'Pre-jurídico'
            WHEN 4 THEN 'Castigo potencial' ELSE 'Segmento ' || CAST(rk AS VARCHAR) END AS cluster_name
    FROM (SELECT cluster_id, cluster_score, row_number() OVER (ORDER BY cluster_score, cluster_id) AS rk FROM (
      SELECT prod_bancario AS cluster_id, -avg(saldo_efectivo) + avg(dias_sin_movimiento) AS cluster_score
      FROM scaled GROUP BY prod_bancario))""")
def q_cluster_naming(h):
    return M.cluster_naming(scaled_last(h).withColumnRenamed("prod_bancario", "cluster_id"))


# --- fitted models: rows-only ------------------------------------------------------

@register("credit_model", kind="R")
def q_credit_model(h):
    return credit_scores(h).select(*KEYS, "riesgo_alto", "probability_default", "prediction", "score", "grade",
                                   "risk_level")


@register("credit_metrics", kind="R")
def q_credit_metrics(h):
    return M.binary_metrics(credit_scores(h), "riesgo_alto", "probability_default")


@register("top_features", kind="R")
def q_top_features(h):
    rf, _ = credit_models(h)
    return M.feature_importances(rf, model_columns(h), h.spark)


@register("grade_distribution", kind="R")
def q_grade_distribution(h):
    return credit_scores(h).groupBy("grade").agg(F.count(F.lit(1)).alias("n_socios"))


@register("grade_rate", kind="R")
def q_grade_rate(h):
    g = F.col("grade")
    return credit_scores(h).agg(
        F.when(F.count(F.lit(1)) > 0, M.X.rnd(F.avg(g.isin("D", "E").cast("double")) * 100, 2)).otherwise(0.0)
         .alias("tasa_riesgo_alto"))


def _member_requests(h):
    """Requests with the member's stored row beside them."""
    from memberrisk.operators import fanin as FI
    from memberrisk.plans import q_decide as QD
    return FI.overlay(h.requests(), QD.members(h))


@register("credit_score_requests", kind="R")
def q_credit_score_requests(h):
    """Requests scored on their own fields over the stored ones."""
    df = with_member_features(_member_requests(h), model_columns(h))
    return score_requests(h, df).select("request_id", "v_ah_cliente", "score", "grade", "probability_default", "risk_level")


@register("cluster_assign_requests", kind="R")
def q_cluster_assign_requests(h):
    """M18 for every request."""
    return assign_requests(h, _member_requests(h)).select("request_id", "v_ah_cliente", "cluster_id", "cluster_name")


@register("kmeans_search", kind="R")
def q_kmeans_search(h):
    return kmeans(h)[1]


@register("silhouette", kind="R")
def q_silhouette(h):
    return kmeans(h)[1].select("k", "silhouette")


@register("cluster_assign", kind="R")
def q_cluster_assign(h):
    c = clusters(h)
    return c.select("v_ah_cliente", "v_ah_cuenta", "cluster_id", "cluster_name",
                    M.strategy(F.col("cluster_name")).alias("strategy"))


@register("cluster_profiles", kind="R")
def q_cluster_profiles(h):
    return M.cluster_profiles(clusters(h))


def fixed_clusters(h):
    """Members with product codes as clusters, named by M17: the reports on
    clusters are checked exactly on these."""
    names = M.cluster_naming(scaled_last(h).withColumnRenamed("prod_bancario", "cluster_id"))
    rows = scaled_last(h).withColumn("cluster_id", F.col("prod_bancario"))
    return rows.join(names.select("cluster_id", "cluster_name"), "cluster_id")


_NAMED = """(SELECT l.saldo_disponible, l.ingresos, l.dias_sin_movimiento, n.cluster_id, n.cluster_name FROM lastp l
    JOIN ({names}) n ON n.cluster_id = l.prod_bancario)"""
_NAMED = _NAMED.format(names=REGISTRY["cluster_naming"].sql)


@reg("cluster_profiles_fixed", f"""SELECT cluster_id, cluster_name, count(*) AS n_socios,
    round_even(avg(saldo_disponible), 2) AS avg_saldo, round_even(avg(ingresos), 2) AS avg_ingresos,
    round_even(avg(dias_sin_movimiento), 1) AS avg_dias_inactivo,
    round_even(count(*) / (SELECT count(*) FROM {_NAMED}) * 100, 1) AS pct_total,
    CASE cluster_name WHEN 'Recuperable fácil' THEN 'Recordatorio SMS/email + llamada amable. Alta probabilidad de pago voluntario.'
      WHEN 'Negociación' THEN 'Contacto personalizado + oferta de reestructuración. Socio con capacidad pero requiere flexibilidad.'
      WHEN 'Pre-jurídico' THEN 'Notificación formal + visita domiciliaria. Riesgo medio-alto, requiere acción inmediata.'
      WHEN 'Castigo potencial' THEN 'Escalamiento a jurídico. Análisis de garantías. Provisión completa recomendada.'
      ELSE 'Análisis individual requerido.' END AS strategy
    FROM {_NAMED} GROUP BY cluster_id, cluster_name""")
def q_cluster_profiles_fixed(h):
    return M.cluster_profiles(fixed_clusters(h))


@reg("channel_counts_fixed", f"""SELECT c.channel, count(n.cluster_name) AS n_socios
    FROM (VALUES ('whatsapp', 'Recuperable fácil'), ('llamada', 'Negociación'), ('llamada', 'Pre-jurídico'),
                 ('legal', 'Castigo potencial')) AS c(channel, cluster_name)
    LEFT JOIN {_NAMED} n ON n.cluster_name = c.cluster_name GROUP BY c.channel""")
def q_channel_counts_fixed(h):
    return M.channel_counts(fixed_clusters(h))


@register("cluster_distribution", kind="R")
def q_cluster_distribution(h):
    return clusters(h).groupBy("cluster_name").agg(F.count(F.lit(1)).alias("n_socios"))


@register("channel_distribution", kind="R")
def q_channel_distribution(h):
    return M.channel_counts(clusters(h))


def _distance(a: str, b: str) -> str:
    return "sqrt(" + " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in CLUSTER_FEATURES) + ")"


@reg("silhouette_products", f"""SELECT count(*) AS n_rows, avg(s) AS silhouette, stddev_pop(s) / sqrt(count(*)) AS silhouette_error FROM (
    SELECT id, CASE WHEN max(n_same) <= 1 OR greatest(max(inside), min(outside)) = 0 THEN 0.0
                    ELSE (min(outside) - max(inside)) / greatest(max(inside), min(outside)) END AS s FROM (
      SELECT a.id,
             CASE WHEN a.prod_bancario = b.prod_bancario THEN count(*) END AS n_same,
             CASE WHEN a.prod_bancario = b.prod_bancario THEN sum({_distance("a", "b")}) / greatest(count(*) - 1, 1) END AS inside,
             CASE WHEN a.prod_bancario <> b.prod_bancario THEN avg({_distance("a", "b")}) END AS outside
      FROM sil a JOIN sil b ON true GROUP BY a.id, a.prod_bancario, b.prod_bancario) GROUP BY id)""")
def q_silhouette_products(h):
    """M15 of the product codes as clusters (rows without one left out), Euclidean."""
    from memberrisk.operators import clustering as K
    rows = scaled_last(h).where("prod_bancario IS NOT NULL")
    n, found = K.silhouette_table(rows, CLUSTER_FEATURES, ["prod_bancario"])
    return h.spark.createDataFrame([(n, *(found["prod_bancario"] or (None, None)))], "n_rows long, silhouette double, silhouette_error double")


# --- identities that hold for any fitted model -----------------------------------------

@reg("model_identities", """SELECT (SELECT count(*) FROM split WHERE split = 'test') AS n_scored,
    (SELECT count(*) FROM split WHERE split = 'test') AS n_graded, (SELECT count(*) FROM lastp) AS n_clustered,
    (SELECT count(*) FROM lastp) AS n_in_profiles, 6 AS n_k, 0 AS n_bad_scores""")
def q_model_identities(h):
    """Counts that the fitted models must keep whatever they learn: the test set
    is scored and graded whole, every latest-period row has one cluster, six k
    are tried, scores and probabilities lie in range."""
    scores = credit_scores(h)
    bad = (F.col("score") < 0) | (F.col("score") > 1000) | (F.col("probability_default") < 0) | (F.col("probability_default") > 1) \
        | F.col("score").isNull() | ~F.col("grade").isin("A", "B", "C", "D", "E")
    one = scores.agg(F.count(F.lit(1)).alias("n_scored"), F.count("grade").alias("n_graded"), F.count_if(bad).alias("n_bad_scores"))
    parts = [clusters(h).agg(F.count("cluster_name").alias("n_clustered")),
             M.cluster_profiles(clusters(h)).agg(F.sum("n_socios").alias("n_in_profiles")),
             kmeans(h)[1].agg(F.count(F.lit(1)).alias("n_k"))]
    for part in parts:
        one = one.withColumn(part.columns[0], M.X.one_row(part)[part.columns[0]])
    return one


SMOTE_FIXTURE_COLUMNS = ("saldo_disponible", "dias_sin_movimiento")
# The model columns (P26) of the featured table, in its order.
MODEL_COLUMNS = (
    "saldo_disponible", "monto_bloq", "ult_tasa_int", "tiene_bloqueos", "bloqueo_encaje", "v24h", "val_de_creditos",
    "val_de_debitos", "cooplinea", "tarjetas", "credito", "edad", "certificadosvalor", "ingresos", "egresos", "menor_edad",
    "v12h", "v48h", "v72h_difer", "int_hoy", "int_acumulado", "saldo_int_decim", "oficina_cta", "prod_bancario",
    "desviacion_maxima", "meses_actividad", "max_dias_mes", "min_dias_mes", "ecivil_S", "ecivil_C", "ecivil_D", "ecivil_V",
    "ecivil_U", "ratio_ingreso_egreso", "flujo_neto", "saldo_efectivo", "ratio_bloqueo", "ratio_certificados_saldo",
    "antiguedad_cuenta_dias", "dias_sin_movimiento", "dias_desde_actualizacion", "actividad_24h", "actividad_12h",
    "volumen_total", "ratio_creditos_debitos", "delta_saldo_mensual", "tendencia_saldo", "grupo_etario", "es_menor",
    "tiene_credito_activo", "tiene_tarjeta", "usa_cooplinea", "productos_digitales")
_DRAW = "CAST(('0x' || substr(md5('42|{tag}|' || CAST({i} AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0"


def _smote_sql(columns) -> tuple[str, dict[str, str]]:
    """M2 by brute force over ``columns``: final SELECT and its CTEs."""
    clean = [f"CASE WHEN isnan(CAST(f.{c} AS DOUBLE)) OR isinf(CAST(f.{c} AS DOUBLE)) OR f.{c} IS NULL THEN 0.0 "
             f"ELSE CAST(f.{c} AS DOUBLE) END AS x{i}" for i, c in enumerate(columns)]
    dist = " + ".join(f"(a.x{i} - b.x{i}) * (a.x{i} - b.x{i})" for i in range(len(columns)))
    ctes = {
        "sm_tr": f"""SELECT s.v_ah_cuenta, s.periodo, s.riesgo_alto, {', '.join(clean)}
                FROM split s JOIN featured f USING (v_ah_cliente, v_ah_cuenta, periodo) WHERE s.split = 'train'""",
        "sm_cls": "SELECT riesgo_alto, count(*) AS n FROM sm_tr GROUP BY riesgo_alto",
        "sm_min": "SELECT riesgo_alto AS c, n FROM sm_cls ORDER BY n, riesgo_alto DESC LIMIT 1",
        "sm_maj": "SELECT riesgo_alto AS c, n FROM sm_cls ORDER BY n DESC, riesgo_alto LIMIT 1",
        "sm_pts": """SELECT row_number() OVER (ORDER BY v_ah_cuenta, periodo) - 1 AS id, *
                FROM sm_tr WHERE riesgo_alto = (SELECT c FROM sm_min)""",
        "sm_nn": f"""SELECT id, nn_id, row_number() OVER (PARTITION BY id ORDER BY d, nn_id) AS nn_rank
                FROM (SELECT a.id, b.id AS nn_id, {dist} AS d FROM sm_pts a JOIN sm_pts b ON a.id <> b.id)""",
        "sm_picks": f"""SELECT i AS synthetic_id,
                CAST(floor({_DRAW.format(tag='base', i='i')} * (SELECT n FROM sm_min)) AS BIGINT) AS id,
                CAST(floor({_DRAW.format(tag='nn', i='i')} * least(5, (SELECT n FROM sm_min) - 1)) + 1 AS BIGINT) AS nn_rank,
                {_DRAW.format(tag='u', i='i')} AS u
                FROM (SELECT unnest(range(CAST(greatest((SELECT sm_maj.n - sm_min.n FROM sm_maj, sm_min), 0) AS BIGINT)))
                      AS i) WHERE (SELECT count(*) FROM sm_cls) > 1 AND (SELECT n FROM sm_min) >= 2""",
    }
    made = ", ".join(f"x.x{i} + p.u * (y.x{i} - x.x{i}) AS {c}" for i, c in enumerate(columns))
    return f"""SELECT p.synthetic_id, p.id AS base_id, n.nn_id, {made}, (SELECT c FROM sm_min) AS riesgo_alto
        FROM sm_picks p JOIN sm_nn n ON n.id = p.id AND n.nn_rank = p.nn_rank
        JOIN sm_pts x ON x.id = p.id JOIN sm_pts y ON y.id = n.nn_id""", {**CTES, **ctes}


@register("smote", *_smote_sql(SMOTE_FIXTURE_COLUMNS))
def q_smote(h):
    """M2 on two features (balance, idle days) of the training split: exact
    against a brute-force neighbour search."""
    train = split(h).where(F.col("split") == "train").select(*KEYS, "riesgo_alto", *SMOTE_FIXTURE_COLUMNS)
    return M.smote(train, list(SMOTE_FIXTURE_COLUMNS))


@register("smote_full", *_smote_sql(MODEL_COLUMNS))
def q_smote_full(h):
    """M2 on every model feature column of the training split."""
    cols = model_columns(h)
    train = FE.scrub_features(split(h).where(F.col("split") == "train"), cols)
    return M.smote(train, cols)


@register("balanced_dataset_smote", kind="R")
def q_balanced_dataset_smote(h):
    """M4 with SMOTE: class counts of the training set the credit model uses."""
    return smote_train(h).groupBy("riesgo_alto", "is_synthetic").agg(F.count(F.lit(1)).alias("n_rows"))
