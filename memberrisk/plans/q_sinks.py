"""Registered sink queries (S8-S14) over data derived from the driver tables."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from memberrisk import session as sess
from memberrisk.functions import exprs as X
from memberrisk.operators import analyzers as A
from memberrisk.plans import q_analyzers as QA
from memberrisk.plans import q_decide as QD
from memberrisk.plans import q_ml as QM
from memberrisk.plans.registry import register
from memberrisk.sources import sinks as SK

T0 = dt.datetime(2001, 7, 1)
T1 = dt.datetime(2001, 7, 2)


@register("upsert_latest", """SELECT id, fuente_alerta, desviacion_maxima FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, src DESC) AS rk FROM (
      SELECT CAST(cliente AS VARCHAR) AS id, fuente_alerta, desviacion_maxima, TIMESTAMP '2001-07-01' AS updated_at,
             0 AS src FROM alerts_raw WHERE fuente_alerta = 'desviados'
      UNION ALL
      SELECT CAST(cliente AS VARCHAR), fuente_alerta, desviacion_maxima, TIMESTAMP '2001-07-02', 1
      FROM alerts_raw WHERE fuente_alerta = 'desviados_3_mas')) WHERE rk = 1""", QA.CTES)
def q_upsert_latest(h):
    a = h.alerts_raw()
    def batch(source, ts):
        return a.where(F.col("fuente_alerta") == source).select(
            F.col("cliente").cast("string").alias("id"), "fuente_alerta", "desviacion_maxima",
            F.lit(ts).cast("timestamp").alias("updated_at"))
    return SK.upsert(batch("desviados", T0), batch("desviados_3_mas", T1)).drop("updated_at")


@register("sink_kpis", """SELECT 'latest' AS id, total_socios, tasa_mora_pct, alertas_desvio, menores_detectados,
    to_json({'sin_mora': sin_mora, 'mora_30d': mora_30d, 'mora_60d': mora_60d, 'mora_90d': mora_90d})
      AS distribucion_riesgo
    FROM (SELECT count(DISTINCT v_ah_cliente) AS total_socios,
      coalesce(round_even(avg(CASE WHEN dias_sin_movimiento > 30 THEN 1.0 ELSE 0.0 END) * 100, 2), 0.0) AS tasa_mora_pct,
      count_if(fuente_alerta <> 'sin_alerta') AS alertas_desvio, count_if(menor_edad = 1) AS menores_detectados,
      count_if(dias_sin_movimiento <= 30) AS sin_mora,
      count_if(dias_sin_movimiento > 30 AND dias_sin_movimiento <= 60) AS mora_30d,
      count_if(dias_sin_movimiento > 60 AND dias_sin_movimiento <= 90) AS mora_60d,
      count_if(dias_sin_movimiento > 90) AS mora_90d FROM lastp)""", QA.CTES)
def q_sink_kpis(h):
    last = h.last_period()
    from memberrisk.operators import decide as D
    buckets = D.idle_buckets(last).select(F.struct("*").alias("distribucion_riesgo"))
    k = D.kpi_core(last).withColumn("distribucion_riesgo", X.one_row(buckets)["distribucion_riesgo"])
    return SK.kpi_record(k).drop("updated_at")


@register("sink_segments", """SELECT 'prod_' || segment AS id, segment AS prod_bancario, n_socios,
    tasa_riesgo AS tasa_mora_pct, risk_score / 100.0 AS score_riesgo FROM grp WHERE dimension = 'producto'""", QA.CTES)
def q_sink_segments(h):
    return SK.segment_records(A.segment_report(QA.groups(h))).drop("updated_at")


@register("sink_decisions", """SELECT CAST(cliente_id AS VARCHAR) AS id, CAST(cliente_id AS DOUBLE) AS cliente_id,
    riesgo_global, elegibilidad_credito, canal_cobranza, dia_pago_sugerido, alertas_activas, acciones_priorizadas,
    bloqueos, 9 AS n_agentes FROM dec WHERE cliente_id IS NOT NULL""", QD.CTES)
def q_sink_decisions(h):
    recs = SK.serializable(SK.decision_records(QD.decisions(h)))
    return recs.withColumn("n_agentes", F.size(F.json_object_keys("agentes")).cast("long")).drop("updated_at", "agentes")


@register("member_extract", """SELECT CAST(v_ah_cliente AS VARCHAR) AS id, v_ah_cliente, edad, sexo, saldo_disponible,
    ingresos, egresos, credito, dias_sin_movimiento, prod_bancario, estado_cta, oficina_cta, tipo_cuenta,
    desviacion_maxima, fuente_alerta FROM lastp""", QA.CTES)
def q_member_extract(h):
    return SK.member_extract(h.last_period())


def stored_decisions(h):
    """The decisions of the requests that give a member's fields, upserted into a
    stored table in two batches: all members, then the minors once more."""
    def build():
        table = f"{sess.ensure_checkpoint_dir(h.spark).rstrip('/')}/tables/scoring-{uuid.uuid4().hex}"
        first = QD.decisions(h).where(F.col("request_id").startswith("m") | F.col("request_id").startswith("c"))
        recs = SK.decision_records(first).withColumn("updated_at", F.lit(T0).cast("timestamp"))
        SK.upsert_table(recs, table, "scoring_results")
        minors = A.minor_ids(QA.validation(h)).select(F.col("v_ah_cliente").cast("string").alias("id"))
        again = recs.join(minors, "id", "left_semi").withColumn("updated_at", F.lit(T1).cast("timestamp"))
        SK.upsert_table(again, table, "scoring_results")
        return table
    return h.memo("stored_decisions", build)


_STORED = "(SELECT * FROM dec WHERE request_id[1] IN ('m', 'c') AND cliente_id IS NOT NULL)"
_LISTS = {"alertas_activas": "array<string>", "bloqueos": "array<string>"}


def _lengths(back):
    return back.select("id", F.size("alertas_activas").cast("long").alias("n_alertas"),
                       F.size("bloqueos").cast("long").alias("n_bloqueos"),
                       F.date_format("updated_at", "yyyy-MM-dd").alias("dia"))


_LENGTHS = f"""SELECT CAST(d.cliente_id AS VARCHAR) AS id, CAST(json_array_length(d.alertas_activas) AS BIGINT) AS n_alertas,
    CAST(json_array_length(d.bloqueos) AS BIGINT) AS n_bloqueos,
    CASE WHEN m.v_ah_cliente IS NULL THEN '2001-07-01' ELSE '2001-07-02' END AS dia
    FROM {_STORED} d LEFT JOIN (SELECT DISTINCT v_ah_cliente FROM minors) m ON m.v_ah_cliente = d.cliente_id"""


@register("read_back_json", _LENGTHS, QD.CTES)
def q_read_back_json(h):
    """S8 + S12 + S14: decisions written to a stored table, upserted and read back."""
    return _lengths(SK.read_back(SK.read_current(h.spark, stored_decisions(h), "scoring_results"), json_columns=_LISTS))


@register("read_back_by_id", f"""SELECT * FROM ({_LENGTHS}) WHERE id = (SELECT CAST(min(v_ah_cliente) AS VARCHAR)
    FROM lastp)""", QD.CTES)
def q_read_back_by_id(h):
    """The keyed read of one member."""
    first = str(h.last_period().agg(F.min("v_ah_cliente")).first()[0])
    return _lengths(SK.read_back(SK.read_current(h.spark, stored_decisions(h), "scoring_results", first), json_columns=_LISTS))


@register("sink_clusters", kind="R")
def q_sink_clusters(h):
    dist = QM.clusters(h).groupBy("cluster_name").agg(F.count(F.lit(1)).alias("n_socios"))
    return SK.cluster_records(dist).drop("updated_at")
