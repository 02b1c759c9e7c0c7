"""Unit cases from the source system's own inline test frames."""
import datetime as dt

from pyspark.sql import functions as F

from memberrisk.operators import clean as C
from memberrisk.operators import features as FE
from memberrisk.operators import load as L


def test_parse_month_map(spark):
    rows = [("{3: 31.0, 4: 30.0}",), ("",), (None,), ("not a dict",)]
    df = L.map_features(spark.createDataFrame(rows, "dias_por_mes string"))
    got = [(r.meses_actividad, r.max_dias_mes, r.min_dias_mes) for r in df.collect()]
    assert got == [(2, 31.0, 30.0), (0, 0.0, 0.0), (0, 0.0, 0.0), (0, 0.0, 0.0)]


def test_parse_dates(spark):
    df = spark.createDataFrame([("May 1 2026 12:00AM",), ("Apr 12 2026 1:05PM",), ("bad",), ("May  1 2026 12:00AM",)],
                               "fecha_proceso string")
    out = L.parse_dates(df, ["fecha_proceso", "absent_column"]).collect()
    assert out[0].fecha_proceso.month == 5 and out[1].fecha_proceso.hour == 13
    assert out[2].fecha_proceso is None and out[3].fecha_proceso.day == 1


def _cleaning_frame(spark, duplicate=False):
    d = "May 1 2026 12:00AM"
    rows = [("100", "1", "1000", "100", "500", "200", "30", "M", "A", "S", "0", "20", "1", d, "Jan 1 1996 12:00AM"),
            ("200", "2", "500", "0", None, None, "45", "F", "I", "C", "0", "20", "1", d, "Jan 1 1981 12:00AM"),
            ("300", "3", "200", "50", "300", "150", "17", "m", "a", "s", "0", "30", "2", d, "Jan 1 2009 12:00AM"),
            ("400", "4", "50000", "0", "200", "100", "70", "F", "C", "V", "0", "20", "1", d, "Jan 1 1956 12:00AM")]
    cols = ("v_ah_cliente v_ah_cuenta saldo_disponible monto_bloq ingresos egresos edad sexo estado_cta estado_civil "
            "menor_edad oficina_cta prod_bancario fecha_proceso v_fecha_nac").split()
    raw = spark.createDataFrame(rows + (rows[:1] if duplicate else []), ", ".join(f"{c} string" for c in cols))
    typed = L.type_snapshot(raw.withColumn("periodo", F.lit("2026-05")))
    return L.enrich_alerts(typed, spark.createDataFrame([], "cliente long, desviacion_maxima double, "
                                                         "meses_actividad long, max_dias_mes double, "
                                                         "min_dias_mes double, fuente_alerta string"))


def test_deduplicate(spark):
    out = C.dedup_snapshot(_cleaning_frame(spark, duplicate=True))
    assert out.count() == 4                           # duplicated row removed


def test_cleaning_rules(spark):
    out = {r.v_ah_cliente: r for r in C.clean(_cleaning_frame(spark)).collect()}
    assert len(out) == 4
    assert out[300].sexo == "M" and out[300].estado_cta == "A" and out[300].menor_edad == 1
    assert all(r.ingresos is not None and r.egresos is not None for r in out.values())
    assert out[200].ingresos == 350.0                 # segment median (office 20, product 1) of 500 and 200
    assert out[200].egresos == 0.0                    # income > 0 -> egress 0


def test_feature_rules(spark):
    rows = []
    for k, per, saldo, bloq, ing, egr, edad, cred, cards, v24, cr, db, cert, aper, ult in [
        (100, "2026-03", 1000, 100, 500, 200, 30, 1, 1, 1, 500, 200, 100, "2020-01-01", "2026-02-28"),
        (100, "2026-04", 1200, 50, 600, 150, 30, 1, 1, 0, 300, 100, 150, "2020-01-01", "2026-03-31"),
        (200, "2026-03", 500, 200, 300, 300, 17, 0, 0, 0, 0, 0, 0, "2024-01-01", "2025-12-01"),
        (200, "2026-04", 400, 200, 250, 400, 17, 0, 0, 0, 0, 0, 0, "2024-01-01", "2025-12-01")]:
        proc = dt.datetime(int(per[:4]), int(per[5:]), 1)
        rows.append((k, k * 10, per, float(saldo), float(bloq), float(ing), float(egr), float(edad), float(cred),
                     float(cards), float(cards), float(v24), 0.0, 0.0, float(cr), float(db), float(cert),
                     proc, dt.datetime.fromisoformat(aper), dt.datetime.fromisoformat(ult), dt.datetime(2026, 1, 1)))
    schema = ("v_ah_cliente long, v_ah_cuenta long, periodo string, saldo_disponible double, monto_bloq double, "
              "ingresos double, egresos double, edad double, credito double, cooplinea double, tarjetas double, "
              "v24h double, v12h double, v48h double, val_de_creditos double, val_de_debitos double, "
              "certificadosvalor double, fecha_proceso timestamp, fecha_aper timestamp, fecha_ultmov timestamp, "
              "fecha_actualizacion timestamp")
    out = FE.feature_pipeline(spark.createDataFrame(rows, schema)).orderBy("v_ah_cliente", "periodo").collect()
    assert out[0].flujo_neto == 300.0
    assert all(r.antiguedad_cuenta_dias > 0 for r in out)
    assert out[2].es_menor == 1
    assert [r.delta_saldo_mensual for r in out] == [0.0, 200.0, 0.0, -100.0]
    assert [r.tendencia_saldo for r in out] == [200.0, 200.0, -100.0, -100.0]
    assert [r.dias_sin_movimiento for r in out] == [1.0, 1.0, 90.0, 121.0]
