"""File sources, keyed upsert sink, output schemas and streaming scoring."""
import os

import pytest
from pyspark.sql import functions as F

from memberrisk.sources import files as SRC
from memberrisk.sources import sinks as SK


def _write(path, text):
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)


def test_scan_snapshots_and_missing_file(spark, scratch):
    _write(f"{scratch}/m3.csv", "v_ah_cliente,saldo_disponible,fecha_proceso\n1,10.5,Mar 1 2026 12:00AM\n2,n/a,bad\n")
    _write(f"{scratch}/m4.csv", "v_ah_cliente;saldo_disponible\n1;11\n")
    spec = SRC.SourceSpec({"2026-03": f"{scratch}/m3.csv", "2026-05": f"{scratch}/missing.csv"})
    df = SRC.read_snapshots(spark, spec)
    assert df.count() == 2 and set(df.select("periodo").distinct().toPandas()["periodo"]) == {"2026-03"}
    reduced = SRC.read_snapshots(spark, SRC.SourceSpec({"2026-04": f"{scratch}/m4.csv"}, sep=";"))
    assert reduced.first()["saldo_disponible"] == "11"
    try:
        SRC.read_snapshots(spark, SRC.SourceSpec({"2026-03": f"{scratch}/none.csv"}))
        raise AssertionError("expected failure when no period exists")
    except FileNotFoundError:
        pass


def test_scan_alerts_tagged_and_empty(spark, scratch):
    _write(f"{scratch}/a1.csv", 'cliente,dias_por_mes,desviacion_maxima\n5,"{3: 31.0, 4: 30.0}",2.5\n')
    df = SRC.read_alerts(spark, SRC.SourceSpec({"desviados": f"{scratch}/a1.csv", "desviados_3_mas": f"{scratch}/x.csv"}))
    r = df.first()
    assert (r.cliente, r.fuente_alerta, r.desviacion_maxima) == (5, "desviados", 2.5)
    empty = SRC.read_alerts(spark, SRC.SourceSpec({"desviados": f"{scratch}/none.csv"}))
    assert empty.count() == 0
    again = SRC.read_alerts(spark, SRC.SourceSpec({"desviados": f"{scratch}/none.csv"}))
    assert again.columns == empty.columns == df.columns


def test_header_per_file_and_ids(spark, scratch):
    os.mkdir(f"{scratch}/m")
    _write(f"{scratch}/m/a.csv", "v_ah_cliente,saldo_disponible\n 1 ,10\n2.0,20\n")
    _write(f"{scratch}/m/b.csv", "saldo_disponible,v_ah_cliente,edad\n30,3,40\n50,,41\n")
    df = SRC.read_snapshots(spark, SRC.SourceSpec({"2026-03": f"{scratch}/m/*.csv"}))
    got = {(r.v_ah_cliente, r.saldo_disponible, r.edad) for r in df.collect()}
    assert got == {(" 1 ", "10", None), ("2.0", "20", None), ("3", "30", "40"), (None, "50", "41")}
    from memberrisk.operators import load as L
    assert sorted(r.v_ah_cliente for r in L.type_snapshot(df).where("v_ah_cliente IS NOT NULL").collect()) == [1, 2, 3]
    assert [r.edad for r in L.rejected_rows(L.type_snapshot(df)).collect()] == [41.0]
    _write(f"{scratch}/al.csv", 'cliente,dias_por_mes,desviacion_maxima\n 1 ,,2.5\n2.0,,3\n')
    alerts = SRC.read_alerts(spark, SRC.SourceSpec({"desviados": f"{scratch}/al.csv"}))
    assert sorted(r.cliente for r in alerts.collect()) == [1, 2]


def test_headers_of_many_files_take_no_jobs(spark, scratch):
    """Some hundred files of two headers (one plain, one compressed): two scans, each with one job that lists its files."""
    import gzip
    os.mkdir(f"{scratch}/many")
    for i in range(300):
        text = f"v_ah_cliente,edad\n{i},30\n" if i % 2 else f'\ufeff\n"edad", v_ah_cliente \n40,{i}\n'
        if i % 3:
            _write(f"{scratch}/many/{i}.csv", text)
        else:
            with gzip.open(f"{scratch}/many/{i}.csv.gz", "wt", encoding="utf-8") as fh:
                fh.write(text)
    _write(f"{scratch}/many/empty.csv", "")
    spec = SRC.SourceSpec({"2026-03": f"{scratch}/many"})
    spark.sparkContext.setJobGroup("headers", "headers")
    df = SRC.read_snapshots(spark, spec)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("headers")) <= 2
    assert df._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 2
    got = sorted((int(r.v_ah_cliente), r.edad) for r in df.collect())
    assert got == [(i, "30" if i % 2 else "40") for i in range(300)]


def test_malformed_rows(spark, scratch):
    _write(f"{scratch}/bad.csv", "v_ah_cliente,edad\n1,30\n2\n3,40,x\n4,\n")
    _write(f"{scratch}/blank.csv", "")
    got = SRC.malformed_rows(spark, SRC.SourceSpec({"2026-03": f"{scratch}/bad.csv", "2026-04": f"{scratch}/blank.csv"}))
    assert sorted((r.periodo, os.path.basename(r.file), r.record) for r in got.collect()) == [
        ("2026-03", "bad.csv", "2"), ("2026-03", "bad.csv", "3,40,x")]
    spec = SRC.SourceSpec({"2026-03": f"{scratch}/bad.csv"})
    assert {(r.v_ah_cliente, r.edad) for r in SRC.read_snapshots(spark, spec).collect()} == {("1", "30"), ("2", None), ("3", "40"), ("4", None)}
    nothing = SRC.malformed_rows(spark, SRC.SourceSpec({"2026-03": f"{scratch}/none.csv"}))
    assert nothing.count() == 0 and nothing.columns == ["periodo", "file", "record"]


def test_file_hub_gives_the_same_features(spark, scratch):
    """The fixture's raw layer written as CSV and read back: same features."""
    from memberrisk.plans.pipeline import FileHub, hub
    from conftest import SMOKE
    h = hub(spark, SMOKE)
    h.snapshot_raw().write.partitionBy("periodo").option("header", True).option("emptyValue", "").csv(f"{scratch}/snap")
    h.alerts_raw().write.partitionBy("fuente_alerta").option("header", True).csv(f"{scratch}/alerts")
    periods = [r[0] for r in h.snapshot_raw().select("periodo").distinct().collect()]
    f = FileHub(spark, [SRC.SourceSpec({p: f"{scratch}/snap/periodo={p}" for p in periods})],
                SRC.SourceSpec({s: f"{scratch}/alerts/fuente_alerta={s}" for s in SRC.ALERT_SOURCES}))
    cols = sorted(set(h.featured().columns) & set(f.featured().columns))
    assert set(h.featured().columns) == set(f.featured().columns) and f.rejected().count() == 0
    a = {tuple(r) for r in h.featured().select(cols).collect()}
    b = {tuple(r) for r in f.featured().select(cols).collect()}
    assert a == b


def test_upsert_latest_wins_and_idempotent(spark, scratch):
    old = spark.createDataFrame([("a", 1, "2026-01-01 00:00:00"), ("b", 2, "2026-01-01 00:00:00")],
                                "id string, n_socios long, t string").withColumn("updated_at", F.to_timestamp("t")).drop("t")
    new = spark.createDataFrame([("a", 10, "2026-02-01 00:00:00")], "id string, n_socios long, t string") \
        .withColumn("updated_at", F.to_timestamp("t")).drop("t")
    merged = {r.id: r.n_socios for r in SK.upsert(old, new).collect()}
    assert merged == {"a": 10, "b": 2}
    again = {r.id: r.n_socios for r in SK.upsert(SK.upsert(old, new), new).collect()}
    assert again == merged
    table = f"{scratch}/clusters"
    SK.upsert_table(new.withColumn("cluster_name", F.lit("x")), table, "pipeline_clusters")
    SK.upsert_table(old.withColumn("cluster_name", F.lit("y")), table, "pipeline_clusters")
    cur = {r.id: r.n_socios for r in SK.read_current(spark, table, "pipeline_clusters").collect()}
    assert cur == {"a": 10, "b": 2}


def test_upsert_touches_only_its_buckets(spark, scratch):
    table = f"{scratch}/t"
    rows = lambda ids, n: spark.createDataFrame([(str(i), n) for i in ids], "id string, n_socios long").withColumns(
        {"cluster_name": F.lit("x"), "updated_at": F.timestamp_seconds(F.col("n_socios"))})
    assert SK.upsert_table(rows(range(500), 1), table, "pipeline_clusters") == 1
    folder = SK._Folder(spark, table)
    first = folder.manifest(1)
    assert SK.upsert_table(rows([7], 2), table, "pipeline_clusters") == 2
    second = folder.manifest(2)
    assert sum(first[b] != second[b] for b in first) == 1               # one bucket was written anew
    got = {r.id: r.n_socios for r in SK.read_current(spark, table, "pipeline_clusters").collect()}
    assert len(got) == 500 and got["7"] == 2 and got["8"] == 1
    one = SK.read_current(spark, table, "pipeline_clusters", "7")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert [r.n_socios for r in one.collect()] == [2] and "PushedFilters: [IsNotNull(id), EqualTo(id,7)]" in plan
    assert not folder.commit(2, {})                                     # the version is taken
    SK.upsert_table(rows(range(500), 3), table, "pipeline_clusters")
    SK.upsert_table(rows(range(500), 4), table, "pipeline_clusters")
    assert folder.versions() == [3, 4] and len(folder.names("data")) == 2  # older folders are gone


def test_output_schemas_and_defaults(spark):
    df = spark.createDataFrame([("prod_1", "1")], "id string, prod_bancario string")
    out = SK.conform_output(df, "pipeline_segmentos")
    assert out.columns == [f.name for f in SK.OUTPUT_SCHEMAS["pipeline_segmentos"].fields]
    r = out.first()
    assert r.n_socios == 0 and r.score_riesgo == 0.0


def test_read_back_json(spark):
    df = spark.createDataFrame([("7", '["A","B"]')], "id string, alertas_activas string")
    back = SK.read_back(df, "7", {"alertas_activas": "array<string>"}).first()
    assert back.alertas_activas == ["A", "B"]


def test_streaming_request_scoring(spark, scratch):
    from memberrisk.plans.pipeline import hub
    from memberrisk.streaming import requests as RQ
    from conftest import SMOKE
    h = hub(spark, SMOKE)
    src = f"{scratch}/requests"
    h.requests().write.parquet(src)
    stream = spark.readStream.schema(h.requests().schema).parquet(src)
    q = RQ.start(h, stream, f"{scratch}/scoring_results", f"{scratch}/ckpt")
    q.awaitTermination(300)
    out = SK.read_current(spark, f"{scratch}/scoring_results", "scoring_results")
    assert out is not None and out.count() == h.requests().select("v_ah_cliente").distinct().count()
    assert out.where("agentes IS NULL").count() == 0
    assert os.path.isdir(f"{scratch}/ckpt")


def _numbers(spark, ids, n):
    return spark.createDataFrame([(str(i), n) for i in ids], "id string, n_socios long").withColumns(
        {"cluster_name": F.lit("x"), "updated_at": F.timestamp_seconds(F.col("n_socios"))})


def test_buckets_split_as_the_table_grows(spark, scratch, monkeypatch):
    monkeypatch.setattr(SK, "BUCKET_ROWS", 40)
    table, folder = f"{scratch}/t", SK._Folder(spark, f"{scratch}/t")
    SK.upsert_table(_numbers(spark, range(20), 1), table, "pipeline_clusters")
    assert set(folder.manifest(1)) == {"b0_0"}
    SK.upsert_table(_numbers(spark, range(600), 2), table, "pipeline_clusters")
    second = folder.manifest(2)
    assert 16 <= len(second) <= 64 and sum(f["rows"] for f in second.values()) == 600
    SK.upsert_table(_numbers(spark, [7, 8], 3), table, "pipeline_clusters")
    third = folder.manifest(3)
    assert sum(second[b]["path"] != third.get(b, {"path": ""})["path"] for b in second) <= 2   # the others stay as they are
    SK.upsert_table(_numbers(spark, range(500, 1500), 4), table, "pipeline_clusters")
    fourth = folder.manifest(4)
    assert len({SK._place(b)[0] for b in fourth}) > 1 or len(fourth) > len(third)
    assert sum(2.0 ** -SK._place(b)[0] for b in fourth) == 1                                   # prefixes cover every hash once
    got = {r.id: r.n_socios for r in SK.read_current(spark, table, "pipeline_clusters").collect()}
    assert got == {str(i): 4 if i >= 500 else 3 if i in (7, 8) else 2 for i in range(1500)}
    for i in (0, 7, 499, 500, 1499):
        one = SK.read_current(spark, table, "pipeline_clusters", str(i))
        assert len(one.inputFiles()) == 1 and [r.n_socios for r in one.collect()] == [got[str(i)]]
        assert one.inputFiles()[0].split("_bucket=")[1].split("/")[0] in fourth
    assert SK.read_current(spark, table, "pipeline_clusters", "nobody").count() == 0


def test_a_dead_writer_leaves_the_table_whole(spark, scratch, monkeypatch):
    table, folder = f"{scratch}/t", SK._Folder(spark, f"{scratch}/t")
    SK.upsert_table(_numbers(spark, range(5), 1), table, "pipeline_clusters")

    def dies(self, aside, version):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(SK._Folder, "_publish", dies)                      # between the file aside and its name
        with pytest.raises(KeyboardInterrupt):
            SK.upsert_table(_numbers(spark, range(9), 2), table, "pipeline_clusters")
    assert folder.versions() == [1] and SK.read_current(spark, table, "pipeline_clusters").count() == 5
    assert SK.upsert_table(_numbers(spark, range(7), 3), table, "pipeline_clusters") == 2
    assert SK.read_current(spark, table, "pipeline_clusters").count() == 7
    assert any(n.startswith(".new-") for n in folder.names("manifests"))
    monkeypatch.setattr(SK, "ORPHAN_HOURS", -1)
    folder.clean()
    assert not any(n.startswith(".new-") for n in folder.names("manifests")) and len(folder.names("data")) == 2
    assert SK.read_current(spark, table, "pipeline_clusters").count() == 7


def test_the_slower_writer_reads_again(spark, scratch, monkeypatch):
    table = f"{scratch}/t"
    SK.upsert_table(_numbers(spark, range(3), 1), table, "pipeline_clusters")
    publish, first = SK._Folder._publish, []

    def overtaken(self, aside, version):
        if not first:
            first.append(version)
            SK.upsert_table(_numbers(spark, [50], 2), table, "pipeline_clusters")
        return publish(self, aside, version)

    monkeypatch.setattr(SK._Folder, "_publish", overtaken)
    assert SK.upsert_table(_numbers(spark, [60], 3), table, "pipeline_clusters") == 3
    assert {r.id for r in SK.read_current(spark, table, "pipeline_clusters").collect()} == {"0", "1", "2", "50", "60"}


def test_a_replayed_batch_commits_nothing(spark, scratch):
    table, folder = f"{scratch}/t", SK._Folder(spark, f"{scratch}/t")
    assert SK.upsert_table(_numbers(spark, range(3), 1), table, "pipeline_clusters", ("s", 0)) == 1
    assert SK.upsert_table(_numbers(spark, range(3), 9), table, "pipeline_clusters", ("s", 0)) == 1
    assert SK.upsert_table(_numbers(spark, range(3), 2), table, "pipeline_clusters", ("other", 0)) == 2
    assert SK.upsert_table(_numbers(spark, range(4), 3), table, "pipeline_clusters", ("s", 1)) == 3
    assert folder.versions() == [2, 3] and folder.read_manifest(3)["batches"] == {"s": 1, "other": 0}
    assert SK.read_current(spark, table, "pipeline_clusters").agg(F.max("n_socios")).first()[0] == 3
    assert SK.upsert_table(_numbers(spark, [], 5), table, "pipeline_clusters") == 4
    assert SK.read_current(spark, table, "pipeline_clusters").count() == 4


def test_a_keyed_read_opens_one_row_group(spark, scratch, monkeypatch):
    """Of a bucket's row groups, ``id = x`` leaves one."""
    monkeypatch.setattr(SK, "GROUP_BYTES", 4096)
    table = f"{scratch}/t"
    rows = spark.range(60_000).select(F.col("id").cast("string").alias("id"), F.col("id").alias("n_socios"),
                                      F.sha2(F.col("id").cast("string"), 256).alias("cluster_name"), F.timestamp_seconds(F.lit(1)).alias("updated_at"))
    SK.upsert_table(rows, table, "pipeline_clusters")
    one = SK.read_current(spark, table, "pipeline_clusters", "4711")
    assert [r.n_socios for r in one.collect()] == [4711]
    leaf = one._jdf.queryExecution().executedPlan().collectLeaves().head()
    read = leaf.metrics().get("numOutputRows").get().value()
    assert 0 < read < 20_000
