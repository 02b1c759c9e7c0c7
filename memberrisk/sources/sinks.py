"""Sinks (S8-S17): keyed "latest row wins" upsert into parquet tables, the
five output table schemas, and the JSON edge for nested values.

A stored table is cut into buckets by the first bits of a hash of the id, as many bits
as a bucket needs to hold ``BUCKET_ROWS`` rows or so: a bucket that grows is split when
it is next written (extendible hashing), so an upsert rewrites files of bounded size and
the number of buckets follows the table. An upsert reads the buckets that the new rows
touch, keeps the newest row per id (max_by aggregate, partially aggregated, so a hot id
costs one row per map task), and writes those buckets anew, sorted by id in small row
groups with bloom filters; the others stay. A manifest names each bucket's file and
rows. It is written aside and renamed to the next version, which only one writer can;
the loser reads again and tries again, and a reader never sees half of one. (The check
and the rename are one step where the file system has it so, as HDFS does.) Folders
that the last manifests do not name are deleted. A keyed read opens one bucket. No row
goes through the driver, only a number a bucket.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memberrisk.functions import exprs as X

# The five output tables and the columns a KPI row may carry.
KPI_COLUMNS = ("pipeline_status", "total_socios", "tasa_mora_pct", "tasa_riesgo_alto", "socios_en_alerta",
               "socios_sobreendeudados", "menores_bloqueados", "menores_detectados", "alertas_desvio",
               "clusters_count", "avg_credit_score", "tasa_imputacion_ingresos_pct", "distribucion_riesgo",
               "distribucion_alerta", "distribucion_canal")

OUTPUT_SCHEMAS = {
    "pipeline_kpis": T.StructType([
        T.StructField("id", T.StringType(), False), T.StructField("updated_at", T.TimestampType()),
        T.StructField("pipeline_status", T.StringType()), T.StructField("total_socios", T.LongType()),
        T.StructField("tasa_mora_pct", T.DoubleType()), T.StructField("tasa_riesgo_alto", T.DoubleType()),
        T.StructField("socios_en_alerta", T.LongType()), T.StructField("socios_sobreendeudados", T.LongType()),
        T.StructField("menores_bloqueados", T.LongType()), T.StructField("menores_detectados", T.LongType()),
        T.StructField("alertas_desvio", T.LongType()), T.StructField("clusters_count", T.LongType()),
        T.StructField("avg_credit_score", T.DoubleType()), T.StructField("tasa_imputacion_ingresos_pct", T.DoubleType()),
        T.StructField("distribucion_riesgo", T.StringType()), T.StructField("distribucion_alerta", T.StringType()),
        T.StructField("distribucion_canal", T.StringType())]),
    "pipeline_segmentos": T.StructType([
        T.StructField("id", T.StringType(), False), T.StructField("updated_at", T.TimestampType()),
        T.StructField("prod_bancario", T.StringType()), T.StructField("n_socios", T.LongType()),
        T.StructField("tasa_mora_pct", T.DoubleType()), T.StructField("score_riesgo", T.DoubleType())]),
    "pipeline_clusters": T.StructType([
        T.StructField("id", T.StringType(), False), T.StructField("cluster_name", T.StringType()),
        T.StructField("n_socios", T.LongType()), T.StructField("updated_at", T.TimestampType())]),
    "scoring_results": T.StructType([
        T.StructField("id", T.StringType(), False), T.StructField("updated_at", T.TimestampType()),
        T.StructField("cliente_id", T.DoubleType()), T.StructField("riesgo_global", T.DoubleType()),
        T.StructField("elegibilidad_credito", T.BooleanType()), T.StructField("canal_cobranza", T.StringType()),
        T.StructField("dia_pago_sugerido", T.LongType()), T.StructField("alertas_activas", T.StringType()),
        T.StructField("acciones_priorizadas", T.StringType()), T.StructField("bloqueos", T.StringType()),
        T.StructField("agentes", T.StringType())]),
    "socios_data": T.StructType([
        T.StructField("id", T.StringType(), False), T.StructField("updated_at", T.TimestampType()),
        T.StructField("v_ah_cliente", T.LongType()), T.StructField("edad", T.DoubleType()),
        T.StructField("sexo", T.StringType()), T.StructField("saldo_disponible", T.DoubleType()),
        T.StructField("ingresos", T.DoubleType()), T.StructField("egresos", T.DoubleType()),
        T.StructField("credito", T.DoubleType()), T.StructField("dias_sin_movimiento", T.DoubleType()),
        T.StructField("prod_bancario", T.LongType()), T.StructField("estado_cta", T.StringType()),
        T.StructField("oficina_cta", T.LongType()), T.StructField("tipo_cuenta", T.StringType()),
        T.StructField("desviacion_maxima", T.DoubleType()), T.StructField("fuente_alerta", T.StringType())]),
}
DEFAULTS = {"total_socios": 0, "tasa_mora_pct": 0.0, "tasa_riesgo_alto": 0.0, "socios_en_alerta": 0,
            "socios_sobreendeudados": 0, "menores_bloqueados": 0, "menores_detectados": 0, "alertas_desvio": 0,
            "clusters_count": 0, "avg_credit_score": 0.0, "tasa_imputacion_ingresos_pct": 0.0, "n_socios": 0,
            "score_riesgo": 0.0, "riesgo_global": 0.0, "elegibilidad_credito": False}
MEMBER_EXTRACT_COLUMNS = ("v_ah_cliente", "edad", "sexo", "saldo_disponible", "ingresos", "egresos", "credito",
                          "dias_sin_movimiento", "prod_bancario", "estado_cta", "oficina_cta", "tipo_cuenta",
                          "desviacion_maxima", "fuente_alerta")


def conform_output(df: DataFrame, table: str) -> DataFrame:
    """Project onto the table schema, typed, with the column defaults."""
    schema = OUTPUT_SCHEMAS[table]
    cols = []
    for f in schema.fields:
        c = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if f.name in DEFAULTS:
            c = F.coalesce(c, F.lit(DEFAULTS[f.name]).cast(f.dataType))
        cols.append(c.alias(f.name))
    return df.select(*cols)


def latest_per_id(df: DataFrame, key: str = "id", order: str = "updated_at", tiebreak: str = "_src") -> DataFrame:
    """Newest row per key (null times oldest; ties -> the later source)."""
    cols = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*[F.col(c) for c in cols]),
                    F.struct(F.col(order).isNotNull(), F.col(order), F.col(tiebreak)))
    return df.groupBy(key).agg(best.alias("_r")).select(key, "_r.*")


def upsert(existing: DataFrame | None, new: DataFrame, key: str = "id") -> DataFrame:
    """Keyed merge, latest ``updated_at`` wins, the new batch wins ties."""
    tagged_new = new.withColumn("_src", F.lit(1))
    if existing is None:
        merged = tagged_new
    else:
        merged = existing.withColumn("_src", F.lit(0)).unionByName(tagged_new, allowMissingColumns=True)
    return latest_per_id(merged, key).drop("_src")


BUCKET_ROWS = 100_000   # a bucket with more rows is split when it is next written
GROUP_BYTES = 1 << 20   # row groups of a bucket's file
KEEP_MANIFESTS = 2
ORPHAN_HOURS = 24       # what a dead writer left is deleted after that


def key_hash(key: Column) -> Column:
    return F.xxhash64(key.cast("string"))


def _top(depth: Column, h: str = "_h") -> Column:
    """The first ``depth`` bits of the hash as a number."""
    shifted = F.expr(f"shiftrightunsigned({h}, CAST(64 - _depth AS INT))")
    return F.when(depth == 0, F.lit(0).cast("long")).otherwise(shifted)


def _label(depth: int, prefix: int) -> str:
    return f"b{depth}_{prefix}"


def _place(label: str) -> tuple[int, int]:
    depth, prefix = label[1:].split("_")
    return int(depth), int(prefix)


class _Folder:
    """A table's folder on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, table_dir: str):
        self.spark, self.dir = spark, table_dir.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(self.dir).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, sub: str) -> list[str]:
        p = self.path(f"{self.dir}/{sub}")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.names("manifests") if n.endswith(".json") and not n.startswith(".")]

    def read_manifest(self, version: int) -> dict:
        """``buckets`` (label to path and rows) and ``batches`` (stream to its last batch)."""
        stream = self.fs.open(self.path(f"{self.dir}/manifests/{version:012d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self, version: int) -> dict[str, dict]:
        return self.read_manifest(version)["buckets"]

    def _write_aside(self, content: str) -> str:
        aside = f"{self.dir}/manifests/.new-{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(aside), False)
        try:
            stream.write(bytearray(content.encode()))
        finally:
            stream.close()
        return aside

    def _publish(self, aside: str, version: int) -> bool:
        """Rename, unless the name is taken. Readers see a whole manifest or none."""
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(self.dir).toUri(), self.conf) \
            if "://" in self.dir or self.dir.startswith("file:") else self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.conf)
        no_options = self.spark.sparkContext._gateway.new_array(getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(self.path(aside), self.path(f"{self.dir}/manifests/{version:012d}.json"), no_options)
        except Py4JJavaError as error:
            if "exist" in str(error.java_exception).lower():
                self.fs.delete(self.path(aside), False)
                return False
            raise
        return True

    def commit(self, version: int, buckets: dict[str, dict], batches: dict[str, int] | None = None) -> bool:
        """Make ``version`` unless another writer has."""
        if version in self.versions():
            return False
        return self._publish(self._write_aside(json.dumps({"buckets": buckets, "batches": batches or {}})), version)

    def clean(self) -> None:
        """Delete manifests but the last ones, folders that only those name, and what dead writers left."""
        versions = self.versions()
        named = {f["path"].split("/")[0] for v in versions[-KEEP_MANIFESTS:] for f in self.manifest(v).values()}
        for v in versions[:-KEEP_MANIFESTS]:
            folders = {f["path"].split("/")[0] for f in self.manifest(v).values()}
            self.fs.delete(self.path(f"{self.dir}/manifests/{v:012d}.json"), False)
            for folder in folders - named:
                self.fs.delete(self.path(f"{self.dir}/data/{folder}"), True)
        before = int((time.time() - ORPHAN_HOURS * 3600) * 1000)
        for sub, stray in (("manifests", lambda n: n.startswith(".new-")), ("data", lambda n: n not in named)):
            p = self.path(f"{self.dir}/{sub}")
            for status in self.fs.listStatus(p) if self.fs.exists(p) else []:
                if stray(status.getPath().getName()) and status.getModificationTime() < before:
                    self.fs.delete(status.getPath(), True)


def _read(folder: _Folder, buckets: dict[str, dict], schema: T.StructType, labels: list[str] | None = None) -> DataFrame | None:
    paths = [f"{folder.dir}/data/{f['path']}" for b, f in sorted(buckets.items()) if (labels is None or b in labels) and f["rows"]]
    return folder.spark.read.schema(schema).parquet(*paths) if paths else None


def bucket_of(h: int, buckets: dict[str, dict]) -> str | None:
    """The bucket whose prefix the hash starts with."""
    bits = h & (2 ** 64 - 1)
    for depth in sorted({_place(b)[0] for b in buckets}):
        label = _label(depth, bits >> (64 - depth) if depth else 0)
        if label in buckets:
            return label
    return None


def read_current(spark: SparkSession, table_dir: str, table: str, key_value: str | None = None) -> DataFrame | None:
    """The committed table, or the rows of one id: one bucket's file is opened, and of it the row
    groups that ``id = x`` leaves by their bounds and bloom filters."""
    folder = _Folder(spark, table_dir)
    versions = folder.versions()
    if not versions:
        return None
    schema, buckets = OUTPUT_SCHEMAS[table], folder.manifest(versions[-1])
    nothing = spark.createDataFrame([], schema)
    if key_value is None:
        df = _read(folder, buckets, schema)
        return df if df is not None else nothing
    h = spark.range(1).select(key_hash(F.lit(key_value)).alias("h")).first()["h"]
    label = bucket_of(h, buckets)
    df = _read(folder, buckets, schema, [label]) if label else None
    return df.where(F.col("id") == key_value) if df is not None else nothing


def _split(depth: int, rows: int) -> int:
    """Depth at which a bucket of at most ``rows`` rows leaves pieces of ``BUCKET_ROWS`` or so."""
    while rows > BUCKET_ROWS and depth < 60:
        depth, rows = depth + 1, (rows + 1) // 2
    return depth


def upsert_table(new: DataFrame, table_dir: str, table: str, batch: tuple[str, int] | None = None) -> int:
    """S8 end to end: merge the touched buckets and commit. Returns the version.

    ``batch`` (a stream's name and batch number) is committed once: if the table has
    that batch of the stream or a later one, nothing is written."""
    from memberrisk.session import write_table
    spark, folder = new.sparkSession, _Folder(new.sparkSession, table_dir)
    rows = None
    while True:
        versions = folder.versions()
        state = folder.read_manifest(versions[-1]) if versions else {"buckets": {}, "batches": {}}
        if batch and state["batches"].get(batch[0], -1) >= batch[1]:
            return versions[-1]
        if rows is None:
            rows = write_table(conform_output(new, table).withColumn("_h", key_hash(F.col("id"))), "upsert")
        buckets = state["buckets"] or {_label(0, 0): {"path": "", "rows": 0}}
        # Each row meets the one bucket whose prefix its hash starts with: a lookup for each depth there is.
        places = spark.createDataFrame([(*_place(b), b) for b in buckets], "_depth int, _prefix long, _bucket string")
        depths = F.array(*[F.lit(d) for d in sorted({_place(b)[0] for b in buckets})])

        def dealt(df: DataFrame, to: DataFrame) -> DataFrame:
            tried = df.withColumn("_depth", F.explode(depths))
            return tried.withColumn("_prefix", _top(F.col("_depth"))).join(to, ["_depth", "_prefix"]).drop("_depth", "_prefix")

        touched = {r["_bucket"]: r["n"] for r in dealt(rows, places).groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
        made = {b: _split(_place(b)[0], buckets[b]["rows"] + n) for b, n in touched.items()}
        current = _read(folder, buckets, OUTPUT_SCHEMAS[table], list(touched))
        merged = conform_output(upsert(current, rows.drop("_h")), table).withColumn("_h", key_hash(F.col("id")))
        targets = spark.createDataFrame([(*_place(b), d) for b, d in made.items()], "_depth int, _prefix long, _to int")
        labelled = (dealt(merged, targets).withColumnRenamed("_to", "_depth")
                    .withColumn("_bucket", F.concat(F.lit("b"), F.col("_depth").cast("string"), F.lit("_"), _top(F.col("_depth")).cast("string")))
                    .drop("_depth", "_h"))
        pieces = sum(2 ** (d - _place(b)[0]) for b, d in made.items())
        data = uuid.uuid4().hex
        (labelled.repartition(max(1, pieces), "_bucket").sortWithinPartitions("_bucket", "id")
         .write.partitionBy("_bucket").option("parquet.bloom.filter.enabled#id", "true")
         .option("parquet.bloom.filter.expected.ndv#id", str(BUCKET_ROWS)).option("parquet.bloom.filter.adaptive.enabled", "true")
         .option("parquet.block.size", str(GROUP_BYTES)).parquet(f"{folder.dir}/data/{data}"))
        sizes = {} if not touched else {r["_bucket"]: r["n"] for r in spark.read.parquet(f"{folder.dir}/data/{data}")
                                        .groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
        after = {b: f for b, f in buckets.items() if b not in touched}
        for b, d in made.items():
            depth, prefix = _place(b)
            for child in range(2 ** (d - depth)):
                label = _label(d, (prefix << (d - depth)) | child)
                after[label] = {"path": f"{data}/_bucket={label}", "rows": sizes.get(label, 0)}
        version = (versions[-1] if versions else 0) + 1
        batches = state["batches"] | ({batch[0]: batch[1]} if batch else {})
        if folder.commit(version, after, batches):
            folder.clean()
            return version
        folder.fs.delete(folder.path(f"{folder.dir}/data/{data}"), True)  # another writer was first


def _now() -> Column:
    return F.current_timestamp()


def kpi_record(kpis: DataFrame) -> DataFrame:
    """One allow-listed KPI row with id 'latest'; maps/structs to JSON."""
    cols = []
    for c in KPI_COLUMNS:
        if c not in kpis.columns:
            continue
        t = kpis.schema[c].dataType
        cols.append((F.to_json(F.col(c)) if isinstance(t, (T.MapType, T.StructType, T.ArrayType)) else F.col(c)).alias(c))
    return kpis.select(F.lit("latest").alias("id"), _now().alias("updated_at"), *cols)


def segment_records(segments: DataFrame) -> DataFrame:
    """id = 'prod_' || product code."""
    return segments.select(F.concat(F.lit("prod_"), F.coalesce(F.col("prod_bancario").cast("string"), F.lit("unknown")))
                           .alias("id"), _now().alias("updated_at"), "prod_bancario", "n_socios", "tasa_mora_pct",
                           "score_riesgo")


def cluster_records(distribution: DataFrame) -> DataFrame:
    """id = cluster name."""
    name = F.concat(F.lit("cluster_"), F.col("cluster_name"))
    return distribution.select(name.alias("id"), name.alias("cluster_name"), F.col("n_socios").cast("long"),
                               _now().alias("updated_at"))


def decision_records(decisions: DataFrame) -> DataFrame:
    """Decisions with lists as JSON text; rows without a client id dropped."""
    d = decisions.where(F.col("cliente_id").isNotNull())
    def js(c):
        t = d.schema[c].dataType if c in d.columns else None
        return F.to_json(F.col(c)) if isinstance(t, (T.ArrayType, T.MapType, T.StructType)) else F.col(c)
    agents = js("agentes") if "agentes" in d.columns else F.lit(None).cast("string")
    return d.select(F.col("cliente_id").cast("long").cast("string").alias("id"), _now().alias("updated_at"),
                    F.col("cliente_id").cast("double").alias("cliente_id"), "riesgo_global", "elegibilidad_credito",
                    "canal_cobranza", "dia_pago_sugerido", js("alertas_activas").alias("alertas_activas"),
                    js("acciones_priorizadas").alias("acciones_priorizadas"), js("bloqueos").alias("bloqueos"),
                    agents.alias("agentes"))


def member_extract(last: DataFrame, max_rows: int | None = None) -> DataFrame:
    """All latest-period members, 14 key columns, id = integer client id as
    text. ``max_rows`` keeps the first by (client, account), for a store that
    limits its uploads."""
    cols = [c for c in MEMBER_EXTRACT_COLUMNS if c in last.columns]
    top = last if max_rows is None else last.orderBy("v_ah_cliente", "v_ah_cuenta").limit(max_rows)
    return top.select(F.col("v_ah_cliente").cast("long").cast("string").alias("id"), *cols)


def read_back(df: DataFrame, key_value: str | None = None, json_columns: dict[str, str] | None = None) -> DataFrame:
    """Keyed read (pushed-down ``id = x``) and JSON text parsed back."""
    out = df if key_value is None else df.where(F.col("id") == key_value)
    for c, ddl in (json_columns or {}).items():
        out = out.withColumn(c, F.from_json(F.col(c), ddl))
    return out


def serializable(df: DataFrame) -> DataFrame:
    """Timestamps to ISO text, NaN to null."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = X.nan_to_null(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def save_model(model, path: str) -> None:
    """Persist a fitted pyspark.ml model."""
    model.write().overwrite().save(path)
