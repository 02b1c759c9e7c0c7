"""The batch job: driver tables -> snapshot + alerts -> clean -> features,
with the analyzers built lazily on top of the featured hub.

Materialisation points (everything else stays lazy and is fused by
Catalyst):

* ``enriched`` (typed snapshot + alerts), ``cleaned`` and ``featured`` are
  written as parquet tables into the shared folder named by the session
  (``spark.checkpoint.dir``). Each is re-read by several branches (quantile
  statistics, the nine analyzers); the checkpoint makes it a plan leaf, so
  plans stay small and a lost executor does not replay the whole
  load/clean/feature chain.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memberrisk import session as sess
from memberrisk.functions import exprs as X
from memberrisk.operators import clean as C
from memberrisk.operators import features as FE
from memberrisk.operators import load as L
from memberrisk.sources import files as FS
from memberrisk.sources import fixtures as FX
from memberrisk.sources.files import SourceSpec

_LOCK = threading.Lock()
_HUBS: dict[tuple[str, str], tuple[tuple, "Hub"]] = {}


class Hub:
    """Lazily built, memoised stages of one run over one table folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.tables = FX.Tables(spark, self.root) if self.root else None
        self._memo: dict[str, DataFrame] = {}
        self._lock = threading.RLock()
        self._building: dict[str, threading.RLock] = {}

    def _get(self, name: str, build) -> DataFrame:
        """Built once. Threads wait for a stage that another builds, not for each other's stages."""
        with self._lock:
            if name in self._memo:
                return self._memo[name]
            own = self._building.setdefault(name, threading.RLock())
        with own:
            if name not in self._memo:
                made = build()
                with self._lock:
                    self._memo[name] = made
            return self._memo[name]

    # --- sources -----------------------------------------------------------
    def snapshot_raw(self) -> DataFrame:
        return self._get("snapshot_raw", lambda: FX.snapshot_raw(self.tables))

    def alerts_raw(self) -> DataFrame:
        return self._get("alerts_raw", lambda: FX.alerts_raw(self.tables))

    def alerts(self) -> DataFrame:
        return self._get("alerts", lambda: L.prepare_alerts(self.alerts_raw()))

    def typed(self) -> DataFrame:
        return self._get("typed", lambda: L.type_snapshot(self.snapshot_raw()))

    def enriched(self) -> DataFrame:
        return self._get("enriched", lambda: materialize(L.enrich_alerts(self.typed(), self.alerts()), "enriched"))

    # --- clean / features ----------------------------------------------------
    def clean_stage(self, name: str) -> DataFrame:
        """Output of the cleaning chain up to step ``name`` (memoised)."""
        steps = [n for n, _ in C.CLEAN_STEPS]
        idx = steps.index(name)

        def build():
            prev = self.enriched() if idx == 0 else self.clean_stage(steps[idx - 1])
            return dict(C.CLEAN_STEPS)[name](prev)
        return self._get(f"clean:{name}", build)

    def cleaned(self) -> DataFrame:
        return self._get("cleaned", lambda: materialize(self.clean_stage("dedup"), "cleaned"))

    def featured(self) -> DataFrame:
        def build():
            # partitioned by period: latest-period reads prune to one folder
            return materialize(FE.feature_pipeline(self.cleaned()), "featured", ("periodo",))
        return self._get("featured", build)

    def last_period(self) -> DataFrame:
        """Rows of the latest period. The max period is a scalar subquery,
        so the filter is a plain predicate on ``periodo``."""
        def build():
            f = self.featured()
            latest = X.one_row(f.agg(F.max("periodo").alias("_last")))["_last"]
            return f.where(F.col("periodo") == latest)
        return self._get("last_period", build)

    def requests(self) -> DataFrame:
        """Scoring requests over whole tables: one row per latest-period member
        (the member's smallest account) with its fields, one more that gives only
        the member's id (its stored data are used), and every customer as an
        unknown member (id -(k + 1), no history) carrying only age, income,
        egress and idle days. ``request_id`` tells a member's requests apart."""
        def build():
            from memberrisk import schemas as S
            from memberrisk.operators import analyzers as A
            cols = [f.name for f in S.REQUEST_SCHEMA.fields if f.name not in ("request_id", "v_ah_cliente")]
            client = F.col("v_ah_cliente").cast("string")
            members = A.latest_per_client(self.last_period(), cols)
            known = members.withColumn("request_id", F.concat(F.lit("m"), client))
            only_id = members.select("v_ah_cliente", F.concat(F.lit("i"), client).alias("request_id"))
            c = self.tables.customer
            k = F.col("c_custkey")
            unknown = c.select(
                F.concat(F.lit("c"), k.cast("string")).alias("request_id"),
                (-(k + 1)).alias("v_ah_cliente"),
                (F.lit(15) + (k * 13) % 60).cast("double").alias("edad"),
                X.rnd(F.abs(F.col("c_acctbal")) * 0.1, 2).alias("ingresos"),
                X.rnd(F.abs(F.col("c_acctbal")) * 0.05, 2).alias("egresos"),
                ((k * 37) % 150).cast("double").alias("dias_sin_movimiento"))

            def typed(df: DataFrame) -> DataFrame:
                return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns
                                   else F.lit(None).cast(f.dataType).alias(f.name) for f in S.REQUEST_SCHEMA.fields])
            return typed(known).unionByName(typed(only_id)).unionByName(typed(unknown))
        return self._get("requests", build)

    def forget_analyzers(self) -> None:
        """Keep the stages up to the featured table; build everything on it anew."""
        with self._lock:
            kept = {"snapshot_raw", "alerts_raw", "alerts", "typed", "enriched", "cleaned", "featured"}
            self._memo = {k: v for k, v in self._memo.items() if k in kept or k.startswith("clean:")}

    def memo(self, name: str, build) -> DataFrame:
        return self._get(name, build)


class FileHub(Hub):
    """The same job on the user's own files: snapshot CSVs per period and alert
    files (S1-S7). Only what is derived from snapshots and alerts is available;
    requests come from the caller."""

    def __init__(self, spark: SparkSession, snapshots: list[SourceSpec], alerts: SourceSpec):
        super().__init__(spark, "")
        self.snapshots, self.alert_spec = snapshots, alerts

    def snapshot_raw(self) -> DataFrame:
        def build():
            out = None
            for spec in self.snapshots:
                df = FS.read_snapshots(self.spark, spec)
                out = df if out is None else out.unionByName(df, allowMissingColumns=True)
            return out
        return self._get("snapshot_raw", build)

    def alerts_raw(self) -> DataFrame:
        return self._get("alerts_raw", lambda: FS.read_alerts(self.spark, self.alert_spec))

    def rejected(self) -> DataFrame:
        """Q11: rows without a client id; the other stages do not see them."""
        return self._get("rejected", lambda: L.rejected_rows(L.type_snapshot(self.snapshot_raw())))

    def typed(self) -> DataFrame:
        return self._get("typed", lambda: L.type_snapshot(self.snapshot_raw()).where("v_ah_cliente IS NOT NULL"))


def materialize(df: DataFrame, name: str = "stage", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write the stage as a table in the shared checkpoint folder and read it
    back: a plan leaf (small plans downstream, real size statistics, no
    lineage replay after an executor loss)."""
    return sess.write_table(df, name, partition_by)


def _marks(spark: SparkSession, root: str) -> tuple:
    """Names, sizes and times of the files below ``root``: a hub is built anew when they change."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(path)))


def hub(spark: SparkSession, root: str) -> Hub:
    key = (spark.sparkContext.applicationId, root.rstrip("/"))
    with _LOCK:
        marks = _marks(spark, root)
        if key not in _HUBS or _HUBS[key][0] != marks:
            sess.configure(spark)  # UTC day arithmetic, checkpoint folder
            _HUBS[key] = (marks, Hub(spark, root))
        return _HUBS[key][1]
