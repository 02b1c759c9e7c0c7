"""Imports every query module so the registry is complete, and exposes the
driver-facing functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from memberrisk import session as sess
from memberrisk.plans import q_prepare  # noqa: F401  (registers queries)
from memberrisk.plans import registry as reg

from memberrisk.plans import q_analyzers  # noqa: F401,E402
from memberrisk.plans import q_ml  # noqa: F401,E402
from memberrisk.plans import q_decide  # noqa: F401,E402
from memberrisk.plans import q_sinks  # noqa: F401,E402


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return reg.spark_queries()


def oracle_sql() -> dict[str, str]:
    return dict(reg.oracle_queries())


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    sess.configure(spark)
    name = "alert_levels" if "alert_levels" in reg.REGISTRY else "feature_pipeline"
    return reg.spark_queries()[name](spark, sf_dir)
