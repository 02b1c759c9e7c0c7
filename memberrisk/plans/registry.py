"""Query registry: name -> (Spark plan, DuckDB oracle).

Every registered query reads the driver tables (through the fixture mapping)
and runs the operator over whole tables. Outputs are normalised the same way
on both sides so that value hashes compare: integers as BIGINT, floats rounded
half-even to 6 decimals, dates/timestamps as ISO text.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memberrisk.functions import exprs as X
from memberrisk.plans import oracle_sql as O
from memberrisk.plans.pipeline import Hub, hub

FLOAT_DECIMALS = 6


@dataclass
class Query:
    name: str
    build: Callable[[Hub], DataFrame]
    sql: str | None = None          # final SELECT over the oracle CTEs
    ctes: dict[str, str] = field(default_factory=dict)
    kind: str = "E"                 # E exact, R rows-only, U unit-only


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, ctes: dict[str, str] | None = None, kind: str = "E"):
    def deco(fn: Callable[[Hub], DataFrame]):
        REGISTRY[name] = Query(name, fn, sql, dict(ctes or {}), kind)
        return fn
    return deco


def normalize(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = X.rnd(c, FLOAT_DECIMALS) + F.lit(0.0)
        elif isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            c = c.cast("long")
        elif isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c.cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def runner(q: Query):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return normalize(q.build(hub(spark, sf_dir)))
        run.__name__ = q.name
        return run
    return {name: runner(q) for name, q in REGISTRY.items()}


_FLOAT_TYPES = ("DOUBLE", "FLOAT", "REAL")
_INT_TYPES = ("TINYINT", "SMALLINT", "INTEGER", "BIGINT", "HUGEINT", "UTINYINT", "USMALLINT",
              "UINTEGER", "UBIGINT", "UHUGEINT")


def _wrap(sql: str, types: list[tuple[str, str]]) -> str:
    cols = []
    for name, typ in types:
        q = '"' + name.replace('"', '""') + '"'
        t = typ.upper()
        if t in _FLOAT_TYPES or t.startswith("DECIMAL"):
            cols.append(f"round_even(CAST({q} AS DOUBLE), {FLOAT_DECIMALS}) + 0.0 AS {q}")
        elif t in _INT_TYPES:
            cols.append(f"CAST({q} AS BIGINT) AS {q}")
        elif t == "DATE":
            cols.append(f"strftime({q}, '%Y-%m-%d') AS {q}")
        elif t.startswith("TIMESTAMP"):
            cols.append(f"strftime(CAST({q} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS {q}")
        else:
            cols.append(q)
    return f"SELECT {', '.join(cols)} FROM (\n{sql}\n) AS _oracle"


@functools.lru_cache(maxsize=1)
def oracle_queries(probe_dir: str = "/root/testdata/sf0.001") -> dict[str, str]:
    """Full oracle SQL per query; output types are read with DuckDB DESCRIBE
    on the smallest table folder so the normalisation matches ``normalize``."""
    import duckdb  # local import: only needed to build the oracle strings
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings "
              "pages benchmark labels conversations").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{probe_dir}/{t}.parquet')")
    out = {}
    for name, q in REGISTRY.items():
        if q.sql is None:
            continue
        full = O.with_base(q.ctes, q.sql)
        try:
            types = [(r[0], r[1]) for r in con.execute(f"DESCRIBE {full}").fetchall()]
            out[name] = _wrap(full, types)
        except Exception:  # noqa: BLE001 - keep the raw SQL; the compare will show the error
            out[name] = full
    con.close()
    return out
