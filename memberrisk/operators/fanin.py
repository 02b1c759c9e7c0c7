"""Fan-in of analyzers (J8, D12): their protocol, guarded fits and answers for requests.

An analyzer (§2.11) fits its tables on the hub and answers for request rows. The fan-in
knows analyzers by this protocol alone, so a further one needs no change here or in
``decide``. Each is run under a guard: one that fails leaves a row ``error`` in the status
table, a null struct in ``agentes`` and null answers, and the others go on. What an
analyzer stores or looks up is written as a table under its guard, so that a failure at
run time is its own and not the decision's.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any, NamedTuple, Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memberrisk.session import write_table

READY, ERROR, OFF = "ready", "error", "off"
AT_ONCE = 4  # analyzers fitted side by side
LOG = logging.getLogger(__name__)
STATUS_SCHEMA = "analyzer string, status string, error string, n_rows long, seconds double"


class Analyzer(Protocol):
    name: str
    answers: dict[str, str]  # the columns it answers with, and their types

    def fit(self, hub: Any) -> DataFrame | None:
        """Its own result table (written), for others and for its row count."""

    def stored(self, hub: Any) -> DataFrame | None:
        """A row a member (``v_ah_cliente``): what it knows of members with history."""

    def lookups(self, hub: Any) -> dict[str, DataFrame]:
        """By request column: a table whose first column is that column's value as text, a row a value."""

    def answer(self, hub: Any, requests: DataFrame) -> DataFrame:
        """``requests`` with its answers. Stored results are in the struct ``k_<name>``, looked-up columns beside."""

    def metrics(self, hub: Any) -> DataFrame | None:
        """One row of headline numbers."""


@dataclass(frozen=True)
class Rules:
    """An analyzer put together from functions; those not given do nothing."""

    name: str
    answers: dict[str, str]
    answering: Callable[[Any, DataFrame], DataFrame]
    fitting: Callable[[Any], DataFrame | None] = lambda hub: None
    storing: Callable[[Any], DataFrame | None] = lambda hub: None
    looking_up: Callable[[Any], dict[str, DataFrame]] = lambda hub: {}
    measuring: Callable[[Any], DataFrame | None] = lambda hub: None

    def fit(self, hub: Any) -> DataFrame | None:
        return self.fitting(hub)

    def stored(self, hub: Any) -> DataFrame | None:
        return self.storing(hub)

    def lookups(self, hub: Any) -> dict[str, DataFrame]:
        return self.looking_up(hub)

    def answer(self, hub: Any, requests: DataFrame) -> DataFrame:
        return self.answering(hub, requests)

    def metrics(self, hub: Any) -> DataFrame | None:
        return self.measuring(hub)


class Status(NamedTuple):
    analyzer: str
    status: str
    error: str | None
    n_rows: int | None
    seconds: float


@dataclass
class FanIn:
    """Fitted analyzers: the member table, the lookups by request column and each one's status."""

    hub: Any
    analyzers: list[Analyzer]
    members: DataFrame
    lookups: dict[str, DataFrame]
    status: dict[str, Status] = field(default_factory=dict)

    def failed(self) -> dict[str, str]:
        return {n: s.error or s.status for n, s in self.status.items() if s.status != READY}

    def without(self, names: Iterable[str]) -> FanIn:
        """The same tables with some analyzers switched off."""
        status = {n: s._replace(status=OFF, error="switched off") if n in set(names) else s for n, s in self.status.items()}
        return FanIn(self.hub, self.analyzers, self.members, self.lookups, status)

    def status_table(self, spark: SparkSession) -> DataFrame:
        """A row an analyzer."""
        return spark.createDataFrame([tuple(self.status[a.name]) for a in self.analyzers], STATUS_SCHEMA)


def message(error: Exception) -> str:
    lines = str(error).strip().splitlines()
    return f"{type(error).__name__}: {lines[0] if lines else ''}"[:500]


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _fit_one(hub: Any, a: Analyzer) -> tuple[Status, DataFrame | None, dict[str, DataFrame]]:
    begun = time.time()
    try:
        table = a.fit(hub)
        n = None if table is None else table.count()
        own = a.stored(hub)
        own = None if own is None else write_table(own, f"stored-{a.name}")
        tables = {key: write_table(df, f"lookup-{a.name}") for key, df in a.lookups(hub).items()}
    except Exception as error:  # noqa: BLE001 - whatever an analyzer raises is its own
        LOG.warning("analyzer %s failed: %s", a.name, message(error))
        return Status(a.name, ERROR, message(error), None, round(time.time() - begun, 3)), None, {}
    return Status(a.name, READY, None, n, round(time.time() - begun, 3)), own, tables


def fit(hub: Any, analyzers: Iterable[Analyzer], latest: DataFrame) -> FanIn:
    """Fit every analyzer under its guard, some side by side: their jobs are many and small.
    ``latest`` has a member's latest row (a row a member)."""
    analyzers = list(analyzers)
    with ThreadPoolExecutor(AT_ONCE) as pool:
        done = list(pool.map(lambda a: _fit_one(hub, a), analyzers))
    status = {s.analyzer: s for s, _, _ in done}
    parts = {s.analyzer: own for s, own, _ in done if own is not None}
    looked: dict[str, list[DataFrame]] = {}
    for _, _, tables in done:
        for key, df in tables.items():
            looked.setdefault(key, []).append(df)

    members = latest.select("v_ah_cliente", F.struct(*[F.col(c) for c in latest.columns if c != "v_ah_cliente"]).alias("member"))
    for name, part in parts.items():
        cols = [F.col(c) for c in part.columns if c != "v_ah_cliente"]
        own = part.select("v_ah_cliente", F.struct(*cols).alias(f"k_{name}"))
        members = members.join(own.hint("merge"), "v_ah_cliente", "left")  # rows of members never go through the driver
    lookups = {}
    for key, tables in looked.items():  # one table, so one join, a request column
        merged = None
        for t in tables:
            t = t.withColumnRenamed(t.columns[0], "_key")
            merged = t if merged is None else merged.join(t, "_key", "full")
        lookups[key] = write_table(merged, "lookup") if len(tables) > 1 else merged
    return FanIn(hub, analyzers, write_table(members, "members"), lookups, status)


def overlay(req: DataFrame, members: DataFrame) -> DataFrame:
    """The request's fields over the member's stored ones (null = not given)."""
    stored = set(members.schema["member"].dataType.fieldNames())
    fields = [f for f in req.columns if f in stored]
    j = req.join(members.hint("merge"), "v_ah_cliente", "left")
    return j.withColumns({f: F.coalesce(F.col(f), F.col(f"member.{f}").cast(req.schema[f].dataType)) for f in fields})


def assess(fan: FanIn, req: DataFrame) -> DataFrame:
    """Each request row with every analyzer's answers, ``agentes`` (a struct an analyzer,
    null for one that is not ready) and ``agentes_error`` (the reason, by analyzer)."""
    df = overlay(req, fan.members)
    for key, table in fan.lookups.items():
        df = df.join(table, F.col(key).cast("string") == F.col("_key"), "left").drop("_key")
    failed = fan.failed()
    for a in fan.analyzers:
        if a.name not in failed:
            try:
                out = a.answer(fan.hub, df)
                df = out.withColumns({c: F.col(c).cast(kind) for c, kind in a.answers.items()})
                df.schema  # analysed here, under the guard
                continue
            except Exception as error:  # noqa: BLE001
                LOG.warning("analyzer %s gave no answer: %s", a.name, message(error))
                failed[a.name] = message(error)
                fan.status[a.name] = fan.status[a.name]._replace(status=ERROR, error=message(error))
        df = df.withColumns({c: _null(kind) for c, kind in a.answers.items()})

    def said(a: Analyzer) -> Column:
        if a.name in failed:
            return _null("struct<" + ",".join(f"{c}:{kind}" for c, kind in a.answers.items()) + ">")
        return F.struct(*a.answers)

    errors = [x for name, why in failed.items() for x in (F.lit(name), F.lit(why))]
    return df.withColumns({
        "agentes": F.struct(*[said(a).alias(a.name) for a in fan.analyzers]),
        "agentes_error": F.create_map(*errors) if errors else F.create_map().cast("map<string,string>")})


def summary(fan: FanIn) -> DataFrame:
    """(analyzer, status, metric, value); one without numbers has a row with a null metric."""
    spark, out = fan.members.sparkSession, None
    shape = "analyzer string, status string, metric string, value double"
    for a in fan.analyzers:
        state, part = fan.status[a.name].status, None
        if state == READY:
            try:
                row = a.metrics(fan.hub)
                if row is not None:
                    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns])
                    part = write_table(row.select(F.explode(pairs).alias("m")).select(
                        F.lit(a.name).alias("analyzer"), F.lit(state).alias("status"), "m.metric", "m.value"), "metrics")
            except Exception as error:  # noqa: BLE001
                LOG.warning("metrics of %s failed: %s", a.name, message(error))
                state = ERROR
                fan.status[a.name] = fan.status[a.name]._replace(status=ERROR, error=message(error))
        if part is None:
            part = spark.createDataFrame([(a.name, state, None, None)], shape)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], shape) if out is None else out
