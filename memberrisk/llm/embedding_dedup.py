"""Embedding near-dedup by spherical k-means cells (operator 3).

Vectors are compared only under equal labels (and equal length), by cosine in
double precision. Equal vectors of a label become one class with a count.
Spherical k-means, fitted on a bounded sample of classes (``SAMPLE`` smallest
hashes), gives each class a home cell, the one of the nearest centre, and the
further cells that a linked vector may have as home (``_cells``). Within a cell, blocks of ``BLOCK`` vectors are multiplied with each other. A pair counts
in one cell only: where both are at home, or else in the lower of the two home
cells in which both are present.

A large cell becomes many pairs of blocks, each a small task; a block gives, for
each of its vectors, how many vectors it links to and the smallest class of its
links' component inside the block, never its pairs. So a group of any size
leaves rows in proportion to its blocks. Components are joined in Spark.

The links are exactly the pairs with cosine >= ``least``.

Edge cases: null, empty, zero vectors, vectors with null or non-finite parts and
vectors without a label link with nothing and are kept. Rows with repeated ids
are vectors of their own. A null id is never a component's id unless alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memberrisk.llm import common as C

LEAST = 0.93
SAMPLE = 32_768
CELL_ROWS = 4096     # classes a cell is meant to have
MOST_CELLS = 4096
BLOCK = 1024
ROUNDS = 12


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres of the unit vectors ``x``; starts from rows spread evenly over ``x``."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(np.int64)].copy()
    for _ in range(rounds):
        home = np.empty(len(x), np.int64)
        for i in range(0, len(x), 8192):
            home[i:i + 8192] = np.argmax(x[i:i + 8192] @ centres.T, axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, home, x)
        size = np.sqrt((total * total).sum(axis=1))
        full = size > 0
        centres[full] = total[full] / size[full, None]  # an empty cell keeps its centre
    return centres


def _cells(x: np.ndarray, centres: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(home, visits) of the unit vectors ``x``; ``visits[i, j]`` if vector ``i`` is compared in cell ``j``.

    Linked x and y are at most ``r = sqrt(2 - 2 * least)`` apart. With homes g and h,
    x(g - h) + y(h - g) = (x - y)(g - h) <= r|g - h|, so one of the two terms, neither
    below 0, is at most half of it, and its vector visits the other's home.
    """
    near = x @ centres.T
    home = near.argmax(axis=1)
    apart = np.sqrt(np.maximum(0.0, 2 - 2 * (centres[home] @ centres.T)))
    half = np.sqrt(max(0.0, 2 - 2 * least)) / 2
    return home, near[np.arange(len(x)), home][:, None] - near <= half * apart + 1e-7  # for rounding


def _vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, label, dim, raw): ``raw`` holds the doubles of a usable vector, else null."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, dim = [], []
        for v, label in zip(batch.column(1), batch.column(2)):
            x = None
            if v.is_valid and label.is_valid and len(v.values) and not v.values.null_count:
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(x).all() or not x.any():
                    x = None
            raw.append(None if x is None else (x + 0.0).tobytes())  # -0.0 becomes 0.0
            dim.append(None if x is None else len(x))
        return C.batch_of({"vec_id": batch.column(0), "label": batch.column(2), "dim": pa.array(dim, pa.int32()),
                           "raw": pa.array(raw, pa.binary())})

    return C.map_batches(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label")),
                         run, "vec_id long, label string, dim int, raw binary")


def _compare(group: pd.DataFrame, cell: int, least: float) -> pd.DataFrame:
    """Links of a pair of blocks: per class, linked vectors and the smallest class of its component in the block."""
    left, right = group[group["side"] == 0], group[group["side"] == 1]
    same = not len(right)  # a block with itself
    b = left if same else right
    x = _unit(np.frombuffer(b"".join(left["raw"]), np.float64).reshape(len(left), -1)) if len(left) else None
    if x is None or not len(b):
        return pd.DataFrame({"cls": pd.Series([], dtype="int64"), "n": pd.Series([], dtype="int64"), "low": pd.Series([], dtype="int64")})
    y = x if same else _unit(np.frombuffer(b"".join(b["raw"]), np.float64).reshape(len(b), -1))
    link = x @ y.T >= least
    if same:
        np.fill_diagonal(link, False)
    else:
        elsewhere = b["home"].to_numpy()
        visits = [set(v) for v in left["cells"]]
        for home in np.unique(elsewhere[(elsewhere < cell)]):  # counted there if the left vector is there too
            there = np.array([home in v for v in visits])
            link[np.ix_(there, elsewhere == home)] = False
    ids = [left["cls"].to_numpy(), b["cls"].to_numpy()]
    held = [left["copies"].to_numpy(), b["copies"].to_numpy()]
    if same:
        cls, n = ids[0], link @ held[0]
        low = cls.copy()
    else:
        cls, n = np.concatenate(ids), np.concatenate([link @ held[1], held[0] @ link])
        full = np.zeros((len(cls), len(cls)), bool)
        full[:len(left), len(left):] = link
        link = full | full.T
        low = cls.copy()
    while True:
        nearest = np.where(link, low[None, :], np.iinfo(np.int64).max).min(axis=1)
        after = np.minimum(low, nearest)
        if (after == low).all():
            break
        low = after
    keep = n > 0
    return pd.DataFrame({"cls": cls[keep], "n": n[keep], "low": low[keep]})


def near_components(rows: DataFrame, least: float = LEAST, cell_rows: int = CELL_ROWS,
                    name: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``rows(vec_id, embedding, label)``."""
    spark = rows.sparkSession
    vectors = C.stage(_vectors(rows).withColumn("cls", F.when(F.col("raw").isNotNull(), F.xxhash64("label", "raw"))), f"{name}-vectors")
    classes = C.stage(vectors.where("raw IS NOT NULL").groupBy("cls").agg(
        F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("raw").alias("raw"),
        F.min("vec_id").alias("low_id"), F.count(F.lit(1)).alias("copies")), f"{name}-classes")

    # Centres for each length of vectors, from a bounded sample of all of them.
    total = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")).limit(64).collect()}
    sample = classes.select("cls", "dim", "raw").orderBy(F.xxhash64("cls"), "cls").limit(SAMPLE).toPandas()
    centres: dict[int, np.ndarray] = {}
    for dim, part in sample.groupby("dim"):
        x = _unit(np.frombuffer(b"".join(part["raw"]), np.float64).reshape(len(part), -1))
        centres[int(dim)] = spherical_kmeans(x, int(max(1, min(MOST_CELLS, len(part), total.get(dim, 1) // cell_rows))))
    shared = spark.sparkContext.broadcast(centres)

    def assign(batch: pa.RecordBatch) -> pa.RecordBatch:
        dims = batch.column(2).to_numpy()
        home, cells = np.zeros(batch.num_rows, np.int32), [[0]] * batch.num_rows
        raw = batch.column(3)
        for dim in np.unique(dims):
            own = np.flatnonzero(dims == dim)
            if int(dim) not in shared.value:  # a length that the sample has not: one cell
                continue
            for i in range(0, len(own), 4096):
                at = own[i:i + 4096]
                x = _unit(np.frombuffer(b"".join(raw[int(j)].as_py() for j in at), np.float64).reshape(len(at), -1))
                home[at], visits = _cells(x, shared.value[int(dim)], least)
                row, cell = np.nonzero(visits)
                for j, part in zip(at, np.split(cell, np.searchsorted(row, np.arange(1, len(at))))):
                    cells[j] = part.tolist()
        return C.batch_of({**{n: batch.column(i) for i, n in enumerate(("cls", "label", "dim", "raw", "copies"))},
                           "home": pa.array(home), "cells": pa.array(cells, pa.list_(pa.int32()))})

    placed = C.stage(C.map_batches(classes.select("cls", "label", "dim", "raw", "copies"), assign,
                                   "cls long, label string, dim int, raw binary, copies long, home int, cells array<int>"), f"{name}-placed")
    visits = placed.withColumn("cell", F.explode("cells")).withColumn("at_home", F.col("cell") == F.col("home"))
    sizes = C.stage(visits.groupBy("label", "dim", "cell").agg(
        F.ceil(F.sum(F.col("at_home").cast("int")) / BLOCK).cast("int").alias("homes"),
        F.ceil(F.sum((~F.col("at_home")).cast("int")) / BLOCK).cast("int").alias("guests"))
        .where("homes > 0"), f"{name}-cells")
    # Every block of the cell's own vectors meets each of its own blocks once and each block of guests once.
    blocks = visits.join(sizes, ["label", "dim", "cell"]).withColumn(
        "block", F.pmod(F.xxhash64("cls"), F.when(F.col("at_home"), F.col("homes")).otherwise(F.col("guests"))).cast("int"))
    own = F.expr("""transform(sequence(0, homes - 1), j -> struct(least(block, j) AS i, greatest(block, j) AS j,
                              IF(j < block, 1, 0) AS side, false AS guest))""")
    host = F.expr("""IF(guests > 0, transform(sequence(0, guests - 1), j -> struct(block AS i, j AS j, 0 AS side, true AS guest)),
                     CAST(array() AS array<struct<i:int,j:int,side:int,guest:boolean>>))""")
    guest = F.expr("transform(sequence(0, homes - 1), i -> struct(i AS i, block AS j, 1 AS side, true AS guest))")
    pairs = blocks.withColumn("task", F.explode(F.when(F.col("at_home"), F.concat(own, host)).otherwise(guest))).select(
        "label", "dim", "cell", "task.*", "cls", "raw", "copies", "home", "cells")

    def compare(key, group):
        return _compare(group, int(key[2]), least)

    found = C.stage(pairs.groupBy("label", "dim", "cell", "i", "j", "guest").applyInPandas(compare, "cls long, n long, low long"), f"{name}-links")
    root = C.components(found.where("cls != low").select(F.col("cls").alias("a"), F.col("low").alias("b")).distinct(), name)
    linked = found.groupBy("cls").agg(F.sum("n").alias("n"))
    of = (classes.select("cls", "low_id", "copies").join(linked, "cls", "left")
          .join(root.withColumnsRenamed({"id": "cls"}), "cls", "left")
          .select("cls", "low_id", (F.coalesce("n", F.lit(0).cast("long")) + F.col("copies") - 1).alias("n_links"),
                  F.coalesce("root", "cls").alias("root")))
    of = C.stage(of, f"{name}-of")
    smallest = of.groupBy("root").agg(F.min("low_id").alias("component_id"))
    label = C.stage(of.join(smallest, "root").select("cls", "n_links", "component_id"), f"{name}-label")
    out = vectors.select("vec_id", "cls").join(label, "cls", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(F.col("cls").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(C.table(spark, sf_dir, "embeddings"), name="op3")


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.vec_id),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT d.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, m.c AS component_id, d.vec_id = m.c AS kept
FROM embeddings d JOIN (SELECT vec_id, min(c) AS c FROM r GROUP BY 1) m USING (vec_id) LEFT JOIN n ON n.a = d.vec_id
"""
