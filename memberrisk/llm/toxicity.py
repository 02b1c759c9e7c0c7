"""Toxicity severity by cumulative-link ordinal regression (operator 10).

``P(grade <= g) = sigmoid(cut[g] - x.w)``: one weight vector is shared by all
ordered cuts. ``x`` holds ``1 + log(count)`` of the terms of a small vocabulary
(lower-cased runs of letters, digits and bytes beyond ASCII), matched by their
whole 64-bit hash. The output is the expected severity ``sum_g P(grade > g)``.

Fitting uses a bounded sample: ``sample`` labelled rows (the smallest
hashes of ``doc_id``), and the ``vocabulary`` terms that separate them best, of
those that separate them beyond chance, so that long texts do not add up noise.
Scoring reads every document once, whole, without a shuffle.

The labels are binary. A toxic row's grade (1 to ``grades``) is its place among
the sampled toxic rows by how many words of the marked terms it holds, so
severity is ordered by how much of such language a text has.

Edge cases: null or empty text scores as a text without known terms. Null or
repeated ``doc_id`` keeps its rows; each is scored by its own text. Labels that
are null or contradict each other count as not toxic unless one is 1. Without
labelled rows of both classes, or without a term that separates them, there is
no model: severity 0, nothing is toxic.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memberrisk.llm import common as C

SAMPLE = 6000
VOCABULARY = 512
GRADES = 3
LEAST_ROOT = 5.0   # chance alone gives a term this with a probability of 6e-7
TABLE_BITS = 18


@dataclass
class Model:
    terms: np.ndarray      # sorted uint64
    weights: np.ndarray
    cuts: np.ndarray       # increasing, one per grade above 0
    threshold: float       # of P(grade > 0)

    def above(self, eta: np.ndarray) -> np.ndarray:
        """P(grade > g) for each cut, a column each."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - eta[:, None], -50, 50)))


NO_MODEL = Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), 2.0)


def level(counts: np.ndarray) -> np.ndarray:
    """Feature of a term that occurs ``counts`` times: 0, then 1 + log(count)."""
    return np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0.0)


def _term_counts(batch: pa.RecordBatch) -> pa.RecordBatch:
    terms, counts = [], []
    size = np.zeros(batch.num_rows, np.int64)
    for w in C.words(batch.column(2), lower=True, terms=True):
        for d in range(len(w.first) - 1):
            t, n = np.unique(C.signed(w.hash[w.first[d]:w.first[d + 1]]), return_counts=True)
            size[w.row + d] = len(t)
            terms.append(t)
            counts.append(n)
    ends = np.concatenate([[0], np.cumsum(size)])
    empty = np.zeros(0, np.int64)
    return C.batch_of({
        "doc_id": batch.column(0), "toxic": batch.column(1),
        "terms": C.lists(np.concatenate([empty, *terms]), ends, pa.int64()),
        "counts": C.lists(np.concatenate([empty, *counts]), ends, pa.int64())})


def fit_ordinal(x: np.ndarray, y: np.ndarray, grades: int, rounds: int = 1500, ridge: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing cuts that maximise the penalised likelihood (Adam on the whole batch)."""
    n, m = x.shape
    share = np.array([np.clip((y > g).mean(), 1e-4, 1 - 1e-4) for g in range(grades)])
    start = np.log((1 - share) / share)  # cuts for zero weights
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    theta = np.concatenate([np.zeros(m), start[:1], gaps])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, rounds + 1):
        w, cuts = theta[:m], np.cumsum(np.concatenate([theta[m:m + 1], np.exp(theta[m + 1:])]))
        eta = x @ w
        below = sigmoid(cuts[None, :] - eta[:, None])            # P(grade <= g)
        full = np.hstack([np.zeros((n, 1)), below, np.ones((n, 1))])
        slope = np.hstack([np.zeros((n, 1)), below * (1 - below), np.zeros((n, 1))])
        rows = np.arange(n)
        p = np.maximum(full[rows, y + 1] - full[rows, y], 1e-9)
        d_eta = (slope[rows, y + 1] - slope[rows, y]) / p / n    # of the negative log-likelihood
        d_cut = np.zeros(grades)
        for g in range(grades):
            d_cut[g] = -((slope[:, g + 1] / p)[y == g].sum() - (slope[:, g + 1] / p)[y == g + 1].sum()) / n
        tail = np.cumsum(d_cut[::-1])[::-1]
        grad = np.concatenate([x.T @ d_eta + ridge * w, tail[:1], tail[1:] * np.exp(theta[m + 1:])])
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        theta = theta - 0.1 * (1 - step / (rounds + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return theta[:m], np.cumsum(np.concatenate([theta[m:m + 1], np.exp(theta[m + 1:])]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, vocabulary: int = VOCABULARY,
        grades: int = GRADES) -> Model:
    """Model from at most ``sample`` labelled rows of ``labels(doc_id, toxic)``."""
    chosen = (labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id"))
              .agg(F.max(F.coalesce(F.col("toxic").cast("int"), F.lit(0))).alias("toxic"))
              .orderBy(F.xxhash64("id"), "id").limit(sample))
    rows = (docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))  # at most `sample` rows
            .select(F.col("doc_id").cast("long").alias("doc_id"), "toxic", "text"))
    rows = C.stage(C.map_batches(rows, _term_counts, "doc_id long, toxic int, terms array<long>, counts array<long>")
                   .dropDuplicates(["doc_id"]), "toxic-sample")
    total = rows.agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n")).first()
    if not total["bad"] or total["bad"] == total["n"]:
        return NO_MODEL
    bad, good = int(total["bad"]), int(total["n"] - total["bad"])
    # Terms that the two classes hold unlike each other, by the signed root of the likelihood ratio.
    term = (rows.select("toxic", F.explode("terms").alias("term")).groupBy("term")
            .agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("n")))
    share = F.col("n") / F.lit(float(bad + good))

    def part(seen: Column, size: int, rate: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / (size * rate))).otherwise(0.0)

    a, b = F.col("a"), F.col("n") - F.col("a")
    ratio = 2 * (part(a, bad, share) + part(b, good, share) + part(bad - a, bad, 1 - share) + part(good - b, good, 1 - share))
    best = (term.where(F.col("n") < bad + good).select("term", (a / bad > b / good).alias("marks"), F.sqrt(F.greatest(ratio, F.lit(0.0))).alias("root"))
            .where(F.col("root") >= LEAST_ROOT).orderBy(F.desc("root"), "term").limit(vocabulary).toPandas())
    if not len(best):
        return NO_MODEL
    terms = np.sort(best["term"].to_numpy(dtype=np.int64).view(np.uint64))
    marks = best.loc[best["marks"], "term"].to_numpy(dtype=np.int64)
    marked = np.isin(terms, marks.view(np.uint64))

    known = docs.sparkSession.createDataFrame([(int(t), i) for i, t in enumerate(C.signed(terms))], "term long, at int")
    cells = (rows.select("doc_id", F.explode(F.arrays_zip("terms", "counts")).alias("z"))
             .select("doc_id", F.col("z.terms").alias("term"), F.col("z.counts").alias("n"))
             .join(F.broadcast(known), "term").select("doc_id", "at", "n").toPandas())  # at most sample x vocabulary
    pairs = rows.select("doc_id", "toxic").orderBy("doc_id").toPandas()
    x = np.zeros((len(pairs), len(terms)))
    x[np.searchsorted(pairs["doc_id"], cells["doc_id"]), cells["at"]] = cells["n"]
    y = pairs["toxic"].to_numpy(dtype=np.int64)
    severity = x[:, marked].sum(axis=1)
    if y.sum() >= grades:  # equal shares of the toxic rows, by how many marked words they hold
        inner = np.quantile(severity[y == 1], [g / grades for g in range(1, grades)])
        y = np.where(y == 1, 1 + np.searchsorted(inner, severity, side="left"), 0)
    order = np.unique(np.concatenate([[0], y]))
    y = np.searchsorted(order, y)  # grades that no row has are left out
    x = level(x)
    weights, cuts = fit_ordinal(x, y, len(order) - 1)
    model = Model(terms, weights, cuts, 0.5)
    p = model.above(x @ weights)[:, 0]
    # The probability that separates the sample best; ties take the middle.
    tries = np.linspace(0.2, 0.9, 71)
    right = np.array([((p >= t) == (y > 0)).sum() for t in tries])
    model.threshold = float(np.median(tries[right == right.max()]))
    return model


def probabilities(column: pa.Array, model: Model) -> np.ndarray:
    """P(grade > g) of each text, a column for each cut."""
    shift = np.uint64(64 - TABLE_BITS)
    used = np.zeros(1 << TABLE_BITS, dtype=bool)  # spares most words the search
    used[(model.terms >> shift).astype(np.int64)] = True
    eta = np.zeros(len(column))
    for w in C.words(column, lower=True, terms=True):
        maybe = np.flatnonzero(used[(w.hash >> shift).astype(np.int64)])
        if not len(maybe):
            continue
        at = np.minimum(np.searchsorted(model.terms, w.hash[maybe]), len(model.terms) - 1)
        real = model.terms[at] == w.hash[maybe]
        at, doc = at[real], np.searchsorted(w.first, maybe[real], side="right") - 1
        key, count = np.unique(doc * len(model.terms) + at, return_counts=True)
        np.add.at(eta, w.row + key // len(model.terms), model.weights[key % len(model.terms)] * level(count))
    return model.above(eta) if len(model.cuts) else np.zeros((len(column), 1))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, severity, grade, toxic`` of every row of ``docs(doc_id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        above = probabilities(batch.column(1), shared.value)
        return C.batch_of({
            "doc_id": batch.column(0), "severity": pa.array(above.sum(axis=1)),
            "grade": pa.array((above >= 0.5).sum(axis=1).astype(np.int32)),
            "toxic": pa.array(above[:, 0] >= shared.value.threshold)})

    return C.map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run,
                         "doc_id long, severity double, grade int, toxic boolean")


def reject_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` (all columns) whose text is not toxic, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(probabilities(batch.column(at), shared.value)[:, 0] < shared.value.threshold))

    return C.map_batches(docs, run, docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    return score(docs, fit(docs, C.table(spark, sf_dir, "labels")))
