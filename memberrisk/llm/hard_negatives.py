"""Hard negatives by zone maps over Hilbert-ordered blocks (operator 13).

Vectors become whole numbers, floor(scale * x), so that scores (inner products) are
exact. Rows are written in the order of label, length and place on a Hilbert curve
through the ``DIMS`` most varying components, cut into blocks of at most ``BLOCK`` rows
of one label, each with the least and greatest value of every component (its zone map).

For an anchor a, interval arithmetic over a zone map bounds the score of all rows of a
block: sum of max(a_d * lo_d, a_d * hi_d) from above, sum of min from below. Each search
first reads zone maps alone and names the blocks that an anchor must read, then only
those blocks' rows:

* positives: the anchor's own block gives a first k-th best score; blocks of its label
  that may hold a better or equal one are read;
* negatives: each positive opens a window of scores; blocks of other labels whose bounds
  meet a window are read.

Anchors of ``TILE`` neighbouring blocks are searched together against ``TILE`` blocks at
a time, the blocks of highest bound first, and blocks that cannot better what the task
has are passed over. A task leaves at most k rows an anchor and window; a window over
(anchor, positive) keeps the first of them, limited before its shuffle.

The sample (``SAMPLE`` rows) that the components are chosen from fixes only the order of
rows; every row is indexed and every search is exact.

Edge cases: rows with a null label or vector or a null or non-finite component take no
part; vectors of unlike lengths are not compared; components count as at most 2**500 in
magnitude and scores are given as at most 2**63 - 1; repeated rows are rows of their own;
a null vec_id is no anchor and comes after all others among equal scores (so does
2**63 - 1, which stands for it). Without positives, or without rows in a window, nothing
is returned for it. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memberrisk.llm import common as C

BLOCK = 1024            # rows of a block, fewer for long vectors:
BLOCK_BYTES = 1 << 17
TILE = 64               # blocks of a task's side
SAMPLE = 4096
DIMS, BITS = 8, 4       # of the Hilbert curve
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90      # window of negatives, in hundredths of the positive's score
NO_ID = np.iinfo(np.int64).max
EXACT = 2.0 ** 53


# ------------------------------------------------------------------ blocks
def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with components of ``bits`` bits (at most 63 in all)."""
    x = x.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            turned = (x[:, i] & q) != 0
            swap = np.where(turned, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(turned, low, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where(x[:, n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= flip[:, None]
    place = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << 1) | ((x[:, i] >> bit) & 1)
    return place


def _whole(rows: DataFrame, scale: float) -> DataFrame:
    """(vec_id, label, anchor, dim, raw): ``raw`` holds floor(scale * x) as doubles."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep, raw, dim = [], [], []
        for i, v in enumerate(batch.column(3)):
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) if v.is_valid and not v.values.null_count else None
            if x is None or not np.isfinite(x).all():
                continue
            keep.append(i)
            whole = np.floor(np.clip(x, -2.0 ** 500, 2.0 ** 500) * scale)
            raw.append((np.clip(whole, -2.0 ** 500, 2.0 ** 500) + 0.0).tobytes())
            dim.append(len(x))
        at = pa.array(keep, pa.int64())
        return C.batch_of({**{n: batch.column(i).take(at) for i, n in enumerate(("vec_id", "label", "anchor"))},
                           "dim": pa.array(dim, pa.int32()), "raw": pa.array(raw, pa.binary())})

    chosen = rows.where("label IS NOT NULL").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
        (F.coalesce("anchor", F.lit(False)) & F.col("vec_id").isNotNull()).alias("anchor"), "embedding")
    return C.map_batches(chosen, run, "vec_id long, label string, anchor boolean, dim int, raw binary")


def _axes(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length in a sample: the most varying components, their least value and their reach."""
    sample = vectors.select("dim", "raw", F.xxhash64("vec_id", "raw").alias("h")).orderBy("h").limit(SAMPLE).toPandas()
    axes = {}
    for dim, part in sample.groupby("dim"):
        if dim:
            x = np.frombuffer(b"".join(part["raw"]), np.float64).reshape(len(part), -1)
            lo, hi = np.quantile(x, 0.02, axis=0), np.quantile(x, 0.98, axis=0)
            most = np.argsort(-(hi - lo), kind="stable")[:DIMS]
            axes[int(dim)] = most, lo[most], np.maximum(hi - lo, 1.0)[most]
    return axes


def blocks(rows: DataFrame, scale: float = 256.0, name: str = "negatives") -> DataFrame:
    """Parquet table of blocks in curve order: ``block, tile, label, dim, n, ids, anchors, m, lo, hi``
    (binary; ``m`` as 16-bit integers where they suffice, else doubles; rows of a block ascend by id)."""
    spark = rows.sparkSession
    vectors = C.stage(_whole(rows, scale), f"{name}-vectors")
    shared = spark.sparkContext.broadcast(_axes(vectors))

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        dims, raw = batch.column(3).to_numpy(), batch.column(4).to_pylist()
        at = np.zeros(batch.num_rows, np.int64)
        for dim in np.unique(dims):
            if int(dim) in shared.value:
                own = np.flatnonzero(dims == dim)
                most, lo, reach = shared.value[int(dim)]
                x = np.frombuffer(b"".join(raw[i] for i in own), np.float64).reshape(len(own), -1)[:, most]
                steps = np.clip((x - lo) / reach * (1 << BITS), 0, (1 << BITS) - 1)
                at[own] = hilbert(steps, BITS)
        return C.batch_of({**{n: batch.column(i) for i, n in enumerate(batch.schema.names)}, "place": pa.array(at)})

    placed = C.map_batches(vectors, place, "vec_id long, label string, anchor boolean, dim int, raw binary, place long")
    parts = max(spark.sparkContext.defaultParallelism, vectors.count() // (TILE * BLOCK) + 1)
    order = ["label", "dim", "place", "vec_id"]
    sliced = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held, kind = TaskContext.get().partitionId(), 0, [], None

        def block() -> pa.RecordBatch:
            ids = np.array([NO_ID if i is None else i for i, _, _ in held], np.int64)
            ascending = np.argsort(ids, kind="stable")
            x = np.frombuffer(b"".join(held[i][2] for i in ascending), np.float64).reshape(len(held), -1)
            small = not x.size or np.abs(x).max() <= 32767
            one = {"part": (part, pa.int32()), "i": (n, pa.int64()), "label": (kind[0], pa.string()), "dim": (kind[1], pa.int32()),
                   "n": (len(held), pa.int32()), "ids": (ids[ascending].tobytes(), pa.binary()),
                   "anchors": (np.array([held[i][1] for i in ascending], bool).tobytes(), pa.binary()),
                   "m": (x.astype(np.int16 if small else np.float64).tobytes(), pa.binary()),
                   "lo": (x.min(axis=0).tobytes(), pa.binary()), "hi": (x.max(axis=0).tobytes(), pa.binary())}
            return C.batch_of({c: pa.array([v], t) for c, (v, t) in one.items()})

        for batch in batches:
            for vec_id, label, anchor, dim, raw in zip(*(batch.column(i).to_pylist() for i in range(5))):
                most = max(16, min(BLOCK, BLOCK_BYTES // (2 * max(dim, 1))))
                if held and (kind != (label, dim) or len(held) >= most):
                    yield block()
                    held, n = [], n + 1
                kind = label, dim
                held.append((vec_id, anchor, raw))
        if held:
            yield block()

    made = C.stage(sliced.mapInArrow(cut, "part int, i long, label string, dim int, n int, ids binary, anchors binary, m binary, lo binary, hi binary"),
                   f"{name}-cut")
    sizes = {r["part"]: r["n"] for r in made.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a partition
    first, starts = 0, []
    for part in sorted(sizes):
        starts.append((part, first))
        first += sizes[part]
    starts = spark.createDataFrame(starts, "part int, first long")
    numbered = made.join(F.broadcast(starts), "part").withColumn("block", F.col("i") + F.col("first"))
    return C.stage(numbered.withColumn("tile", (F.col("block") / TILE).cast("long")).drop("part", "i", "first"), f"{name}-blocks")


def _matrix(raw: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, np.int16 if len(raw) == 2 * n * dim else np.float64).astype(np.float64).reshape(n, dim)


# ------------------------------------------------------------------ scores
def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: doubles where all sums (times ``BLOCK``) are whole in them, else Python integers."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1]) * BLOCK
    if most < EXACT:
        return a @ b.T
    def whole(x):
        return np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)

    return whole(a).dot(whole(b).T)


def _bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(from below, from above) of the scores of anchors with rows between ``lo`` and ``hi`` (a row a zone)."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    slack = np.abs(a) @ np.maximum(np.abs(lo), np.abs(hi)).T * 1e-12
    return up @ lo.T + down @ hi.T - slack, up @ hi.T + down @ lo.T + slack


class _Best:
    """The first ``k`` (score, id, row) of each of ``n`` searches, higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.of = k, [[] for _ in range(n)]

    def least(self, i: int):
        """The score that a further row must reach, none yet if None."""
        return self.of[i][-1][0] if len(self.of[i]) == self.k else None

    def add(self, searches: np.ndarray, scores: np.ndarray, fits: np.ndarray, ids: np.ndarray, block: int) -> None:
        """``scores`` (a row a search) of the rows of a block, ascending by id; only where ``fits``."""
        for i, s, ok in zip(searches, scores, fits):
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            own = s[at]
            if len(at) > self.k:
                if own.dtype == object:
                    at = at[np.argsort(-own, kind="stable")[:self.k]]
                else:
                    key = own * BLOCK - at
                    at = at[np.argpartition(-key, self.k - 1)[:self.k]]
            new = [(int(s[j]), int(ids[j]), block * BLOCK + int(j)) for j in at]
            self.of[i] = sorted(self.of[i] + new, key=lambda r: (-r[0], r[1], r[2]))[:self.k]


def _long(score: int) -> int:
    return max(-2 ** 63, min(2 ** 63 - 1, score))


# ---------------------------------------------------------------- searches
def _anchors(indexed: DataFrame, k: int) -> DataFrame:
    """(tile, uid, vec_id, label, dim, raw, kth): anchors with the k-th best score in their own block, if it has so many."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = {c: [] for c in ("tile", "uid", "vec_id", "label", "dim", "raw", "kth")}
        for r in batch.to_pylist():
            x = _matrix(r["m"], r["n"], r["dim"])
            ids = np.frombuffer(r["ids"], np.int64)
            at = np.flatnonzero(np.frombuffer(r["anchors"], bool))
            for i in range(0, len(at), 256):
                some = at[i:i + 256]
                scores = _scores(x[some], x)
                for j, s in zip(some, scores):
                    others = np.sort(np.delete(s, j))[::-1]
                    out["kth"].append(float(others[k - 1]) if len(others) >= k else None)
                    for c, v in (("tile", r["tile"]), ("uid", r["block"] * BLOCK + int(j)), ("vec_id", int(ids[j])), ("label", r["label"]),
                                 ("dim", r["dim"]), ("raw", x[j].tobytes())):
                        out[c].append(v)
        kinds = {"tile": pa.int64(), "uid": pa.int64(), "vec_id": pa.int64(), "label": pa.string(), "dim": pa.int32(), "raw": pa.binary(), "kth": pa.float64()}
        return C.batch_of({c: pa.array(v, kinds[c]) for c, v in out.items()})

    C.prepare(indexed.sparkSession)

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 8):
                yield run(batch.slice(i, 8))

    return indexed.select("block", "tile", "label", "dim", "n", "ids", "anchors", "m").mapInArrow(
        few, "tile long, uid long, vec_id long, label string, dim int, raw binary, kth double")


def _search(anchors: DataFrame, indexed: DataFrame, k: int, same_label: bool, name: str) -> DataFrame:
    """(uid, search, score, cand_id, cand): the first ``k`` rows of each search of each anchor, task by task.

    ``same_label``: one search an anchor, over its label's other rows, from ``kth`` on.
    Else a search for each window in ``lows``, ``highs`` over the other labels' rows."""

    def table(part: pd.DataFrame):
        """Anchors of one length: their rows, matrix, and least and greatest scores wanted (a column a search)."""
        for dim, own in part.groupby("dim"):
            own = own.sort_values("uid", kind="stable")
            a = np.frombuffer(b"".join(own["raw"]), np.float64).reshape(len(own), -1)
            if same_label:
                low = own["kth"].to_numpy(np.float64)[:, None]
                low, high = np.where(np.isnan(low), -np.inf, low), np.full((len(own), 1), np.inf)
            else:
                wide = max(map(len, own["lows"]))
                low, high = np.full((len(own), wide), NO_ID), np.full((len(own), wide), ~NO_ID)  # no window: empty
                for i, (x, y) in enumerate(zip(own["lows"], own["highs"])):
                    low[i, :len(x)], high[i, :len(y)] = x, y
            yield int(dim), own, a, low, high

    def wanted(own: pd.DataFrame, a, low, high, zones: pd.DataFrame):
        """Boolean (anchor, zone): must it be read? and the bounds from above."""
        lo = np.frombuffer(b"".join(zones["lo"]), np.float64).reshape(len(zones), -1)
        hi = np.frombuffer(b"".join(zones["hi"]), np.float64).reshape(len(zones), -1)
        below, above = _bounds(a, lo, hi)
        meets = ((above[:, :, None] >= low[:, None, :]) & (below[:, :, None] <= high[:, None, :])).any(axis=2)
        alike = own["label"].to_numpy()[:, None] == zones["label"].to_numpy()[None, :]
        return meets & (alike == same_label), above

    def plan(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            for dim, own, a, low, high in table(left):
                zones = right[right["dim"] == dim]
                if len(zones):
                    must, _ = wanted(own, a, low, high, zones)
                    rows += [(key[0], int(b), must[:, j].sum()) for j, b in enumerate(zones["block"]) if must[:, j].any()]
        return pd.DataFrame(rows, columns=["grp", "block", "n_anchors"]).astype("int64")

    def read(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            for dim, own, a, low, high in table(left):
                here = right[right["dim"] == dim]
                if len(here):
                    must, above = wanted(own, a, low, high, here)
                    rows += _read(own, a, low, high, here, must, above, k, same_label)
        return pd.DataFrame(rows, columns=["uid", "search", "score", "cand_id", "cand"]).astype("int64")

    # Every group of anchors (a tile's) against the zone maps of every tile: tiles are laid out once a group.
    zones = indexed.select("block", "tile", "label", "dim", "lo", "hi")
    if same_label:  # a group looks at the tiles that hold its labels
        held = anchors.select(F.col("tile").alias("grp"), "label").distinct()
        met = held.join(indexed.select("tile", "label").distinct(), "label").select("grp", "tile").distinct()
    else:
        last = anchors.agg(F.max("tile")).first()[0] or 0
        met = (indexed.select("tile").distinct().withColumn("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))))
               .join(anchors.select(F.col("tile").alias("grp")).distinct(), "grp").select("grp", "tile"))
    met = C.stage(met, f"{name}-met")
    of = anchors.withColumnRenamed("tile", "grp")
    planned = C.stage(of.join(met, "grp").groupBy("grp", "tile").cogroup(zones.join(met, "tile").groupBy("grp", "tile"))
                      .applyInPandas(plan, "grp long, block long, n_anchors long"), f"{name}-plan")
    data = planned.join(indexed, "block").select("grp", "tile", "block", "label", "dim", "n", "ids", "m", "lo", "hi")
    pairs = planned.select("grp", (F.col("block") / TILE).cast("long").alias("tile")).distinct()
    return C.stage(of.join(pairs, "grp").groupBy("grp", "tile").cogroup(data.groupBy("grp", "tile"))
                   .applyInPandas(read, "uid long, search long, score long, cand_id long, cand long"), f"{name}-read")


def _read(own, a, low, high, here, must, above, k: int, same_label: bool) -> list[tuple]:
    """Rows of the blocks ``here`` for the anchors that must read them, the blocks of highest bound first."""
    wide = low.shape[1]
    best, uids = _Best(len(own) * wide, k), own["uid"].to_numpy()
    for j in np.argsort(-above.max(axis=0), kind="stable"):
        at = np.flatnonzero(must[:, j])
        row = here.iloc[int(j)]
        x = None
        for i in range(0, len(at), 256):
            some = at[i:i + 256]
            # What an anchor has already may leave this block nothing to give.
            reach = np.array([any((m := best.least(s * wide + w)) is None or above[s, j] >= m for w in range(wide)) for s in some])
            some = some[reach]
            if not len(some):
                continue
            if x is None:
                x, ids = _matrix(row["m"], row["n"], row["dim"]), np.frombuffer(row["ids"], np.int64)
            scores = _scores(a[some], x)
            for w in range(wide):
                if same_label:
                    fits = np.ones(scores.shape, bool)
                    mine = np.flatnonzero(uids[some] // BLOCK == row["block"])
                    fits[mine, uids[some][mine] % BLOCK] = False
                else:
                    least, most = (z[some, w].astype(scores.dtype)[:, None] for z in (low, high))
                    fits = ((scores >= least) & (scores <= most)).astype(bool)
                best.add(some * wide + w, scores, fits, ids, int(row["block"]))
    return [(int(uids[s // wide]), s % wide, _long(score), cand_id, cand)
            for s, found in enumerate(best.of) for score, cand_id, cand in found]


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("uid", "search").orderBy(F.desc("score"), "cand_id", "cand")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
                   scale: float = 256.0, name: str = "negatives") -> DataFrame:
    """``rows(vec_id, embedding, label, anchor)`` to ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    An anchor's positives are its first ``positives`` other rows of its label by score; the negatives
    of each are the first ``negatives`` rows of other labels with scores of ``low`` to ``high``
    hundredths of the positive's."""
    indexed = blocks(rows, scale, name)
    anchors = C.stage(_anchors(indexed, positives), f"{name}-anchors")
    near = C.stage(_first(_search(anchors, indexed, positives, True, f"{name}-positive"), positives)
                   .select("uid", (F.col("rank") - 1).cast("long").alias("search"), F.col("cand_id").alias("positive_id"),
                           F.col("score").alias("positive_score")), f"{name}-near")
    # Whole bounds of the windows; a negative score's window is empty. At most ``positives`` an anchor.
    decimal = F.col("positive_score").cast("decimal(20,0)")
    windows = near.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct(
        "search", F.ceil(decimal * low / 100).cast("long").alias("low"), F.floor(decimal * high / 100).cast("long").alias("high")))).alias("w"))
    searching = C.stage(anchors.drop("kth").join(windows, "uid").select("tile", "uid", "label", "dim", "raw", F.col("w.low").alias("lows"),
                                                                       F.col("w.high").alias("highs")), f"{name}-searching")
    far = _first(_search(searching, indexed, negatives, False, f"{name}-negative"), negatives)
    null_id = F.lit(int(NO_ID))
    return (far.join(near, ["uid", "search"]).join(anchors.select("uid", F.col("vec_id").alias("anchor_id")), "uid")
            .select("anchor_id", F.nullif("positive_id", null_id).alias("positive_id"), F.col("rank").cast("int").alias("rank"),
                    F.nullif("cand_id", null_id).alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        (F.col("vec_id") % 100 == 0).alias("anchor"))
    return hard_negatives(rows, name="op13")


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS alike, list_dot_product(a.e, b.e)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE alike
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT * FROM (
  SELECT p.anchor_id, p.positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other))::INTEGER AS rank,
         s.other AS negative_id, p.positive_score, s.score AS negative_score
  FROM p JOIN s USING (anchor_id)
  WHERE NOT s.alike AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
WHERE rank <= 10
"""
