"""Helpers shared by the training-data operators.

* ``documents`` / ``table``: the input tables, read whole.
* ``stage``: cut lineage through a parquet table in the shared folder of
  ``spark.checkpoint.dir``; survives lost executors.
* ``slices`` / ``words``: words of a batch of texts as 64-bit hashes, computed
  with array operations over the UTF-8 bytes. A word is a maximal run of bytes
  other than 0x20 and 0x09-0x0D.
* ``components``: connected components of a large edge table by label
  propagation with pointer jumping; everything stays in Spark tables.
"""

from __future__ import annotations

import gc
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memberrisk.session import ship_package

#: Rows handled at once.
ROWS = 1024
#: Bytes of text turned into arrays at once; one longer text makes its own slice.
SLICE_BYTES = 1 << 18
#: Bytes from which on a word's hash is a cryptographic one.
LONG_WORD = 256
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """What tasks in Python need: this package, and small batches, for texts are long."""
    ship_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# ------------------------------------------------------------------ staging
def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="llm-stage-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The driver's garbage is collected after the job, so that Spark's cleaner
    drops the shuffle files of jobs that nothing refers to any more.
    """
    spark = df.sparkSession
    prepare(spark)
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete the table of a ``stage`` whose consumers have all run."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def map_batches(df: DataFrame, func: Callable[[pa.RecordBatch], pa.RecordBatch], schema) -> DataFrame:
    """``mapInArrow`` of a function of some rows (``ROWS`` at most, to bound memory)."""

    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(func, pieces(batches))

    return df.mapInArrow(run, schema)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)


def row_key():
    """Hash of a row's id and text: tells apart rows with null or repeated ids."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, made longer until no column of ``df`` has the name."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


class IdFilter:
    """A map of 2**24 bits (2 MB, whatever the input's size) that holds all ids of a
    table and few others. It spares most rows a shuffle; an exact join follows.
    On an input whose ids fill it, it spares less and nothing else changes."""

    BITS = 24

    def __init__(self, spark: SparkSession, bitmap: np.ndarray) -> None:
        self.shared = spark.sparkContext.broadcast(bitmap)

    @classmethod
    def _bit(cls, column: str):
        return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(1 << cls.BITS)).cast("int")

    @classmethod
    def of(cls, df: DataFrame, column: str) -> IdFilter:
        words = (df.select(cls._bit(column).alias("bit")).groupBy(F.shiftright("bit", 5).alias("word"))
                 .agg(F.bit_or(F.expr("shiftleft(1L, bit & 31)")).alias("bits")).toPandas())  # at most 2**19 rows
        bitmap = np.zeros(1 << (cls.BITS - 5), dtype=np.uint32)
        bitmap[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64)
        return cls(df.sparkSession, bitmap)

    def run(self, df: DataFrame, column: str, func: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
            schema, held: bool) -> DataFrame:
        """``mapInArrow`` of ``func`` over the rows whose id the map holds, or over the others."""
        shared, n = self.shared, len(df.columns)

        def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bit = batch.column(n).to_numpy()
                has = (shared.value[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1 == 1
                rows = batch.select(list(range(n))).filter(pa.array(has == held))
                if rows.num_rows:
                    yield rows

        return df.withColumn(free_name(df, "__bit"), self._bit(column)).mapInArrow(lambda batches: func(chosen(batches)), schema)

    def keep(self, df: DataFrame, column: str) -> DataFrame:
        return self.run(df, column, lambda rows: rows, df.schema, True)

    def drop(self, df: DataFrame, column: str) -> DataFrame:
        return self.run(df, column, lambda rows: rows, df.schema, False)


# -------------------------------------------------------------------- words
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: ASCII other than letters and digits separates terms.
_NOT_TERM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_BYTE = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
# Lower case of the two-byte characters (Latin, Greek, Cyrillic, ...), where it is such a character too.
_TWO_BYTES = np.arange(0x800)
for _c in range(0x80, 0x800):
    if len(chr(_c).lower()) == 1 and 0x80 <= ord(chr(_c).lower()) < 0x800:
        _TWO_BYTES[_c] = ord(chr(_c).lower())
_BASE = 0xD1342543DE82EF95
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, SLICE_BYTES + 1)
        for key, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            p = np.full(size, np.uint64(base))
            p[0] = 1
            _POWERS[key] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (three xor-shift-multiply rounds)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def fold(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with two-byte characters in lower case (A-Z stay)."""
    lead = np.flatnonzero((data >= 0xC2) & (data <= 0xDF))
    lead = lead[lead + 1 < len(data)]
    if not len(lead):
        return data
    low = _TWO_BYTES[((data[lead] & 0x1F).astype(np.int64) << 6) | (data[lead + 1] & 0x3F)]
    out = data.copy()
    out[lead], out[lead + 1] = 0xC0 | (low >> 6), 0x80 | (low & 0x3F)
    return out


class Words(NamedTuple):
    """Words of a slice of texts. ``first[d]:first[d + 1]`` are the words of text ``d``."""

    row: int             # row of the slice's first text in the batch
    hash: np.ndarray     # uint64 of each word
    start: np.ndarray    # byte positions in ``data``
    end: np.ndarray
    first: np.ndarray    # word offsets of the texts
    data: np.ndarray     # uint8, the bytes of the slice
    edge: np.ndarray     # byte offsets of the texts in ``data``


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    edge = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    return edge, np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)


def slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, byte offsets from 0, bytes) of runs of texts of about ``SLICE_BYTES``."""
    edge, data = _buffers(column)
    row, n = 0, len(column)
    while row < n:
        stop = int(np.searchsorted(edge, edge[row] + SLICE_BYTES, side="right")) - 1
        stop = min(n, max(stop, row + 1))
        yield row, edge[row:stop + 1] - edge[row], data[edge[row]:edge[stop]]
        row = stop


def _alone(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the characters of scripts without blanks: Thai, Lao, Burmese, Khmer, Chinese, Japanese; wide forms."""
    second = np.append(data[1:], np.uint8(0))
    three = (data >= 0xE3) & (data <= 0xE9) | (data == 0xE0) & (second >= 0xB8) & (second <= 0xBB) | (data == 0xEF) & (second >= 0xBC) & (second <= 0xBD)
    three |= (data == 0xE1) & ((second >= 0x80) & (second <= 0x82) | (second >= 0x9E) & (second <= 0x9F))
    four = (data == 0xF0) & (second >= 0xA0) & (second <= 0xAF)
    start = np.flatnonzero(three | four)
    return start, start + 3 + four[start]


def words(column: pa.Array, lower: bool = False, terms: bool = False, scripts: bool = False) -> Iterator[Words]:
    """Words of each text. ``lower`` folds A-Z. With ``terms``, ASCII punctuation separates
    them too, and ``lower`` folds two-byte characters as well. With ``scripts``, each character
    of a script without blanks is a word."""
    for row, edge, data in slices(column):
        space = (_NOT_TERM if terms else _IS_SPACE)[data]
        before = np.empty(len(data), dtype=bool)
        after = np.empty(len(data), dtype=bool)
        if len(data):
            before[1:], after[:-1] = space[:-1], space[1:]
            inner = edge[:-1][edge[:-1] < edge[1:]]  # starts of texts that are not empty
            before[inner] = True
            after[edge[1:][edge[:-1] < edge[1:]] - 1] = True
            if scripts:
                first, last = _alone(data)
                before[first] = after[last - 1] = True
                after[first[first > 0] - 1] = before[last[last < len(data)]] = True
        start = np.flatnonzero(~space & before)
        end = np.flatnonzero(~space & after) + 1
        up, down = _powers(len(data) + 1)
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        text = fold(data) if lower and terms else data
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[text] * up[:len(data)], out=total[1:])
        h = mix((total[end] - total[start]) * down[start] + GOLDEN * (end - start).astype(np.uint64))
        for i in np.flatnonzero(end - start > LONG_WORD).tolist():  # such polynomials collide on long words made for it
            word = text[start[i]:end[i]]
            h[i] = int.from_bytes(hashlib.blake2b((_LOWER[word] if lower else word).tobytes(), digest_size=8).digest(), "little")
        yield Words(row, h, start, end, np.searchsorted(start, edge), data, edge)


_LANE = mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN) | np.uint64(1)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive words (``len(h) - k + 1`` of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    if k > len(_LANE):
        raise ValueError("at most 256 words a gram")
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out += h[j:j + n] * _LANE[j]
    return mix(out + np.uint64(k))


def prefix_hash(h: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` makes the hash of any run of words."""
    up, _ = _powers(len(h) + 1)
    total = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * up[:len(h)], out=total[1:])
    return total


def span_hash(total: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words from each of ``start``; equal runs give equal hashes."""
    _, down = _powers(len(total))
    return mix((total[start + length] - total[start]) * down[start] + np.array([length], np.uint64) * GOLDEN)


def sliding_min(g: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, in linear time."""
    n = len(g) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    full = np.full(-(-len(g) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[:len(g)] = g
    blocks = full.reshape(-1, width)
    up = np.minimum.accumulate(blocks, axis=1).ravel()
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[:n], up[width - 1:width - 1 + n])


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Arrow list column from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))


def batch_of(schema: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(schema.values()), names=list(schema))


# --------------------------------------------------------------- components
def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components: ``edges(a, b)`` (long, not null) to ``(id, root)``.

    ``root`` is the smallest id of the component. Each round lowers a node's
    label to the smallest label among its neighbours, then jumps to the label
    of that label. Both joins are between plain tables, so a hub is split by
    the adaptive skew join, and the minimum is pre-aggregated before its shuffle.
    Node ids must carry their order: smaller label wins.
    """
    both = stage(
        edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        .unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        .where("u != v").distinct(), f"{name}-edges")
    label = stage(both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("low"))
                  .select("id", F.least("id", "low").alias("root")), f"{name}-label")
    while True:
        near = (both.join(label.withColumnsRenamed({"id": "v"}), "v")
                .groupBy(F.col("u").alias("id")).agg(F.min("root").alias("near")))
        lower = label.join(near, "id", "left").select("id", F.col("root").alias("was"),
                                                      F.least("root", "near").alias("now"))
        jump = label.select(F.col("id").alias("now"), F.col("root").alias("beyond"))
        after = stage(lower.join(jump, "now", "left")
                      .select("id", F.least("now", "beyond").alias("root"), "was"), f"{name}-label")
        label = after.select("id", "root")
        if after.where("root != was").limit(1).count() == 0:
            return label
