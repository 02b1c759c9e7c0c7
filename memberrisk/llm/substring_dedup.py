"""Substring dedup by level-wise doubling (operator 8).

Windows of words that repeat in another document at one length, and those
alone, are extended to twice the length, until no candidates survive.

Level 0 has half windows (6 words for windows of 13) and stands for them by selected
ones: the smallest hash among neighbouring half windows, as many as one window holds.
Equal windows hold the same selected half window, so they can repeat only if it
does. Level 1 has the windows themselves, levels 2, 3, ... windows of 26, 52, ...
words; each looks at every window both halves of which repeat, as those of any
repeated window do.

At each level a task first gathers equal windows of its own rows into one row
(hash, documents), so a passage of a third of all texts makes one row a task
and not one a text. What repeats goes back to its documents by a join on the
id; a fixed-size map of the ids spares the other texts that shuffle. Later
levels read only the texts that still have candidates. Copies of a whole text
are told by its hash before all this: only the one with the smallest id is
looked at, and the others lose every word (from one window's length on).

A word is removed when a window (level 1) covers it whose word sequence also
starts in a document with a smaller ``doc_id``; windows are judged on the input.
``reach`` is the longest level at which a window of the document repeats; a repeat of
m words is seen at every level of at most m words. ``longest`` is the longest level
of which a repeat has room for two windows side by side (for one at level 1).

Edge cases: null or empty text has no words. Rows with a null ``doc_id`` stay
whole and remove nothing. Rows with the same id are not compared with each
other; each is judged by its own text. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memberrisk.llm import common as C

WINDOW = 13
#: Windows gathered in a task before they are written as rows.
GATHER = 1 << 19
Batches = Iterator[pa.RecordBatch]
Found = Iterator[tuple[np.ndarray, int]]


def _starts(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of the window of ``length`` words from each position."""
    if len(h) < length:
        return np.zeros(0, np.uint64)
    return C.span_hash(C.prefix_hash(h), np.arange(len(h) - length + 1), length)


class _Gather:
    """Collects (hash, document) and writes one row for each hash of a bunch."""

    def __init__(self) -> None:
        self.hash: list[np.ndarray] = []
        self.doc: list[np.ndarray] = []
        self.n = 0

    def add(self, h: np.ndarray, doc: int) -> None:
        self.hash.append(h)
        self.doc.append(np.full(len(h), doc, np.int64))
        self.n += len(h)

    def rows(self) -> Batches:
        if not self.n:
            return
        h, doc = np.concatenate(self.hash), np.concatenate(self.doc)
        self.__init__()
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
        h, doc = h[new], doc[new]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        ends = np.concatenate([first, [len(h)]])
        rest = np.ones(len(h), bool)
        rest[first] = False  # a row's smallest document is its own column, the others are an array
        before = np.concatenate([[0], np.cumsum(rest)])
        for i in range(0, len(first), 50_000):
            j = min(i + 50_000, len(first))
            lo, hi = ends[i], ends[j]
            offsets = before[ends[i:j + 1]] - before[lo]
            none = np.append(np.diff(offsets) == 0, False)
            more = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), mask=none),
                                            pa.array(doc[lo:hi][rest[lo:hi]], pa.int64()))
            yield C.batch_of({"hash": pa.array(C.signed(h[first[i:j]])), "doc": pa.array(doc[first[i:j]]), "more": more})


_WINDOWS = "hash long, doc long, more array<long>"


def _gathered(found: Callable[[pa.RecordBatch], Found]) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        bunch = _Gather()
        for batch in batches:
            for h, doc in found(batch):
                bunch.add(h, doc)
                if bunch.n >= GATHER:
                    yield from bunch.rows()
        yield from bunch.rows()

    return run


def _repeated(windows: DataFrame, name: str) -> DataFrame:
    """Per document: its window hashes that occur in another document too, and
    whether the smallest such document is smaller (``again.hash``, ``again.later``)."""
    one = Window.partitionBy("hash")
    again = (windows
             .select("hash", "doc", "more", F.min("doc").over(one).alias("low"),
                     F.max(F.coalesce(F.element_at("more", -1), "doc")).over(one).alias("high"))
             .where("low < high")
             .select("hash", "low", F.explode(F.concat(F.array("doc"), F.coalesce("more", F.array().cast("array<long>")))).alias("doc_id")))
    return C.stage(again.groupBy("doc_id").agg(
        F.collect_list(F.struct("hash", F.expr("low < doc_id").alias("later"))).alias("again")), name)


def _own_words(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    for w in C.words(batch.column(1)):
        for d in range(len(w.first) - 1):
            yield w.row + d, w.hash[w.first[d]:w.first[d + 1]]


def _hashes(column: pa.Array, row: int) -> np.ndarray:
    return column[row].values.to_numpy(zero_copy_only=False).view(np.uint64)


def _halves(window: int) -> Callable[[pa.RecordBatch], Found]:
    half = window // 2

    def found(batch: pa.RecordBatch) -> Found:
        ids = batch.column(0).to_numpy()
        for row, h in _own_words(batch):
            chosen = C.sliding_min(C.grams(h, half), window - half + 1)
            if len(chosen):
                yield np.unique(chosen), ids[row]

    return found


def _all_windows(window: int) -> Callable[[pa.RecordBatch], Found]:
    half = window // 2

    def found(batch: pa.RecordBatch) -> Found:
        ids = batch.column(0).to_numpy()
        for row, h in _own_words(batch):
            chosen = C.sliding_min(C.grams(h, half), window - half + 1)
            if len(chosen):
                yield _starts(h, window)[np.isin(chosen, _hashes(batch.column(2), row))], ids[row]

    return found


def _doubled(length: int) -> Callable[[pa.RecordBatch], Found]:
    """The windows of twice ``length`` both halves of which repeat."""

    def found(batch: pa.RecordBatch) -> Found:
        ids = batch.column(0).to_numpy()
        for row, h in _own_words(batch):
            if len(h) < 2 * length:
                continue
            hit = np.isin(_starts(h, length), _hashes(batch.column(2), row))
            able = hit[:-length] & hit[length:]
            if able.any():
                yield _starts(h, 2 * length)[able], ids[row]

    return found


def copies(docs: DataFrame, name: str) -> DataFrame:
    """Per id: hashes of the texts (``texts``) that a smaller id has too."""
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text", F.length("text")).alias("t"))
    low = C.stage(rows.groupBy("t").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
                  .where("low < high").select("t", "low"), f"{name}-texts")
    return C.stage(rows.join(low, "t").where("doc_id > low").groupBy("doc_id").agg(F.collect_set("t").alias("texts")), f"{name}-copies")


def _text_hash():
    return F.xxhash64("text", F.length("text"))


def levels(docs: DataFrame, again: DataFrame, window: int = WINDOW, name: str = "substring") -> Iterator[tuple[int, DataFrame]]:
    """(length, marks) of each level from ``window`` on; marks as in ``_repeated``, gone when the next are asked for.
    ``again``: the copies."""
    known = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = C.IdFilter.of(again, "doc_id")
    halves = _gathered(_halves(window))
    single = held.keep(known, "doc_id").join(again, "doc_id", "left").where(
        F.expr("texts IS NULL") | ~F.array_contains("texts", _text_hash())).select("doc_id", "text")
    windows = held.run(known, "doc_id", halves, _WINDOWS, False).unionByName(single.mapInArrow(halves, _WINDOWS))
    marks = _repeated(windows, f"{name}-{window // 2}")

    def texts_of(marks: DataFrame, texts: DataFrame) -> DataFrame:
        return texts.join(marks, "doc_id").select("doc_id", "text", F.col("again.hash").alias("hash"))

    texts = C.IdFilter.of(marks, "doc_id").keep(known, "doc_id")
    after = _repeated(texts_of(marks, texts).mapInArrow(_gathered(_all_windows(window)), _WINDOWS), f"{name}-{window}")
    C.unstage(marks)
    length, marks = window, after
    texts, left = C.IdFilter.of(marks, "doc_id").keep(known, "doc_id"), None
    while marks.limit(1).count():
        yield length, marks
        rest = C.stage(texts_of(marks, texts), f"{name}-texts")  # later levels read no other texts
        C.unstage(marks)
        if left is not None:
            C.unstage(left)
        left = rest
        marks = _repeated(left.mapInArrow(_gathered(_doubled(length)), _WINDOWS), f"{name}-{2 * length}")
        texts, length = left.select("doc_id", "text"), 2 * length


def _kept(batch: pa.RecordBatch, window: int, marked: bool, digest: bool) -> pa.RecordBatch:
    """Words, removed words, and the kept text or its digest. Columns: doc_id, text[, hash, later, copy]."""
    n = batch.num_rows
    total, removed, texts = np.zeros(n, np.int64), np.zeros(n, np.int64), [b""] * n
    for w in C.words(batch.column(1)):
        keep = np.ones(len(w.hash), bool)
        for d in range(len(w.first) - 1) if marked else ():
            lo, hi, row = w.first[d], w.first[d + 1], w.row + d
            if hi - lo < window:
                continue
            if batch.column(4)[row].as_py():
                keep[lo:hi] = False
                continue
            later = batch.column(3)[row].values.to_numpy(zero_copy_only=False).astype(bool)
            hit = np.isin(_starts(w.hash[lo:hi], window), _hashes(batch.column(2), row)[later])
            cover = np.zeros(hi - lo + 1, np.int64)
            cover[:len(hit)] += hit
            cover[window:window + len(hit)] -= hit
            keep[lo:hi] = np.cumsum(cover[:-1]) == 0
        count = np.concatenate([[0], np.cumsum(keep)])
        rows = slice(w.row, w.row + len(w.first) - 1)
        total[rows] = np.diff(w.first)
        left = count[w.first[1:]] - count[w.first[:-1]]
        removed[rows] = total[rows] - left
        # Bytes of kept words, and the blank before each but a text's first.
        inside = np.zeros(len(w.data) + 1, np.int8)
        inside[w.start[keep]] += 1
        np.subtract.at(inside, w.end[keep], 1)
        inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        number = np.flatnonzero(keep)
        doc = np.searchsorted(w.first, number, side="right") - 1
        blank = w.start[number[count[number] > count[w.first[doc]]]] - 1
        data = w.data.copy()
        data[blank] = 0x20
        inside[blank] = True
        ends = np.concatenate([[0], np.cumsum(inside)])[w.edge]
        data = data[inside].tobytes()
        for d in range(len(w.first) - 1):
            texts[w.row + d] = data[ends[d]:ends[d + 1]]
    last = pa.array([hashlib.sha256(t).hexdigest() for t in texts] if digest else [t.decode() for t in texts], pa.string())
    return C.batch_of({"doc_id": batch.column(0), "n_words": pa.array(total), "n_removed": pa.array(removed), "kept": last,
                       "copied": batch.column(4) if marked else pa.array(np.zeros(n, bool))})


def dedup(docs: DataFrame, window: int = WINDOW, name: str = "substring", digest: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, longest, reach`` and ``kept``, the text that stays (or its sha-256), of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    again = copies(docs, name)
    later, seen = None, None
    for length, found in levels(docs, again, window, name):
        if later is None:
            later = C.stage(found.select("doc_id", F.filter("again", lambda e: e["later"]).alias("again")).where("size(again) > 0")
                            .join(again, "doc_id", "full"), f"{name}-later")
        at = C.stage(found.select("doc_id", F.lit(length).cast("long").alias("reach")), f"{name}-reach")
        seen = at if seen is None else seen.unionByName(at)
    if later is None:
        later = C.stage(again.select("doc_id", F.expr("CAST(NULL AS array<struct<hash:long,later:boolean>>)").alias("again"), "texts"), f"{name}-later")
        seen = again.select("doc_id", F.lit(0).cast("long").alias("reach")).limit(0)
    top = C.stage(seen.groupBy("doc_id").agg(F.max("reach").alias("reach")), f"{name}-longest")
    held = C.IdFilter.of(later, "doc_id")
    # Texts that lose words take the join; the others never move.
    joined = held.keep(docs, "doc_id").join(later, "doc_id", "left").select(
        "doc_id", "text", F.coalesce(F.col("again.hash"), F.array().cast("array<long>")).alias("hash"),
        F.coalesce(F.col("again.later"), F.array().cast("array<boolean>")).alias("later"),
        F.coalesce(F.array_contains("texts", _text_hash()), F.lit(False)).alias("copy"))
    shape = "doc_id long, n_words long, n_removed long, kept string, copied boolean"
    rows = C.map_batches(joined, lambda b: _kept(b, window, True, digest), shape).unionByName(held.run(
        docs, "doc_id", lambda batches: (_kept(b, window, False, digest) for b in batches), shape, False))
    # A copy repeats whole: the longest level that it has room for.
    whole = F.expr(f"CAST({window} * pow(2, floor(log2(n_words / {window}.0))) AS long)")
    zero = F.lit(0).cast("long")
    rows = rows.join(top, "doc_id", "left").withColumn("_seen", F.coalesce("reach", zero))
    two = F.when(F.col("_seen") > window, (F.col("_seen") / 2).cast("long")).otherwise(F.col("_seen"))
    return rows.select(
        "doc_id", "n_words", "n_removed", "kept",
        F.when((F.col("n_removed") == F.col("n_words")) & (F.col("n_words") >= window), F.greatest(whole, two)).otherwise(two).alias("longest"),
        F.when(F.col("copied") & (F.col("n_words") >= window), F.greatest(whole, "_seen")).otherwise(F.col("_seen")).alias("reach"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(C.documents(spark, sf_dir), WINDOW, "op8", digest=True)
    return out.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(l) - 11)) AS i, l FROM w WHERE len(l) >= 13),
g AS (SELECT doc_id, i, array_to_string(l[i:i + 12], ' ') AS t FROM s),
f AS (SELECT t, min(doc_id) AS low FROM g GROUP BY t HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN f USING (t) WHERE low < doc_id),
d AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id),
k AS (SELECT w.doc_id, len(l) AS n, coalesce(len(gone), 0) AS r,
      CASE WHEN gone IS NULL THEN l ELSE list_transform(list_filter(range(1, len(l) + 1),
           lambda x: NOT list_contains(gone, x)), lambda x: l[x]) END AS kept
      FROM w LEFT JOIN d USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, r::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
