"""Suffix-array dedup over sparse suffixes (operator 7).

Only suffixes that start at content-selected positions are kept: the smallest
hash among ``WIDTH`` neighbouring ``GRAM``-word grams. Equal passages select
equal positions, so a passage of ``least`` words that repeats holds a kept suffix
among its first ``WIDTH`` words, with ``least - WIDTH + 1`` words (the reach)
still to come. Suffixes are sorted by the fingerprint of their reach, then by
document and position, and compared with their neighbours of other documents:
equal neighbours share the reach. Neighbouring hits on one diagonal make one
match, which is extended to the left and to the right by comparing words (by
selection, at most ``WIDTH - 1`` on each side are left to find).

Of every passage of at least ``least`` words that a document shares with another
one, at least the reach (43 words of 50) is covered by matches of that document;
matches have at least the reach. (A match ends where its neighbour's words end.
Where several documents share the middle of a passage, the neighbour may share
up to ``WIDTH - 1`` words less of it at an end than another document does.) Each suffix is compared with neighbours only, so
a passage of any number of documents gives matches in proportion to them. A
task first gathers equal suffixes of its own rows, so such a passage moves as
one row a task.

Edge cases: null or short texts have no matches. Rows without an id are not
searched. Rows with the same id are one document: not compared with each other;
a place is a word position in the row that has those words. Repeated rows give
their matches once. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memberrisk.llm import common as C

LEAST = 50
GRAM = 6
WIDTH = 8
GATHER = 1 << 20


def selected(h: np.ndarray) -> np.ndarray:
    """Positions of one text's kept suffixes."""
    g = C.grams(h, GRAM)
    low = C.sliding_min(g, WIDTH)
    if not len(low):
        return np.zeros(0, np.int64)
    edge = np.zeros(WIDTH - 1, np.uint64)
    # A position is selected when the largest minimum of the blocks around it is its own hash.
    return np.flatnonzero(~C.sliding_min(~np.concatenate([edge, low, edge]), WIDTH) == g)


def _own_words(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    for w in C.words(batch.column(1)):
        for d in range(len(w.first) - 1):
            yield w.row + d, w.hash[w.first[d]:w.first[d + 1]]


def suffixes(docs: DataFrame, reach: int) -> DataFrame:
    """(key, doc, pos, more): a task's kept suffixes, those of one key in a row, in order."""

    def rows(keys: list[np.ndarray], docs: list[np.ndarray], pos: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, doc, at = np.concatenate(keys), np.concatenate(docs), np.concatenate(pos)
        order = np.lexsort((at, doc, key))
        key, doc, at = key[order], doc[order], at[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends = np.concatenate([first, [len(key)]])
        rest = np.ones(len(key), bool)
        rest[first] = False
        before = np.concatenate([[0], np.cumsum(rest)])
        for i in range(0, len(first), 50_000):
            j = min(i + 50_000, len(first))
            lo, hi = ends[i], ends[j]
            offsets = before[ends[i:j + 1]] - before[lo]
            none = np.append(np.diff(offsets) == 0, False)
            part = rest[lo:hi]
            pair = pa.StructArray.from_arrays([pa.array(doc[lo:hi][part], pa.int64()), pa.array(at[lo:hi][part], pa.int32())], ["doc", "pos"])
            yield C.batch_of({"key": pa.array(C.signed(key[first[i:j]])), "doc": pa.array(doc[first[i:j]]),
                              "pos": pa.array(at[first[i:j]], pa.int32()),
                              "more": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), mask=none), pair)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, names, pos, held = [], [], [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for row, h in _own_words(batch):
                at = selected(h)
                at = at[at <= len(h) - reach]
                if len(at):
                    keys.append(C.span_hash(C.prefix_hash(h), at, reach))
                    names.append(np.full(len(at), ids[row], np.int64))
                    pos.append(at)
                    held += len(at)
                    if held >= GATHER:
                        yield from rows(keys, names, pos)
                        keys, names, pos, held = [], [], [], 0
        if held:
            yield from rows(keys, names, pos)

    return docs.mapInArrow(run, "key long, doc long, pos int, more array<struct<doc:long,pos:int>>")


def neighbours(kept: DataFrame) -> DataFrame:
    """(doc, pos, key, other, other_pos): each suffix that another document has too, with a neighbour."""
    one = Window.partitionBy("key")
    last = F.coalesce(F.element_at("more", -1)["doc"], "doc")
    again = kept.select("key", "doc", "pos", "more", F.min("doc").over(one).alias("low"), F.max(last).over(one).alias("high")).where("low < high")
    entry = again.select("key", F.explode(F.concat(F.array(F.struct("doc", "pos")), F.coalesce(
        "more", F.expr("CAST(array() AS array<struct<doc:long,pos:int>>)")))).alias("e")).select("key", "e.doc", "e.pos")
    order = Window.partitionBy("key").orderBy("doc", "pos")
    entry = entry.select(
        "key", "doc", "pos", F.lag(F.struct("doc", "pos")).over(order).alias("a"), F.lead(F.struct("doc", "pos")).over(order).alias("b"),
        F.min(F.struct("doc", "pos")).over(one).alias("first"), F.max(F.struct("doc", "pos")).over(one).alias("final"))
    other = F.when(F.col("a.doc") != F.col("doc"), F.col("a")).when(F.col("b.doc") != F.col("doc"), F.col("b")).when(
        F.col("first.doc") != F.col("doc"), F.col("first")).otherwise(F.col("final"))
    return entry.select("doc", "pos", "key", other.alias("o")).select("doc", "pos", "key", F.col("o.doc").alias("other"), F.col("o.pos").alias("other_pos"))


def matches(docs: DataFrame, least: int = LEAST, name: str = "suffix") -> DataFrame:
    """``doc_id, start, n_words, match_doc_id, match_start`` (word positions) of each match of each document."""
    reach = least - WIDTH + 1
    if reach < GRAM:
        raise ValueError(f"least must be at least {GRAM + WIDTH - 1}")
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hits = neighbours(suffixes(docs, reach)).withColumn("diagonal", F.col("other_pos") - F.col("pos")).distinct()
    line = Window.partitionBy("doc", "other", "diagonal").orderBy("pos")
    fresh = F.coalesce((F.col("pos") - F.lag("pos").over(line) > reach).cast("int"), F.lit(1))
    run = F.sum("fresh").over(line.rowsBetween(Window.unboundedPreceding, 0))
    parts = (hits.withColumn("fresh", fresh).withColumn("run", run).groupBy("doc", "other", "diagonal", "run")
             .agg(F.min(F.struct("pos", "key")).alias("at"), (F.max("pos") + reach).alias("end"))
             .select(F.xxhash64("doc", "other", "diagonal", "at.pos").alias("id"), "doc", "other", "diagonal",
                     F.col("at.pos").alias("start"), "at.key", "end"))
    parts = C.stage(parts, f"{name}-parts")

    # The words around each part, from both documents.
    ends = parts.select(F.explode(F.array(
        F.struct(F.col("doc").alias("doc_id"), "id", F.lit(0).alias("side"), "start", "end", "key"),
        F.struct(F.col("other").alias("doc_id"), "id", F.lit(1).alias("side"), (F.col("start") + F.col("diagonal")).alias("start"),
                 (F.col("end") + F.col("diagonal")).alias("end"), "key"))).alias("e")).select("e.*")
    asked = ends.groupBy("doc_id").agg(F.collect_list(F.struct("id", "side", "start", "end", "key")).alias("asked"))
    texts = C.IdFilter.of(ends, "doc_id").keep(docs, "doc_id").join(asked, "doc_id").select("doc_id", "text", "asked")

    def around(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, sides, left, right = [], [], [], []
        for row, h in _own_words(batch):
            ask = batch.column(2)[row].values
            column = {n: ask.field(n).to_numpy(zero_copy_only=False) for n in ("id", "side", "start", "end", "key")}
            inside = np.flatnonzero((column["end"] <= len(h)))
            if not len(inside):
                continue
            own = C.signed(C.span_hash(C.prefix_hash(h), column["start"][inside].astype(np.int64), reach)) == column["key"][inside]
            words = C.signed(h)
            for i in inside[own].tolist():  # a row of the same id without these words is not meant
                start, end = column["start"][i], column["end"][i]
                ids.append(column["id"][i])
                sides.append(column["side"][i])
                left.append(words[max(0, start - WIDTH):start][::-1])
                right.append(words[end:end + WIDTH])
        flat = lambda x: C.lists(np.concatenate([np.zeros(0, np.int64), *x]), np.concatenate([[0], np.cumsum([len(y) for y in x])]), pa.int64())
        return C.batch_of({"id": pa.array(ids, pa.int64()), "side": pa.array(sides, pa.int32()), "left": flat(left), "right": flat(right)})

    words = C.map_batches(texts, around, "id long, side int, left array<long>, right array<long>")
    side = lambda n, c: F.max(F.when(F.col("side") == n, F.col(c)))
    met = words.groupBy("id").agg(side(0, "left").alias("l0"), side(1, "left").alias("l1"), side(0, "right").alias("r0"), side(1, "right").alias("r1"))
    # Words in common from the part's end outward: up to the first place that differs.
    count = lambda a, b: F.expr(
        f"aggregate(zip_with({a}, {b}, (x, y) -> coalesce(x = y, false)), struct(0 AS n, true AS go), "
        "(s, same) -> struct(s.n + IF(s.go AND same, 1, 0) AS n, s.go AND same AS go), s -> s.n)")
    grown = met.select("id", count("l0", "l1").alias("l"), count("r0", "r1").alias("r"))
    out = parts.join(grown, "id", "left").na.fill(0, ["l", "r"])
    return out.select(
        F.col("doc").alias("doc_id"), (F.col("start") - F.col("l")).cast("long").alias("start"),
        (F.col("end") - F.col("start") + F.col("l") + F.col("r")).cast("long").alias("n_words"),
        F.col("other").alias("match_doc_id"), (F.col("start") + F.col("diagonal") - F.col("l")).cast("long").alias("match_start"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(C.documents(spark, sf_dir), LEAST, "op7")
