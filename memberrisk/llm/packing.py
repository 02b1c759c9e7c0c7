"""Best-fit packing by bin completion (operator 6).

Documents become pieces of at most ``capacity`` tokens; only longer documents
are cut. Packing depends on lengths alone, so the packing itself works on the
number of pieces of each length (at most ``capacity`` rows, whatever the input).

Bin completion: take the longest length that is left, enumerate undominated
fillings of the room beside it (a filling is dominated when another holds the
same lengths or longer ones), apply one as often as the counts allow, go on.
Best-fit decreasing gives the first incumbent; the first way down takes the
fullest fillings. Branches whose waste so far exceeds what a better solution may waste
are cut. The search ends at the bound ``ceil(tokens / capacity)`` or after
``NODES`` nodes with the best solution found; it never leaves a piece out.

The result, runs of equal sequences, is turned into places for the pieces by
their rank within their length. Ranks are made per (length, bucket of the id)
and shifted by the counts of the buckets before, so that a length that a third
of the pieces have is ranked by many tasks.

Edge cases: null or empty text is one piece of one token, the end id. Rows with
null or repeated ids are pieces of their own. An empty table packs into nothing.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memberrisk.llm import common as C
from memberrisk.llm import tokens

CAPACITY = 2048
BUCKETS = 1024
NODES = 4000


# ------------------------------------------------------------------ packing
@dataclass
class Run:
    """``times`` sequences that hold pieces of the same lengths, in this order."""

    lengths: tuple[int, ...]
    times: int


def _fillings(left: np.ndarray, room: int, wanted: int, tries: int = 400) -> list[tuple[int, ...]]:
    """Up to ``wanted`` undominated fillings of ``room`` from the counts ``left``, fullest first."""
    sizes = [int(s) for s in np.flatnonzero(left[:room + 1])[::-1]]
    if not sizes:
        return [()]
    found: dict[tuple[int, ...], int] = {}
    array = np.array(sizes)
    budget = tries

    def fill(chosen: list[tuple[int, int]], room: int, at: int) -> bool:
        nonlocal budget
        budget -= 1
        at = max(at, int(np.searchsorted(-array, -room)))  # the first size that still fits
        if at == len(sizes):
            found[tuple(x for x, n in chosen for _ in range(n))] = room
            return sum(r == 0 for r in found.values()) >= wanted
        for i in range(at, len(sizes)):
            for n in range(min(int(left[sizes[i]]), room // sizes[i]), 0, -1):
                if fill([*chosen, (sizes[i], n)], room - n * sizes[i], i + 1):
                    return True
                if budget <= 0:
                    return True
        return False

    fill([], room, 0)  # sizes differ on the way down, so it is at most 63 deep for 2048
    ranked = sorted(found, key=lambda f: (found[f], tuple(-x for x in f)))
    kept: list[tuple[int, ...]] = []
    for f in ranked:  # f is dominated by g when each of its pieces fits a longer one of g
        if not any(len(g) >= len(f) and all(x <= y for x, y in zip(f, g)) for g in kept):
            kept.append(f)
        if len(kept) == wanted:
            break
    return kept


def best_fit(counts: np.ndarray, capacity: int) -> list[Run]:
    """Best-fit decreasing: each piece, longest first, where the least room stays. Equal pieces and
    equal sequences are placed together."""
    open_: dict[int, list[Run]] = {}  # by room left
    rooms: list[int] = []             # those rooms, ascending
    for size in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[size])
        while left:
            i = bisect_left(rooms, size)
            if i == len(rooms):
                run, room = Run((), 1 << 62), capacity
            else:
                room = rooms[i]
                run = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[i]
            each = min(room // size, left)
            times = min(run.times, left // each)
            left -= each * times
            for lengths, n in (((*run.lengths, *[size] * each), times), (run.lengths, run.times - times)):
                if n and lengths:
                    rest = capacity - sum(lengths)
                    if n < 1 << 60:
                        if rest not in open_:
                            open_[rest] = []
                            insort(rooms, rest)
                        open_[rest].append(Run(lengths, n))
    return [run for runs in open_.values() for run in runs]


def complete_bins(counts: np.ndarray, capacity: int, nodes: int = NODES) -> list[Run]:
    """Runs of sequences for ``counts[length]`` pieces of each length."""
    left = counts.astype(np.int64).copy()
    total = int((left * np.arange(len(left))).sum())
    bound = -(-total // capacity)
    best = best_fit(counts, capacity)  # the first incumbent
    best_bins = sum(run.times for run in best)

    def moves() -> list[Run]:
        longest = int(np.flatnonzero(left)[-1])
        left[longest] -= 1
        out = []
        for f in _fillings(left, capacity - longest, 3):
            lengths = (longest, *f)
            uses = {x: lengths.count(x) for x in lengths}
            out.append(Run(lengths, min((int(left[x]) + (x == longest)) // n for x, n in uses.items())))
        left[longest] += 1
        return out

    def apply(run: Run, sign: int) -> None:
        for x in run.lengths:
            left[x] += sign * run.times

    # Depth first with an explicit stack: (moves still to try, the move that is applied).
    stack: list[tuple[list[Run], Run | None]] = []
    bins, waste, seen = 0, 0, 0
    if left.any() and best_bins > bound:
        stack.append((moves()[::-1], None))
    while stack:
        options, applied = stack[-1]
        if applied is not None:  # back from below
            apply(applied, 1)
            bins -= applied.times
            waste -= applied.times * (capacity - sum(applied.lengths))
            stack[-1] = (options, None)
        if not options or best_bins == bound or seen > nodes:
            stack.pop()
            continue
        run = options.pop()
        apply(run, -1)
        bins += run.times
        waste += run.times * (capacity - sum(run.lengths))
        stack[-1] = (options, run)
        seen += 1
        if waste > (best_bins - 1) * capacity - total:
            continue
        if not left.any():
            if bins < best_bins:
                best, best_bins = [a for _, a in stack if a is not None], bins
            continue
        stack.append((moves()[::-1], None))
    return best


def places(runs: list[Run]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(length, first rank, first sequence, offset) of each slot of each run, by length and rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for run in runs:
        offset = 0
        for x in run.lengths:
            rows.append((x, used.get(x, 0), sequence, offset))
            used[x] = used.get(x, 0) + run.times
            offset += x
        sequence += run.times
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return table[:, 0], table[:, 1], table[:, 2], table[:, 3]


# -------------------------------------------------------------------- Spark
def pieces(docs: DataFrame, path: str, spaced: bool, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``, little-endian unsigned 32-bit) of all documents."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[list] = [[], [], [], [], [], []]
        for doc, ids in zip(batch.column(0).to_pylist(), tokens.encode_column(batch.column(1), path, spaced)):
            for n, start in enumerate(range(0, len(ids), capacity)):
                part = ids[start:start + capacity].astype("<u4").tobytes()
                for column, value in zip(rows, (doc, n, start, len(part) // 4, zlib.crc32(part), part if with_ids else None)):
                    column.append(value)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
        return C.batch_of({n: pa.array(v, k) for n, v, k in zip(names, rows, kinds)})

    out = C.map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run,
                        "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")
    return out if with_ids else out.drop("ids")


def pack(rows: DataFrame, capacity: int = CAPACITY, name: str = "pack") -> DataFrame:
    """``rows`` with ``sequence_id`` and ``offset``; ``rows`` are written once and have ``length`` in 1..capacity."""
    spark = rows.sparkSession
    own = rows.columns
    rows = C.stage(rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(BUCKETS)).cast("int")),
                   f"{name}-pieces")
    held = C.stage(rows.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("n")), f"{name}-counts")
    by_length = held.groupBy("length").agg(F.sum("n").alias("n")).toPandas()  # at most `capacity` rows
    counts = np.zeros(capacity + 1, np.int64)
    counts[by_length["length"].to_numpy(dtype=np.int64)] = by_length["n"].to_numpy(dtype=np.int64)
    length, first, sequence, offset = places(complete_bins(counts, capacity))
    shared = spark.sparkContext.broadcast((length * (1 << 48) + first, first, sequence, offset))

    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("length", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("_before"))
    order = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (rows.withColumn("_rank", F.row_number().over(order)).join(held, ["length", "_bucket"])
              .select(*own, (F.col("_before") + F.col("_rank") - 1).alias("_rank")))
    at, rank = own.index("length"), len(own)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, first, sequence, offset = shared.value
        r = batch.column(rank).to_numpy()
        slot = np.searchsorted(keys, batch.column(at).to_numpy().astype(np.int64) * (1 << 48) + r, side="right") - 1
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:rank], pa.array(sequence[slot] + r - first[slot]), pa.array(offset[slot])],
            names=[*own, "sequence_id", "offset"])

    schema = ranked.drop("_rank").schema.add("sequence_id", "long").add("offset", "long")
    return C.map_batches(ranked, run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id`` and its ids, from packed pieces that carry ``ids``; a sequence is at most one capacity long."""
    return packed.groupBy("sequence_id").agg(F.expr(
        "concat_ws('', transform(array_sort(collect_list(struct(offset, hex(ids) AS h))), e -> e.h))").alias("h")).select(
        "sequence_id", F.unhex("h").alias("ids"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = pieces(C.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), spaced=False)
    return pack(rows, CAPACITY, "op6").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
