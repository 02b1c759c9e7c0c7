"""Benchmark decontamination by template canonicalisation (operator 2).

Texts become sequences of terms (lower-cased runs of letters, digits and bytes
beyond ASCII). Numbers, names (capitalised inside a sentence) and units (after a
number) become typed placeholders; neighbouring numbers or names make one. A
capitalised term that opens a sentence may be a name or not: windows with such
terms are made both ways, all as words and all as names.
Windows of ``window`` template terms, at least half of them literal, are
hash-joined with the windows of the benchmark's items.

For each (document, item) the values behind the placeholders are paired in
order. The pairing must be one-to-one for each type: a question with other
numbers or names, used alike throughout, is the same question. It is judged for
the whole document and for each occurrence: windows that meet on one diagonal
(place in the document less place in the item), and chains that stray up to a
window from it, as words put in or left out do. The best counts, when the windows
it shares, of all the item's, reach ``coverage``; of slots that contradict each
other only windows with the item's own values count.

Whatever its share, a verbatim run of ``RUN`` terms (of the whole item, where it has
fewer) counts too: items of numbers or names, of few terms, and a long quotation
from a longer item. Then ``share`` is of the item's runs, where that is more.
Characters of scripts without blanks are terms of their own.

A fixed-size map of the benchmark's window hashes (2**20 entries) spares the
windows that cannot match their shuffle; the join is exact on 64-bit hashes.
An item of fewer than ``window`` but at least ``LEAST`` terms is one window.

Edge cases: null texts and items, and those without a letter or digit, match
nothing; an item of one word is in every document with the word. Rows are told apart by id and text, so null and repeated
ids are judged by their own text. Repeated items each count. Empty tables give
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memberrisk.llm import common as C

WINDOW = 8
LEAST = 5
RUN = 13
COVERAGE = 0.5
MAP_BITS = 20

# Names of units.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound "
    "pounds ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days "
    "week weeks month months year years percent degree degrees dollar dollars cent cents euro euros mph kmh watt watts "
    "volt volts byte bytes kb mb gb tb")

LITERAL, NUMBER, NAME, UNIT = range(4)
PLAIN, NAMED, VERBATIM = range(3)  # windows: of the first template, with openers as names, of the terms themselves
_OWN = np.uint64(0x5851F42D4C957F2D)  # tells the hashes of verbatim runs from those of windows
_PLACE = C.mix(np.arange(101, 105, dtype=np.uint64))
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;\n\r\"()"]] = True


def _unit_hashes() -> np.ndarray:
    return np.sort(np.concatenate([w.hash for w in C.words(pa.array([UNITS]), lower=True, terms=True)]))


_UNIT_HASHES = _unit_hashes()


def _capital(w: C.Words) -> np.ndarray:
    """Terms whose first letter is upper case and whose second is not."""
    data = np.concatenate([w.data, np.zeros(4, np.uint8)])
    upper = C.fold(data) != data
    upper = upper | np.concatenate([upper[1:], [False]])  # a two-byte character, by its first byte
    upper |= (data >= 65) & (data <= 90)
    head = data[w.start]
    second = w.start + np.where(head < 0x80, 1, np.where(head < 0xE0, 2, np.where(head < 0xF0, 3, 4)))
    letter = (data[second] >= 97) & (data[second] <= 122) | (data[second] >= 0xC2)
    return upper[w.start] & (second < w.end) & letter & ~upper[second]


class Template(NamedTuple):
    """A text with typed placeholders."""

    hash: np.ndarray    # of each template term
    kind: np.ndarray
    value: np.ndarray   # hash of the terms behind it
    place: np.ndarray   # its place in the text's first template
    opener: np.ndarray  # it is a name because it opens a sentence


def templates(column: pa.Array) -> Iterator[tuple[int, list[Template], np.ndarray]]:
    """(row, templates, terms) of each text: sentence openers as words and, where there are capitalised ones, as names."""
    for w in C.words(column, lower=True, terms=True, scripts=True):
        n = len(w.hash)
        if not n:
            continue
        digits = np.concatenate([[0], np.cumsum((w.data >= 48) & (w.data <= 57))])
        stops = np.concatenate([[0], np.cumsum(_STOP[w.data])])
        doc = np.searchsorted(w.first, np.arange(n), side="right") - 1
        opens = np.concatenate([[True], doc[1:] != doc[:-1]])  # first term of its text
        sentence = opens | (stops[w.start] > stops[np.concatenate([[0], w.end[:-1]])])
        capital = _capital(w)
        number = digits[w.end] > digits[w.start]
        at = np.minimum(np.searchsorted(_UNIT_HASHES, w.hash), len(_UNIT_HASHES) - 1)
        after = np.concatenate([[False], number[:-1]]) & ~opens
        unit = (_UNIT_HASHES[at] == w.hash) & after
        made, base = [], None
        for name in (capital & ~sentence, capital):
            kind = np.where(number, NUMBER, np.where(name, NAME, np.where(unit, UNIT, LITERAL)))
            follows = (kind == NUMBER) | (kind == NAME) & ~sentence  # an opener starts a name of its own
            same = np.concatenate([[False], kind[1:] == kind[:-1]]) & ~opens & follows
            keep = np.flatnonzero(~same)
            index = np.arange(n)
            run = index - np.maximum.accumulate(np.where(same, 0, index))  # of a term in its run
            value = np.add.reduceat(C.mix(w.hash + run.astype(np.uint64) * C.GOLDEN), keep)
            first = np.searchsorted(keep, w.first)
            base = (keep, first) if base is None else base
            place = np.searchsorted(base[0], keep, side="right") - 1
            template = np.where(kind[keep] == LITERAL, w.hash[keep], _PLACE[kind[keep]])
            made.append((first, template, kind[keep], value, place, (kind == NAME)[keep] & sentence[keep]))
        for d in range(len(w.first) - 1):
            if w.first[d] < w.first[d + 1]:
                out = []
                for first, template, kind, value, place, opener in made:
                    part = slice(first[d], first[d + 1])
                    if not out or opener[part].any():
                        out.append(Template(template[part], kind[part], value[part], place[part] - base[1][d], opener[part]))
                yield w.row + d, out, w.hash[w.first[d]:w.first[d + 1]]


def _windows(t: Template, window: int, again: bool) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the windows of which half the terms are literal; with ``again``, of those with an opener."""
    g = C.grams(t.hash, window)
    if not len(g):
        return np.zeros(0, np.int64), g
    literal = np.concatenate([[0], np.cumsum(t.kind == LITERAL)])
    keep = 2 * (literal[window:] - literal[:-window]) >= window
    if again:  # the others are windows of the first template
        openers = np.concatenate([[0], np.cumsum(t.opener)])
        keep &= openers[window:] > openers[:-window]
    at = np.flatnonzero(keep)
    return at, g[at]


_SCHEMA = "key long, hash long, way int, pos array<int>, slots array<long>"


def _rows(df: DataFrame, windows: list[int], runs: list[int], whole_if_short: bool, held) -> DataFrame:
    """A row for each text of ``df(key, text)`` and hash of a window or run: its places and, one place after the
    other, the value hashes of its slots, the kind in the last two bits."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        key, hashes, ways, pos, slots, edge, ends = [], [], [], [], [], [0], [0]

        def add(row: int, way: int, at: np.ndarray, h: np.ndarray, place, slots_of) -> None:
            if held is not None:
                hit = held.value[(h >> np.uint64(64 - MAP_BITS)).astype(np.int64)]
                at, h = at[hit], h[hit]
            places: dict[int, list[int]] = {}
            for p, one in zip(at.tolist(), C.signed(h).tolist()):
                places.setdefault(one, []).append(p)
            for one, own in places.items():
                key.append(keys[row])
                hashes.append(one)
                ways.append(way)
                pos.extend(place[own].tolist() if place is not None else own)
                edge.append(len(pos))
                part = [slots_of(p) for p in own] if slots_of else []
                slots.extend(part)
                ends.append(ends[-1] + sum(map(len, part)))

        for row, made, terms in templates(batch.column(1)):
            for way, t in enumerate(made):
                marked = C.signed((t.value & ~np.uint64(3)) | t.kind.astype(np.uint64))
                for length in [len(t.hash)] if whole_if_short and LEAST <= len(t.hash) < windows[0] else windows:
                    at, h = _windows(t, length, way == NAMED)
                    add(row, way, at, h, t.place, lambda p: marked[p:p + length][t.kind[p:p + length] != LITERAL])  # noqa: B023
            for length in [min(len(terms), RUN)] if whole_if_short else runs:
                g = C.grams(terms, length)
                add(row, VERBATIM, np.arange(len(g)), g ^ _OWN, None, None)
        return C.batch_of({"key": pa.array(key, pa.int64()), "hash": pa.array(hashes, pa.int64()),
                           "way": pa.array(ways, pa.int32()), "pos": C.lists(np.array(pos, np.int32), np.array(edge), pa.int32()),
                           "slots": C.lists(np.concatenate([np.zeros(0, np.int64), *slots]), np.array(ends), pa.int64())})

    return C.map_batches(df, run, _SCHEMA)


def _one_to_one(pairs: set[tuple[int, int]]) -> bool:
    return len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs})


def _split(pos: list[int], slots: list[int]) -> list[tuple[int, tuple[int, ...]]]:
    """(place, slots) of a window's places; all have as many slots."""
    n = len(slots) // len(pos)
    return [(p, tuple(slots[i * n:i * n + n])) for i, p in enumerate(pos)]


def best_occurrence(met: list[dict], stray: int = WINDOW) -> tuple[int, bool]:
    """(windows, consistent) of the occurrence of an item in a document that shares most of the item's windows.

    ``met`` has, for each hash that both hold, ``pos, slots, item_pos, item_slots``.
    """
    both = [(_split(m["pos"], m["slots"]), _split(m["item_pos"], m["item_slots"])) for m in met]
    pairs = {e for here, there in both for a in {s for _, s in here} for b in {s for _, s in there} for e in zip(a, b)}
    n_all = len({q for _, there in both for q, _ in there})
    if _one_to_one(pairs):
        return n_all, True  # no occurrence has more
    same = set()  # places of the item whose values the document has
    meets: dict[tuple[int, int], set] = {}
    for here, there in both:
        held = {s for _, s in here}
        same |= {q for q, s in there if s in held}
        for q, b in there:
            for p, a in here:
                meets.setdefault((p, q), set()).add((a, b))
    best = len(same), False
    places: dict[int, list[int]] = {}
    size: dict[int, int] = {}
    for p, q in sorted(meets):
        places.setdefault(q, []).append(p)
        size[p - q] = size.get(p - q, 0) + 1
    order = sorted(places)
    for reach in (0, stray):
        for d in sorted(size, key=lambda d: (-size[d], d)):
            if best == (n_all, True):
                return best
            if sum(size.get(e, 0) for e in range(d - reach, d + reach + 1)) < best[0]:
                continue
            now, last, chain = d, -1, []
            for q in order:
                near = [p for p in places[q] if p > last and abs(p - q - d) <= reach]
                if near:
                    last = min(near, key=lambda p: (abs(p - q - now), p))
                    now = last - q
                    chain.append(meets[last, q])
            if _one_to_one({e for one in chain for a, b in one for e in zip(a, b)}):
                best = max(best, (len(chain), True))
            else:
                best = max(best, (sum(any(a == b for a, b in one) for one in chain), False))
    return best


def _judge(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = []
    for met, total, total_plain, total_runs in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5))):
        windows, plain = [m for m in met if m["way"] != VERBATIM], [m for m in met if m["way"] == PLAIN]
        runs = len({q for m in met if m["way"] == VERBATIM for q in m["item_pos"]})
        n, consistent = best_occurrence(windows)
        share = n / max(total, 1)
        if plain and (share < 1 or not consistent):  # openers may be words after all
            n_plain, consistent_plain = best_occurrence(plain)
            if (n_plain / total_plain, consistent_plain) > (share, consistent):
                n, consistent, share = n_plain, consistent_plain, n_plain / total_plain
        if runs / total_runs > share:
            n, share = runs, runs / total_runs
        found.append((n, share, consistent, runs > 0))
    return C.batch_of({"key": batch.column(0), "item": batch.column(1), "n_windows": pa.array([f[0] for f in found], pa.int64()),
                       "share": pa.array([f[1] for f in found], pa.float64()), "consistent": pa.array([f[2] for f in found], pa.bool_()),
                       "verbatim": pa.array([f[3] for f in found], pa.bool_())})


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE,
            name: str = "decontaminate") -> DataFrame:
    """``row_key, doc_id, item_id, n_windows, share, consistent`` of each contaminated document and item.

    ``row_key`` (``common.row_key``) tells apart rows with null or repeated ids.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.xxhash64(F.col("item_id").cast("long"), "text").alias("key"),
                             F.col("item_id").cast("long").alias("item_id"), "text").dropDuplicates(["key"])
    item_rows = C.stage(_rows(items.select("key", "text"), [window], [], True, None), f"{name}-items")
    named = items.select("key", "item_id")
    bits = item_rows.select(F.shiftrightunsigned("hash", 64 - MAP_BITS).alias("bit")).distinct().toPandas()  # at most 2**20
    held = np.zeros(1 << MAP_BITS, bool)
    held[bits["bit"].to_numpy(dtype=np.int64)] = True
    # Lengths of the items that are one window or one run: at most window - LEAST and RUN - 1 more.
    short, runs = _lengths(items, window)
    found = _rows(docs.select(C.row_key().alias("key"), "text"), [window, *short], [RUN, *runs], False, spark.sparkContext.broadcast(held))
    found = C.stage(found, f"{name}-found")
    starts = lambda of: F.size(F.array_distinct(F.flatten(F.collect_list(F.when(of, F.col("pos"))))))
    total = item_rows.groupBy("key").agg(starts(F.col("way") != VERBATIM).alias("total"), starts(F.col("way") == PLAIN).alias("total_plain"),
                                         starts(F.col("way") == VERBATIM).alias("total_runs"))
    other = item_rows.join(total, "key").select(
        F.col("key").alias("item"), "hash", F.col("way").alias("item_way"), F.col("pos").alias("item_pos"),
        F.col("slots").alias("item_slots"), "total", "total_plain", "total_runs")
    # Repeated rows have equal keys; a set holds what they share once.
    met = F.struct("hash", F.greatest("way", "item_way").alias("way"), "pos", "slots", "item_pos", "item_slots")
    pair = found.join(other, "hash").groupBy("key", "item").agg(
        F.collect_set(met).alias("met"), *(F.max(c).alias(c) for c in ("total", "total_plain", "total_runs")))
    pair = (C.map_batches(pair, _judge, "key long, item long, n_windows long, share double, consistent boolean, verbatim boolean")
            .where((F.col("share") >= coverage) | F.col("verbatim")))
    pair = C.stage(pair.select("key", "item", "n_windows", "share", "consistent"), f"{name}-pairs")
    keys = pair.select("key").distinct()
    ids = C.IdFilter.of(keys, "key").keep(docs.select(C.row_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id")), "key")
    return (pair.join(ids, "key").join(named.withColumnRenamed("key", "item"), "item")
            .select(F.col("key").alias("row_key"), "doc_id", "item_id", "n_windows", "share", "consistent"))


def _lengths(items: DataFrame, window: int) -> tuple[list[int], list[int]]:
    """Numbers of template terms (from ``LEAST`` and below ``window``) and of terms (below ``RUN``) of the items that have fewer."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = set()
        for _, made, terms in templates(batch.column(0)):
            n |= {(len(t.hash), False) for t in made if LEAST <= len(t.hash) < window}
            if len(terms) < RUN:
                n.add((len(terms), True))
        return C.batch_of({"n": pa.array([k for k, _ in sorted(n)], pa.int32()), "terms": pa.array([t for _, t in sorted(n)], pa.bool_())})

    rows = C.map_batches(items.select("text"), run, "n int, terms boolean").distinct().collect()
    return tuple(sorted(r["n"] for r in rows if r["terms"] == terms) for terms in (False, True))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, name: str = "decontaminate") -> DataFrame:
    """``docs`` (all columns) without the documents that hold an item."""
    key = C.free_name(docs, "__key")
    keys = matches(docs, benchmark, name=name).select(F.col("row_key").alias(key)).distinct()
    keys = C.stage(keys, f"{name}-keys")
    marked = docs.withColumn(key, C.row_key())
    held = C.IdFilter.of(keys, key)
    return held.drop(marked, key).unionByName(held.keep(marked, key).join(keys, key, "left_anti")).select(docs.columns)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(C.documents(spark, sf_dir), C.table(spark, sf_dir, "benchmark"), name="op2").select(
        "doc_id", "item_id", "n_windows", "share", "consistent")
