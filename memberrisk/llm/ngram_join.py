"""N-gram Jaccard join (operator 1).

A text's set holds its distinct ``k``-word shingles (A-Z lower-cased; a text of
fewer than ``k`` words has its whole word sequence as its one shingle; a text
without words has an empty set and links with nothing). Two texts link when
``100 * |A & B| >= percent * |A | B|``.

Plan
 1. *Order.* A sketch of 2**22 cells counts shingles over all texts. Cells that
    are heavy in some input partition keep their summed count; the others count
    as rare. Shingles are ordered by (count class, hash): rare first, and a
    shingle that a good share of the texts hold comes last. Any total order
    gives whole results; the sketch's fixed size bounds what is broadcast.
 2. *Prefixes.* Each text gives ``n - ceil(t n) + 1`` first shingles of that
    order and a histogram of its set, about 4 to 8 shingles a part. Equal sets (by 64-bit
    fingerprint) become one class before anything is joined.
 3. *Hub round.* Each prefix shingle held by two or more classes links its
    members to one of them, the one that shares most of its prefix with others
    (a linear number of pairs). Length, positional
    and prefix-count filters cut pairs at the join (the last one: of two sets,
    the one whose prefix ends first in the order can share no more than its
    prefix shingles that others hold, and what comes after its prefix); the
    suffix filter (Hamming bound over the histograms) cuts the distinct pairs,
    the rest is verified once on the whole sets. What links is merged into components.
 4. *Remaining pairs.* Members of one shingle that are in different components
    now are joined with each other under the same filters. Each carries the
    smallest of its prefix shingles, so a pair meets at the smallest one that it
    has in common and not again at each of the others (only a pair whose
    smallest common one is beyond what both carry meets more often). The exact
    number of prefix shingles in common is then taken from the two prefixes,
    and pairs that were verified before are taken out. So no link between
    components is lost, while a group of near copies never makes all its pairs.
 5. Components of all links give every text its class.

Edge cases: null or empty text and text of blanks: empty set, ``n_shingles`` 0,
own component. Null ``doc_id``: the row is kept; ids of its component come
from the other rows (null if there is none). Repeated rows stay repeated. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memberrisk.llm import common as C

CELL_BITS = 22
PART_BITS = 20
MAP_WORDS = 16
#: Smallest open prefix shingles that a posting carries.
FIRST_KEYS = 8


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text with words."""
    for w in C.words(column, lower=True):
        g = C.grams(w.hash, k)
        for d in range(len(w.first) - 1):
            lo, hi = w.first[d], w.first[d + 1]
            if hi - lo >= k:
                yield w.row + d, np.unique(g[lo:hi - k + 1])
            elif hi > lo:
                yield w.row + d, C.grams(w.hash[lo:hi], int(hi - lo))


def fingerprint(s: np.ndarray) -> int:
    """64 bits of a set of shingles, the same for equal sets."""
    return int(C.signed(C.mix(C.mix(s).sum(keepdims=True, dtype=np.uint64) + np.array([len(s)], np.uint64) * C.GOLDEN))[0])


def histogram(s: np.ndarray) -> np.ndarray:
    """Counts (uint8) of a set's shingles in 2**b equal parts of the hashes, about 4 to 8 a part."""
    b = min(PART_BITS, max(4, len(s).bit_length() - 3))
    part = ((s >> np.uint64(20)) & np.uint64((1 << PART_BITS) - 1)) >> np.uint64(PART_BITS - b)
    return np.minimum(np.bincount(part.astype(np.int64), minlength=1 << b), 255).astype(np.uint8)


def common_at_most(p: np.ndarray, q: np.ndarray) -> int:
    """Bound of the intersection from two histograms (the suffix filter); the finer one is folded."""
    if len(p) < len(q):
        p, q = q, p
    p = p.reshape(len(q), -1).sum(axis=1, dtype=np.int64)
    return int(np.minimum(p, q).sum(dtype=np.int64))


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def count_classes(docs: DataFrame, k: int) -> np.ndarray:
    """uint8 per sketch cell: 0 for rare, else by the logarithm of the count."""

    def heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << CELL_BITS, dtype=np.uint32)
        for batch in C.pieces(batches):
            part = [s for _, s in shingle_sets(batch.column(0), k)]
            if part:
                np.add.at(counts, _cell(np.concatenate(part)), 1)
        mean = counts.mean()
        cell = np.flatnonzero(counts >= mean + 6 * np.sqrt(mean) + 4)
        for i in range(0, len(cell), 1 << 16):
            part = cell[i:i + (1 << 16)]
            yield C.batch_of({"cell": pa.array(part, pa.int32()), "n": pa.array(counts[part], pa.int64())})

    rows = (docs.select("text").mapInArrow(heavy, "cell int, n long")
            .groupBy("cell").agg(F.sum("n").alias("n")).toPandas())  # at most 2**22 rows by construction
    out = np.zeros(1 << CELL_BITS, dtype=np.uint8)
    out[rows["cell"].to_numpy(dtype=np.int64)] = np.minimum(255, 8 * np.log2(rows["n"].to_numpy(dtype=float) + 1)).astype(np.uint8)
    return out


def prefixes(docs: DataFrame, k: int, percent: int, order: np.ndarray, name: str) -> DataFrame:
    """Per row: row_key, doc_id, n, fp (fingerprint of the set), prefix (ordered shingles), last (the order of its
    last one), parts (histogram)."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        size, fp, last = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        parts: list[bytes | None] = [None] * n
        found: list[np.ndarray] = [np.zeros(0, np.uint64)] * n
        rank = shared.value
        for row, s in shingle_sets(batch.column(1), k):
            m = size[row] = len(s)
            fp[row] = fingerprint(s)
            parts[row] = histogram(s).tobytes()
            own = rank[_cell(s)]
            first = np.argsort(own, kind="stable")[:m - -(-percent * m // 100) + 1]
            found[row], end = s[first], first[-1]
            last[row] = (int(own[end]) << 55) | int(s[end] >> np.uint64(9))
        ends = np.concatenate([[0], np.cumsum([len(x) for x in found])])
        return C.batch_of({
            "row_key": batch.column(2), "doc_id": batch.column(0), "n": pa.array(size), "fp": pa.array(fp), "last": pa.array(last),
            "prefix": C.lists(C.signed(np.concatenate(found)), ends, pa.int64()),
            "parts": pa.array(parts, pa.binary())})

    return C.stage(C.map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", C.row_key().alias("row_key")), run,
                                 "row_key long, doc_id long, n long, fp long, last long, prefix array<long>, parts binary"), f"{name}-prefix")


def _need(percent: int) -> str:
    """Intersection that two sets of ``n`` and ``n2`` shingles must have."""
    return f"ceil({percent} * (n + n2) / {100 + percent}.0 - 1e-9)"


def _beyond(percent: int) -> str:
    """What two sets can have in common beyond their common prefix shingles: the
    shingles after the prefix of the set whose prefix ends first in the order."""
    rest = f"(({percent} * {{0}} + 99) div 100 - 1)"
    one, two = rest.format("n"), rest.format("n2")
    return f"IF(last < last2, {one}, IF(last2 < last, {two}, greatest({one}, {two})))"


def _passes(percent: int) -> str:
    """Length, positional and prefix-count filter on two postings of one shingle."""
    return (f"100 * least(n, n2) >= {percent} * greatest(n, n2) AND "
            f"least(pos, pos2) + least(n - pos, n2 - pos2) >= {_need(percent)} AND "
            f"least(held, held2) + {_beyond(percent)} >= {_need(percent)}")


def _meetings(carried: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes of two components that may pass, met at their smallest common open prefix shingle.

    ``carried``: postings with the class's ``held`` open shingles, the ``least`` of them, the map ``m0_...`` and ``free``,
    the number that the map does not tell apart. A pair whose smallest common one is not among both ``least`` meets at others too.
    """
    # Named by side, so that both sides are one exchange.
    both = lambda text: re.sub(r"\b(n|pos|last|root|held|free|least|fp|m\d+_)(2?)\b(?!\()", lambda m: ("y." if m[2] else "x.") + m[1], text)
    common = " + ".join(f"bit_count(m{w}_ & m{w}_2)" for w in range(MAP_WORDS))
    return (carried.alias("x").join(carried.alias("y"), F.expr(both(
        f"x.key = y.key AND fp < fp2 AND root != root2 AND {_passes(percent)} AND "
        f"{common} + least(free, free2) + {_beyond(percent)} >= {_need(percent)} AND "
        f"coalesce(array_min(array_intersect(least, least2)), x.key) >= x.key")))
        .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")))


def _sharing(pairs: DataFrame, own: DataFrame, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) whose prefixes have enough in common: ``own`` has each class's ``keys``, ``n``, ``last``."""
    for c, at in (("a", ""), ("b", "2")):
        pairs = pairs.join(own.toDF(c, f"keys{at}", f"n{at}", f"last{at}"), c)
    return pairs.where(f"size(array_intersect(keys, keys2)) + {_beyond(percent)} >= {_need(percent)}").select("a", "b")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int, name: str) -> DataFrame:
    """The distinct pairs (a, b) of class fingerprints with ``link``: whether they pass.

    Pairs that the suffix filter takes out are not among them.
    """
    side = classes.select("fp", "n", "parts", "low")
    for c, at in (("a", ""), ("b", "2")):
        pairs = pairs.join(side.toDF(c, f"n{at}", f"parts{at}", f"low{at}"), c)

    def suffix_filter(batch: pa.RecordBatch) -> pa.RecordBatch:
        total = batch.column(2).to_numpy() + batch.column(3).to_numpy()
        keep = [(100 + percent) * common_at_most(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8))
                >= percent * int(t) for x, y, t in zip(batch.column(6), batch.column(7), total)]
        return batch.select([0, 1, 4, 5]).filter(pa.array(keep, pa.bool_()))

    likely = C.stage(C.map_batches(pairs.select("a", "b", "n", "n2", "low", "low2", "parts", "parts2"), suffix_filter,
                                   "a long, b long, low long, low2 long"), f"{name}-likely")
    ends = likely.select("a", "b", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("a").alias("fp"), F.col("low").alias("id")),
        F.struct(F.lit(1).alias("side"), F.col("b").alias("fp"), F.col("low2").alias("id")))).alias("e")).select("a", "b", "e.*")
    if likely.limit(1).count() == 0:
        return likely.select("a", "b", F.lit(True).alias("link"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.pieces(batches):
            found = [s for _, s in shingle_sets(batch.column(0), k)]
            yield C.batch_of({"fp": pa.array([fingerprint(s) for s in found], pa.int64()),
                              "items": pa.array([s.tobytes() for s in found], pa.binary())})

    whole = C.IdFilter.of(ends, "id").run(docs.select("text", F.col("doc_id").cast("long").alias("id")), "id", sets,
                                          "fp long, items binary", True)

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        passed = []
        for x, y in zip(batch.column(2), batch.column(3)):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            passed.append(100 * both >= percent * (len(p) + len(q) - both))
        return C.batch_of({"a": batch.column(0), "b": batch.column(1), "link": pa.array(passed, pa.bool_())})

    # Both sets meet at their pair; copies of a class bring equal sets.
    met = ends.join(whole, "fp").groupBy("a", "b").agg(
        F.max(F.when(F.col("side") == 0, F.col("items"))).alias("items"),
        F.max(F.when(F.col("side") == 1, F.col("items"))).alias("items2"))
    return C.stage(C.map_batches(met, verify, "a long, b long, link boolean"), f"{name}-links")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, name: str = "ngram") -> DataFrame:
    """One row per document: ``row_key, doc_id, n_shingles, component_id`` (smallest linked id).

    ``row_key`` hashes id and text; it tells apart rows with null or repeated ids.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent is in (0, 100]")
    docs = docs.select("doc_id", "text")
    wide = prefixes(docs, k, percent, count_classes(docs, k), name)
    whole = C.stage(wide.where("n > 0").groupBy("fp").agg(
        F.min("doc_id").alias("low"), F.first("n").alias("n"), F.first("last").alias("last"), F.first("prefix").alias("prefix"),
        F.first("parts").alias("parts")), f"{name}-whole")
    # The prefixes are most of these tables; they go as soon as the postings are written.
    rows = C.stage(wide.select("row_key", "doc_id", "n", "fp"), f"{name}-rows")
    C.unstage(wide)
    classes = C.stage(whole.drop("prefix"), f"{name}-classes")
    postings = whole.select("fp", "n", F.posexplode("prefix").alias("pos", "key"))  # a class has each shingle once
    shared = C.stage(postings.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high"))
                     .where("low != high").select("key"), f"{name}-keys")
    # ``held``: how many of a class's prefix shingles others hold too; no pair has more in common there.
    found = C.stage(postings.join(shared, "key"), f"{name}-found")
    C.unstage(whole)
    held = found.groupBy("fp").agg(F.count(F.lit(1)).alias("held")).join(classes.select("fp", "last"), "fp")
    members = C.stage(found.join(held, "fp"), f"{name}-members")
    C.unstage(found)
    # A shingle's hub is the member that shares most of its prefix: the middle of a group of near copies.
    middle = F.max_by(F.struct(F.col("fp").alias("a"), F.col("n").alias("n2"), F.col("pos").alias("pos2"),
                               F.col("held").alias("held2"), F.col("last").alias("last2")), F.struct(F.col("held") / F.col("n"), "fp"))
    hubs = C.stage(members.groupBy("key").agg(middle.alias("hub")).select("key", "hub.*"), f"{name}-hubs")
    near = (members.withColumnRenamed("fp", "b").join(hubs, "key")
            .where("a != b").where(_passes(percent))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    first = _verified(near, classes, docs, k, percent, f"{name}-hub")
    links = first.where("link")
    merged = C.components(links, f"{name}-hub")

    # Shingles whose members are not in one component yet.
    placed = members.join(merged.withColumnsRenamed({"id": "fp"}), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    open_keys = (placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"))
                 .where("low != high").select("key"))
    left = C.stage(placed.select("key", "fp", "n", "pos", "last", "root").join(open_keys, "key"), f"{name}-open")
    for used in (members, hubs, shared):
        C.unstage(used)
    # Every prefix shingle that a pair of two components has in common is open. A class's open ones, in order,
    # give the exact number in common; a map of 1024 bits bounds it before two classes meet, and the first
    # of them tell whether a pair meets at a smaller shingle as well.
    own = C.stage(left.groupBy("fp").agg(F.sort_array(F.collect_list("key")).alias("keys")), f"{name}-own")
    bit = f"shiftright(key, 7) & {MAP_WORDS * 64 - 1}"
    marked = left.groupBy("fp").agg(F.count(F.lit(1)).alias("held"), *[
        F.expr(f"bit_or(IF(shiftright({bit}, 6) = {w}, shiftleft(1L, cast(({bit}) & 63 AS int)), 0L))").alias(f"m{w}_")
        for w in range(MAP_WORDS)])
    marks = " + ".join(f"bit_count(m{w}_)" for w in range(MAP_WORDS))
    marked = marked.withColumn("free", F.expr(f"held - ({marks})")).join(
        own.select("fp", F.slice("keys", 1, FIRST_KEYS).alias("least")), "fp")
    carried = C.stage(left.join(marked, "fp"), f"{name}-left")
    C.unstage(left)
    rest = C.stage(_meetings(carried, percent).distinct().join(first.select("a", "b"), ["a", "b"], "left_anti"), f"{name}-met")
    C.unstage(carried)
    second = _verified(_sharing(rest, own.join(classes.select("fp", "n", "last"), "fp"), percent, name),
                       classes, docs, k, percent, f"{name}-rest").where("link")
    edges = links.select("a", "b").unionByName(second.select("a", "b"))
    root = C.components(edges, f"{name}-all")

    low = (classes.select("fp", "low").join(root.withColumnsRenamed({"id": "fp"}), "fp", "left")
           .select("fp", "low", F.coalesce("root", "fp").alias("root")))
    smallest = C.stage(low.groupBy("root").agg(F.min("low").alias("component_id")), f"{name}-smallest")
    label = C.stage(low.join(smallest, "root").select("fp", "component_id"), f"{name}-of")
    return rows.select("row_key", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("fp")).alias("fp")).join(
        label, "fp", "left").select(
        "row_key", "doc_id", "n_shingles",
        F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_per_group(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents (all columns) that stay: of each group the smallest id, once.

    Texts without words stay. In a group without any id all rows stay.
    """
    rows = C.stage(jaccard_components(docs, k, percent, "ngram-keep").where("n_shingles > 0"), "ngram-groups")
    first = (rows.where("doc_id = component_id").groupBy("component_id")
             .agg(F.min("row_key").alias("kept"), F.count(F.lit(1)).alias("n")))
    # A row with another id than its group's goes whatever its group is; only rows of the group's own id are joined.
    other = rows.where("component_id IS NOT NULL AND NOT doc_id <=> component_id")
    same = rows.where("doc_id = component_id").join(first.select("component_id", "kept"), "component_id").where("row_key != kept")
    key = C.free_name(docs, "__key")
    gone = C.stage(other.select(F.col("row_key").alias(key)).union(same.select("row_key")).distinct(), "ngram-gone")
    again = C.stage(first.where("n > 1").select(F.col("kept").alias(key)), "ngram-again")  # one row of equal ones stays
    keyed = docs.withColumn(key, C.row_key())
    held = C.IdFilter.of(gone.unionByName(again), key)
    maybe = held.keep(keyed, key).join(gone, key, "left_anti")
    return (held.drop(keyed, key)
            .unionByName(maybe.join(again, key, "left_anti"))
            .unionByName(maybe.join(again, key, "left_semi").dropDuplicates([key]))).select(docs.columns)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(C.documents(spark, sf_dir), 4, 85, "op1").drop("row_key")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents),
s AS (SELECT doc_id, CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 4 THEN [array_to_string(l, ' ')]
      ELSE list_distinct(list_transform(range(1, len(l) - 2), lambda i: array_to_string(l[i:i + 3], ' '))) END AS g FROM w),
p AS (SELECT doc_id, len(g) AS n, unnest(g) AS sh FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb
      FROM p a JOIN p b ON a.sh = b.sh AND a.doc_id <> b.doc_id
       AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY 1, 2),
e AS (SELECT a, b FROM o WHERE 100 * i >= 85 * (na + nb - i)),
r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, m.c AS component_id
FROM s JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY 1) m USING (doc_id)
"""
