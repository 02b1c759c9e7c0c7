"""Prefix trie of conversations by time-forward processing (operator 11).

A conversation is a sequence of turns (role, text). A node is a distinct sequence of
first turns; its members are the conversations that start with it. Turns are known
by the SHA-256 of role and text; a sequence of them by the sums of four 32-bit lanes
of the SHA-256 of each turn with its place, so that a node's key comes from a running
total and no conversation is gathered, however long.

Subtree totals go up by time-forward processing. Nodes are dealt to shards that are
subtrees, sorted outside memory by reverse level (deepest first), and read once: a node
takes the messages sent to it from a priority queue that spills sorted runs, adds them
up, and sends its total to its parent. Shards are cut by weight (turns that members have
left): a subtree of weight at most ``SHARD`` below a heavier node is a shard of its own.
The heavier nodes above them get the totals of the shards' roots. They are few, save
where conversations are very long; then they are cut at every ``SPAN`` levels, the roots
of those shards are solved first as a smaller tree of the same kind, and their totals
are messages in a second pass.

Edge cases: null role or text is empty; null turns come first; equal turn numbers are in
the order of their turns' SHA-256; repeated rows are turns of their own; rows without a
conv_id take no part; other columns are not looked at. An empty table has no node,
otherwise the root (no turn) is one. A conversation without turns ends at the root.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memberrisk.functions import ranking
from memberrisk.llm import common as C

SHARD = 50_000      # weight of a subtree that is one shard
SPAN = 4096         # levels of the heavier nodes in one shard
QUEUE = 100_000     # messages in memory
IDS = 1 << 16       # conversation ids hashed at once
LANES = ("s0", "s1", "s2", "s3")
ROOT = hashlib.md5(b"0,0,0,0,0").hexdigest()


# ------------------------------------------------------------------- turns
def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, idx from 1, turn_key, n_chars): the turns in order, without their texts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("turn_key"),
        F.length(text).cast("long").alias("n_chars"))
    return ranking.running(rows, ["turn", "turn_key"], ["conv_id"], out="idx").drop("turn")


def as_they_are(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations with their number of turns, turns with their place) of ``turns``, nothing rebuilt."""
    convs = numbered.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"))
    return convs, numbered.join(convs, "conv_id").withColumn("pos", F.col("idx")).withColumn("src_conv", F.col("conv_id"))


def rebuilt(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``as_they_are``, each conversation c opening with the first crc32(c) % 6 turns of
    conversation c - c % 100 in place of as many of its own."""
    held = numbered.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % 100
    of = held.select("conv_id", "n", base.alias("base"), (F.crc32(F.col("conv_id").cast("string")) % 6).alias("h"))
    bases = held.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    of = of.join(bases, "base", "left").withColumn("take", F.least("h", F.coalesce("n_base", F.lit(0).cast("long"))))
    convs = C.stage(of.select("conv_id", "base", "h", "take",
                              (F.col("take") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns")), "trie-convs")
    opening = numbered.where("conv_id % 100 = 0 AND idx <= 5").withColumnRenamed("conv_id", "base")
    shared = convs.where("take > 0").join(opening, "base").where("idx <= take").select(
        "conv_id", "n_turns", F.col("idx").alias("pos"), F.col("base").alias("src_conv"), "idx", "turn_key", "n_chars")
    own = numbered.join(convs.select("conv_id", "h", "take", "n_turns"), "conv_id").where("idx > h").select(
        "conv_id", "n_turns", (F.col("take") + F.col("idx") - F.col("h")).alias("pos"), F.col("conv_id").alias("src_conv"),
        "idx", "turn_key", "n_chars")
    return convs, shared.unionByName(own)


def _paths(placed: DataFrame) -> DataFrame:
    """A row a turn with the keys of its node and of the node before."""
    mixed = F.sha2(F.concat(F.col("pos").cast("string"), F.lit(":"), F.col("turn_key")), 256)
    lanes = {f"l{i}": F.conv(F.substring("mixed", 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)}
    rows = placed.withColumn("mixed", mixed).withColumns(lanes).select(
        "conv_id", "n_turns", "pos", "src_conv", "idx", "n_chars", *lanes)
    summed = ranking.running(rows, ["pos"], ["conv_id"], out="_at", sums=dict(zip(LANES, lanes)))

    def key(pos: Column, sums: list[Column]) -> Column:
        return F.md5(F.concat_ws(",", pos, *sums))

    return summed.select(
        "conv_id", "n_turns", "pos", "src_conv", "idx", "n_chars",
        key(F.col("pos"), [F.col(s) for s in LANES]).alias("key"),
        key(F.col("pos") - 1, [F.col(s) - F.col(x) for s, x in zip(LANES, lanes)]).alias("parent"))


# ------------------------------------------------------ time-forward passes
class SpillingQueue:
    """Smallest first. Beyond ``most`` items in memory they go to a sorted run on the
    task's own scratch file (unlinked when opened, so it ends with the task)."""

    CHUNK = 1024

    def __init__(self, most: int = QUEUE) -> None:
        self.most, self.near, self.runs, self.spills = most, [], [], 0

    def push(self, item: tuple) -> None:
        heapq.heappush(self.near, item)
        if len(self.near) > self.most:
            self.near.sort()
            run = tempfile.TemporaryFile()
            for i in range(0, len(self.near), self.CHUNK):
                pickle.dump(self.near[i:i + self.CHUNK], run)
            run.seek(0)
            self.near, self.spills = [], self.spills + 1
            self._refill(run)

    def _refill(self, run) -> None:
        try:
            chunk = pickle.load(run)
        except EOFError:
            run.close()
            return
        heapq.heappush(self.runs, (chunk[0], self.spills, len(chunk), id(run), chunk[::-1], run))

    def head(self) -> tuple | None:
        if self.runs and (not self.near or self.runs[0][0] < self.near[0]):
            return self.runs[0][0]
        return self.near[0] if self.near else None

    def pop(self) -> tuple:
        if not self.runs or (self.near and self.near[0] <= self.runs[0][0]):
            return heapq.heappop(self.near)
        item, order, size, name, chunk, run = self.runs[0]
        chunk.pop()
        if chunk:
            heapq.heapreplace(self.runs, (chunk[-1], order, len(chunk), name, chunk, run))
        else:
            heapq.heappop(self.runs)
            self._refill(run)
        return item


def _forward(nodes: DataFrame, queue: int, name: str) -> DataFrame:
    """``nodes(key, parent, depth, shard, own_leaves, own_saved, ...)`` with ``n_leaves``,
    ``saved_tokens`` and ``n_sent`` (children in the shard) of each node's part of the
    subtree in its shard. Where ``own_leaves`` is null, a node without children is a leaf.

    A task holds many shards; all are sorted together, for no message leaves its shard."""
    extra = ["n_leaves", "saved_tokens", "n_sent"]
    at = {c: i for i, c in enumerate(nodes.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = SpillingQueue(queue)
        for batch in batches:
            key, parent, depth, shard, leaves, saved = (
                batch.column(at[c]).to_pylist() for c in ("key", "parent", "depth", "shard", "own_leaves", "own_saved"))
            out = [[], [], []]
            for i in range(batch.num_rows):
                here, total, got, sent = (-depth[i], key[i]), saved[i], 0, 0
                while (m := waiting.head()) is not None and m[:2] <= here:
                    if m[:2] < here:
                        raise RuntimeError("message to a node that is not there")
                    _, _, of_leaves, of_saved = waiting.pop()
                    got, total, sent = got + of_leaves, total + of_saved, sent + 1
                got += (sent == 0) if leaves[i] is None else leaves[i]
                if key[i] != shard[i]:
                    waiting.push((1 - depth[i], parent[i], got, total))
                for column, value in zip(out, (got, total, sent)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in out)], names=[*at, *extra])

    C.prepare(nodes.sparkSession)
    order = nodes.repartition("shard").sortWithinPartitions(F.desc("depth"), "key")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema.fields)
    return C.stage(order.mapInArrow(run, f"{fields}, " + ", ".join(f"{c} long" for c in extra)), name)


def _across(heavy: DataFrame, paths: DataFrame, span: int, queue: int, name: str, step: int = 1) -> DataFrame:
    """Totals of the nodes above the light shards: ``heavy(key, parent, conv_id, depth, own_leaves, own_saved)``.

    ``step`` is the number of levels between neighbours of this tree, ``span`` how many of its levels a shard has."""
    columns = heavy.columns
    wide = step * span
    deepest = heavy.agg(F.max("depth")).first()[0] or 0
    if deepest < wide:
        scaled = heavy.withColumn("depth", F.col("depth") / step).withColumn("depth", F.col("depth").cast("long"))
        done = _forward(scaled.withColumn("shard", F.lit(ROOT)), queue, f"{name}-top")
        return done.select("key", "n_leaves", "saved_tokens")
    band = (F.col("depth") / wide).cast("long")
    roots = paths.where((F.col("pos") % wide) == 0).select("conv_id", (F.col("pos") / wide).cast("long").alias("_band"),
                                                         F.col("key").alias("shard"))
    dealt = C.stage(heavy.withColumn("_band", band).join(roots, ["conv_id", "_band"], "left")
                    .withColumn("shard", F.coalesce("shard", F.lit(ROOT))), f"{name}-dealt")
    levels = dealt.select(*[c for c in columns if c != "depth"], "shard", (F.col("depth") / step).cast("long").alias("depth"),
                          F.col("depth").alias("_depth"))
    first = _forward(levels, queue, f"{name}-first")
    tops = first.where("key = shard")
    smaller = tops.join(dealt.select(F.col("key").alias("parent"), F.col("shard").alias("above")), "parent", "left").select(
        "key", F.coalesce("above", "parent").alias("parent"), "conv_id", F.col("_depth").alias("depth"),
        F.col("n_leaves").alias("own_leaves"), F.col("saved_tokens").alias("own_saved"))
    solved = _across(C.stage(smaller, f"{name}-roots"), paths, span, queue, name, wide)
    sent = tops.select("key", "parent").join(solved, "key").where(F.col("key") != ROOT).groupBy(F.col("parent").alias("key")).agg(
        F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
    zero = F.lit(0).cast("long")
    again = levels.join(sent, "key", "left").withColumns({
        "own_leaves": F.col("own_leaves") + F.coalesce("more_leaves", zero),
        "own_saved": F.col("own_saved") + F.coalesce("more_saved", zero)}).drop("more_leaves", "more_saved")
    return _forward(again, queue, f"{name}-second").select("key", "n_leaves", "saved_tokens")


# -------------------------------------------------- ids of those that end here
def _id_digests(ends: DataFrame, name: str) -> DataFrame:
    """(key, ends_sha256) of ``ends(key, conv_id)``: SHA-256 of the ascending ids joined by commas.

    Each task hashes the keys that lie within its slice of the sorted rows. Of a key at
    the edge of a slice it leaves the ids as text, in pieces of ``IDS`` at most, and one
    pass over the pieces in order ends those: a hash has to see its text in order, but no
    task holds more of it than a piece."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, at_edge = [], None, True  # the first key of a slice may have begun before it

        def piece(edge: bool) -> pa.RecordBatch:
            text = ",".join(map(str, held))
            return C.batch_of({"key": pa.array([key]), "first": pa.array([held[0]], pa.int64()),
                               "ids": pa.array([text if edge else None], pa.string()),
                               "ends_sha256": pa.array([None if edge else hashlib.sha256(text.encode()).hexdigest()], pa.string())})

        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != key:
                    if held:
                        yield piece(at_edge)
                        at_edge = False
                    held, key = [], k
                elif len(held) >= IDS:
                    yield piece(True)
                    held, at_edge = [], True
                held.append(c)
        if held:
            yield piece(True)  # may go on in the next slice

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k == key:
                    sha.update(b"," + ids.encode())
                    continue
                if key is not None:
                    yield C.batch_of({"key": pa.array([key]), "ends_sha256": pa.array([sha.hexdigest()])})
                key, sha = k, hashlib.sha256(ids.encode())
        if key is not None:
            yield C.batch_of({"key": pa.array([key]), "ends_sha256": pa.array([sha.hexdigest()])})

    C.prepare(ends.sparkSession)
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = ends.select("key", "conv_id").repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    found = C.stage(sliced.mapInArrow(write, "key string, first long, ids string, ends_sha256 string"), f"{name}-ends")
    open_ = found.where("ids IS NOT NULL").select("key", "ids", "first").repartition("key").sortWithinPartitions("key", "first")
    return found.where("ends_sha256 IS NOT NULL").select("key", "ends_sha256").unionByName(
        open_.select("key", "ids").mapInArrow(join, "key string, ends_sha256 string"))


# -------------------------------------------------------------------- trie
def trie(convs: DataFrame, placed: DataFrame, shard: int = SHARD, span: int = SPAN, queue: int = QUEUE,
         name: str = "trie") -> DataFrame:
    """Nodes of ``convs(conv_id, n_turns)`` and their turns ``placed(conv_id, n_turns, pos from 1,
    src_conv, idx, turn_key, n_chars)``.

    ``key, parent, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, src_conv, idx`` (the last two: where the node's last turn stands in ``turns``)."""
    paths = C.stage(_paths(placed), f"{name}-paths")
    own = paths.groupBy("key").agg(
        F.min("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.min("pos").alias("depth"),
        F.count(F.lit(1)).alias("n_convs"), F.min("n_chars").alias("n_chars"),
        F.sum(F.col("n_turns") - F.col("pos") + 1).alias("weight"), F.min(F.struct("src_conv", "idx")).alias("src"))
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        F.lit(ROOT).alias("key"), F.lit(None).cast("string").alias("parent"), "conv_id", F.lit(0).cast("long").alias("depth"),
        "n_convs", F.lit(0).cast("long").alias("n_chars"), F.lit(0).cast("long").alias("weight"),
        F.lit(None).cast("struct<src_conv:bigint,idx:bigint>").alias("src"))
    nodes = C.stage(own.unionByName(top).withColumn("own_saved", (F.col("n_convs") - 1) * F.col("n_chars")), f"{name}-nodes")

    # How far down each conversation's nodes are heavy, and the first light one: the root of its shard.
    heavy_keys = nodes.where(F.col("weight") > shard).select("key", F.lit(True).alias("heavy"))
    cut = paths.join(heavy_keys, "key", "left").groupBy("conv_id").agg(
        F.max(F.when(F.col("heavy"), F.col("pos"))).alias("heavy_to"),
        F.min_by("key", F.when(F.col("heavy").isNull(), F.col("pos"))).alias("shard"))
    sided = C.stage(nodes.join(cut, "conv_id", "left").withColumn("heavy_to", F.coalesce("heavy_to", F.lit(0).cast("long"))), f"{name}-sided")
    light = _forward(sided.where("depth > heavy_to").withColumn("own_leaves", F.lit(None).cast("long")), queue, f"{name}-light")

    heavy = sided.where("depth <= heavy_to").drop("shard")
    below = light.where("key = shard").groupBy(F.col("parent").alias("key")).agg(
        F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"), F.count(F.lit(1)).alias("n"))
    beside = heavy.where("depth > 0").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("m"))
    zero = F.lit(0).cast("long")
    heavy = C.stage(heavy.join(below, "key", "left").join(beside, "key", "left").withColumns({
        "n_children": F.coalesce("n", zero) + F.coalesce("m", zero), "own_leaves": F.coalesce("l", zero),
        "own_saved": F.col("own_saved") + F.coalesce("s", zero)})
        .withColumn("own_leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.col("own_leaves"))), f"{name}-heavy")
    totals = _across(heavy.select("key", "parent", "conv_id", "depth", "own_leaves", "own_saved"), paths, span, queue, name)
    shown = ["key", "parent", "conv_id", "depth", "n_convs", "src", "n_children", "n_leaves", "saved_tokens"]
    both = light.withColumn("n_children", F.col("n_sent")).select(*shown).unionByName(heavy.join(totals, "key").select(*shown))

    ends = paths.where("pos = n_turns").select("key", "conv_id").unionByName(
        convs.where("n_turns = 0").select(F.lit(ROOT).alias("key"), "conv_id"))
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (both.join(parents, "parent", "left").join(_id_digests(ends, name), "key", "left")
            .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
            .select("key", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                    "saved_tokens", "ends_sha256", "src.src_conv", "src.idx"))


def conversation_trie(conversations: DataFrame, **options) -> DataFrame:
    """``trie`` of conversations as they are."""
    numbered = C.stage(turns(conversations), "trie-turns")
    return trie(*as_they_are(numbered), **options)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs, placed = rebuilt(C.stage(turns(C.table(spark, sf_dir, "conversations")), "op11-turns"))
    return trie(convs, placed, name="op11").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


ORACLE = """
WITH t AS (
  SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn_key,
         length(coalesce(text, '')) AS n_chars, turn FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, turn_key, n_chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, turn_key) AS idx FROM t),
c AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 100 AS base,
        xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
          lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
            lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 6 AS h
      FROM t GROUP BY conv_id),
m AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS take FROM c LEFT JOIN c b ON b.conv_id = c.base),
p AS (
  SELECT m.conv_id, n.idx AS pos, n.turn_key, n.n_chars FROM m JOIN n ON n.conv_id = m.base AND n.idx <= m.take
  UNION ALL SELECT m.conv_id, m.take + n.idx - m.h, n.turn_key, n.n_chars FROM m JOIN n ON n.conv_id = m.conv_id AND n.idx > m.h),
s AS (SELECT conv_id, pos, n_chars, sha256(string_agg(turn_key, ',') OVER (PARTITION BY conv_id ORDER BY pos)) AS key FROM p
      UNION ALL SELECT conv_id, 0, 0, '' FROM c),
l AS (SELECT conv_id, max(pos) AS n_turns FROM s GROUP BY 1),
k AS (SELECT s.key, min(s.conv_id) AS conv_id, min(pos) AS depth, count(*) AS n_convs, min(n_chars) AS n_chars,
        coalesce(string_agg(s.conv_id::VARCHAR, ',' ORDER BY s.conv_id) FILTER (WHERE pos = n_turns), '') AS ends
      FROM s JOIN l USING (conv_id) GROUP BY 1),
e AS (SELECT k.*, b.key AS parent, d.conv_id AS parent_conv_id FROM k LEFT JOIN s b ON b.conv_id = k.conv_id AND b.pos = k.depth - 1
      LEFT JOIN k d ON d.key = b.key),
f AS (SELECT parent AS key, count(*) AS n FROM e WHERE parent IS NOT NULL GROUP BY 1),
u AS (SELECT a.key, sum(CASE WHEN f.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((k.n_convs - 1) * k.n_chars) AS saved
      FROM k JOIN s a ON a.conv_id = k.conv_id AND a.pos <= k.depth LEFT JOIN f ON f.key = k.key GROUP BY 1)
SELECT e.conv_id, e.depth::BIGINT AS depth, e.parent_conv_id, e.n_convs, coalesce(f.n, 0)::BIGINT AS n_children,
  u.n_leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, sha256(e.ends) AS ends_sha256
FROM e JOIN u USING (key) LEFT JOIN f USING (key)
"""
