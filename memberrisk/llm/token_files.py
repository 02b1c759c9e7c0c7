"""Token-id files by an adaptive context-mixing range coder (operator 4).

Ids are cut into blocks of ``BLOCK`` ids. Each block is coded on its own: every
model starts anew and the block has a CRC-32 of its ids, so a damaged block is
noticed and costs no other block.

Four predictions drive the arithmetic coder for each id:
 * order 2 and order 1: a table from the last two ids (the last id) to the id that
   followed them last, with a confidence that grows by hits; the probability that
   each confidence deserves is learned as the block goes;
 * order 0: how often each id came in the block so far, for ids that neither table predicts;
 * a fixed fall over the vocabulary, for ids that are new in the block.
The two tables' probabilities are mixed with a weight for each pair of confidences,
learned from the ids at which only one of them was right; the share of new ids is
learned too. All arithmetic is on integers, so a reader gets exactly the writer's models.

The tables learn at each id. What is learned about probabilities, and the order-0
counts, is renewed between stretches, which grow with the block up to ``STRETCH`` ids.
So the writer prepares all but the tables and the coder itself for a stretch at once.

Blocks are coded side by side: one step handles the same position of all blocks
of a segment as arrays. The range coder has a 60-bit window and puts out digits of
20 bits; the writer adds up carries at the end.

File format: Parquet rows, one a segment, in ascending order of ``doc_id`` (null
first) over the files and in them: ``part, segment, doc_ids, doc_tokens,
n_tokens, block, blocks`` where a block is ``(n, crc32, data)``. A segment holds
whole documents. Spark's committed writer makes it safe against lost tasks.

Edge cases: null or empty text is the end id alone. Null and repeated ids keep
their rows. An empty table gives files without rows, read back as no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memberrisk.llm import common as C
from memberrisk.llm import tokens

BLOCK = 4096
LANES = 2048          # blocks coded side by side
SLOTS = 2048          # of each prediction table of a block
FIRST = 8             # ids of the first stretch
STRETCH = 256         # of the longest ones
DIGIT, WINDOW = 20, 60
_REST = WINDOW - DIGIT
_LOW, _DIGIT = (1 << _REST) - 1, (1 << DIGIT) - 1
_ONE = (1 << 15) - 1  # the events' frequencies are of 2**15
# Of 64: what a confidence that was never tried deserves.
_PRIOR = np.array([0, 10, 26, 45])
_HELD = np.arange(4) > 0
# Hashes of the last id and the one before it: factors and shifts for order 1 and order 2.
_LAST, _SECOND, _SHIFT = (np.array(v)[:, None] for v in ([40503, 30011], [0, 48271], [4, 3]))


def _stretches(size: int) -> list[tuple[int, int]]:
    """(first step, end) of the stretches between which the models are renewed."""
    marks, at = [0], FIRST
    while at < size:
        marks.append(at)
        at += min(max(at // 4, 1), STRETCH)
    return list(zip(marks, [*marks[1:], size]))


def _lives(length: np.ndarray) -> list[int]:
    """Blocks that are longer than each step; longest first."""
    return np.searchsorted(-length, -np.arange(length[0]), side="left").tolist()


def _divide(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of numbers not below 0; spares the checks of signs."""
    return (a.view(np.uint64) // b.view(np.uint64)).view(np.int64)


class _Model:
    """The adaptive models of ``lanes`` blocks; lanes that ended are at the back.

    An entry of the tables is the guess and, in the low two bits, its confidence
    (0: none). The context of an id's event is the two confidences and whether the
    guesses agree. Events: 0 order 2 is right, 1 order 1 is, 2 an id of the block, 3 a new id.
    """

    def __init__(self, lanes: int, id_limit: int) -> None:
        if id_limit > 1 << 22:
            raise ValueError("ids below 2**22 only")
        self.bits = (id_limit - 1).bit_length() + 1
        fall = np.concatenate([[0], np.cumsum((1 << 24) // (np.arange(id_limit) + 200))])
        self.fixed = np.arange(id_limit + 1) + fall * ((1 << self.bits) - id_limit) // fall[-1]
        self.table = np.full(2 * lanes * SLOTS, -4, np.int32)
        self.place = np.arange(2 * lanes).reshape(2, lanes) * SLOTS
        self.context = np.arange(lanes) * 32
        self.tally = np.zeros((lanes, 4, 4, 2, 2, 2), np.int64)  # by context, order 2 right, order 1 right
        self.new = np.full(lanes, 1 << 15)                       # share of new ids among those not predicted
        self.one, self.two = np.full(lanes, 1, np.int32), np.full((2, lanes), 2, np.int32)

    def renew(self, live: int, context: np.ndarray, right: np.ndarray, event: np.ndarray) -> None:
        """Bounds of the events in each context, after a stretch (none before the first)."""
        t = self.tally[:live]
        if len(event):
            seen = context[:, :live] * 4 + (2 * right[:, 1, :live] + right[:, 0, :live])
            t += np.bincount(seen.ravel(), minlength=live * 128).reshape(t.shape)
        tried2, hit2 = t.sum((2, 3, 4, 5)), t[:, :, :, :, 1].sum((2, 3, 4))
        tried1, hit1 = t.sum((1, 3, 4, 5)), t[:, :, :, :, :, 1].sum((1, 3, 4))
        share2 = np.minimum((hit2 * 1024 + _PRIOR * 20) * 32 // (tried2 + 2), 31_000)
        share1 = np.minimum((hit1 * 1024 + _PRIOR * 20) * 32 // (tried1 + 2), 31_000)
        only2, only1 = t[:, :, :, :, 1, 0].sum(3), t[:, :, :, :, 0, 1].sum(3)
        weight = (only2 * 256 + 256) // (only2 + only1 + 2)
        weight[:, :, 0], weight[:, 0, :] = 256, 0
        two = (share2[:, :, None] * weight >> 8) + 16 * _HELD[:, None]
        both = np.minimum(two + (share1[:, None, :] * (256 - weight) >> 8) + 16 * _HELD, 32_000)
        two = np.stack([np.minimum(two, both), both], -1)  # guesses that agree count as order 2
        both = np.stack([both, both], -1)
        if len(event):
            missed, new = (event[:, :live] >= 2).sum(0), (event[:, :live] == 3).sum(0)
            self.new[:live] = ((new << 15) + 4 * self.new[:live]) // (missed + 4)
            rest = (1 << 15) - both
            known = both + np.clip(rest * ((1 << 15) - self.new[:live, None, None, None]) >> 15, 4, rest - 4)
        else:
            known = both + 1
        self.bound = (two << 15 | both << 30 | known << 45).ravel()
        t -= t >> 2

    def slots(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Places in the tables (order 1, order 2) for the last id and the one before it."""
        at = one * _LAST
        at += two * _SECOND
        at >>= _SHIFT
        at &= SLOTS - 1
        at += self.place[:, :len(one)]
        return at

    def predict(self, at: np.ndarray) -> np.ndarray:
        """Contexts of the events; sets the guesses."""
        held = self.table.take(at)
        self.guess, self.level = held >> 2, held & 3
        context = (self.level[1] << 2) + self.level[0]
        context += context
        context += self.guess[0] == self.guess[1]
        return context + self.context[:len(context)]

    def learn(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        right = self.guess == x
        entry = np.minimum(self.level, self.two[:, :len(x)])
        entry *= right
        entry += (x << 2) + self.one[:len(x)]
        self.table[at] = entry
        return right


def _numbers(rows: np.ndarray, id_limit: int) -> tuple[np.ndarray, int]:
    """Each row's ids as numbers 0, 1, ... in their order, and how many there are at most."""
    lanes, size = rows.shape
    if size <= 1 << 12 and id_limit < 1 << 19:
        order = np.sort(rows << 12 | np.arange(size, dtype=np.int32), axis=1) & 4095
    else:
        order = np.argsort(rows, axis=1, kind="stable")
    ordered = np.take_along_axis(rows, order, 1)
    dense = np.zeros((lanes, size), np.int32)
    np.cumsum(ordered[:, 1:] != ordered[:, :-1], axis=1, out=dense[:, 1:])
    out = np.empty((lanes, size), np.int32)
    np.put_along_axis(out, order, dense, 1)
    return out, int(dense[:, -1].max()) + 1


def encode_blocks(blocks: list[np.ndarray], id_limit: int) -> list[bytes]:
    """Codes of blocks of ids below ``id_limit``, each on its own. Longest first."""
    lanes, size = len(blocks), len(blocks[0])
    rows = np.full((lanes, size), id_limit, np.int32)
    ids = np.zeros((size + 2, lanes), np.int32)  # the first two stand before the blocks
    for i, b in enumerate(blocks):
        rows[i, :len(b)] = ids[2:len(b) + 2, i] = b
    number, numbers = _numbers(rows, id_limit)
    number = np.ascontiguousarray((number + np.arange(lanes)[:, None] * numbers).T)
    count = np.zeros(lanes * numbers, np.int64)
    model = _Model(lanes, id_limit)
    low, wide = np.zeros(lanes, np.int64), np.full(lanes, 1 << WINDOW)
    out = np.zeros((lanes, 2 * size + 4), np.int32)  # pages that no code reaches stay untouched
    begin = np.arange(lanes) * out.shape[1]
    digits, filled = out.reshape(-1), begin.copy()
    lives = _lives(np.array([len(b) for b in blocks]))
    context = right = event = np.zeros((0, lanes), np.int64)
    was = 0
    for n, stop in _stretches(size):
        live = lives[n]
        model.renew(live, context, right, event)
        if n:
            count += np.bincount(number[was:n, :live].ravel(), minlength=len(count))
            sums = np.cumsum(count.reshape(lanes, numbers)[:live], axis=1).reshape(-1)
            freq = count.take(number[n:stop, :live])
            start = sums.take(number[n:stop, :live]) - freq
        else:
            start = freq = np.zeros((stop, live), np.int64)
        was = n
        x = ids[n + 2:stop + 2, :live]
        one, two = ids[n + 1:stop + 1, :live].astype(np.int64), ids[n:stop, :live].astype(np.int64)
        context, right = np.empty((stop - n, live), np.int64), np.empty((stop - n, 2, live), bool)
        for k in range(stop - n):  # lanes that end within a stretch go on until its end, without being coded
            at = model.slots(one[k], two[k])
            context[k] = model.predict(at)
            right[k] = model.learn(at, x[k])
        event = np.where(right[:, 1], 0, np.where(right[:, 0], 1, 2 + (freq == 0)))
        bound = model.bound.take(context) >> 15 * event
        start1 = bound & _ONE
        freq1 = ((bound >> 15) - start1) & _ONE
        known, new = event == 2, event == 3
        first = model.fixed.take(x)
        total = np.where(known, n, np.where(new, 1 << model.bits, 1))
        start2 = np.where(known, start, np.where(new, first, 0))
        freq2 = np.where(known, freq, np.where(new, model.fixed.take(x + 1) - first, 1))
        for k in range(stop - n):
            live = lives[n + k]
            r, at = wide[:live] >> 15, low[:live]
            at += r * start1[k, :live]
            r *= freq1[k, :live]
            r = _divide(r, total[k, :live])
            at += r * start2[k, :live]
            r *= freq2[k, :live]
            go = (r <= _LOW).nonzero()[0]
            while len(go):
                place, ahead = filled.take(go), at.take(go)
                digits[place] = ahead >> _REST  # may be one above what a digit holds
                filled[go] = place + 1
                at[go] = (ahead & _LOW) << DIGIT
                wider = r.take(go) << DIGIT
                r[go] = wider
                go = go[wider <= _LOW]
            wide[:live] = r
    digits[filled] = (low + _LOW) >> _REST
    filled += 1 - begin
    out = out[:, :int(filled.max()) + 1]
    carry = out >> DIGIT
    while carry.any():
        out = out & _DIGIT
        out[:, :-1] += carry[:, 1:]
        carry = out >> DIGIT
    codes = []
    for i, n in enumerate(filled.tolist()):
        d = out[i, :n + n % 2].astype(np.int64)
        d[n:] = 0
        codes.append((d[0::2] << 44 | d[1::2] << 24).astype(">i8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes())
    return codes


def decode_blocks(codes: list[bytes], lengths: list[int], id_limit: int) -> list[np.ndarray]:
    """Blocks of ids from their codes and numbers of ids; longest first."""
    lanes, size = len(codes), lengths[0]
    feed = np.zeros((lanes, max(map(len, codes)) // 5 * 2 + 8), np.int32)
    for i, code in enumerate(codes):
        pairs = np.zeros((len(code) // 5, 8), np.uint8)
        pairs[:, 3:] = np.frombuffer(code, np.uint8, len(pairs) * 5).reshape(-1, 5)
        pairs = pairs.view(">i8").astype(np.int64).ravel()
        feed[i, 0:2 * len(pairs):2], feed[i, 1:2 * len(pairs):2] = pairs >> DIGIT, pairs & _DIGIT
    taken = np.arange(lanes) * feed.shape[1] + 3
    code = feed[:, 0].astype(np.int64) << 2 * DIGIT | feed[:, 1].astype(np.int64) << DIGIT | feed[:, 2]
    feed, wide = feed.reshape(-1), np.full(lanes, 1 << WINDOW)
    rows = np.zeros((lanes, size), np.int32)
    model = _Model(lanes, id_limit)
    lives = _lives(np.array(lengths))
    one = two = np.zeros(lanes, np.int64)
    context = right = event = np.zeros((0, lanes), np.int64)
    for n, stop in _stretches(size):
        live = lives[n]
        model.renew(live, context, right, event)
        if n:  # order 0: the ids so far in their order, and the first place of each
            past = np.sort(rows[:live, :n], axis=1).reshape(-1)
            opens = np.empty(len(past), bool)
            np.not_equal(past[1:], past[:-1], out=opens[1:])
            opens[::n] = True
            group = np.cumsum(opens, dtype=np.int32)
            first = np.concatenate([[0], opens.nonzero()[0], [len(past)]])  # by group from 1 on
            base = np.arange(live) * n
        one, two, code, wide = one[:live], two[:live], code[:live], wide[:live]
        context, event = np.empty((stop - n, live), np.int64), np.empty((stop - n, live), np.int8)
        right, ids = np.empty((stop - n, 2, live), bool), np.empty((stop - n, live), np.int32)
        for k in range(stop - n):
            at = model.slots(one, two)
            context[k] = model.predict(at)
            bound = model.bound.take(context[k])
            r = wide >> 15
            o = event[k]
            np.add((code >= r * ((bound >> 15) & _ONE)).view(np.int8), (code >= r * ((bound >> 30) & _ONE)).view(np.int8), out=o)
            o += (code >= r * (bound >> 45)).view(np.int8)
            bound >>= o.astype(np.int64) * 15
            start = bound & _ONE
            bound >>= 15
            bound -= start
            bound &= _ONE
            code -= r * start
            r *= bound
            x = np.where(o == 0, model.guess[1], model.guess[0])
            if n:
                known = (o == 2).nonzero()[0]
                ahead, part = code.take(known), r.take(known) // n
                from_ = base.take(known)
                v = group.take(_divide(ahead, part) + from_, mode="clip")
                start = first.take(v)
                x[known] = past.take(start)
                code[known] = ahead - part * (start - from_)
                r[known] = part * (first.take(v + 1) - start)
            new = (o == 3).nonzero()[0]
            if len(new):
                ahead, part = code.take(new), r.take(new) >> model.bits
                v = np.minimum(model.fixed.searchsorted(ahead // part, "right") - 1, id_limit - 1)
                start = model.fixed.take(v)
                x[new] = v
                code[new] = ahead - part * start
                r[new] = part * (model.fixed.take(v + 1) - start)
            go = (r <= _LOW).nonzero()[0]
            while len(go):
                place, room = taken.take(go), r.take(go)
                # A damaged code may point beyond its range or ask for more than there is; its checksum fails later.
                code[go] = np.minimum(code.take(go), room - 1) << DIGIT | feed.take(place, mode="clip")
                taken[go] = place + 1
                room <<= DIGIT
                r[go] = room
                go = go[room <= _LOW]
            wide = r
            ids[k] = x
            two, one = one, x.astype(np.int64)
            right[k] = model.learn(at, x)
        rows[:live, n:stop] = ids.T
    return [rows[i, :m] for i, m in enumerate(lengths)]


# -------------------------------------------------------------------- files
_FILE = ("part int, segment int, doc_ids array<long>, doc_tokens array<int>, n_tokens long, block int, "
         "blocks array<struct<n:int,crc32:long,data:binary>>")


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _segment(part: int, number: int, docs: list[int | None], ids: list[np.ndarray], id_limit: int) -> pa.RecordBatch:
    whole = np.concatenate(ids)
    blocks = [whole[i:i + BLOCK] for i in range(0, len(whole), BLOCK)]
    coded = [c for i in range(0, len(blocks), LANES) for c in encode_blocks(blocks[i:i + LANES], id_limit)]
    kind = pa.list_(pa.struct([("n", pa.int32()), ("crc32", pa.int64()), ("data", pa.binary())]))
    return C.batch_of({
        "part": pa.array([part], pa.int32()), "segment": pa.array([number], pa.int32()),
        "doc_ids": pa.array([docs], pa.list_(pa.int64())), "doc_tokens": pa.array([[len(x) for x in ids]], pa.list_(pa.int32())),
        "n_tokens": pa.array([len(whole)], pa.int64()), "block": pa.array([BLOCK], pa.int32()),
        "blocks": pa.array([[{"n": len(b), "crc32": _crc(b), "data": c} for b, c in zip(blocks, coded)]], kind)})


def write(docs: DataFrame, path: str, vocabulary: str, spaced: bool, id_limit: int) -> None:
    """Write the ids of all documents (each with the end id 0) as files below ``path``."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held = TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        ids: list[np.ndarray] = []
        for batch in batches:
            for doc, x in zip(batch.column(0).to_pylist(), tokens.encode_column(batch.column(1), vocabulary, spaced)):
                names.append(doc)
                ids.append(x)
                held += len(x)
                if held >= BLOCK * LANES:
                    yield _segment(part, number, names, ids, id_limit)
                    names, ids, held, number = [], [], 0, number + 1
        if names:
            yield _segment(part, number, names, ids, id_limit)

    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
               .repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id"))
    ordered.mapInArrow(run, _FILE).write.parquet(path)


def decode_segment(row: dict, id_limit: int) -> list[np.ndarray]:
    """Ids of each document of a segment; raises ValueError at a block that does not match its checksum."""
    blocks = row["blocks"]
    parts: list[np.ndarray] = []
    for i in range(0, len(blocks), LANES):
        lot = blocks[i:i + LANES]
        for block, ids in zip(lot, decode_blocks([b["data"] for b in lot], [b["n"] for b in lot], id_limit)):
            if _crc(ids) != block["crc32"]:
                raise ValueError(f"part {row['part']}, segment {row['segment']}: a block does not match its checksum")
            parts.append(ids)
    return np.split(np.concatenate(parts), np.cumsum(row["doc_tokens"])[:-1])


def read(spark: SparkSession, path: str, id_limit: int, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (and ``ids``) of each document of the files below ``path``."""
    files = spark.read.schema(_FILE).parquet(path)
    # Ids before each segment: sums over the segments of a part, and over the parts.
    sizes = files.select("part", "segment", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("first"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = (sizes.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0).cast("long")))
              .join(parts, "part").select("part", "segment", (F.col("before") + F.col("first")).alias("first")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = decode_segment(row, id_limit)
                n = np.array([len(x) for x in ids])
                yield C.batch_of({
                    "doc_id": pa.array(row["doc_ids"], pa.int64()), "start": pa.array(row["first"] + np.cumsum(n) - n, pa.int64()),
                    "n_tokens": pa.array(n, pa.int64()), "ids_crc32": pa.array([_crc(x) for x in ids], pa.int64()),
                    "ids": pa.array([x.astype("<u4").tobytes() if with_ids else None for x in ids], pa.binary())})

    # The codes meet their starts before they are decoded, so each is decoded once.
    out = files.join(starts, ["part", "segment"]).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
    return out if with_ids else out.drop("ids")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{C.shared_folder(spark)}/llm-op4-files-{uuid.uuid4().hex}"
    write(C.documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"), True, 50_257)
    return read(spark, path, 50_257)
