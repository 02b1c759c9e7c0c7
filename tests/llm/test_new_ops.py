"""Operators 11, 12 and 13 against brute force."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict
from fractions import Fraction
from math import ceil, floor

import numpy as np
import pytest
import regex
import zstandard
from pyspark.sql import functions as F

from llm_cases import DOCS, prose
from memberrisk.llm import common, hard_negatives, language_id, prefix_trie


# ---------------------------------------------------------------- operator 11
def turn_key(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute_trie(rows, rebuild):
    """{(conv_id, depth): row} of the trie of (conv_id, turn, role, text) rows, path by path."""
    of = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            of[c].append(((turn is not None, turn or 0), turn_key(role, text), role or "", text or ""))
    of = {c: [(r, t) for _, _, r, t in sorted(v, key=lambda x: x[:2])] for c, v in of.items()}
    made = {}
    for c, own in of.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        made[c] = of.get(c - int(np.fmod(c, 100)), [])[:h] + own[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, path in made.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, cs in members.items():
        own = (len(cs) - 1) * len(path[-1][1]) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += own
            leaves[path[:d]] += not children[path]
    return sorted((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, cs in members.items())


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(11)
    lines = [prose(rng, 3) for _ in range(6)]
    rows = []
    for c in list(range(140)) + [-7, 200, 201, 305, 999, 1000, 1063]:
        for turn in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((c, turn, rng.choice(["user", "user", None]), rng.choice(lines[:2] + [None] if turn < 3 else lines)))
    rows += [(5000 + i, t, "user", lines[0]) for i in range(60) for t in range(4)]        # a large group of copies
    rows += [(7000, t, "user", f"long {t // 2}") for t in range(300)]                       # one long conversation
    rows += [(7001, t, "user", f"long {t // 2}") for t in range(260)] + [(7001, None, "x", "first")]
    rows += [(7002, t, "user", f"long {t // 2}") for t in range(280)]
    rows += [(8000, 1, "user", "a"), (8000, 1, "user", "b"), (8000, 1, "user", "b"), (None, 1, "user", "x"), (8001, None, None, None)]
    rows += [(9000, 0, "ab", "c"), (9001, 0, "a", "bc"), (9002, 0, "", "2:abc")]
    rng.shuffle(rows)
    return rows


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.mark.parametrize("options", [{}, {"shard": 20, "span": 4, "queue": 3}, {"shard": 1, "span": 7, "queue": 1}])
def test_trie_is_the_brute_force_one(spark, talk, options):
    df = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").withColumn("key", F.lit("clash")).repartition(5)
    if not options:
        convs, placed = prefix_trie.rebuilt(common.stage(prefix_trie.turns(df), "test-turns"))
        got = prefix_trie.trie(convs, placed)
    else:
        got = prefix_trie.conversation_trie(df, **options)
    assert sorted(map(tuple, got.select(*NODE).collect())) == brute_trie(talk, not options)


def test_trie_of_nothing_and_of_turnless(spark):
    shape = "conv_id long, turn long, role string, text string"
    assert prefix_trie.conversation_trie(spark.createDataFrame([], shape)).count() == 0
    one = [(c, 0, "u", "t") for c in (101, 103, 104)]  # rebuilt from a conversation that is absent
    convs, placed = prefix_trie.rebuilt(prefix_trie.turns(spark.createDataFrame(one, shape)))
    assert sorted(map(tuple, prefix_trie.trie(convs, placed).select(*NODE).collect())) == brute_trie(one, True)


def test_spilling_queue_gives_back_in_order():
    rng = random.Random(3)
    queue, waiting = prefix_trie.SpillingQueue(50), []
    queue.CHUNK = 7
    for _ in range(4000):
        if waiting and rng.random() < 0.4:
            assert queue.head() == min(waiting)
            assert queue.pop() == min(waiting)
            waiting.remove(min(waiting))
        else:
            item = (rng.randrange(300), str(rng.randrange(9)))
            queue.push(item)
            waiting.append(item)
    assert queue.spills > 5
    assert [queue.pop() for _ in range(len(waiting))] == sorted(waiting)
    assert queue.head() is None


def test_ids_over_many_slices(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 16)
    rows = [("hot", i) for i in range(2000)] + [(f"k{i % 40}", 5000 + i) for i in range(300)]
    got = dict(map(tuple, prefix_trie._id_digests(spark.createDataFrame(rows, "key string, conv_id long").repartition(6), "test").collect()))
    want = defaultdict(list)
    for k, i in rows:
        want[k].append(i)
    assert got == {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in want.items()}


# ---------------------------------------------------------------- operator 13
def brute_negatives(rows, k=5, n=10):
    """All pairs in Python integers. ``rows``: (vec_id, vector, label, anchor)."""
    ok = [(i, [floor(Fraction(256) * Fraction(x)) for x in v], label, a) for i, v, label, a in rows
          if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    last = [(NO if i is None else i) for i, *_ in ok]
    out = []
    for at, (i, v, label, anchor) in enumerate(ok):
        if not anchor or i is None:
            continue
        score = [sum(x * y for x, y in zip(v, w)) if len(w) == len(v) else None for _, w, _, _ in ok]
        known = sorted((j for j in range(len(ok)) if j != at and score[j] is not None), key=lambda j: (-score[j], last[j]))
        for p in [j for j in known if ok[j][2] == label][:k]:
            fit = [j for j in known if ok[j][2] != label and 30 * score[p] <= 100 * score[j] <= 90 * score[p]][:n]
            out += [(i, ok[p][0], r + 1, ok[j][0], score[p], score[j]) for r, j in enumerate(fit)]
    return sorted(out, key=str)


NO = 2 ** 63 - 1


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(13)
    centres = rng.normal(size=(6, 8))
    rows = []
    for i in range(500):
        c = int(rng.integers(0, 6))
        rows.append((i, [float(x) for x in centres[c] + rng.normal(size=8) * 0.4], c if rng.random() < 0.8 else int(rng.integers(0, 6)), i % 12 == 0))
    rows += [(600 + i, rows[i % 3][1], rows[i][2], False) for i in range(30)]              # ties
    rows += [(5, rows[7][1], 2, True), (5, rows[7][1], 2, True)]                            # repeated rows
    rows += [(700, None, 1, True), (701, [1.0, None, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0], 1, True), (702, [float("nan")] * 8, 1, True),
             (703, [float("inf")] * 8, 1, True), (704, [0.0] * 8, 1, True), (705, rows[3][1], None, True), (706, [], 1, True),
             (707, [1.0, 2.0], 1, True), (708, [1.0, 2.0], 1, False), (709, [0.5, 1.0], 2, False), (710, [0.2, 0.9], 3, False),
             (None, rows[9][1], 1, True), (None, rows[9][1], 2, False)]
    return rows


@pytest.mark.parametrize("size", [(1024, 64), (16, 3)])
def test_hard_negatives_are_the_brute_force_ones(spark, vectors, size, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 2 * 8 * size[0])
    monkeypatch.setattr(hard_negatives, "TILE", size[1])
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int, anchor boolean").withColumn("block", F.lit("x"))
    got = sorted(map(tuple, hard_negatives.hard_negatives(df.repartition(6)).collect()), key=str)
    assert got == brute_negatives(vectors)


def test_scores_stay_exact_in_large_numbers(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-2 ** 34, 2 ** 34, 3) / 2 ** 14], i % 3, i % 4 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, anchor boolean")
    assert sorted(map(tuple, hard_negatives.hard_negatives(df).collect()), key=str) == brute_negatives(rows)
    assert hard_negatives.hard_negatives(df.limit(0)).count() == 0
    wide = spark.createDataFrame([(i, [1e300 * (i + 1), -1e300], i % 2, True) for i in range(6)], df.schema)
    hard_negatives.hard_negatives(wide).count()  # scores beyond a long are held at its end


def test_curve_places_are_a_walk():
    """Neighbours on the curve are neighbours in space, and every point has its own place."""
    points = np.array(list(itertools.product(range(8), repeat=3)))
    place = hard_negatives.hilbert(points, 3)
    assert sorted(place) == list(range(512))
    walk = points[np.argsort(place)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_zone_maps_spare_blocks(spark, monkeypatch):
    """Bounds hold for every row, and far clusters' blocks are not read."""
    rng = np.random.default_rng(1)
    a, x = rng.integers(-300, 300, (20, 16)).astype(float), rng.integers(-300, 300, (50, 16)).astype(float)
    below, above = hard_negatives._bounds(a, x.min(axis=0)[None, :], x.max(axis=0)[None, :])
    assert (a @ x.T <= above + 1e-6).all() and (a @ x.T >= below - 1e-6).all()
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 2 * 8 * 16)
    plans = {}
    stage = common.stage
    monkeypatch.setattr(common, "stage", lambda df, name: plans.setdefault(name, stage(df, name)))
    centres = rng.normal(size=(12, 8)) * 3
    rows = [(i, [float(v) for v in centres[i % 12] + rng.normal(size=8) * 0.1], i % 2, i % 12 == 0) for i in range(960)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, anchor boolean")
    hard_negatives.hard_negatives(df, name="spare").count()
    every, anchors = plans["spare-blocks"].count(), plans["spare-anchors"].count()
    read = [plans[f"spare-{kind}-plan"].agg(F.sum("n_anchors")).first()[0] or 0 for kind in ("positive", "negative")]
    assert read[0] < 0.5 * anchors * every / 2 and read[1] < 0.7 * anchors * every / 2  # of the blocks of its label, of the others


# ---------------------------------------------------------------- operator 12
SYLLABLES = {"aa": "ba ce di fo gu ka le", "bb": "tha wor ing sted ough", "cc": "éa oui çon nè eux"}


@pytest.fixture(scope="module")
def speech(spark):
    rng = random.Random(12)

    def say(lang, n):
        parts = SYLLABLES[lang].split()
        return " ".join("".join(rng.choice(parts) for _ in range(rng.choice([1, 2, 3]))) for _ in range(n)).capitalize() + "."

    rows = [(i, say(lang, rng.choice([8, 30, 120])), lang, lang) for i, lang in enumerate(rng.choices(["aa", "bb", "cc"], [6, 3, 2], k=700))]
    rows += [(1000, None, "aa", "s"), (1001, "", "bb", "s"), (1002, "12 + 3 = 15 !!", "aa", "s"), (1003, say("bb", 9000), "bb", "s"), (1004, say("cc", 40), None, "s"),
             (None, say("aa", 50), "bb", "s"), (1005, say("aa", 20).upper(), "aa", "s"), (1005, say("aa", 20).upper(), "aa", "s"), (1006, "ß", "bb", "s"), (1007, "a퟿b", "bb", "s")]
    return rows, spark.createDataFrame([(i, t, lang, s, None) for i, t, lang, s in rows], DOCS).withColumn("best", F.lit(3)).withColumn("margin", F.lit("m")).repartition(4)


def test_language_is_the_smallest_by_plain_compression(spark, speech):
    rows, docs = speech
    model = language_id.fit(docs.where(~language_id.held_out() & F.col("doc_id").isNotNull()))
    assert set(model.languages) == {"aa", "bb", "cc"}
    settings = [zstandard.ZstdCompressionParameters.from_level(language_id.LEVEL, dict_size=len(d), source_size=language_id.PIECE,
                                                               write_content_size=False, write_checksum=False, write_dict_id=False) for d in model.dictionaries]
    plain = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=s)
             for d, s in zip(model.dictionaries, settings)]

    def predict(text):
        if not text or not regex.search(r"\p{L}", text):
            return "und"
        data = language_id.plain(text)
        total = [sum(len(c.compress(data[i:i + language_id.PIECE])) for i in range(0, len(data), language_id.PIECE)) for c in plain]
        return model.languages[total.index(min(total))]

    got = language_id.identify(docs, model).collect()
    assert sorted((str(r["doc_id"]), r["lang_pred"]) for r in got) == sorted((str(i), predict(t)) for i, t, *_ in rows)
    assert all(0 <= r["score"] <= 1 for r in got)
    truth = {i: lang for i, _, lang, _ in rows[:700]}
    held = [r for r in got if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)
    narrow = {(r["doc_id"], r["lang_pred"]) for r in language_id.classify(docs, model).collect()}
    assert narrow >= {(r["doc_id"], r["lang_pred"] if r["accepted"] else "und") for r in got}


def test_held_out_rows_and_their_labels_teach_nothing(spark, speech):
    _, docs = speech
    learn = docs.where(~language_id.held_out() & F.col("doc_id").isNotNull())
    other = docs.withColumn("lang", F.when(language_id.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    assert language_id.fit(learn) == language_id.fit(other.where(~language_id.held_out() & F.col("doc_id").isNotNull()))


def test_language_edges(spark, speech):
    _, docs = speech
    nothing = language_id.fit(docs.limit(0))
    assert nothing.languages == ()
    assert {r["lang_pred"] for r in language_id.identify(docs, nothing).collect()} == {"und"}
    one = language_id.fit(docs.where("lang = 'bb'"))
    assert {r["lang_pred"] for r in language_id.identify(docs, one).where("doc_id < 700").collect()} == {"bb"}
    assert language_id.identify(docs.limit(0), one).count() == 0
    assert language_id.plain("Aİ, b1c") == " ai̇ b c ".encode()
