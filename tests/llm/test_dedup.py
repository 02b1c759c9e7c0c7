"""Operators 1, 3, 7 and 8 against brute force."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm_cases import empty, groups, odd, texts  # noqa: F401  (fixtures)
from memberrisk.llm import common, decontaminate, embedding_dedup, ngram_join, substring_dedup, suffix_dedup


def words(text, lower=False):
    text = text or ""
    if lower:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def test_word_hashes_follow_the_words(texts):
    column = pa.array([t for _, t in texts] + [None, "a b", "b a", " a\tb\n"])
    seen, rows = {}, {}
    for w in common.words(column):
        for d in range(len(w.first) - 1):
            rows[w.row + d] = w.hash[w.first[d]:w.first[d + 1]].tolist()
    for i, t in enumerate(column.to_pylist()):
        own = words(t)
        assert len(own) == len(rows[i])
        for word, h in zip(own, rows[i]):
            assert seen.setdefault(h, word) == word
    assert len(seen) == len(set(seen.values()))


def shingles(text, k):
    w = words(text, lower=True)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute_groups(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = groups(range(len(rows)), links)
    low = defaultdict(list)
    for n, r in root.items():
        if rows[n][0] is not None:
            low[r].append(rows[n][0])
    return [(rows[n][0], len(sets[n]), (min(low[r]) if low[r] else None) if sets[n] else rows[n][0]) for n, r in root.items()]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("k,percent", [(4, 85), (2, 50)])
def test_jaccard_components(odd, texts, k, percent):
    got = ngram_join.jaccard_components(odd, k, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert order(map(tuple, got)) == order(brute_groups(texts, k, percent))


def test_one_per_group(odd, texts):
    kept = ngram_join.one_per_group(odd, 5, 80)
    assert kept.columns == odd.columns
    left = [(r["doc_id"], r["text"]) for r in kept.collect()]
    rows = brute_groups(texts, 5, 80)
    want = {i for i, n, c in rows if i is not None and (n == 0 or i == c)}
    assert {i for i, _ in left if i is not None} == want
    assert sum(i == 601 for i, _ in left) <= 1  # equal rows of one id
    assert any(i is None and t is None for i, t in left)


def test_columns_with_inner_names_stay(spark):
    same = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    other = "a quite different text of some more words that shares none of them with the rest of all rows here"
    rows = [(1, same, "k1", 11, "x"), (2, same, "k2", 12, None), (3, other, "k3", 13, "y"), (4, None, "k4", None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __key string, __BIT int, __key_ string")
    kept = ngram_join.one_per_group(docs, 5, 80)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == [rows[0], rows[2], rows[3]]
    item = spark.createDataFrame([(1, other)], "item_id long, text string")
    clean = decontaminate.drop_contaminated(docs, item)
    assert clean.columns == docs.columns
    assert sorted(map(tuple, clean.collect())) == [rows[0], rows[1], rows[3]]


def test_pairs_below_the_threshold_meet_once(spark, monkeypatch):
    """Near copies just below the threshold: a pair meets at one of its many common shingles, and no link is lost."""
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(70):
        own = list(base)
        for at in rng.choice(300, 4, replace=False):
            own[at] = f"x{i}_{at}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, rows[i][1] + " tail") for i in range(5)]
    met, real = [], ngram_join._meetings

    def counted(carried, percent):
        pairs = real(carried, percent)
        met.append((pairs.count(), pairs.distinct().count()))
        return pairs

    monkeypatch.setattr(ngram_join, "_meetings", counted)
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80)
    assert order(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == order(brute_groups(rows, 5, 80))
    assert met[0][1] > 0 and met[0][0] <= 1.5 * met[0][1]


def test_jaccard_of_nothing(empty):
    assert ngram_join.jaccard_components(empty).count() == 0
    assert ngram_join.one_per_group(empty).count() == 0


def test_suffix_filter_bound():
    rng = np.random.default_rng(3)
    for n, m in ((5, 6), (300, 350), (2000, 1800), (9000, 4100)):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[:n // 2], rng.integers(0, 2**63, m, dtype=np.uint64)]))
        assert ngram_join.common_at_most(ngram_join.histogram(a), ngram_join.histogram(b)) >= len(np.intersect1d(a, b))


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)]
    got = common.components(spark.createDataFrame(path, "a long, b long"), "test")
    want = groups({x for e in path for x in e}, path)
    assert {r["id"]: r["root"] for r in got.collect()} == want


# ------------------------------------------------------------- substring dedup
def brute_removed(rows, window):
    first = {}
    for i, t in rows:
        if i is not None:
            w = words(t)
            for p in range(len(w) - window + 1):
                key = tuple(w[p:p + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w, gone = words(t), set()
        if i is not None:
            for p in range(len(w) - window + 1):
                if first[tuple(w[p:p + window])] < i:
                    gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


@pytest.mark.parametrize("window", [13, 4])
def test_substring_dedup(odd, texts, window):
    got = substring_dedup.dedup(odd, window).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert order(map(tuple, got)) == order(brute_removed(texts, window))


def test_substring_levels(spark):
    rng = np.random.default_rng(5)
    long = " ".join(f"w{x}" for x in rng.integers(0, 10**9, 400))
    rows = [(1, f"a b c {long}"), (2, f"d e {long} f"), (3, " ".join(f"v{x}" for x in range(500)))]
    got = {r["doc_id"]: r for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), digest=True).collect()}
    assert got[2]["longest"] == got[1]["longest"] == 104 and got[3]["longest"] == 0  # 13 * 2**3, of which 400 words hold two
    assert got[2]["n_removed"] == 400 and got[2]["kept"] == hashlib.sha256(b"d e f").hexdigest()


def test_every_level_looks_at_every_window(spark):
    """Repeats that just reach a level, in texts hardly longer: each level has exactly the windows that repeat at its length."""
    rng = np.random.default_rng(8)
    passages = {m: [f"p{m}x{x}" for x in rng.integers(0, 10**9, m)] for m in (12, 13, 25, 26, 30, 51, 52, 110)}
    rows = []
    for m, passage in passages.items():
        rows += [(len(rows), " ".join([f"u{m}", *passage])), (len(rows) + 1, " ".join([*passage, f"v{m}", f"w{m}"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for length, marks in substring_dedup.levels(docs, substring_dedup.copies(docs, "t"), 13, "t"):
        got[length] = {r["doc_id"]: len(r["again"]) for r in marks.collect()}
    want = {}
    for length in (13, 26, 52, 104):
        where = defaultdict(set)
        for i, t in rows:
            w = words(t)
            for p in range(len(w) - length + 1):
                where[tuple(w[p:p + length])].add(i)
        want[length] = dict(Counter(i for ids in where.values() if len(ids) > 1 for i in ids))
    assert got == want
    found = {r["doc_id"]: (r["reach"], r["n_removed"]) for r in substring_dedup.dedup(docs).collect()}
    for i, m in enumerate(passages):
        assert found[2 * i][0] == found[2 * i + 1][0] == max([n for n in want if n <= m], default=0)
        assert found[2 * i][1] == 0 and found[2 * i + 1][1] == (m if m >= 13 else 0)


def test_substring_dedup_of_nothing(empty):
    assert substring_dedup.dedup(empty).count() == 0


# ---------------------------------------------------------------- suffix array
def shared_windows(rows, least):
    """(id, start) of the windows of ``least`` words that another id has too."""
    where = defaultdict(set)
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - least + 1):
            where[tuple(w[p:p + least])].add(i)
    return [(i, p) for i, t in rows for w in [words(t)] for p in range(len(w) - least + 1) if len(where[tuple(w[p:p + least])]) > 1]


def test_sliding_min():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 9, 40, 101):
        g = rng.integers(0, 50, n, dtype=np.uint64)
        for width in (1, 3, 8):
            want = [g[i:i + width].min() for i in range(n - width + 1)]
            assert common.sliding_min(g, width).tolist() == want


def test_suffix_matches(odd, texts):
    least = 50
    rows = [(i, t) for i, t in texts if i is not None]
    text = defaultdict(list)
    for i, t in rows:
        text[i].append(words(t))
    covered = defaultdict(set)
    found = suffix_dedup.matches(odd, least).collect()
    for r in found:
        assert r["doc_id"] != r["match_doc_id"] and r["n_words"] >= least - suffix_dedup.WIDTH + 1
        spans = [tuple(w[r["start"]:r["start"] + r["n_words"]]) for w in text[r["doc_id"]]]
        others = [tuple(w[r["match_start"]:r["match_start"] + r["n_words"]]) for w in text[r["match_doc_id"]]]
        assert any(s in others and len(s) == r["n_words"] for s in spans)
        covered[r["doc_id"]].update(range(r["start"], r["start"] + r["n_words"]))
    reach = least - suffix_dedup.WIDTH + 1
    for i, start in shared_windows(rows, least):
        assert len(covered[i] & set(range(start, start + least))) >= reach, (i, start)
    few = {i for i, _ in shared_windows(rows, reach)}
    assert set(covered) <= few  # nothing is said of clean documents
    assert len(found) == len({tuple(r) for r in found})


def test_suffix_matches_of_nothing(empty):
    assert suffix_dedup.matches(empty).count() == 0


# ------------------------------------------------------------------ embeddings
def brute_links(rows, least):
    unit = []
    for _, v, label in rows:
        ok = v is not None and label is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)
        unit.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None)
    return [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if unit[a] is not None and unit[b] is not None
            and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= least]


@pytest.mark.parametrize("cell_rows,block", [(4096, 1024), (40, 16)])
def test_embedding_components(spark, monkeypatch, cell_rows, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(11)
    rows = [(i, rng.normal(size=16).tolist(), int(i % 3)) for i in range(120)]
    centre = rng.normal(size=16)
    rows += [(200 + i, (centre + 0.05 * rng.normal(size=16)).tolist(), 1) for i in range(60)]       # near copies
    rows += [(300 + i, rows[i % 4][1], rows[i % 4][2]) for i in range(30)]                            # exact copies
    rows += [(400 + i, (np.array(rows[i][1]) * 3).tolist(), rows[i][2] if i % 2 else None) for i in range(10)]
    rows += [(500, None, 1), (501, [], 1), (502, [0.0] * 16, 1), (503, [None] + [1.0] * 15, 1), (504, [float("nan")] + [1.0] * 15, 1),
             (505, [float("inf")] + [1.0] * 15, 1), (506, [1.0, 2.0], 1), (507, [2.0, 4.0], 1), (508, [2.0, 4.0], 2), (None, rows[3][1], rows[3][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("cls", F.lit(1))
    got = embedding_dedup.near_components(df, cell_rows=cell_rows).collect()
    links = brute_links(rows, 0.93)
    root = groups(range(len(rows)), links)
    n = defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    low = defaultdict(list)
    for i, r in root.items():
        if rows[i][0] is not None:
            low[r].append(rows[i][0])
    want = [(rows[i][0], n[i], min(low[r], default=None)) for i, r in root.items()]
    assert order((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == order(want)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_cells_miss_no_link(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(800, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = rng.normal(size=x.shape)
    off -= (off * x).sum(axis=1, keepdims=True) * x
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    cos = rng.uniform(0.93, 0.96, size=(800, 1))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([x, cos * x + np.sqrt(1 - cos * cos) * off]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_components(df, cell_rows=100).collect()}
    n = defaultdict(int)
    for pair in brute_links(rows, embedding_dedup.LEAST):
        for i in pair:
            n[i] += 1
    assert got == {i: n[i] for i, _, _ in rows}


def test_embeddings_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_components(df).count() == 0
