"""The corpus pipeline against a brute-force version on a small planted corpus."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from llm_cases import edited, groups, prose
from memberrisk.llm import pii, registry
from test_dedup import shingles

BAD = ("grumf", "zork", "plex", "vrek")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder of tables, and what each stage must make of them."""
    rng = random.Random(21)
    items = [(i, prose(rng, 30)) for i in range(5)]
    rows, toxic, leaked = [], set(), set()
    for i in range(500):
        text = prose(rng, rng.choice([20, 60, 150]))
        if i % 6 == 0:
            words = text.split()
            for _ in range(1 + i // 6 % 3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
            text = " ".join(words)
            toxic.add(i)
        elif i % 25 == 1:
            text = f"{text} {items[i // 25 % 5][1]} {prose(rng, 10)}"
            leaked.add(i)
        elif i % 10 == 2:
            text += f" x{i}@mail.example.com and 10.0.{i % 256}.7 or +1 (555) 555-{1000 + i}"
        rows.append((i, text))
    rows += [(600 + i, rows[2 + 6 * i][1]) for i in range(10)]                         # exact copies
    rows += [(700 + i, edited(rng, rows[3 + 6 * i][1], 0.005)) for i in range(20)]      # near copies
    rows += [(800, None), (801, ""), (802, " \n "), (None, prose(rng, 30))]
    toxic |= {i for i, t in rows if i is not None and t and set(t.split()) & set(BAD)}
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", None if t is None else len(t)) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i, _ in rows[:400]], "doc_id long, quality int, toxic int") \
        .write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, toxic, leaked


def brute(rows, toxic, leaked):
    """Rows after the first three stages, and their texts after the fourth."""
    rows = [r for r in rows if r[0] not in toxic]
    sets = [shingles(t, 5) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = groups(range(len(rows)), links)
    low = {}
    for n, r in root.items():
        if rows[n][0] is not None:
            low[r] = min(low.get(r, rows[n][0]), rows[n][0])
    rows = [r for n, r in enumerate(rows) if r[0] is None or not sets[n] or low[root[n]] == r[0]]
    return [(i, t) for i, t in rows if i not in leaked]


def test_stages_and_run(spark, corpus):
    folder, rows, toxic, leaked = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        path = f"{folder}/{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
    kept = brute(rows, toxic, leaked)
    got = {(r["doc_id"], r["text"]) for r in docs.collect()}
    want = set()
    for i, t in kept:
        want.add((i, pii.redact(t, pii.base_spans(t)) if t else t))
    assert {i for i, _ in got} == {i for i, _ in want}
    assert len(got & want) >= 0.97 * len(want)  # the model may redact more
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect() if r["text"] is not None)

    out = corpus_pipeline.run(spark, folder).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = []
    for i, t in got:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for n, s in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[s:s + 2048], "<u4").tobytes()
            pieces.append((i, n, s, len(part) // 4, zlib.crc32(part)))
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out), key=str) == sorted(pieces, key=str)
    place = {}
    for r in out:
        place.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in place.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048


def test_empty_tables(spark, tmp_path):
    for name, shape in (("documents", "doc_id long, text string, lang string, source string, n_chars long"),
                        ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], shape).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.queries())
    assert numbers == list(range(1, 11)) and set(registry.oracle_sql()) <= set(registry.queries())
    assert [f for _, f in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5
