"""Operators 2, 4, 5, 6, 9 and 10 against brute force, exact round trips and held-out labels."""

import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm_cases import empty, odd, prose, texts  # noqa: F401  (fixtures)
from memberrisk.llm import common, decontaminate, packing, pii, token_count, token_files, tokens, toxicity

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


# --------------------------------------------------------------- tokenization
def whole(path, text):
    t = Tokenizer.from_file(path)
    return t.encode(text, add_special_tokens=False).ids


ENCODERS = {p: whole for p in (BYTE, WORD)}
PLAIN = {BYTE: Tokenizer.from_file(BYTE), WORD: Tokenizer.from_file(WORD)}


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab'sT 1.\n\t\r \x0b\x0c\x1c\xa0 　́é日<|endoftext|>-_\U0001f600")), max_size=40))
def test_pieces_give_the_ids_of_the_text(text):
    for path, spaced in ((BYTE, True), (WORD, False)):
        want = PLAIN[path].encode(text, add_special_tokens=False).ids
        assert tokens.Encoder.of(path, spaced).encode(text).tolist() == want


def thue_morse(n, a="a", b="b"):
    word = a
    for _ in range(n):
        word += word.translate(str.maketrans(a + b, b + a))
    return word


def test_special_tokens_and_words_made_to_collide():
    """The library's ids for strings of special tokens; two words whose polynomial hashes agree stay two."""
    one, other = thue_morse(11), thue_morse(11, "b", "a")
    rows = ["a <|endoftext|> b", "<|startoftext|>x<|endoftext|>", "plain", f"{one} x", f"{other} x", f"y {other}", f"y {one}", "<|endoftext|", ""]
    for path, spaced in ((BYTE, True), (WORD, False)):
        got = [ids.tolist() for ids in tokens.encode_column(pa.array(rows), path, spaced)]
        assert got == [PLAIN[path].encode(t, add_special_tokens=False).ids + [0] for t in rows]
    assert 50256 in PLAIN[BYTE].encode(rows[0], add_special_tokens=False).ids
    for options in ({}, {"lower": True}, {"lower": True, "terms": True}):
        hashes = [h for w in common.words(pa.array([f"{one} {other} {one.upper()}"]), **options) for h in w.hash.tolist()]
        assert hashes[0] != hashes[1] and (hashes[0] == hashes[2]) == bool(options)


def test_pieces_of_prose(texts):
    for path, spaced in ((BYTE, True), (WORD, False)):
        for _, t in texts:
            assert tokens.Encoder.of(path, spaced).encode(t or "").tolist() == PLAIN[path].encode(t or "", add_special_tokens=False).ids


# --------------------------------------------------------------- token counts
def greedy(vocabulary, word):
    n, at = 0, 0
    longest = max(map(len, vocabulary))
    while at < len(word):
        for size in range(min(longest, len(word) - at), 0, -1):
            if word[at:at + size] in vocabulary:
                break
        at, n = at + size, n + 1
    return n


def test_automaton_is_greedy_longest_match():
    rng = random.Random(2)
    vocabulary = [bytes([b]) for b in range(256)] + [b"ab", b"abcd", b"bcdx", b"cd", b"dxabc", b" a", b" ab", b"aaaa", b"aaaaaab"]
    automaton = token_count.Automaton.of(vocabulary)
    held = set(vocabulary)
    cases = ["".join(rng.choice("abcdx") for _ in range(rng.choice([1, 2, 5, 30, 127, 128, 129, 700]))).encode() for _ in range(300)]
    data = np.frombuffer(b" ".join(cases), np.uint8)
    size = np.array([len(c) for c in cases])
    start = np.cumsum(size + 1) - size - 1
    want = [greedy(held, b" " + c) for c in cases]
    assert automaton.count(data, start, start + size).tolist() == want
    assert [automaton.count_one(b" " + c) for c in cases] == want
    with pytest.raises(ValueError):
        token_count.Automaton.of([b"a"])


def test_token_counts(odd, empty, texts):
    vocabulary = token_count.byte_vocabulary(BYTE)
    automaton, held = token_count.Automaton.of(vocabulary), set(vocabulary)
    got = sorted(map(tuple, token_count.count_tokens(odd, automaton).collect()), key=str)
    want = []
    for i, t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
        want.append((i, len(w), sum(greedy(held, b" " + x) for x in w)))
    assert got == sorted(want, key=str)
    assert token_count.count_tokens(empty, automaton).count() == 0


# ---------------------------------------------------------------- token files
@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 50_256), st.integers(0, 3)), min_size=1, max_size=300), min_size=1, max_size=8))
def test_range_coder_round_trip(blocks):
    blocks = sorted((np.array(b) for b in blocks), key=len, reverse=True)
    codes = token_files.encode_blocks(blocks, 50_257)
    back = token_files.decode_blocks(codes, [len(b) for b in blocks], 50_257)
    assert all((a == b).all() for a, b in zip(blocks, back))


def test_blocks_are_independent_and_small():
    rng = np.random.default_rng(4)
    pattern = rng.integers(0, 50_257, 200)
    blocks = [np.tile(pattern, 20), rng.integers(0, 50_257, 4000), np.zeros(3000, np.int64)]
    codes = token_files.encode_blocks(blocks, 50_257)
    assert codes[1] == token_files.encode_blocks([blocks[1]], 50_257)[0]
    assert len(codes[0]) < 1600 and len(codes[2]) < 100 and len(codes[1]) < 2.4 * 4000


def test_token_files(odd, empty, texts, scratch, spark):
    token_files.write(odd, f"{scratch}/files", BYTE, True, 50_257)
    got = token_files.read(spark, f"{scratch}/files", 50_257, with_ids=True).collect()
    assert sorted((r["start"], r["n_tokens"]) for r in got)[0][0] == 0
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    want = []
    for i, t in texts:
        x = np.array(PLAIN[BYTE].encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()
        want.append((i, len(x) // 4, zlib.crc32(x), x))
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) for r in got), key=str) == sorted(want, key=str)
    token_files.write(empty, f"{scratch}/none", BYTE, True, 50_257)
    assert token_files.read(spark, f"{scratch}/none", 50_257).count() == 0


def test_damaged_block_is_noticed():
    ids = [np.arange(900) % 70, np.arange(500) % 11]
    batch = token_files._segment(0, 0, [1, 2], ids, 50_257)
    row = batch.to_pylist()[0]
    assert [x.tolist() for x in token_files.decode_segment(row, 50_257)] == [x.tolist() for x in ids]
    data = bytearray(row["blocks"][0]["data"])
    data[3] ^= 64
    row["blocks"][0]["data"] = bytes(data)
    with pytest.raises(ValueError):
        token_files.decode_segment(row, 50_257)


def test_any_damage_ends_and_is_seen():
    rng = np.random.default_rng(6)
    for limit in (50_257, 70, 300_000):
        blocks = [rng.zipf(1.3, n) % limit for n in (700, 300, 1)]
        codes = token_files.encode_blocks(blocks, limit)
        for damaged in ([rng.bytes(len(c)) for c in codes], [b"\xff" * len(c) for c in codes], [c[:len(c) // 2] for c in codes]):
            back = token_files.decode_blocks(damaged, [700, 300, 1], limit)
            assert [len(b) for b in back] == [700, 300, 1] and (back[0] != blocks[0]).any()


def test_coding_costs_little_beside_sorting():
    """Time to code and decode an id, by the time to sort it: about 12; it was over 35 when each id took all steps of the models and the coder."""
    def took(call):
        begin = time.process_time()
        call()
        return time.process_time() - begin

    rng = np.random.default_rng(5)
    blocks = list(rng.zipf(1.25, (1200, 600)) % 50_257)
    codes = token_files.encode_blocks(blocks, 50_257)
    numbers = rng.integers(0, 1 << 60, 1200 * 600)
    sorting = min(took(lambda: np.sort(numbers, kind="stable")) for _ in range(5))
    coding = min(took(lambda: token_files.encode_blocks(blocks, 50_257)) + took(lambda: token_files.decode_blocks(codes, [600] * 1200, 50_257))
                 for _ in range(2))
    assert coding < 22 * sorting


# -------------------------------------------------------------------- packing
def packs(counts, capacity):
    runs = packing.complete_bins(counts, capacity)
    used = np.zeros_like(counts)
    for run in runs:
        assert sum(run.lengths) <= capacity and run.times > 0
        for x in run.lengths:
            used[x] += run.times
    assert (used == counts).all()
    return sum(r.times for r in runs)


def fewest(items, capacity):
    """Exact minimum by search over small sets."""
    best = [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for j in sorted({r: j for j, r in enumerate(rooms)}.values()):
            if rooms[j] >= items[i]:
                rooms[j] -= items[i]
                go(i + 1, rooms)
                rooms[j] += items[i]
        go(i + 1, rooms + [capacity - items[i]])

    go(0, [])
    return best[0]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=0, max_size=11))
def test_bin_completion_is_optimal_on_small_sets(items):
    counts = np.bincount(items, minlength=31) if items else np.zeros(31, np.int64)
    assert packs(counts, 30) == fewest(sorted(items, reverse=True), 30)


def test_bin_completion_on_many():
    rng = np.random.default_rng(8)
    for sizes in (rng.integers(1, 2049, 20_000), np.minimum(2048, rng.lognormal(6, 1.2, 50_000).astype(int) + 1), np.ones(9000, int), np.full(500, 1025)):
        counts = np.bincount(sizes, minlength=2049)
        bound = max(-(-int(sizes.sum()) // 2048), int((sizes > 1024).sum()))
        assert packs(counts, 2048) <= bound + max(1, bound // 100)


def test_packing(odd, empty, texts):
    rows = packing.pieces(odd, WORD, False, 64, with_ids=True)
    got = packing.pack(rows, 64, "test").collect()
    place = defaultdict(list)
    for r in got:
        place[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in place.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    want = []
    for i, t in texts:
        x = PLAIN[WORD].encode(t or "", add_special_tokens=False).ids + [0]
        for n, s in enumerate(range(0, len(x), 64)):
            part = np.array(x[s:s + 64], "<u4").tobytes()
            want.append((i, n, s, len(part) // 4, zlib.crc32(part)))
    assert sorted((tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got), key=str) == sorted(want, key=str)
    total = sum(w[3] for w in want)
    assert len(place) <= 1.02 * max(-(-total // 64), sum(w[3] > 32 for w in want))
    whole_ = packing.sequences(packing.pack(rows, 64, "test")).collect()
    assert sum(len(r["ids"]) for r in whole_) == 4 * total
    assert packing.pack(packing.pieces(empty, WORD, False), 2048, "none").count() == 0


# ------------------------------------------------------------ decontamination
def test_decontamination(spark, empty):
    rng = random.Random(5)
    item = "A train leaves Boston at 9 with Maria Lopez aboard and covers 120 miles in 2 hours before it stops where Maria waits for 30 minutes"
    again = item.replace("Boston", "Denver").replace("Maria Lopez", "Omar Khan").replace("Maria", "Omar").replace("120 miles", "75.5 km").replace("9", "11")
    broken = item.replace("Maria Lopez", "Omar Khan").replace("waits for 30", "waits for 9")  # Maria stands for two names
    other = prose(rng, 40)
    accented = "La. Éai éonleeau pour an éonqueê aivi ai, éenaitreoiaux éoiré anvitre èenreré élé dcièépaè ñandú ñoño ülber le"
    rows = [(1, f"{prose(rng, 30)}. {item}. {prose(rng, 30)}"), (2, f"{prose(rng, 30)}. {again}."), (3, prose(rng, 200)), (4, None), (5, ""),
            (6, other.upper().replace(" ", ",!! ")), (16, "AND " + accented.upper() + ".!! THE"), (7, " ".join(item.split()[:6])), (None, item), (8, item), (8, prose(rng, 50)), (9, "7 9 8 1 2 3 4 5 6 7")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, hash string")
    bench = spark.createDataFrame([(10, item), (11, other), (12, None), (13, "too short"), (14, "alpha beta gamma delta epsilon zeta"), (17, accented),
                                   (15, "1 2 3 4 5 6 7 8 9 10")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.matches(docs, bench).collect()}
    assert set(got) == {(1, 10), (2, 10), (6, 11), (None, 10), (8, 10), (16, 17)}
    assert got[2, 10]["consistent"] and got[2, 10]["share"] == 1.0
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 7, 8, 9]
    short = spark.createDataFrame([(1, "so alpha beta gamma delta epsilon zeta then"), (2, broken)], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.matches(short, bench).where("item_id = 14").collect()] == [(1, 14)]
    assert not any(r["consistent"] for r in decontaminate.matches(short, bench, coverage=0.0).where("doc_id = 2 AND item_id = 10").collect())
    assert decontaminate.matches(empty, bench).count() == 0
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == docs.count()


def contaminated(spark, docs, items):
    """(doc_id, item_id) -> row of ``matches`` for lists of texts."""
    docs = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in decontaminate.matches(docs, items).collect()}


def test_occurrences_are_judged_one_by_one(spark):
    item = "the train from Boston to Paris takes 9 hours and the train from Boston to Vienna takes 12 hours when it snows"
    other = item.replace("Boston", "Denver").replace("9", "4").replace("12", "7")
    third = other.replace("Denver", "Lima").replace("4", "5").replace("when", "surely when")
    twice = "on the way and Ann has 5 apples and 6 pears and Bob has 7 apples and 8 pears"
    asked = twice.replace("Ann", "Eve").replace("5", "9").replace("Bob", "Max").replace("7", "3")
    got = contaminated(spark, [f"{item} {other}", twice, f"{other} {third}", f"{asked} or so {twice}", asked], [item, twice])
    assert set(got) == {(0, 0), (1, 1), (2, 0), (3, 1), (4, 1)}
    assert all(r["consistent"] for r in got.values())
    assert got[0, 0]["share"] == got[1, 1]["share"] == got[2, 0]["share"] == got[3, 1]["share"] == 1.0


def test_names_that_open_sentences(spark):
    item = "Natalia sold clips to 48 friends in April. Natalia then sold half as many clips in May."
    maria = item.replace("Natalia", "Maria").replace("48", "36")
    inner = "Yesterday Omar Khan sold clips to 48 friends in April. Omar Khan then sold half as many clips in May."
    mixed = item.replace("Natalia then", "Maria then")  # two names for one: the words alone are the item's
    quoted = 'He said: "The river is wide and slow where it meets the old stone bridge."'
    got = contaminated(spark, [f"Read this. {maria} Then answer.", inner, item, mixed, quoted.lower(), quoted.upper()], [item, quoted])
    assert set(got) >= {(0, 0), (1, 0), (2, 0), (4, 1), (5, 1)}
    assert got[0, 0]["share"] == got[2, 0]["share"] == 1.0 and got[0, 0]["consistent"] and got[1, 0]["consistent"]
    assert (3, 0) not in got or not got[3, 0]["consistent"]


def test_verbatim_runs_of_any_item(spark):
    rng = random.Random(31)
    long = prose(rng, 100)
    items = [long, "12 + 30 = 42, 7 * 8 = 56, 9 - 4 = 5", "Anna Karenina", "日本語の文章です", "3 4 5 6 7 8 9 10 11 12 13 14 15 16"]
    quote = " ".join(long.split()[30:70])
    docs = [f"{prose(rng, 50)} {quote} {prose(rng, 50)}", f"{prose(rng, 9)} 12 + 30 = 42; 7 * 8 = 56; 9 - 4 = 5.", "He read Anna Karenina in May.",
            "これは日本語の文章です。次", "table: 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17",
            "12 + 31 = 43, 7 * 8 = 56, 9 - 4 = 5", "Anna and Karenina", "日本語の文", " ".join(long.split()[30:42]), "3 4 5 6 7 8 9 10 11 12 13 15"]
    got = contaminated(spark, docs, items)
    assert set(got) == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 4)}
    assert all(r["consistent"] for r in got.values())


# ------------------------------------------------------------------------ PII
def strict(text):
    """The formats as written, by a plain regular-expression search."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and pii.luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("0123456789.@+- ()ab_%é日")), max_size=60))
def test_base_spans_are_the_formats(text):
    assert pii.base_spans(text) == strict(text)


def test_base_spans_of_cases():
    for text in ("x a@b.c@d.e y", "1.2.3.4.5.6.7.8", "999.1.1.1 0255.0.0.000", "4111 1111 1111 1111 4111-1111-1111-1111", "+1 (743) 555-3824.",
                 "a" * 300 + "@b.co", "4" * 5000, "1." * 3000, "+" * 3000, "@" * 3000, "a@" * 2000, "+1" + "-" * 4000):
        assert pii.base_spans(text) == strict(text)
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_redact():
    text = "mail a@b.co or 10.0.0.1"
    assert pii.redact(text, pii.base_spans(text)) == "mail [EMAIL] or [IP]"
    assert pii.redact("abcdef", [("card", 0, 3), ("phone", 2, 5)]) == "[CARD]f"


def test_pii(spark, odd, empty, texts):
    rng = random.Random(9)
    rows = []
    for i in range(400):
        kind = i % 5
        secret = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        number = "".join(rng.choice("0123456789") for _ in range(15))
        card = next(number + c for c in "0123456789" if pii.luhn(number + c))
        hit = [f"x{i}@mail.example.com", f"{rng.randrange(256)}.{rng.randrange(256)}.3.4", card, f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}",
               f'token = "{secret}"'][kind]
        rows.append((i, f"{prose(rng, 20)} {hit} {prose(rng, 20)} {rng.randrange(10**9, 10**10)} {rng.randrange(300, 900)}.4.5.6"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(docs)
    found = {r["doc_id"]: r for r in pii.find(docs, model).collect()}
    for i, t in rows:
        assert found[i]["base"] == pii.joined(strict(t))
        assert set(found[i]["base"].split(",")) <= set(found[i]["spans"].split(",")) or not found[i]["base"]
    secrets = [i for i, _ in rows if i % 5 == 4]
    assert sum("secret:" in found[i]["spans"] for i in secrets) > 0.9 * len(secrets)  # no strict format has these
    assert sum("secret:" in found[i]["spans"] for i, _ in rows if i % 5 != 4) == 0
    got = pii.redact_documents(odd, model)
    assert got.columns == odd.columns and got.count() == len(texts)
    assert all(r["n_chars"] == len(r["text"]) for r in got.collect() if r["text"] is not None)
    assert pii.fit(empty) is None and pii.find(empty, None).count() == 0
    assert {r["doc_id"]: r["spans"] for r in pii.find(docs, None).collect()} == {i: pii.joined(strict(t)) for i, t in rows}


def test_boosted_trees_add_each_kind(spark):
    rng = random.Random(17)
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def spans():
        number = n(15)
        card = next(number + c for c in "0123456789" if pii.luhn(number + c))
        return [("email", "", f"jane{n(3)} [at] example{n(2)} [dot] com"), ("ip", "server ", ". ".join(str(rng.randrange(10, 256)) for _ in range(4))),
                ("card", "card ", ".".join(card[i:i + 4] for i in (0, 4, 8, 12))), ("phone", "phone: ", f"({rng.randrange(200, 999)}) {n(3)}-{n(4)}"),
                ("secret", "token = ", "ab1" + n(300))]

    def texts(count):
        made = []
        for i in range(count):
            kind, says, s = spans()[i % 5]
            made.append((i, f"{prose(rng, 20)} {says}{s} {prose(rng, 20)} {n(10)} x {n(4)}.{n(4)}.{n(4)}.{n(3)} 3+{i}@4 {rng.randrange(300, 900)}. 4. 5. 6", kind, s))
        return made

    fitted, fresh = texts(1000), texts(200)
    model = pii.fit(spark.createDataFrame([r[:2] for r in fitted], "doc_id long, text string"))
    for kind in pii.KINDS:
        own = [(t, s) for _, t, k, s in fresh if k == kind]
        assert not any(pii.detect(t, None)[1] for t, _ in own)  # no strict format
        assert sum((kind, t.index(s), t.index(s) + len(s)) in pii.detect(t, model)[1] for t, s in own) > 0.9 * len(own), kind
    extra = sum(len(pii.detect(t, model)[1]) for _, t, _, _ in fresh)
    assert extra <= 1.05 * len(fresh)


def test_boosted_trees_learn():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = pii.fit_trees(x[:2000], y[:2000])
    assert ((model.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95


def test_boosted_trees_learn_from_every_document(spark):
    """Secrets in none of the 4000 documents with the smallest hash; the trees depend on no order of the rows."""
    rng = random.Random(23)
    ids = [r["id"] for r in spark.range(4300).orderBy(F.xxhash64("id"), "id").collect()]
    rows = []
    for place, i in enumerate(ids):
        number = "".join(rng.choice("0123456789") for _ in range(10))
        token = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        rows.append((i, f"tel {number} x" if place < 4000 and place % 2 else f"of {number} x" if place < 4000
                     else f'token = "{token}" x' if place % 2 else f"of {token} x"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(docs)
    assert [k for k, _, _ in pii.detect(f'a token = "{"0123456789abcdef" * 2}" b', model)[1]] == ["secret"]
    again = pii.fit(docs.orderBy("text").repartition(3))
    assert again.threshold == model.threshold and again.start == model.start
    for name in ("feature", "cut", "value"):
        assert (getattr(again, name) == getattr(model, name)).all()


def test_boosted_trees_of_a_table_are_those_of_its_rows(spark):
    rng = np.random.default_rng(29)
    x = np.round(rng.normal(size=(3000, pii.FEATURES)), 1)
    y = (x[:, 0] > 0) ^ (x[:, 1] > 0.5)
    rows = spark.createDataFrame([(a.tolist(), bool(b)) for a, b in zip(x, y)], "x array<double>, y boolean")
    table, local = pii._fit_rows(rows.repartition(5), y.mean()), pii.fit_trees(x, y.astype(float))
    assert (table.feature == local.feature).all() and np.allclose(table.cut, local.cut) and np.allclose(table.value, local.value)
    assert ((table.probability(x) > 0.5) == y).mean() > 0.95


# ------------------------------------------------------------------- toxicity
def test_ordinal_regression_recovers_order():
    rng = np.random.default_rng(10)
    x = rng.poisson(1.0, size=(3000, 5)).astype(float)
    y = np.searchsorted([2.0, 4.0, 6.0], x @ np.array([2.0, 1.0, 0, 0, 0]) + rng.logistic(size=3000))
    w, cuts = toxicity.fit_ordinal(x, y, 3)
    assert (np.diff(cuts) > 0).all() and w[0] > w[1] > 0.5 and np.abs(w[2:]).max() < 0.3
    assert abs(w[0] / w[1] - 2) < 0.4


def test_toxicity(spark, odd, empty, texts):
    rng = random.Random(12)
    bad = ["grumf", "zork", "plex", "vrek"]
    rows = []
    for i in range(900):
        words = prose(rng, rng.choice([5, 30, 200])).split()
        n = (i % 6 == 0) * (1 + i // 6 % 4)
        for _ in range(n):
            words.insert(rng.randrange(len(words)), rng.choice(bad).upper() + rng.choice([",", "!", ""]))
        rows.append((i, " ".join(words), int(n > 0), n))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t, _ in rows if i < 600] + [(10_000, 1), (None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [r for r in rows if r[0] >= 600]
    assert sum(got[i]["toxic"] == bool(t) for i, _, t, _ in held) >= 0.98 * len(held)
    severity = [np.mean([got[i]["severity"] for i, _, _, m in held if m == n]) for n in range(5)]
    assert severity == sorted(severity) and 0 <= min(severity) and max(severity) <= toxicity.GRADES
    kept = toxicity.reject_toxic(odd, model)
    assert kept.columns == odd.columns and kept.count() == len(texts)  # clean documents stay
    assert {r["doc_id"] for r in toxicity.reject_toxic(docs, model).collect()} == {i for i in got if not got[i]["toxic"]}
    nothing = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs, nothing).where("toxic OR severity != 0").count() == 0
    assert toxicity.score(empty, model).count() == 0


def test_id_filter_keeps_all_ids(spark):
    ids = spark.range(0, 5000, 7).select(F.col("id").alias("doc_id"))
    held = common.IdFilter.of(ids, "doc_id")
    all_ = spark.range(5000).select(F.col("id").alias("doc_id"))
    kept = {r[0] for r in held.keep(all_, "doc_id").collect()}
    assert kept >= set(range(0, 5000, 7)) and len(kept) < 900
    assert {r[0] for r in held.drop(all_, "doc_id").collect()} == set(range(5000)) - kept


def test_slices_cover_long_texts():
    column = pa.array(["a" * 10, None, "b" * (3 << 20), "", "c d"])
    assert [(r, len(e) - 1) for r, e, _ in common.slices(column)] == [(0, 2), (2, 1), (3, 2)]
