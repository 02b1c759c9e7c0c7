"""Personal data by candidate gradient boosting (operator 9).

Strict formats give the *base* spans of kinds email, ip, card and phone; they
always stay. High-recall generators propose further, overlapping spans (digit
groups of any make-up, dotted groups, spelled-out addresses, long mixed
tokens). Boosted trees score each proposal by its format and its context; a
proposal is redacted when its score passes the threshold calibrated for its
kind and nothing better or base overlaps it. Tokens have the kind ``secret``.

The trees are fitted on all proposals of all documents with weak labels from evidence
beside the format: a proposal is positive when a word that
announces its kind stands before it, when an address is spelled out, when a grouped
number has a card's checksum, when a number has an area code in brackets, when a
token follows a credential's name and a sign of assignment; base spans are positive
too. The features hold none of what defines base spans. Every fifth is held out;
those that overlap no base span, which the model has to judge, calibrate the
thresholds at a precision of ``PRECISION``. Proposals are written as binned features;
a level of a tree is a pass over them that sums gradients by node, feature and bin, in
whole numbers, so the trees do not depend on how the rows are dealt.

Detection is one pass over the documents, without a shuffle; each text is scanned whole in
time linear in its length. Spans count code points, end exclusive.

Edge cases: null or empty text has no spans. Rows with null or repeated ids are
kept and treated alone. Without positive and negative proposals
there is no model and only base spans are found.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memberrisk.llm import common as C

KINDS = ("email", "ip", "card", "phone", "secret")
PRECISION = 0.98
TREES, DEPTH, RATE, BINS = 40, 3, 0.3, 32
UNIT = float(1 << 30)  # of a gradient in sums
GRID = 512             # places a unit of log odds

Span = tuple[str, int, int]

# ------------------------------------------------------------- strict formats
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _emails(text: str) -> list[Span]:
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return found


def _ips(text: str) -> list[Span]:
    found = []
    for m in _DOTTED.finditer(text):
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            end = at + sum(map(len, four)) + 3
            if all(map(_octet, four)):
                found.append(("ip", at, end))
            at = end + 1
    return found


def base_spans(text: str) -> list[Span]:
    """All strict spans, by start and then by kind."""
    found = _emails(text) if "@" in text else []
    if _DIGIT.search(text):
        found += _ips(text)
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    found.append(("phone", m.start(), m.end()))
    return sorted(found, key=_place)


def _place(span: Span) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


# ------------------------------------------------------------------ proposals
_GROUPS = re.compile(r"(?<![0-9A-Za-z+(])[+(]{0,2}[0-9]++(?:[\x20()./-]{1,2}[0-9]++)*+")
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64}+\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,64}+"
                      r"(?:\x20?(?:[\[(](?:dot|DOT)[\])]|\.)\x20?[A-Za-z0-9-]{1,64}+)++")
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?![A-Za-z0-9+/_-])")
_SAYS = (  # words of context by what they announce
    re.compile(r"mail|contact|write", re.I), re.compile(r"\bip\b|host|server|addr", re.I),
    re.compile(r"card|visa|account|credit|pay", re.I), re.compile(r"tel|phone|call|fax|mobile", re.I),
    re.compile(r"token|key|secret|passw|auth", re.I))
_ASSIGNED = re.compile(r"(?:token|key|secret|passw\w*|auth\w*)[\"']?\x20{0,3}[=:]\x20{0,3}[\"']?\Z", re.I)
_ANNOUNCED = tuple(re.compile(rf"\b(?:{words})[^A-Za-z0-9+(]{{0,4}}(?:(?:is|at|me|us|on|no|number)\b[^A-Za-z0-9+(]{{1,3}}){{0,2}}\Z", re.I) for words in (
    "e-?mail|mail|contact|write", "ip|host|server|addr|address", "card|visa|mastercard|amex|credit",
    "tel|telephone|phone|call|fax|mobile|cell"))
_AREA = re.compile(r"\([0-9]{2,4}\)[\x20-]?[0-9]{3,4}[\x20.-][0-9]{4}")
FEATURES = 19


def proposals(text: str) -> list[Span]:
    found: list[Span] = []
    if _DIGIT.search(text):
        for m in _GROUPS.finditer(text):
            digits = sum(c.isdigit() for c in m.group())
            dots = m.group().count(".")
            if 9 <= digits <= 16:
                found.append(("phone", m.start(), m.end()))
            if 12 <= digits <= 20:
                found.append(("card", m.start(), m.end()))
            if dots >= 3 and digits <= 20:
                found.append(("ip", m.start(), m.end()))
        found += [("secret", m.start(), m.end()) for m in _TOKEN.finditer(text)
                  if _DIGIT.search(m.group()) and not m.group().isdigit()]
    if "@" in text:
        found += [s for s in _emails(text)]
        found += [("email", i - 1, i + 2) for i in _lone_ats(text)]
    if "at)" in text or "at]" in text or "AT)" in text or "AT]" in text:
        found += [("email", m.start(), m.end()) for m in _SPELLED.finditer(text)]
    return found


def _lone_ats(text: str) -> list[int]:
    """Signs of mail addresses without a domain, as contrast."""
    out, at = [], text.find("@")
    while at >= 0:
        if 0 < at < len(text) - 1 and not _DOMAIN.match(text, at + 1):
            out.append(at)
        at = text.find("@", at + 1)
    return out


def features(text: str, span: Span) -> list[float]:
    kind, start, end = span
    s, before, after = text[start:end], text[max(0, start - 24):start], text[end:end + 8]
    digits = "".join(c for c in s if c.isascii() and c.isdigit())
    parts = [p for p in re.split(r"[^0-9]+", s) if p]
    letters = sum(c.isalpha() for c in s)
    return [
        *(float(kind == k) for k in KINDS), float(len(s)), float(len(digits)), letters / len(s),
        float(len(parts)), float(max(map(len, parts), default=0)), float(max((int(p[:6]) for p in parts), default=0)),
        float("(" in s), float(s.count(".")), float(s.count("-") + s.count(" ")),
        float(before[-1:].isalnum()), float(after[:1].isalnum()),
        float(bool(_SAYS[KINDS.index(kind)].search(before))), float("=" in before or ":" in before),
        len(set(s)) / len(s)]


def weak_label(text: str, span: Span, base: set[Span]) -> bool:
    """Evidence for a proposal: the words before it, its checksum, how an address is spelled, or a base span."""
    kind, start, end = span
    before, s = text[max(0, start - 40):start], text[start:end]
    if kind == "secret":
        return bool(_ASSIGNED.search(before))
    if span in base:
        return True
    announced = bool(_ANNOUNCED[KINDS.index(kind)].search(before))
    if kind == "email":
        return bool(_SPELLED.fullmatch(s))
    parts = re.findall(r"[0-9]+", s)
    if kind == "ip":
        return announced and len(parts) == 4 and s.count(".") == 3 and all(map(_octet, parts))
    if kind == "card":
        return 13 <= sum(map(len, parts)) <= 19 and luhn("".join(parts)) and (announced or len(parts) >= 3)
    return sum(map(len, parts)) <= 15 and (announced or bool(_AREA.fullmatch(s)))


# -------------------------------------------------------------- boosted trees
@dataclass
class Trees:
    """Additive regression trees on the log odds; node 2i+1 and 2i+2 follow node i."""

    start: float
    feature: np.ndarray     # (trees, nodes), -1 at a leaf
    cut: np.ndarray
    value: np.ndarray
    depth: int
    threshold: dict[str, float]

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                inner = f[node] >= 0
                right = x[rows, np.maximum(f[node], 0)] > c[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += v[node]
        return 1 / (1 + np.exp(-total))


def _grow(start: float, cuts: list[np.ndarray], sums, trees: int, depth: int, rate: float) -> Trees:
    """Newton boosting of the logistic loss. ``sums(grown, level)`` gives the gradients and the
    hessians by node of the last tree's ``level``, feature and bin."""
    nodes = 2 ** (depth + 1) - 1
    model = Trees(start, np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes)), depth, {})
    at = np.zeros((trees, nodes), np.int64)  # the bin of each cut
    for t in range(trees):
        for level in range(depth):
            first = 2**level - 1
            open_ = [i for i in range(first, 2 * first + 1) if not level or model.feature[t, (i - 1) // 2] >= 0]
            if not open_:
                break
            grad, hess = sums((start, model.feature[:t + 1], at[:t + 1], model.value[:t + 1]), level)
            for i in open_:
                gs, hs = grad[i - first], hess[i - first]
                g, h = gs[0].sum(), hs[0].sum() + 1.0
                model.value[t, i] = rate * g / h
                best = (1e-3, -1, 0)
                for f, cut in enumerate(cuts):
                    if len(cut):
                        gl = np.cumsum(gs[f])[:len(cut)]
                        hl = np.cumsum(hs[f])[:len(cut)] + 1.0
                        gain = gl**2 / hl + (g - gl) ** 2 / (h - hl + 2.0) - g * g / h
                        j = int(np.argmax(gain))
                        if gain[j] > best[0]:
                            best = (gain[j], f, j)
                _, f, j = best
                if f >= 0:
                    model.feature[t, i], model.cut[t, i], at[t, i] = f, cuts[f][j], j
                    for child, own in ((2 * i + 1, slice(0, j + 1)), (2 * i + 2, slice(j + 1, None))):
                        model.value[t, child] = rate * gs[f, own].sum() / (hs[f, own].sum() + 1.0)
    return model


def _node(binned: np.ndarray, feature: np.ndarray, at: np.ndarray, steps: int) -> np.ndarray:
    """The node of a tree that each row is in after ``steps`` steps."""
    node, rows = np.zeros(len(binned), np.int64), np.arange(len(binned))
    for _ in range(steps):
        right = binned[rows, np.maximum(feature[node], 0)] > at[node]
        node = np.where(feature[node] >= 0, 2 * node + 1 + right, node)
    return node


def _sums(binned: np.ndarray, y: np.ndarray, grown, level: int, depth: int, bins: int) -> np.ndarray:
    """Gradients and hessians in units of 1 / ``UNIT``, whole numbers, so that their sum depends on no order:
    (2, nodes of the level, features, bins)."""
    start, feature, at, value = grown
    total = np.full(len(binned), start)
    for f, a, v in zip(feature[:-1], at[:-1], value[:-1]):
        total += v[_node(binned, f, a, depth)]
    p = 1 / (1 + np.exp(-total))
    node = _node(binned, feature[-1], at[-1], level) - (2**level - 1)
    live = np.flatnonzero(node >= 0)
    shape = (2**level, binned.shape[1], bins)
    out = np.zeros((2, *shape), np.int64)
    for i in range(0, len(live), 1 << 20):  # whole numbers in doubles up to 2**53
        rows = live[i:i + (1 << 20)]
        for k, v in enumerate((np.rint((y - p)[rows] * UNIT), np.rint((p * (1 - p))[rows] * UNIT))):
            for f in range(shape[1]):
                out[k, :, f] += np.bincount(node[rows] * bins + binned[rows, f], v, shape[0] * bins).astype(np.int64).reshape(shape[0], bins)
    return out


def _start(share: float) -> float:
    share = min(max(share, 1e-3), 1 - 1e-3)
    return float(np.log(share / (1 - share)))


def _binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T)], axis=1).astype(np.uint8)


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> Trees:
    """Boosted trees over binned features of rows at hand."""
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    binned = _binned(x, cuts)
    return _grow(_start(y.mean()), cuts, lambda grown, level: _sums(binned, y, grown, level, depth, bins) / UNIT, trees, depth, rate)


def _candidates(docs: DataFrame) -> DataFrame:
    """Each proposal of each text: its kind, features, weak label, whether it is held out and whether
    it overlaps no base span."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kinds, rows, labels, keys, judged = [], [], [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text:
                base = set(base_spans(text))
                for span in dict.fromkeys(proposals(text)):
                    kinds.append(span[0])
                    rows.append(features(text, span))
                    labels.append(weak_label(text, span, base))
                    keys.append(f"{doc}:{span}")
                    judged.append(not any(a < span[2] and span[1] < b for _, a, b in base))
        return C.batch_of({"kind": pa.array(kinds, pa.string()), "x": pa.array(rows, pa.list_(pa.float64())),
                           "y": pa.array(labels, pa.bool_()), "key": pa.array(keys, pa.string()),
                           "judged": pa.array(judged, pa.bool_())})

    found = C.map_batches(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), run,
                          "kind string, x array<double>, y boolean, key string, judged boolean")
    return found.select("kind", "x", "y", "judged", (F.pmod(F.xxhash64("key"), F.lit(5)) == 4).alias("held"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), FEATURES)


def _fit_rows(rows: DataFrame, share: float) -> Trees:
    """``fit_trees`` on rows (``x``, ``y``) of any number: the cuts are their exact quantiles, and a level of a
    tree is one pass that brings a row a node, feature and bin to the driver."""
    at = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    found = rows.agg(*[F.percentile(F.col("x")[f], at).alias(f"f{f}") for f in range(FEATURES)]).first()
    cuts = [np.unique(np.array(q, np.float64)) for q in found]

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        binned = _binned(_matrix(batch.column(0)), cuts)
        return C.batch_of({"b": pa.array([binned.tobytes()], pa.binary()),
                           "y": pa.array([batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()], pa.binary())})

    blocks = C.stage(C.map_batches(rows.select("x", "y"), pack, "b binary, y binary"), "pii-binned")

    def sums(grown, level: int) -> np.ndarray:
        size = 2**level * FEATURES * BINS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, 2**level, FEATURES, BINS), np.int64)
            for batch in batches:
                binned = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, FEATURES)
                total += _sums(binned, np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8), grown, level, DEPTH, BINS)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), *map(pa.array, total.reshape(2, size))], names=["at", "g", "h"])

        cells = (blocks.mapInArrow(run, "at long, g long, h long").where("g != 0 OR h != 0")
                 .groupBy("at").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas())  # a row a node, feature and bin
        out = np.zeros((2, size))
        out[:, cells["at"].to_numpy(dtype=np.int64)] = cells["g"], cells["h"]
        return out.reshape(2, 2**level, FEATURES, BINS) / UNIT

    model = _grow(_start(share), cuts, sums, TREES, DEPTH, RATE)
    C.unstage(blocks)
    return model


def _calibrate(model: Trees, rows: DataFrame) -> dict[str, float]:
    """For each kind the lowest score from which its ``rows`` (``kind``, ``x``, ``y``) are right often enough. All rows
    count; they come as counts by their score's place on a fine grid of log odds, with the scores' ends."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = model.probability(_matrix(batch.column(1)))
        odds = np.log(p / np.maximum(1 - p, 1e-12))
        return C.batch_of({"kind": batch.column(0), "at": pa.array(np.clip(odds * GRID, -1, 20 * GRID).astype(np.int64)),
                           "p": pa.array(p), "y": batch.column(2)})

    held = C.map_batches(rows.select("kind", "x", "y"), run, "kind string, at long, p double, y boolean").where("p >= 0.5")
    found = held.groupBy("kind", "at").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("y").alias("right"), F.min("p").alias("low"), F.max("p").alias("high")).toPandas()  # at most 20 * GRID rows a kind
    threshold = dict.fromkeys(KINDS, 2.0)
    for kind in KINDS:
        own = found[found["kind"] == kind].sort_values("at", ascending=False)
        good = np.flatnonzero((own["right"].cumsum() / own["n"].cumsum()).to_numpy() >= PRECISION)
        if len(good):  # half-way to the next lower score, the first that is not
            lower = np.append(own["high"].to_numpy(), 0.5)[good[-1] + 1]
            threshold[kind] = float((own["low"].to_numpy()[good[-1]] + lower) / 2)
    return threshold


def fit(docs: DataFrame) -> Trees | None:
    """Trees from all proposals of all documents; every fifth (by hash) is held out and calibrates the thresholds."""
    rows = C.stage(_candidates(docs), "pii-proposals")
    n, n_yes, n_fitted, n_fitted_yes = rows.agg(
        F.count(F.lit(1)), F.count_if("y"), F.count_if(~F.col("held")), F.count_if(F.col("y") & ~F.col("held"))).first()
    model = None
    if n >= 20 and 0 < n_yes < n and n_fitted:
        model = _fit_rows(rows.where("NOT held"), n_fitted_yes / n_fitted)
        model.threshold.update(_calibrate(model, rows.where("held AND judged")))
    C.unstage(rows)
    return model


# ------------------------------------------------------------------ detection
def detect(text: str, model: Trees | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by start and then by kind."""
    base = base_spans(text)
    offered = [s for s in dict.fromkeys(proposals(text)) if s not in set(base)] if model else []
    if not offered:
        return base, base
    score = model.probability(np.array([features(text, s) for s in offered]))
    chosen = sorted(((-p, s) for p, s in zip(score, offered) if p >= model.threshold[s[0]]), key=lambda z: (z[0], _place(z[1])))
    taken = bytearray(len(text))
    for _, start, end in base:
        taken[start:end] = b"\1" * (end - start)
    added: list[Span] = []
    for _, span in chosen:
        if not any(taken[span[1]:span[2]]):
            added.append(span)
            taken[span[1]:span[2]] = b"\1" * (span[2] - span[1])
    return base, sorted(base + added, key=_place)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each run of overlapping spans replaced by the name of its first kind."""
    out, at = [], 0
    i = 0
    while i < len(spans):
        kind, start, end = spans[i]
        while i + 1 < len(spans) and spans[i + 1][1] < end:
            i += 1
            end = max(end, spans[i][2])
        out += [text[at:start], f"[{kind.upper()}]"]
        at, i = end, i + 1
    return "".join(out) + text[at:]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, model: Trees | None, texts: bool = True) -> DataFrame:
    """``doc_id``, base counts, ``base`` and ``spans`` (``kind:start:end`` joined by commas) and, with
    ``texts``, the redacted text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, spans, redacted = [], [], []
        for text in batch.column(1).to_pylist():
            b, s = detect(text or "", shared.value)
            base.append(b)
            spans.append(s)
            redacted.append((redact(text, s) if s else text) if texts else None)
        count = lambda kind: pa.array([sum(k == kind for k, _, _ in b) for b in base], pa.int64())
        return C.batch_of({
            "doc_id": batch.column(0), **{f"n_{k}": count(k) for k in KINDS[:4]},
            "base": pa.array(list(map(joined, base)), pa.string()), "spans": pa.array(list(map(joined, spans)), pa.string()),
            "redacted": pa.array(redacted, pa.string())})

    return C.map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run,
                         "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, redacted string")


def redact_documents(docs: DataFrame, model: Trees | None) -> DataFrame:
    """``docs`` with all its columns, personal data in ``text`` replaced; ``n_chars`` follows the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, schema = docs.columns.index("text"), docs.schema
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, changed = batch.column(at).to_pylist(), []
        for i, text in enumerate(texts):
            spans = detect(text, shared.value)[1] if text else []
            if spans:
                texts[i] = redact(text, spans)
                changed.append(i)
        if not changed:
            return batch
        columns = batch.columns
        columns[at] = pa.array(texts, columns[at].type)
        if chars is not None:
            n = columns[chars].to_pylist()
            for i in changed:
                n[i] = len(texts[i])
            columns[chars] = pa.array(n, columns[chars].type)
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return C.map_batches(docs, run, schema)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    return find(docs, fit(docs), texts=False).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.encode("base", "UTF-8"), 256).alias("base_sha256"), "spans")


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
