"""Language identification by compression (operator 12).

Each language has a zstandard raw-content dictionary: passages from the middle of up to
``PASSAGES`` distinct learned texts. A text is cut into pieces of ``PIECE`` bytes, all of
them, each compressed with every language's dictionary; the language with the smallest
total wins. Texts and dictionaries are in lower case, with ASCII other than letters as
blanks. Equal sizes go to the language with more learned rows, then to the smaller name.

The margin (bytes by which the second smallest is larger) becomes a probability of being
right by a logistic curve fitted on further learned texts that no dictionary holds. A
prediction whose probability is below ``ACCEPT`` is rejected: ``classify`` then answers
``und``, and the query's ``accepted`` is false.

Bounds of the fit: ``PASSAGES`` passages of at most ``PASSAGE`` characters and ``CHECKED``
further texts for each of the ``LANGUAGES`` most frequent values of ``lang``. They are
chosen by the smallest hashes among distinct texts, so a group of copies counts once.
Prediction looks at nothing but the text.

Edge cases: a null text, an empty one and one without a letter are ``und`` with score 0;
so is every text where nothing can be learned. Null ``lang``, null text or null doc_id
are not learned from; a null doc_id is not held out. Repeated rows are predicted each.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memberrisk.llm import common as C

UNKNOWN = "und"
PASSAGES, PASSAGE = 96, 1024
CHECKED = 64
LANGUAGES = 512
LEVEL = 9
PIECE = 4096
ACCEPT = 0.9
_LETTER = regex.compile(r"\p{L}")
_BLANKS = bytes(i if i >= 128 or chr(i).isalpha() else 32 for i in range(256))


class Model(NamedTuple):
    """Languages in the order that breaks ties, their dictionaries, and the curve from log(1 + margin)."""

    languages: tuple[str, ...]
    dictionaries: tuple[bytes, ...]
    offset: float = 0.0
    slope: float = 0.0

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.offset + self.slope * np.log1p(margin), -30, 30)))


def plain(text: str) -> bytes:
    """Lower case, ASCII other than letters as single blanks, a blank at both ends."""
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_BLANKS).split()) + b" "


def compressors(model: Model) -> list[zstandard.ZstdCompressor]:
    made = []
    for raw in model.dictionaries:
        held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        settings = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, dict_size=len(raw), source_size=PIECE, write_content_size=False, write_checksum=False, write_dict_id=False)
        held.precompute_compress(compression_params=settings)
        made.append(zstandard.ZstdCompressor(dict_data=held, compression_params=settings))
    return made


def sizes(text: str, by: list[zstandard.ZstdCompressor]) -> list[int]:
    """Compressed bytes of the whole text with each dictionary."""
    data = plain(text)
    cut = [data[i:i + PIECE] for i in range(0, len(data), PIECE)]
    return [sum(len(c.compress(p)) for p in cut) for c in by]


def choose(found: list[int]) -> tuple[int, int]:
    """(the smallest's place, how many bytes the next one is larger); alone, its own size."""
    best = min(range(len(found)), key=found.__getitem__)  # the first of equal ones
    rest = min((s for i, s in enumerate(found) if i != best), default=2 * found[best])
    return best, rest - found[best]


def _predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` with ``best`` (place of the language, null if there is none to tell) and ``margin``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the languages and passages
    made: list = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(compressors(shared.value))
        best, margin = [], []
        for text in batch.column(len(keep)):
            text = text.as_py()
            known = made[0] and text and _LETTER.search(text)
            i, m = choose(sizes(text, made[0])) if known else (None, None)
            best.append(i)
            margin.append(m)
        return C.batch_of({**{n: batch.column(i) for i, n in enumerate(keep)},
                           "best": pa.array(best, pa.int32()), "margin": pa.array(margin, pa.int64())})

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return C.map_batches(docs.select(*keep, "text"), run, f"{shape}, best int, margin long")


def _curve(margin: np.ndarray, right: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression of ``right`` on log(1 + margin), slightly shrunk; rises with the margin."""
    x = np.column_stack([np.ones(len(margin)), np.log1p(margin)])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (right - p)) - 1e-2 * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(max(0.0, w[1]))


def fit(docs: DataFrame) -> Model:
    """Model of the rows of ``docs(text, lang)``."""
    spark = docs.sparkSession
    learned = docs.select("text", F.col("lang").cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    rows = {r["lang"]: r["n"] for r in learned.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not rows:
        return Model((), ())
    # Distinct texts of a language by their hashes, the smallest first; texts themselves stay where they are.
    hashed = learned.where("text RLIKE '\\\\p{L}'").select("lang", F.xxhash64("text").alias("h"))
    order = Window.partitionBy("lang").orderBy("h")
    rank = (hashed.join(F.broadcast(spark.createDataFrame([(c,) for c in rows], "lang string")), "lang").distinct()
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PASSAGES + CHECKED))
    chosen = C.stage(rank, "language-chosen")  # at most LANGUAGES * (PASSAGES + CHECKED) rows
    texts = learned.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["lang", "h"])
    middle = F.greatest(F.lit(1), F.floor((F.length("text") - PASSAGE) / 2).cast("int") + 1)
    passages = (texts.where(F.col("rank") <= PASSAGES).select("lang", "rank", F.substring("text", middle, F.lit(PASSAGE)).alias("text"))
                .groupBy("lang", "rank").agg(F.min("text").alias("text")).toPandas())
    held = {lang: b"".join(plain(t) for t in part.sort_values("rank")["text"]) for lang, part in passages.groupby("lang")}
    languages = tuple(c for c in rows if c in held)
    model = Model(languages, tuple(held[c] for c in languages))
    checked = texts.where(F.col("rank") > PASSAGES).groupBy("lang", "rank").agg(F.min("text").alias("text"))
    seen = _predict(checked, model, ["lang"]).where("best IS NOT NULL").toPandas()
    if not len(seen):  # no texts beside the dictionaries': margins say nothing
        return model
    right = np.array([languages[b] == lang for b, lang in zip(seen["best"], seen["lang"])], float)
    weight = seen["lang"].map(rows).to_numpy(float) / seen["lang"].map(seen["lang"].value_counts()).to_numpy(float)  # as languages occur
    offset, slope = _curve(seen["margin"].to_numpy(float), right, weight / weight.mean())
    return model._replace(offset=offset, slope=slope)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, accepted`` of every row of ``docs(doc_id, text)``."""
    found = _predict(docs, model, ["doc_id"])
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.least(F.greatest(F.lit(model.offset) + F.lit(model.slope) * F.log1p("margin"), F.lit(-30.0)), F.lit(30.0))))
    names = F.array(*[F.lit(c) for c in model.languages]) if model.languages else F.array(F.lit(UNKNOWN))
    return found.select(
        "doc_id", F.when(F.col("best").isNull(), UNKNOWN).otherwise(F.element_at(names, F.col("best") + 1)).alias("lang_pred"),
        F.when(F.col("best").isNull(), 0.0).otherwise(score).alias("score")).withColumn(
        "accepted", (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= ACCEPT))


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score``: ``und`` also where the margin is narrow."""
    found = identify(docs, model)
    return found.select("doc_id", F.when(F.col("accepted"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"), "score")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    model = fit(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")
