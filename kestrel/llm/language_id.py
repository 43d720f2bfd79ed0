"""Language ID: blended-spectrum string kernel, Nyström landmarks, kernel ridge regression.

A text is the set of its 1- to 3-grams over 64 character classes (its whole lower-cased
text); k(x, y) = |x & y| / sqrt(|x| |y|). ``fit`` takes ``LANDMARKS`` labelled rows, the
languages in turn, as Nyström landmarks and solves one-versus-rest ridge regression on the
kernel columns of every labelled row; the sums of its normal equations are built where the
rows are. Languages are balanced by weights: one weighs as many rows as it has, at most
``BALANCED`` / their number. The sums are of whole multiples of ``UNIT``, so the model does
not depend on how the rows are dealt. The kernel is linear in the presence vectors, so the
landmark columns and the weights fold into one (grams x languages) matrix; a block of texts
is scored by a product of its presence matrix with it.

The score of an answer is its share of all languages' scores, at least 1 / their number
whatever the text. ``known_language`` therefore asks for the gain: how far the text moves the
answer's raw score from the language's frequency (the guess without reading) towards 1. The
least gain is learned from all held-out labelled rows: ``SLACK`` of what ``KEEP`` of them
reach, ``LEAST`` in any case. With one language learned every text with a letter is of it.

Defined results: null texts and texts without a letter get ``und`` with score 0; rows
without a label or doc_id are never learned from; equal scores go to the first language in
order; with nothing to learn from everything is ``und``; repeated rows and clashing or
extra columns are left as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrel.llm.common import documents, hash_share, store

BALANCED, LANDMARKS, RIDGE = 1600, 256, 1e-3
UNIT = 2.0 ** -42   # BALANCED / UNIT < 2 ** 53: sums of weighted products are exact as doubles
CLASS_BITS = 6
OFFSETS = (0, 1 << CLASS_BITS, (1 << CLASS_BITS) + (1 << 2 * CLASS_BITS))
UNIVERSE = OFFSETS[2] + (1 << 3 * CLASS_BITS)
ROWS_PER_PRODUCT = 32
UND = "und"
MIN_SCORE = 0.25
KEEP, SLACK, LEAST = 0.995, 0.5, 0.05


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Character class by code point: 0 for non-letters, 1-26 for a-z, 27-63 for other letters."""
    out = np.zeros(0x110000, np.uint32)
    out[[c for c in range(0x110000) if chr(c).isalpha()]] = 1
    other = np.flatnonzero(out)
    out[other] = 27 + other % 37
    out[ord("a"):ord("z") + 1] = np.arange(1, 27)
    return out


def grams(text: str) -> np.ndarray | None:
    """Distinct n-gram codes of a text, ascending; None if it has no letter."""
    cls = _classes()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
    if not cls.any():
        return None
    c = np.concatenate([[0], cls, [0]]).astype(np.uint32)
    seen = np.zeros(UNIVERSE, bool)
    seen[c] = True
    seen[OFFSETS[1] + (c[:-1] << CLASS_BITS | c[1:])] = True
    seen[OFFSETS[2] + (c[:-2] << 2 * CLASS_BITS | c[1:-1] << CLASS_BITS | c[2:])] = True
    return np.flatnonzero(seen).astype(np.int32)


@dataclass
class Model:
    languages: list[str]
    vocabulary: np.ndarray   # gram codes of the landmarks, ascending
    weights: np.ndarray      # (len(vocabulary), len(languages))
    bias: np.ndarray

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        where = np.full(UNIVERSE, -1, np.int32)
        where[self.vocabulary] = np.arange(len(self.vocabulary))
        out = np.empty((len(texts), len(self.languages)))
        for i in range(0, len(texts), ROWS_PER_PRODUCT):
            block = texts[i:i + ROWS_PER_PRODUCT]
            out[i:i + len(block)] = _presence(block, where, len(self.vocabulary)) @ self.weights + self.bias
        return out


def _presence(texts: list[np.ndarray], where: np.ndarray, width: int) -> np.ndarray:
    """Rows of the normalised presence matrix, restricted to the landmark grams."""
    x = np.zeros((len(texts), width), np.float32)
    for r, codes in enumerate(texts):
        at = where[codes]
        x[r, at[at >= 0]] = 1 / np.sqrt(len(codes))
    return x


class Landmarks:
    """Kernel columns of texts against the landmark texts."""

    def __init__(self, marks: list[np.ndarray]):
        self.vocabulary = np.unique(np.concatenate(marks))
        self.where = np.full(UNIVERSE, -1, np.int32)
        self.where[self.vocabulary] = np.arange(len(self.vocabulary))
        self.present = np.zeros((len(self.vocabulary), len(marks)), np.float32)
        for m, codes in enumerate(marks):
            self.present[self.where[codes], m] = 1
        self.root = np.sqrt([len(codes) for codes in marks])

    def columns(self, codes: np.ndarray) -> np.ndarray:
        """k(text, landmark) for every landmark."""
        at = self.where[codes]
        return self.present[at[at >= 0]].sum(axis=0).astype(np.float64) / (self.root * np.sqrt(len(codes)))

    def solve(self, weight: dict[str, float], squares: np.ndarray, sums: dict[str, np.ndarray],
              ridge: float = RIDGE) -> Model:
        """One target column per language, from the weights and the weighted sums of all rows' columns.

        ``squares`` sums the columns' products, ``sums`` the columns of a language's rows.
        """
        languages, total = sorted(weight), sum(weight.values())
        bias = np.array([weight[x] / total for x in languages])
        phi = self.present / self.root
        k_mm = phi.T @ phi
        by_language = np.stack([sums[x] for x in languages], axis=1)
        lhs = squares + ridge * total * k_mm + 1e-9 * total * np.eye(len(self.root))
        alpha = np.linalg.solve(lhs, by_language - by_language.sum(axis=1, keepdims=True) * bias)
        return Model(languages, self.vocabulary, (phi @ alpha).astype(np.float32), bias)


def weighted_sums(columns: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Products and sums of kernel columns (one row a text) in multiples of ``UNIT``."""
    scaled = np.rint(columns * np.sqrt(weights)[:, None] / np.sqrt(UNIT))
    return scaled.T @ scaled, np.rint(columns * weights[:, None] / UNIT).sum(axis=0)


def solve(texts: list[np.ndarray], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Nyström kernel ridge regression of a few texts of weight 1."""
    by_turn = sorted(range(len(texts)), key=lambda i: (labels[:i].count(labels[i]), labels[i]))[:landmarks]
    marks = Landmarks([texts[i] for i in by_turn])
    found = {x: weighted_sums(np.stack([marks.columns(c) for c, y in zip(texts, labels) if y == x]),
                              np.ones(labels.count(x))) for x in set(labels)}
    return marks.solve({x: float(labels.count(x)) for x in found}, sum(s for s, _ in found.values()) * UNIT,
                       {x: s * UNIT for x, (_, s) in found.items()}, ridge)


def fold(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def _landmarks(train: DataFrame, sizes: DataFrame, landmarks: int) -> list[np.ndarray]:
    """Grams of the landmark texts: the languages in turn, each by a hash of doc_id."""
    # A hash threshold leaves about 2 ``most`` + 20 rows of every language, however many it has.
    most, share = max(1, BALANCED // sizes.count()), hash_share(F.col("doc_id"))
    first = Window.partitionBy("lang").orderBy("share", "doc_id", "tie")
    turn = Window.partitionBy("lang").orderBy("doc_id", "tie")
    chosen = (train.select("doc_id", "lang", "text", share.alias("share"), F.xxhash64("text").alias("tie")).join(sizes, "lang")
              .filter(F.col("share") * F.col("rows") < 2 * most + 20)
              .withColumn("first", F.row_number().over(first)).filter(F.col("first") <= most)
              .withColumn("turn", F.row_number().over(turn)).filter(F.col("turn") <= landmarks)
              .orderBy("turn", "lang").limit(landmarks))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [grams(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("turn"), b.column("lang"),
                 pa.array([None if c is None else c.tobytes() for c in codes], pa.binary())],
                ["turn", "lang", "codes"])

    rows = (chosen.select("turn", "lang", "text").mapInArrow(extract, "turn int, lang string, codes binary")
            .filter("codes IS NOT NULL").collect())     # at most ``landmarks`` texts' grams
    return [np.frombuffer(r.codes, np.int32) for r in sorted(rows, key=lambda r: (r.turn, r.lang))]


def fit(docs: DataFrame, landmarks: int = LANDMARKS) -> Model | None:
    """Learn from text and lang of all documents outside fold 1; None without labelled texts."""
    train = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (fold(F.col("doc_id")) != 1))
    sizes = store(train.groupBy("lang").agg(F.count("*").alias("rows")), "languages")
    languages = sizes.count()
    if not languages:
        return None
    sizes = F.broadcast(sizes) if languages <= 10_000 else sizes
    chosen = _landmarks(train, sizes, landmarks)
    if not chosen:
        return None
    held = docs.sparkSession.sparkContext.broadcast(Landmarks(chosen))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = held.value
        squares, sums, weight = np.zeros((len(marks.root),) * 2), {}, {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                codes = [grams(t) for t in b.column("text").to_pylist()]
                rows = [i for i, c in enumerate(codes) if c is not None]
                if not rows:
                    continue
                columns = np.stack([marks.columns(codes[i]) for i in rows])
                langs = np.array(b.column("lang").to_pylist(), object)[rows]
                w = b.column("weight").to_numpy()[rows]
                for lang in set(langs):
                    mine = langs == lang
                    product, total = weighted_sums(columns[mine], w[mine])
                    squares += product
                    sums[lang] = sums.get(lang, 0.0) + total
                    weight[lang] = weight.get(lang, 0.0) + np.rint(w[mine] / UNIT).sum()
        keys = [(lang, -1) for lang in sums] + [(None, i) for i in range(len(squares))]
        values = [np.append(sums[lang], weight[lang]) for lang in sums] + list(squares)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
                 pa.array([v.tobytes() for v in values], pa.binary())], ["lang", "line", "total"])

    def merge(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v) for v in t.column("total").to_pylist())
        return pa.table([t.column("lang")[:1], t.column("line")[:1], pa.array([total.tobytes()], pa.binary())],
                        names=["lang", "line", "total"])

    # A language weighs its rows, or as many as all would have in a balanced set.
    weight = F.least(F.lit(float(max(1, BALANCED // languages))), F.col("rows")) / F.col("rows")
    form = "lang string, line int, total binary"
    total = (train.join(sizes, "lang").select("lang", "text", weight.alias("weight")).mapInArrow(add, form)
             .groupBy("lang", "line").applyInArrow(merge, form).collect())     # landmarks + languages rows
    by = {(r.lang, r.line): np.frombuffer(r.total) * UNIT for r in total}
    found = [lang for lang, line in by if line < 0]
    return held.value.solve({x: by[x, -1][-1] for x in found}, np.stack([by[None, i] for i in range(len(chosen))]),
                            {x: by[x, -1][:-1] for x in found})


def predict(spark: SparkSession, model: Model | None):
    """Column function: text -> struct(lang_pred, score, gain)."""
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, gain double")
    def run(text: pa.Array) -> pa.Array:
        m = held.value
        lang, score, gain = [UND] * len(text), np.zeros(len(text)), np.zeros(len(text))
        if m is not None:
            for at in range(0, len(text), 256):
                codes = [None if t is None else grams(t) for t in text[at:at + 256].to_pylist()]
                rows = [i for i, c in enumerate(codes) if c is not None]
                if not rows:
                    continue
                raw = m.scores([codes[i] for i in rows])
                s = np.clip(raw, 0, 1)
                best, total = s.argmax(axis=1), s.sum(axis=1)
                for r, i in enumerate(rows):
                    lang[at + i] = m.languages[best[r]]
                    score[at + i] = s[r, best[r]] / total[r] if total[r] > 0 else 0.0
                    guess = m.bias[best[r]]
                    gain[at + i] = (raw[r, best[r]] - guess) / (1 - guess) if len(m.languages) > 1 else 1.0
        return pa.StructArray.from_arrays(
            [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(gain, pa.float64())],
            ["lang_pred", "score", "gain"])
    return run


def identify(docs: DataFrame) -> DataFrame:
    """``docs`` plus a struct column ``language`` (lang_pred, score, gain)."""
    return docs.withColumn("language", predict(docs.sparkSession, fit(docs))(F.col("text")))


def least_gain(docs: DataFrame, model: Model | None) -> float:
    """The least gain of a clear language, from all labelled rows of fold 1."""
    held = docs.filter(F.col("lang").isNotNull() & (fold(F.col("doc_id")) == 1))
    found = held.select("lang", predict(docs.sparkSession, model)(F.col("text")).alias("f"))
    low = found.filter("f.lang_pred = lang").agg(F.percentile_approx("f.gain", 1 - KEEP, 10_000)).first()[0]
    return max(LEAST, SLACK * (low or 0.0))


def known_language(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language is clear, with a score of at least ``min_score``."""
    model = fit(docs)
    found = predict(docs.sparkSession, model)(F.col("text"))
    return docs.filter((found["lang_pred"] != UND) & (found["score"] >= min_score)
                       & (found["gain"] >= least_gain(docs, model)))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = identify(documents(spark, sf_dir).select("doc_id", "lang", "text"))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"),
                      "language.lang_pred", "language.score")
