"""Mixing to target weights with soft domain membership.

A classifier learned from the ``labels`` table gives every document a posterior over the
domains ``good``, ``plain`` and ``toxic``. Nonnegative document rates are then fitted by
projected-gradient least squares so that the expected domain token totals
sum_i rate_i * tokens_i * posterior_id come as close as possible to the targets.

A document's gradient depends on its posterior and one residual per domain only, so an
iteration is one distributed sum of ``len(DOMAINS)`` numbers, and a rate is a fold over the
short list of steps: it is recomputed from the posterior wherever it is needed and no
per-document state is kept or collected. Steps are taken in the token-weighted norm with
step length 1 / L, L the largest eigenvalue of the (domains x domains) moment matrix. Where
these are too slow, implicit steps follow: the residual is the one after the step, found by
Newton's method on its three numbers, so that a step may be as long as it likes. The fit ends
when every domain is within ``TOLERANCE`` of its own target, or warns that this cannot be met
(``Fit.met``): then the totals are the least-squares ones.

The classifier is fitted on a bounded sample (``SAMPLE`` labelled documents by a hash of
doc_id): multinomial logistic regression over ``WORDS`` selected words (presence) and a few
shape ratios of the whole text.

Defined results: null and empty texts have no tokens, the prior-like posterior of an empty
text and a rate that moves no total; rows without a doc_id are mixed but not learned from;
label rows with a null, and all but the largest of repeated label rows, are ignored; without
labels every document is ``good``; repeated rows are mixed each; an empty table gives an
empty result; extra columns are kept by ``select_mixed``.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.common import documents, hash_sample, hash_share, lower_ascii, store

DOMAINS = ("good", "plain", "toxic")
# Target shares of the mixed tokens; the budget keeps ``HEADROOM`` times the good tokens there are.
TARGET = {"good": 0.93, "plain": 0.065, "toxic": 0.005}
ANCHOR, HEADROOM = "good", 1.03
DRAWN = 0.99     # the same for documents drawn at most once: nearly all good tokens stay
SAMPLE, WORDS, LEAST_DOCS, MOST_SHARE = 8000, 1024, 4, 0.1
ROUNDS, TOLERANCE = 60, 0.01   # plain steps at most; largest error of a domain relative to its own target
LONGEST, NEWTON = (1e4, 1e6, 1e8, 1e10), 60   # lengths of the implicit steps; Newton rounds for one at most
SHAPE = 6
_EDGE = re.compile(r"^\W+|\W+$")


def _domain(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, 2).when(quality == 1, 0).otherwise(1)


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id and domain of every label row that can be learned from."""
    return (labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
            .groupBy("doc_id").agg(F.max(_domain(F.col("quality"), F.col("toxic"))).alias("domain")))


def _words(text: Column) -> Column:
    """Distinct lower-cased words without punctuation at their ends."""
    return F.array_distinct(F.transform(F.split(lower_ascii(text), r"[\x20\x09-\x0D]+"),
                                        lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))


@dataclass
class Classifier:
    words: dict[str, int]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray   # (1 + SHAPE + words, domains)

    def shape(self, text: str, words: list[str]) -> list[float]:
        """Ratios over the whole text: signs, digits, capitals, words with signs inside or behind, word length."""
        n = max(1, len(text))
        letters = sum(map(len, re.findall(r"[^\W\d_]+", text)))
        digits = sum(map(len, re.findall(r"\d+", text)))
        blanks = len(text) - sum(map(len, words))
        capitals = sum(map(len, re.findall(r"[A-Z]+", text)))
        ending = sum(not w[-1].isalnum() for w in words) / max(1, len(words))
        return [(n - letters - digits - blanks) / n, digits / n, capitals / n, ending,
                len(words) / n, float(np.log1p(len(words)))]

    def row(self, text: str) -> tuple[int, np.ndarray, list[int]]:
        """Tokens, standardised shape and the selected words present."""
        words = text.split()
        low = set(text.lower().split())
        known, table = set(), self.words
        for w in low:
            at = table.get(w)
            if at is None and not w.isalnum():
                at = table.get(_EDGE.sub("", w))
            if at is not None:
                known.add(at)
        return len(words), (np.array(self.shape(text, words)) - self.mean) / self.scale, sorted(known)

    def posterior(self, text: str) -> tuple[int, np.ndarray]:
        tokens, shape, known = self.row(text)
        z = self.weights[0] + shape @ self.weights[1:1 + SHAPE] + self.weights[1 + SHAPE:][known].sum(axis=0)
        e = np.exp(z - z.max())
        return tokens, e / e.sum()


def solve(shape: np.ndarray, known: list[list[int]], y: np.ndarray, n_words: int, ridge: float = 1e-4,
          rounds: int = 600) -> np.ndarray:
    """Multinomial logistic regression by accelerated gradient steps."""
    x = np.zeros((len(y), 1 + SHAPE + n_words), np.float32)
    x[:, 0], x[:, 1:1 + SHAPE] = 1, shape
    for i, k in enumerate(known):
        x[i, 1 + SHAPE + np.array(k, int)] = 1
    target = np.eye(len(DOMAINS), dtype=np.float32)[y]
    v = np.ones(x.shape[1], np.float32)
    for _ in range(20):   # largest eigenvalue of x'x / n
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v)
    step = 1 / (0.5 * np.linalg.norm(x.T @ (x @ v)) / len(y) + ridge)
    w = np.zeros((x.shape[1], len(DOMAINS)), np.float32)
    prev, look = w, w
    for t in range(rounds):
        z = x @ look
        e = np.exp(z - z.max(axis=1, keepdims=True))
        grad = x.T @ (e / e.sum(axis=1, keepdims=True) - target) / len(y) + ridge * look
        w, prev = look - step * grad, w
        look = w + t / (t + 3) * (w - prev)
    return w.astype(np.float64)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, n_words: int = WORDS) -> Classifier:
    spark = docs.sparkSession
    known = store(labelled(labels).join(docs.select("doc_id"), "doc_id", "left_semi"), "mix-labels")
    chosen = store(hash_sample(known, "doc_id", sample, known.count()), "mix-sample")   # at most ``sample`` rows
    texts = store(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
                  .join(F.broadcast(chosen), "doc_id"), "mix-texts")
    per_domain = {r["domain"]: r["count"] for r in texts.groupBy("domain").count().collect()}
    if len(per_domain) < 2:
        only = next(iter(per_domain), 0)
        weights = np.zeros((1 + SHAPE, len(DOMAINS)))
        weights[0, only] = 30.0
        return Classifier({}, np.zeros(SHAPE), np.ones(SHAPE), weights)
    # The words whose presence differs most between domains: largest chi-square of any domain.
    total = sum(per_domain.values())
    counts = texts.select("domain", F.explode(_words(F.col("text"))).alias("word")).groupBy("word").agg(
        F.count("*").alias("n"), *(F.count_if(F.col("domain") == d).alias(f"n{d}") for d in per_domain))
    chi = F.greatest(*(
        F.pow(F.col(f"n{d}") * total - F.col("n") * c, 2) / (F.col("n") * F.lit(float(c)) * (total - c) * (total - F.col("n") + 1))
        for d, c in per_domain.items()), F.lit(0.0))
    # Words in more than MOST_SHARE of the documents tell the language, not the domain.
    top = (counts.filter((F.col("n") >= LEAST_DOCS) & (F.col("n") <= MOST_SHARE * total) & (F.col("word") != ""))
           .orderBy(F.desc(chi), "word").limit(n_words).select("word"))
    words = {r["word"]: i for i, r in enumerate(top.collect())}
    blank = Classifier(words, np.zeros(SHAPE), np.ones(SHAPE), np.zeros((0, 0)))
    held = spark.sparkContext.broadcast(blank)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [held.value.row(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("domain"), pa.array([r[1].tolist() for r in rows], pa.list_(pa.float64())),
                 pa.array([r[2] for r in rows], pa.list_(pa.int32()))], ["doc_id", "domain", "shape", "known"])

    got = (texts.select("doc_id", F.col("domain").cast("int"), "text")
           .mapInArrow(extract, "doc_id long, domain int, shape array<double>, known array<int>").collect())
    got.sort(key=lambda r: r.doc_id)
    shape = np.array([r["shape"] for r in got])
    mean, scale = shape.mean(axis=0), shape.std(axis=0) + 1e-9
    weights = solve((shape - mean) / scale, [r.known for r in got], np.array([r.domain for r in got]), len(words))
    return Classifier(words, mean, scale, weights)


def posterior_of(spark: SparkSession, model: Classifier):
    """Column function: text -> struct(n_tokens, p)."""
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("n_tokens long, p array<double>")
    def run(text: pa.Array) -> pa.Array:
        rows = [held.value.posterior(t or "") for t in text.to_pylist()]
        p = np.array([r[1] for r in rows]).reshape(-1)
        offsets = np.arange(0, len(p) + 1, len(DOMAINS), dtype=np.int32)
        return pa.StructArray.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(p))],
            ["n_tokens", "p"])
    return run


def _moved(p: np.ndarray, steps: list[list[float]], upper: float) -> np.ndarray:
    """Rates from 1 by projected steps r <- clip(r - p . step, 0, upper), the last one not yet projected."""
    r = np.ones(len(p))
    for s in steps:
        r = np.clip(r, 0.0, upper) - p @ np.array(s)
    return r


def rates(p: np.ndarray, steps: list[list[float]], upper: float = np.inf) -> np.ndarray:
    """Rates of documents with posteriors ``p`` after the steps, between 0 and ``upper``."""
    return np.clip(_moved(p, steps, upper), 0.0, upper)


def _matrix(p: pa.Array) -> np.ndarray:
    return p.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(DOMAINS))


def rate_of(steps: list[list[float]], upper: float = np.inf):
    """Column function: posterior -> rate."""
    @F.arrow_udf("double")
    def run(p: pa.Array) -> pa.Array:
        return pa.array(rates(_matrix(p), steps, upper))
    return run


def _totals(posteriors: DataFrame, steps: list[list[float]], upper: float = np.inf) -> tuple[np.ndarray, float, np.ndarray]:
    """At the rates after ``steps``: expected domain tokens, the potential whose slope the rates are (half
    their squares, linear beyond ``upper``), moments of the rows strictly between the bounds."""
    k = len(DOMAINS)
    names = [f"x{i}" for i in range(k + 1 + k * k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, t = _matrix(b.column("p")), b.column("n_tokens").to_numpy(zero_copy_only=False).astype(float)
            z = _moved(p, steps, upper)
            r = np.clip(z, 0.0, upper)
            over = np.maximum(z - upper, 0.0)
            s = [*((r * t) @ p), r @ (r * t) / 2 + over @ (r * t), *((p * (t * ((z > 0) & (z < upper)))[:, None]).T @ p).ravel()]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in s], names)

    sums = posteriors.select("n_tokens", "p").mapInArrow(run, ", ".join(f"{n} double" for n in names))
    x = np.array([v or 0.0 for v in sums.agg(*(F.sum(n) for n in names)).first()])
    return x[:k], float(x[k]), x[k + 1:].reshape(k, k)


@dataclass
class Fit:
    steps: list[list[float]]
    natural: np.ndarray    # expected domain tokens at rate 1
    target: np.ndarray
    reached: np.ndarray

    @property
    def met(self) -> bool:
        """Every domain is within ``TOLERANCE`` of its own target."""
        return _met(self.reached, self.target)


def _met(reached: np.ndarray, goal: np.ndarray) -> bool:
    return bool((np.abs(reached - goal) <= TOLERANCE * goal).all())


def _implicit(posteriors: DataFrame, steps: list[list[float]], goal: np.ndarray, total: float, w: np.ndarray,
              length: float, upper: float) -> tuple[list[float], np.ndarray]:
    """The step s = length * w * residual after s, and what it reaches; shorter where that already meets the targets.

    s minimises a convex function of three numbers; its gradient and curvature are sums over
    the documents, one job each for a round.
    """
    s = np.zeros(len(w))

    def at(s: np.ndarray):
        reached, half, moment = _totals(posteriors, [*steps, s.tolist()], upper)
        return (half + goal @ s) / total + (s * s / w).sum() / (2 * length), reached, moment / total

    value, reached, moment = at(s)
    for _ in range(NEWTON):
        gradient = s / (length * w) - (reached - goal) / total
        if _met(reached, goal) or np.abs(np.sqrt(w) * gradient).max() < 1e-7:
            break
        way = -np.linalg.solve(moment + np.diag(1 / (length * w)), gradient)
        share = 1.0
        while (new := at(s + share * way))[0] > value + 1e-4 * share * (gradient @ way) and share > 1e-6:
            share /= 2
        s, (value, reached, moment) = s + share * way, new
    return s.tolist(), reached


def fit_rates(posteriors: DataFrame, target: dict[str, float] | None = None, rounds: int = ROUNDS,
              upper: float = np.inf, headroom: float = HEADROOM) -> Fit:
    """Projected-gradient least squares over (n_tokens, p); every round is one distributed sum (or a few).

    The projection keeps rates between 0 and ``upper``.
    """
    weight = np.array([(target or TARGET)[d] for d in DOMAINS])
    weight = weight / weight.sum()
    k = range(len(DOMAINS))
    t, p = F.col("n_tokens").cast("double"), F.col("p")
    row = posteriors.agg(*(F.sum(t * p[a] * p[b]).alias(f"m{a}{b}") for a in k for b in k),
                         *(F.sum(t * p[a]).alias(f"s{a}") for a in k)).first()
    natural = np.array([row[f"s{a}"] or 0.0 for a in k])
    total = natural.sum()
    if not total:
        return Fit([], natural, natural, natural)
    moment = np.array([[row[f"m{a}{b}"] for b in k] for a in k]) / total
    anchor = DOMAINS.index(ANCHOR)
    goal = weight * (headroom * natural[anchor] / weight[anchor])
    # Residuals are weighted by the inverse natural share, so that small domains count as much.
    w = total / np.maximum(natural, 1e-9 * total)
    root = np.sqrt(w)
    step = 1 / np.linalg.eigvalsh(root[:, None] * moment * root[None, :]).max()
    steps: list[list[float]] = []
    reached = natural
    for _ in range(rounds):
        if _met(reached, goal):
            break
        residual = (reached - goal) / total
        steps.append((step * w * residual).tolist())
        before, reached = reached, _totals(posteriors, steps, upper)[0]
        missed = np.maximum(np.abs(reached - goal) - TOLERANCE * goal, 0)
        if (missed > ROUNDS * np.abs(reached - before)).any():   # more than as many rounds away at this pace
            break
    error = lambda x: (w * ((x - goal) / total) ** 2).sum()
    for length in LONGEST:
        if _met(reached, goal):
            break
        found, after = _implicit(posteriors, steps, goal, total, w, length, upper)
        if not (_met(after, goal) or error(after) < error(reached)):
            break
        steps.append(found)
        before, reached = reached, after
        if error(reached) > 0.99 * error(before):   # as small as it gets
            break
    if not _met(reached, goal):
        warnings.warn("mixing: target tokens " + ", ".join(
            f"{d} {g:.0f} (reached {x:.0f})" for d, g, x in zip(DOMAINS, goal, reached))
            + ": no nonnegative rates were found that meet them", stacklevel=2)
    return Fit(steps, natural, goal, reached)


def uniform(doc_id: Column) -> Column:
    """A number in [0, 1) that a doc_id always gets, independent of the sample's order."""
    return hash_share(F.xxhash64(F.lit("mix"), doc_id))


def mix(docs: DataFrame, labels: DataFrame, target: dict[str, float] | None = None) -> tuple[DataFrame, Fit, Classifier]:
    """doc_id, n_tokens, p and rate of every row; the fit and the classifier behind them."""
    model = fit(docs, labels)
    found = docs.select("doc_id", posterior_of(docs.sparkSession, model)(F.col("text")).alias("f"))
    posteriors = store(found.select("doc_id", "f.n_tokens", "f.p"), "mix-posteriors")
    got = fit_rates(posteriors, target)
    return posteriors.withColumn("rate", rate_of(got.steps)(F.col("p"))), got, model


def select_mixed(docs: DataFrame, labels: DataFrame, target: dict[str, float] | None = None) -> DataFrame:
    """The rows of ``docs`` drawn at rates of at most 1, so that the expected domain tokens meet the targets.

    Every text is scored once: its posterior is stored beside the row.
    """
    spark = docs.sparkSession
    name = "__mix"
    while name in docs.columns:
        name += "_"
    scored = store(docs.withColumn(name, posterior_of(spark, fit(docs, labels))(F.col("text"))), "mix-scored")
    got = fit_rates(scored.select(f"{name}.n_tokens", f"{name}.p"), target, upper=1.0, headroom=DRAWN)
    return scored.filter(uniform(F.col("doc_id")) < rate_of(got.steps, 1.0)(F.col(name)["p"])).select(*docs.columns)


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated, _, _ = mix(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    copies = F.floor("rate") + (uniform(F.col("doc_id")) < F.col("rate") - F.floor("rate")).cast("long")
    return rated.select("doc_id", "n_tokens", *(F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)), "rate",
                        copies.alias("copies"))
