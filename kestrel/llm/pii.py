"""PII spans: base rules plus candidates selected by gradient boosting.

Base rules (leftmost, non-overlapping per kind) find e-mail addresses, IPv4 addresses, card
numbers and international phone numbers; each runs in time linear in the text. High-recall
generators then propose further, overlapping spans: the same data in other writings (``at``
and ``dot`` spelled out, defanged or spaced dots, other separators, phones without the plus).
Boosted trees score every proposal by features of its format and its surroundings; Platt
scaling on held-out documents calibrates the scores, and per kind the lowest threshold
with a held-out precision of ``PRECISION`` selects what is redacted (nothing if none has).

The trees learn from a bounded sample (``SAMPLE_DOCS`` documents by a hash of doc_id,
``ROWS_PER_DOC`` proposals each): a base span, and every rewriting of it in its place, is
positive; any other proposal is negative. Added spans never overlap base spans or each
other; the counts are those of the base rules.

Defined results: null text is empty; texts without spans have the empty string's hash and
an empty ``spans``; rows without a doc_id are scored but not learned from; repeated rows are
answered each; an empty table gives an empty result; only ``doc_id`` and ``text`` are read.
Positions are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.boosting import Boosted, boost, platt
from kestrel.llm.common import documents, hash_sample

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS, ROWS_PER_DOC = 6000, 64
PRECISION, LEAST_POSITIVES = 0.99, 10
AROUND = 24

Span = tuple[int, int, int]   # start, end, kind

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match of these can only start at the head of a run of digits, so the rest need not be tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Generators: loose writings of the four kinds.
_LOOSE_IP = re.compile(r"(?<![0-9])[0-9]{1,3}+(?:(?:\.|\[\.\]|\(\.\)| \. | dot )[0-9]{1,3}+){3}(?![0-9])")
_LOOSE_CARD = re.compile(r"(?<![0-9])(?:[0-9]{14,19}|[0-9]{3,6}(?:[\x20._/-]{1,3}[0-9]{2,6}){2,5})(?![0-9])")
_LOOSE_PHONE = re.compile(r"(?<![0-9+])(?:\+ ?)?\(?[0-9](?:[\x20()./-]{0,3}[0-9]){9,14}(?![0-9])")
_AT_WORD = re.compile(
    r"[\[(]at[\])]|\bat\b(?= [A-Za-z0-9-]{1,64}(?:\.[A-Za-z0-9]| ?[\[(](?:dot|\.)[\])]| dot [A-Za-z0-9]))", re.I)
_DOT_WORD = re.compile(r"\bdot\b|\[\.\]|\(\.\)", re.I)
_LOOSE_EMAIL = re.compile(
    r"[A-Za-z0-9._%+-]{1,64} ?(?:@|[\[(]at[\])]| at ) ?[A-Za-z0-9-]{1,64}"
    r"(?: ?(?:\.|[\[(](?:dot|\.)[\])]| dot ) ?[A-Za-z0-9-]{1,64}){1,4}", re.I)
_CUE = (re.compile(r"mail|contact|write|@", re.I), re.compile(r"\bip\b|addr|host|server", re.I),
        re.compile(r"card|visa|credit|pay|iban", re.I), re.compile(r"phone|tel|call|fax|mobile", re.I))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _octet(digits: str) -> bool:
    digits = digits.lstrip("0") or "0"      # int() refuses thousands of digits
    return len(digits) <= 3 and int(digits) <= 255


def base_spans(text: str) -> list[Span]:
    """The base rules' spans, by start, then kind."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end(), 0))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        out += [(m.start(), m.end(), 1) for m in _IP.finditer(text)
                if all(map(_octet, m.group().split(".")))]
        for m in _CARD.finditer(text):
            if 14 <= m.end() - m.start() <= 37:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), 2))
        if "+" in text:
            out += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text)
                    if 10 <= sum(map(str.isdigit, m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def proposals(text: str) -> list[Span]:
    """Overlapping candidate spans of all kinds."""
    out: set[Span] = set()
    if _DIGIT.search(text):
        for kind, pattern in ((1, _LOOSE_IP), (2, _LOOSE_CARD), (3, _LOOSE_PHONE)):
            out.update((m.start(), m.end(), kind) for m in pattern.finditer(text))
    marks = [m.start() for mark in (_DOT_WORD, _AT_WORD) for m in mark.finditer(text)]
    at = text.find("@")
    while at >= 0:
        marks.append(at)
        at = text.find("@", at + 1)
    for mark in marks:   # the address lies around its mark
        low = max(0, mark - 140)
        out.update((low + m.start(), low + m.end(), 0) for m in _LOOSE_EMAIL.finditer(text[low:mark + 140])
                   if low + m.start() <= mark <= low + m.end())
    return sorted(out)


class Taken:
    """Disjoint intervals; tells in logarithmic time whether a span meets one of them."""

    def __init__(self, spans: list[Span] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end, _ in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, start: int, end: int) -> bool:
        at = bisect_right(self.ends, start)
        return at < len(self.starts) and self.starts[at] < end

    def add(self, start: int, end: int) -> None:
        at = bisect_right(self.starts, start)
        self.starts.insert(at, start)
        self.ends.insert(at, end)


def features(text: str, span: Span) -> list[float]:
    """Format and context of a proposal."""
    start, end, kind = span
    s = text[start:end]
    groups = re.findall(r"[0-9]+", s)
    digits = "".join(groups)
    sizes = [len(g) for g in groups] or [0]
    before, after = text[max(0, start - AROUND):start], text[end:end + AROUND]
    labels = re.split(r"\s*(?:\.|[\[(](?:dot|\.)[\])]|\bdot\b)\s*", s)
    return [
        *(float(kind == k) for k in range(4)),
        len(digits), len(s), len(groups), max(sizes), min(sizes), float(len(set(sizes)) == 1),
        float(bool(digits) and luhn(digits)), float(all(int(g) <= 255 for g in groups if len(g) < 9)),
        len(set(digits)), s.count(" "), s.count("-"), float("(" in s),
        float(bool(re.search(r"@|[\[(]at[\])]", s))), len(labels), float(labels[-1].isalpha()),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(bool(re.match(r"[.,-]?[0-9]", after))),
        float(bool(_CUE[kind].search(before))), sum(map(str.isdigit, before + after)),
    ]


def rewritings(s: str, kind: int) -> list[str]:
    """Other writings of a base span."""
    if kind == 0:
        user, domain = s.rsplit("@", 1)
        plain = re.sub("[^A-Za-z]", "", user) or "x"
        letters = re.sub("[0-9]", "", domain)
        return [f"{plain} at {letters.replace('.', ' dot ')}", f"{plain}(at){letters.replace('.', '(dot)')}",
                f"{user} at {domain.replace('.', ' dot ')}", f"{user}(at){domain.replace('.', '(dot)')}",
                f"{user} [at] {domain.replace('.', ' [dot] ')}", f"{user}@{domain.replace('.', '[.]')}",
                f"{user} [at] {domain}", f"{user}(at){domain}", f"{user} at {domain}"]
    if kind == 1:
        return [s.replace(".", "[.]"), s.replace(".", " . "), s.replace(".", "(.)")]
    if kind == 2:
        digits = re.sub("[^0-9]", "", s)
        groups = [digits[i:i + 4] for i in range(0, len(digits), 4)]
        return [".".join(groups), " - ".join(groups), "/".join(groups)]
    bare = s.lstrip("+")
    return [bare, "+ " + bare, bare.replace(" ", ".").replace("-", ".")]


def examples(text: str) -> list[tuple[list[float], int]]:
    """(features, label) of a text's proposals and of the rewritings of its base spans."""
    base = base_spans(text)
    known, taken = set(base), Taken(base)
    # A number that passes the card check without being a base span (two cards in a row) is left unlabelled.
    out = [(features(text, p), int(p in known)) for p in proposals(text)
           if p in known or not (p[2] == 2 and luhn(re.sub("[^0-9]", "", text[p[0]:p[1]])))
           and not taken.meets(p[0], p[1])][:ROWS_PER_DOC]
    for start, end, kind in base[:ROWS_PER_DOC // 8]:
        for s in rewritings(text[start:end], kind):
            head, tail = text[max(0, start - 200):start], text[end:end + 200]
            near, span = head + s + tail, (len(head), len(head) + len(s), kind)
            out += [(features(near, p), int(p == span)) for p in proposals(near)
                    if p == span or (p[0] < span[1] and span[0] < p[1])]
    return out


@dataclass
class Selector:
    trees: Boosted
    scale: tuple[float, float]
    thresholds: list[float]   # by kind; above 1: never

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.trees.raw(x) + b, -30, 30)))

    def added(self, text: str, base: list[Span]) -> list[Span]:
        taken = Taken(base)
        free = [p for p in proposals(text) if not taken.meets(p[0], p[1])]
        if not free:
            return []
        prob = self.probability(np.array([features(text, p) for p in free], float))
        out: list[Span] = []
        for q, p in sorted((-q, p) for q, p in zip(prob.tolist(), free)):
            if -q >= self.thresholds[p[2]] and not taken.meets(p[0], p[1]):
                taken.add(p[0], p[1])
                out.append(p)
        return out


def solve(x: np.ndarray, y: np.ndarray, held_out: np.ndarray) -> Selector | None:
    """Trees on the learning part; calibration and thresholds on the held-out part."""
    if len(x) == 0 or y[~held_out].min(initial=1) == y[~held_out].max(initial=0) or not held_out.any():
        return None
    trees = boost(x[~held_out], y[~held_out])
    xv, yv = x[held_out], y[held_out]
    model = Selector(trees, platt(trees.raw(xv), yv), [2.0] * len(KINDS))
    prob = model.probability(xv)
    for kind in range(len(KINDS)):
        mine = xv[:, kind] == 1
        p, t = prob[mine], yv[mine]
        for cut in np.unique(p[p >= 0.5]):
            chosen = t[p >= cut]
            if chosen.sum() < LEAST_POSITIVES:
                break
            if chosen.mean() >= PRECISION:
                model.thresholds[kind] = float(cut)
                break
    return model


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Selector | None:
    rows = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ids = hash_sample(rows.select("doc_id").distinct(), "doc_id", sample_docs, rows.select("doc_id").count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                found = examples(t or "")
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i] * len(found), pa.int64()), pa.array([f for f, _ in found], pa.list_(pa.float64())),
                         pa.array([y for _, y in found], pa.int32())], ["doc_id", "x", "y"])

    got = (rows.join(F.broadcast(ids), "doc_id", "left_semi")
           .mapInArrow(run, "doc_id long, x array<double>, y int").toPandas())
    if not len(got):
        return None
    got = got.sort_values(["doc_id", "y"], kind="stable")
    return solve(np.stack(got["x"].to_numpy()), got["y"].to_numpy().astype(float),
                 (got["doc_id"].to_numpy() * 2654435761 >> 7) % 3 == 0)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2])))


def find_pii(docs: DataFrame, selector: Selector | None) -> DataFrame:
    """doc_id, base counts by kind, hash of the base spans, all spans, and the number of added ones."""
    held = docs.sparkSession.sparkContext.broadcast(selector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                more = model.added(text, base) if model else []
                rows.append((*(sum(s[2] == k for s in base) for k in range(4)),
                             hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + more), len(more)))
            cols = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:4]),
                 pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string()), pa.array(cols[6], pa.int64())],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
             "n_added long")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return find_pii(docs, fit(docs))
