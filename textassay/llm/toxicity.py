"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(theta_k - w.x) with one weight vector for all thresholds
theta_0 < theta_1 < ...; the expected severity is the sum of P(grade > k).

Features are the lower-case words of a text and the beginnings of words (``PREFIXES``
letters). A feature's amount is the number of words that have it per ``PER`` words of
text, ``PRIOR`` words added to the text's length so that one word of a short text does
not count for much. Only features that are markedly denser in toxic rows of the fitting
sample carry weight, so long clean texts do not add up noise.

Labels here only say toxic or not; no severity was ever labelled. Toxic rows of the
sample get grades 1 to 3 by the density of toxic features (terciles), so the grades
order texts by how much of them is toxic.

The fit is the only step that looks at a sample: at most ``max_rows`` labelled rows,
those with the lowest hash of id and text. All rows are scored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, text_of

#: Bound on the labelled rows that are fitted.
MAX_ROWS = 8_000
PREFIXES = (4, 5, 6, 7)
#: Words that amounts are counted by, and words added to a text's length.
PER, PRIOR = 50, 25
#: Toxic rows of the sample that a feature must be in, and its least lift.
MIN_ROWS, MIN_LIFT = 3, 8.0
GRADES = 4
#: Toxic from this probability of a grade above 0.
CUTOFF = 0.5
#: Amounts are summed as whole numbers of this part, so that sums do not depend on their order.
UNIT = 1 << 20

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> tuple[dict[str, int], float]:
    """The distinct words with their counts, and what a word counts for."""
    found = _WORD.findall(text.lower())
    return Counter(found), PER / (len(found) + PRIOR)


def row_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashed features and their amounts."""
    words, each = words_of(text)
    total: dict[int, int] = {}
    for w, c in words.items():
        for f in features_of(w):
            total[f] = total.get(f, 0) + c
    names = np.array(sorted(total), "<u4")
    return names, np.array([total[f] for f in names.tolist()], float) * each


def features_of(word: str) -> list[int]:
    """Hashed features of a word: itself and its beginnings."""
    return [zlib.crc32(word.encode("utf-8", "surrogatepass"))] + [zlib.crc32(f"^{word[:n]}".encode("utf-8", "surrogatepass")) for n in PREFIXES if len(word) >= n]


@dataclass
class OrdinalModel:
    """Weights by hashed feature, and thresholds in rising order."""

    weights: dict[int, float] = field(default_factory=dict)
    theta: np.ndarray = field(default_factory=lambda: np.array([4.0, 6.0, 8.0]))

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and threshold."""
        return 1.0 / (1.0 + np.exp(np.clip(self.theta[None, :] - score[:, None], -60, 60)))


def _adam(grad, x: np.ndarray, steps: int, rate: float) -> np.ndarray:
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        g = grad(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return x


def dense(rows: Column, bad: Column, good: Column, n_bad: int, n_good: int) -> Column:
    """Whether a feature may carry weight: in enough toxic rows, and with a mean amount there that is many times that of clean rows."""
    return (rows >= MIN_ROWS) & (bad / (UNIT * n_bad) >= MIN_LIFT * (good / UNIT + 0.5) / n_good)


def within(row: np.ndarray, values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places among the known features of a row's features, and their amounts."""
    if not len(known) or not len(row):
        return np.empty(0, np.int64), np.empty(0)
    at = np.minimum(np.searchsorted(known, row), len(known) - 1)
    hit = known[at] == row
    return at[hit], values[hit].astype(float)


@dataclass
class Objective:
    """Mean negative log likelihood of graded rows, and its gradient.

    Parameters are the weights, the first threshold and the logarithms of the steps to
    the further ones. Rows are given as (row, column, amount) triples.
    """

    row: np.ndarray
    col: np.ndarray
    x: np.ndarray
    grade: np.ndarray
    features: int
    l2: float

    def unpack(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self.features
        return p[:d], np.cumsum(np.concatenate([p[d : d + 1], np.exp(np.clip(p[d + 1 :], -8, 8))]))

    def _parts(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w, theta = self.unpack(p)
        s = np.bincount(self.row, weights=w[self.col] * self.x, minlength=len(self.grade))
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        hi = np.where(self.grade == GRADES - 1, 1.0, sig(edge[self.grade + 1] - s))
        lo = np.where(self.grade == 0, 0.0, sig(edge[self.grade] - s))
        return w, hi, lo

    def value(self, p: np.ndarray) -> float:
        w, hi, lo = self._parts(p)
        return float(-np.log(np.maximum(hi - lo, 1e-9)).mean() + self.l2 / 2 * (w * w).sum())

    def gradient(self, p: np.ndarray) -> np.ndarray:
        w, hi, lo = self._parts(p)
        n, d = len(self.grade), self.features
        each = np.maximum(hi - lo, 1e-9) * n
        d_hi, d_lo = hi * (1 - hi) / each, lo * (1 - lo) / each
        g_w = np.bincount(self.col, weights=(d_hi - d_lo)[self.row] * self.x, minlength=d) + self.l2 * w
        g_theta = (np.bincount(self.grade, weights=d_lo, minlength=GRADES) - np.bincount(self.grade + 1, weights=d_hi, minlength=GRADES + 1)[:GRADES])[1:]
        tail = np.cumsum(g_theta[::-1])[::-1]
        return np.concatenate([g_w, tail[:1], tail[1:] * np.exp(np.clip(p[d + 1 :], -8, 8))])


def objective(kept: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, l2: float) -> Objective:
    """Rows of (places among the features ``kept``, amounts) with 0/1 labels, graded by terciles of the toxic rows' amounts."""
    row, col = np.repeat(np.arange(len(rows)), [len(at) for at, _ in rows]), np.concatenate([at for at, _ in rows]).astype(np.int64)
    x = np.concatenate([v for _, v in rows]).astype(float)
    amount = np.bincount(row, weights=x, minlength=len(rows))
    grade = np.zeros(len(rows), int)
    some = amount[toxic == 1]
    grade[toxic == 1] = 1 + (some > np.quantile(some, 1 / 3)).astype(int) + (some > np.quantile(some, 2 / 3)).astype(int)
    return Objective(row, col, x, grade, len(kept), l2)


def fit_rows(kept: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, steps: int = 400, l2: float = 2e-5) -> OrdinalModel:
    """Fit weights of the features ``kept`` on rows of (places among them, amounts) and 0/1 labels.

    Without features, toxic rows or clean ones nothing can be told apart: the model
    then has no weights and calls no text toxic.
    """
    n, n_bad = len(rows), int(toxic.sum())
    if not n_bad or n_bad == n or not len(kept):
        return OrdinalModel()
    f = objective(kept, rows, toxic, l2)
    start = np.concatenate([np.zeros(len(kept)), [np.log((n - n_bad + 1) / (n_bad + 1))], np.zeros(GRADES - 2)])
    w, theta = f.unpack(_adam(f.gradient, start, steps, 0.05))
    return OrdinalModel({int(k): float(v) for k, v in zip(kept, w, strict=True) if v}, theta)


def fit(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> OrdinalModel:
    """Fit on at most ``max_rows`` labelled rows, chosen by the hash of id and text; ids may be of any type.

    Rows without an id or label are left out; a label counts as toxic if it is 1. Features
    are counted and picked where the texts are; the driver gets the picked ones, and of
    each row what it has of these.
    """
    bounded_batches(documents.sparkSession)
    picked = labels.select(F.col(doc_id).alias("id"), (F.col(toxic) == 1).cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IS NOT NULL")
    picked = picked.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    rows = documents.select(F.col(doc_id).alias("id"), text_of(text).alias("text")).join(F.broadcast(picked), "id")  # max_rows ids at most
    # an id can stand many times: the bound holds for rows
    rows = rows.select(F.xxhash64("id", "text").alias("place"), "text", "toxic").orderBy("place", "text", "toxic").limit(max_rows)
    rows = cut(rows.repartition(documents.sparkSession.sparkContext.defaultParallelism, "place"))
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return OrdinalModel()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [row_of(t) for t in batch["text"]]
            label = np.repeat(batch["toxic"].to_numpy(), [len(names) for names, _ in made])
            names, at = np.unique(np.concatenate([f for f, _ in made] or [np.empty(0, "<u4")]), return_inverse=True)
            amount = np.round(np.concatenate([v for _, v in made] or [np.empty(0)]) * UNIT).astype(np.int64)
            sums = [np.zeros(len(names), np.int64) for _ in range(3)]
            for out, values in zip(sums, (label, amount * label, amount * (1 - label)), strict=True):
                np.add.at(out, at, values)
            yield pd.DataFrame({"f": names.astype(np.int64), "rows": sums[0], "bad": sums[1], "good": sums[2]})

    counted = rows.mapInPandas(count, "f long, rows long, bad long, good long").groupBy("f").agg(*[F.sum(c).alias(c) for c in ("rows", "bad", "good")])
    kept = np.array(sorted(r["f"] for r in counted.where(dense(F.col("rows"), F.col("bad"), F.col("good"), n[1], n[0])).select("f").collect()), np.int64)

    def restrict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [within(*row_of(t), kept) for t in batch["text"]]
            yield pd.DataFrame({"place": batch["place"], "toxic": batch["toxic"], "at": [a.astype("<i4").tobytes() for a, _ in made], "x": [v.astype("<f8").tobytes() for _, v in made]})

    sample = rows.mapInPandas(restrict, "place long, toxic int, at binary, x binary").collect()
    sample.sort(key=lambda r: (r["place"], bytes(r["at"]), bytes(r["x"]), r["toxic"]))
    made = [(np.frombuffer(r["at"], "<i4").astype(np.int64), np.frombuffer(r["x"], "<f8")) for r in sample]
    return fit_rows(kept, made, np.array([r["toxic"] for r in sample], int))


def scored(model: OrdinalModel, text: Column, cutoff: float = CUTOFF) -> Column:
    """struct(grade, expected_severity, p_toxic, toxic) of a text column without nulls."""
    weights, theta = model.weights, model.theta

    @F.pandas_udf("grade int, expected_severity double, p_toxic double, toxic boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[str, float] = {}
        own = OrdinalModel(weights, theta)
        for batch in batches:
            score = np.zeros(len(batch))
            for k, t in enumerate(batch):
                words, each = words_of(t)
                if len(known) > 500_000:
                    known.clear()
                for w in words:
                    if w not in known:
                        known[w] = sum(weights.get(f, 0.0) for f in features_of(w))
                score[k] = sum(sorted(known[w] * c for w, c in words.items() if known[w])) * each
            above = own.above(score)
            grade = (above >= 0.5).sum(axis=1).astype(np.int32)
            yield pd.DataFrame({"grade": grade, "expected_severity": above.sum(axis=1), "p_toxic": above[:, 0], "toxic": above[:, 0] >= cutoff})

    return run.asNondeterministic()(text)


def grade_documents(documents: DataFrame, model: OrdinalModel, text: str = "text", cutoff: float = CUTOFF, name: str = "__toxicity") -> DataFrame:
    """``documents`` with a struct column ``name``, in place of one that has this name.

    A null or empty text has no features and gets the base rate's grade. Repeated
    rows get equal grades; other columns pass through.
    """
    bounded_batches(documents.sparkSession)
    return documents.withColumn(name, scored(model, text_of(text), cutoff))


def clean(documents: DataFrame, model: OrdinalModel, text: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``documents`` that the model does not call toxic, whole and unchanged."""
    bounded_batches(documents.sparkSession)
    return documents.where(~scored(model, text_of(text), cutoff)["toxic"])
