"""Toxicity as expected severity from cumulative-link (proportional-odds) ordinal regression on sparse text features.

P(grade <= j | x) = 1 / (1 + exp(-(theta_j - w.x))): one weight vector for all thresholds theta_0 < theta_1 < ...; the
expected severity is the sum over j of P(grade > j). Features are the distinct words of the lower-cased text and their beginnings, each
weighing 1 if present: repeated words or rows change nothing in a score.

Fit: on at most `sample` labelled rows, those of smallest hash of their id (parameter; 20,000 by default), so what
reaches the driver is bounded: the vocabulary and, of each sampled row, its words of it. The vocabulary is every word in at least `min_docs` of them that differs between
grades (a chi-square statistic over `min_chi`). Scoring maps over all rows with the words and weights in the closure,
bounded by the sample too.

Nulls: a null or empty text has no features and gets the severity of the thresholds alone, as does any text without a
known word. Labels whose grade or id is null are left out; of several grades for an id the highest counts. Without
labels, or with one grade only, every severity is that grade (0 with none). Only the id and text columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import cut as written
from vellum.llm.common import text_column

WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> set[str]:
    """The distinct words, and the beginnings of 4 and 5 letters of longer ones (marked by "-"), which inflected forms share."""
    own = set(WORD.findall(text.lower()))
    return own | {f"{w[:4]}-" for w in own if len(w) > 4} | {f"{w[:5]}-" for w in own if len(w) > 5}


@dataclass(frozen=True)
class Model:
    vocabulary: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray
    base: float = 0.0

    def severity(self, text: str) -> float:
        known = [self.vocabulary[w] for w in words(text) & self.vocabulary.keys()]
        x = self.weights[known].sum() if known else 0.0
        return self.base + float(np.sum(1 / (1 + np.exp(np.clip(self.thresholds - x, -500, 500)))))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n_features: int, l2: float, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds (as a first one and positive gaps) by L-BFGS-free accelerated gradient descent with a
    backtracking step. rows: the features of each document, grades: 0..K."""
    k = int(grades.max())
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    n = len(rows)
    w, raw = np.zeros(n_features), np.zeros(k)
    share = [max(1e-3, float((grades <= j).mean())) for j in range(k)]
    raw[0] = np.log(share[0] / max(1e-3, 1 - share[0]))
    raw[1:] = 0.0

    def value(w: np.ndarray, raw: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        gaps = np.exp(raw[1:])
        theta = raw[0] + np.concatenate([[0.0], np.cumsum(gaps)])
        x = np.bincount(owner, w[flat], n) if len(flat) else np.zeros(n)
        upper = np.concatenate([theta, [np.inf]])[grades]
        lower = np.concatenate([[-np.inf], theta])[grades]
        su, sl = sigmoid(upper - x), sigmoid(lower - x)
        p = np.maximum(su - sl, 1e-12)
        du, dl = su * (1 - su), sl * (1 - sl)
        loss = -np.log(p).sum() / n + l2 * (w @ w) / 2
        gx = (du - dl) / p / n
        gw = (np.bincount(flat, gx[owner], n_features) if len(flat) else np.zeros(n_features)) + l2 * w
        gt = np.zeros(k)
        np.add.at(gt, np.minimum(grades, k - 1)[grades < k], (-du / p / n)[grades < k])
        np.add.at(gt, grades[grades > 0] - 1, (dl / p / n)[grades > 0])
        tail = np.cumsum(gt[::-1])[::-1]
        return loss, gw, np.concatenate([[tail[0]], tail[1:] * gaps])

    step, (vw, vr), (pw, pr), t = 1.0, (w, raw), (w, raw), 1.0
    for _ in range(steps):
        loss, gw, gr = value(vw, vr)
        square = gw @ gw + gr @ gr
        if square < 1e-12:
            break
        while True:
            nw, nr = vw - step * gw, vr - step * gr
            if value(nw, nr)[0] <= loss - step * square / 2 or step < 1e-6:
                break
            step /= 2
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vr = nw + (t - 1) / t_next * (nw - pw), nr + (t - 1) / t_next * (nr - pr)
        pw, pr, t, step = nw, nr, t_next, step * 1.3
    return pw, pr[0] + np.concatenate([[0.0], np.cumsum(np.exp(pr[1:]))])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(features: list[np.ndarray], grades: np.ndarray, vocabulary: dict[str, int], l2: float = 3e-4) -> Model:
    """A model from each example's known words (as numbers) and grade."""
    levels = np.unique(grades)
    if len(levels) < 2:
        return Model({}, np.zeros(0), np.zeros(0), float(levels[0]) if len(levels) else 0.0)
    w, theta = fit_ordinal(features, np.searchsorted(levels, grades), len(vocabulary), l2)
    return Model(vocabulary, w, theta, float(levels[0]))


def labelled_sample(docs: DataFrame, labels: DataFrame, grade: str, sample: int) -> DataFrame:
    """(text, grade) of at most `sample` labelled rows: those with the smallest hash of their id."""
    graded = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.expr(grade).cast("int").alias("grade")).dropna()
    picked = graded.groupBy("doc_id").agg(F.max("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_column().alias("text")).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "grade")


def train_from(docs: DataFrame, labels: DataFrame, grade: str, sample: int = 20_000, min_docs: int = 5, min_chi: float = 12.0) -> Model:
    """Words are taken and counted on the executors; the driver gets the vocabulary and each sampled row's words of it, as numbers."""

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sorted(words(t)) for t in b.column(1).to_pylist()], pa.list_(pa.string())), b.column(2)], names=["doc_id", "words", "grade"])

    picked = written(labelled_sample(docs, labels, grade, sample).mapInArrow(bags, "doc_id bigint, words array<string>, grade int"))
    levels = {r["grade"]: r["count"] for r in picked.groupBy("grade").count().collect()}
    n, lowest = sum(levels.values()), min(levels, default=0)
    high = n - levels.get(lowest, 0)
    seen = picked.select(F.explode("words").alias("word"), (F.col("grade") > lowest).cast("int").alias("high")).groupBy("word").agg(F.count("*").alias("c"), F.sum("high").alias("h"))
    expected = F.col("c") * high / max(n, 1)
    chi = (F.col("h") - expected) ** 2 / expected * n / max(n - high, 1)
    told = seen.where((F.col("c") >= min_docs) & (chi >= min_chi)).select("word").toArrow().column("word").to_pylist() if high else []
    vocabulary = {w: i for i, w in enumerate(sorted(told))}

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = [[vocabulary[w] for w in own if w in vocabulary] for own in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(known, pa.list_(pa.int32())), b.column(2)], names=["doc_id", "known", "grade"])

    got = picked.mapInArrow(numbers, "doc_id bigint, known array<int>, grade int").toArrow()
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    known, grades = got.column("known").to_pylist(), got.column("grade").to_numpy()[order].astype(np.int64)
    return train([np.array(known[i], np.int64) for i in order], grades, vocabulary)


def score(docs: DataFrame, model: Model, cut: float = 0.3) -> DataFrame:
    """doc_id, severity (rounded to 6 places) and toxic (severity >= cut) of each row. A map: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [round(model.severity(t), 6) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array([x >= cut for x in s], pa.bool_())], names=["doc_id", "severity", "toxic"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_column().alias("text")).mapInArrow(run, "doc_id bigint, severity double, toxic boolean")


def keep_below(docs: DataFrame, model: Model, cut: float = 0.3) -> DataFrame:
    """The rows of lower severity, with all their columns. A map: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([model.severity(t or "") < cut for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
