"""Toxicity severity by cumulative-link ordinal regression.

P(grade <= j) = sigmoid(threshold_j - w . x): one weight vector for all ordered
thresholds. x holds log(1 + count) of a document's words and word beginnings
(``STEMS`` letters, so unseen endings of a known word count too). The model is
fitted on a bounded sample of labelled rows; scoring runs over every document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from engram.llm.common import row_key, stored

# the sample: labelled documents, and the words that count as features
SAMPLE_ROWS = 5_000
MIN_ROWS = 8
MOST_ROWS = 0.5
MAX_WORDS = 65_536
# the absolute penalty that picks features, in units of the largest slope that chance gives one of them;
# then the square penalty that fits the picked ones
PICK = 0.7
SHRINK = 1e-4
STEMS = (4, 5, 6)
REJECT_FROM = 0.5

_WORD = re.compile(r"[^\W_]+")
_LONGEST = 64


def words(text: str | None) -> list[str]:
    """Lower-case words; a run of over 64 letters and digits stands for itself as one word ``<long>``."""
    return [w if len(w) <= _LONGEST else "<long>" for w in _WORD.findall((text or "").lower())]


def features(text: str | None) -> Counter:
    """Counts of the words and of their beginnings, the latter written with a final ``*``."""
    found = Counter(words(text))
    for word, n in list(found.items()):
        for size in STEMS:
            if len(word) >= size:
                found[word[:size] + "*"] += n
    return found


@dataclass
class Model:
    thresholds: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        known, found = self.weights, features(text)
        return float(sum(known[w] * np.log1p(found[w]) for w in sorted(known.keys() & found.keys())))

    def at_least(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > j) for each threshold j; non-increasing in j."""
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -500, 500)))


# entries of the matrix multiplied at a time
_STEP = 1 << 18


class _Rows:
    """A sparse matrix by rows, with the two products the fit needs."""

    def __init__(self, index: list[np.ndarray], value: list[np.ndarray], width: int):
        sizes = np.array([len(x) for x in index])
        self.rows, self.width = len(sizes), width
        self.row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.col = np.concatenate([*index, np.zeros(0, np.int32)])
        self.val = np.concatenate([*value, np.zeros(0, np.float32)])
        squares = np.zeros(width)
        for at in range(0, len(self.val), _STEP):
            squares += np.bincount(self.col[at : at + _STEP], self.val[at : at + _STEP] ** 2, width)
        rms = np.sqrt(squares / max(1, self.rows))
        self.scale = np.where(rms > 0, 1 / np.maximum(rms, 1e-12), 0.0)
        self.val *= self.scale.astype(np.float32)[self.col]

    def only(self, cols: np.ndarray) -> None:
        keep = np.isin(self.col, cols)
        self.row, self.col, self.val = self.row[keep], self.col[keep], self.val[keep]

    def _product(self, to: np.ndarray, by: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
        """Sums of entries times ``x[by]`` per ``to``, some entries at a time to keep the driver small."""
        out = np.zeros(size)
        for at in range(0, len(self.val), _STEP):
            some = slice(at, at + _STEP)
            out += np.bincount(to[some], self.val[some] * x[by[some]], size)
        return out

    def dot(self, w: np.ndarray) -> np.ndarray:
        return self._product(self.row, self.col, w, self.rows)

    def back(self, g: np.ndarray) -> np.ndarray:
        return self._product(self.col, self.row, g, self.width)

    def steepest(self) -> float:
        v = np.random.default_rng(0).standard_normal(self.width)
        size = 1.0
        for _ in range(20):
            v = self.back(self.dot(v)) / max(1, self.rows)
            size = float(np.linalg.norm(v))
            if size == 0:
                return 1.0
            v /= size
        return size


def _slopes(score: np.ndarray, grade: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of the mean negative log-likelihood by each row's score and by each threshold."""
    edges = np.concatenate(([-np.inf], cuts, [np.inf]))
    with np.errstate(over="ignore"):
        upper = 1 / (1 + np.exp(-(edges[grade + 1] - score)))
        lower = 1 / (1 + np.exp(-(edges[grade] - score)))
    mass = np.maximum(upper - lower, 1e-12)
    at_upper, at_lower = upper * (1 - upper) / mass, lower * (1 - lower) / mass
    n = len(score)
    by_cut = np.array([(at_lower[grade == j + 1].sum() - at_upper[grade == j].sum()) / n for j in range(len(cuts))])
    return (at_upper - at_lower) / n, by_cut


def _descend(x: _Rows, grade: np.ndarray, cuts: np.ndarray, absolute: float, square: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Accelerated proximal gradient on weights and thresholds together."""
    rate = 1.0 / (0.5 * (x.steepest() + 1.0) + square)
    w, at, best, lead, t = np.zeros(x.width), np.zeros(x.width), cuts.copy(), cuts.copy(), 1.0
    for _ in range(steps):
        by_row, by_cut = _slopes(x.dot(at), grade, lead)
        step = at - rate * (x.back(by_row) + square * at)
        new_w = np.sign(step) * np.maximum(np.abs(step) - rate * absolute, 0)
        new_cuts = np.maximum.accumulate(lead - rate * by_cut + 1e-6 * np.arange(len(cuts)))
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        push = (t - 1) / new_t
        at, lead = new_w + push * (new_w - w), np.sort(new_cuts + push * (new_cuts - best)) + 1e-6 * np.arange(len(cuts))
        w, best, t = new_w, new_cuts, new_t
    return w, best


def fit_rows(index: list[np.ndarray], value: list[np.ndarray], grade: np.ndarray, names: list[str], grades: int) -> Model:
    """Fit on rows in memory: pick words with an absolute penalty, then fit the picked ones with a slight square one."""
    share = [(np.sum(grade <= j) + 0.5) / (len(grade) + 1.0) for j in range(grades - 1)]
    cuts = np.log(np.array(share) / (1 - np.array(share))) + 1e-6 * np.arange(grades - 1)
    if len(grade) == 0 or len(names) == 0 or len(np.unique(grade)) < 2:
        return Model(np.full(grades - 1, np.inf))
    x = _Rows(index, value, len(names))
    # the rows are in ``x`` now; the driver does not keep them twice
    index.clear()
    value.clear()
    share_high = np.clip((grade > 0).mean(), 1 / len(grade), 1 - 1 / len(grade))
    chance = np.sqrt(2 * np.log(max(2, len(names))) / len(grade) * share_high * (1 - share_high))
    picked = np.flatnonzero(_descend(x, grade, cuts, PICK * chance, 0.0, 150)[0])
    x.only(picked)
    w, cuts = _descend(x, grade, cuts, 0.0, SHRINK, 600)
    return Model(cuts, {names[j]: float(w[j] * x.scale[j]) for j in picked})


def _counts(names: dict[str, int] | None):
    """Without ``names``: one row per word of a document. With: the document's features as packed arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, grade, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "grade", "text")), strict=True):
                found = features(text)
                if names is None:
                    yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["word"])
                    continue
                own = sorted((names[w], n) for w, n in found.items() if w in names)
                index = np.array([i for i, _ in own], np.int32)
                value = np.log1p(np.array([n for _, n in own], np.float32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc], pa.int64()), pa.array([grade], pa.int32()), pa.array([index.tobytes()]), pa.array([value.tobytes()])],
                    ["doc_id", "grade", "index", "value"],
                )

    return run


def fit(docs: DataFrame, grades: DataFrame, top: int, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``rows`` documents that ``grades`` (doc_id, grade 0..top) names, picked by a hash of the id.

    Several grades of a document count as their highest; nulls and grades out
    of range are left out; of several texts with one id the one with the least
    hash counts. Without usable rows of at least two grades nothing is known, and
    every severity is 0.
    """
    known = grades.where(F.col("doc_id").isNotNull() & F.col("grade").between(0, top))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("grade").cast("int").alias("grade"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most ``rows`` pairs of numbers
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    sample = joined.groupBy("doc_id", "grade").agg(F.min_by("text", row_key()).alias("text"))
    sample = stored(sample, "toxicity-sample")
    # words of one row in two tell little and make most of the entries
    usual = F.col("n").between(MIN_ROWS, MOST_ROWS * sample.count())
    by_word = sample.mapInArrow(_counts(None), "word string").groupBy("word").agg(F.count("*").alias("n")).where(usual)
    names = sorted(by_word.orderBy(F.col("n").desc(), "word").limit(MAX_WORDS).select("word").toArrow()["word"].to_pylist())
    packed = sample.mapInArrow(_counts({w: i for i, w in enumerate(names)}), "doc_id long, grade int, index binary, value binary").collect()
    packed.sort(key=lambda r: r["doc_id"])
    index = [np.frombuffer(r["index"], np.int32) for r in packed]
    value = [np.frombuffer(r["value"], np.float32) for r in packed]
    grade = np.array([r["grade"] for r in packed], np.int64)
    del packed
    return fit_rows(index, value, grade, names, top + 1)


def severity(model: Model, text: Column) -> Column:
    """struct(at_least array<double>, severity double, grade int) of a text column.

    ``severity`` is the expected grade, the sum of P(grade > j); ``grade`` the
    number of thresholds passed with at least one half. A null text scores as
    an empty one.
    """

    @pandas_udf("at_least array<double>, severity double, grade int")
    def run(texts: pd.Series) -> pd.DataFrame:
        over = model.at_least(np.array([model.score(t) for t in texts], np.float64))
        return pd.DataFrame({"at_least": [np.round(x, 6) for x in over], "severity": np.round(over.sum(axis=1), 6), "grade": (over >= 0.5).sum(axis=1).astype(np.int32)})

    return run(text)


def label_grades(labels: DataFrame) -> DataFrame:
    """Grades of the ``labels`` table: 0 not toxic, 1 toxic, 2 toxic and of low quality."""
    toxic, poor = F.col("toxic") == 1, F.coalesce(F.col("quality") == 0, F.lit(False))
    grade = F.when(toxic & poor, 2).when(toxic, 1).when(F.col("toxic") == 0, 0)
    return labels.select("doc_id", grade.alias("grade"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, at_least, severity, grade for every row of ``docs``; an empty table gives no rows."""
    return docs.select("doc_id", severity(model, F.col("text")).alias("s")).select("doc_id", "s.at_least", "s.severity", "s.grade")


def keep_mild(docs: DataFrame, model: Model, reject_from: float = REJECT_FROM) -> DataFrame:
    """The rows of ``docs``, all columns, whose expected severity is below ``reject_from``."""
    return docs.where(severity(model, F.col("text"))["severity"] < reject_from)
