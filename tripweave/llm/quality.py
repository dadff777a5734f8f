"""Document quality by regularised quadratic discriminant analysis.

Each document becomes a short vector of statistics of its text, transformed towards bell
shapes.  Each class has its mean and covariance over all labelled rows, shrunk towards the
pooled covariance and its diagonal.  The score compares the log densities, which are
Mahalanobis distances by the Cholesky factor of each covariance, taken once.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import key_and_text, map_arrow
from tripweave.plans.lineage import cut_lineage

STATISTICS = (
    "words",
    "word_length",
    "word_spread",
    "symbols",
    "digits",
    "capitals",
    "stops",
    "exclaims",
    "other_marks",
    "distinct",
    "same_as_before",
    "line_words",
    "repeated_lines",
    "squeezed",
    "longest_word",
)
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_SYMBOLS = b"#*$%&|<>"
_MARKS = b"\"'()[]{}/\\@^_~`+=-;:"


def statistics(text: str) -> list[float]:
    """The transformed statistics of one text, in the order of ``STATISTICS``; all 0 for a text
    without words.  Shares go through a square root or logit-like log, counts through a log."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    size = len(raw)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    without = lambda chars: size - len(raw.translate(None, chars))
    share = lambda count, of: float(np.log(count / of + 1e-3))
    before = sum(map(bytes.__eq__, words[1:], words))
    return [
        float(np.log(n)),
        float(np.log(lengths.mean())),
        float(np.log1p(lengths.std())),
        share(without(_SYMBOLS), size),
        share(without(_DIGITS), size),
        share(without(_UPPER), size),
        share(raw.count(b".") + raw.count(b"?"), n),
        share(raw.count(b"!"), n),
        share(without(_MARKS), size),
        float(np.log(len(set(words)) / n**0.85)),
        share(before, n),
        float(np.log(n / max(1, len(lines)))),
        share(len(lines) - len(set(lines)), max(1, len(lines))),
        float(np.log(len(zlib.compress(raw, 1)) / (size + 20.0))),
        float(np.log1p(lengths.max())),
    ]


def document_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, x): the statistics of each text."""

    def measured(batches):
        for batch in batches:
            found = [statistics(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "x": pa.array(found, pa.list_(pa.float64()))}
            )

    return map_arrow(key_and_text(docs, key, text), measured, "doc_id long, x array<double>")


@dataclass(frozen=True)
class Model:
    """Per class: log prior, mean and inverse Cholesky factor; scale of the statistics.

    ``classes`` is empty where labels of one kind or none were seen; then ``share`` answers.
    """

    centre: np.ndarray
    scale: np.ndarray
    classes: tuple[tuple[float, np.ndarray, np.ndarray], ...]
    share: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(x), self.share)
        z = np.clip((x - self.centre) / self.scale, -12.0, 12.0)
        density = []
        for prior, mean, inverse in self.classes:
            away = (z - mean) @ inverse.T
            density.append(prior + np.log(np.diag(inverse)).sum() - 0.5 * (away * away).sum(axis=1))
        return 1.0 / (1.0 + np.exp(np.clip(density[0] - density[1], -700.0, 700.0)))


def train(
    measured: DataFrame, labels: DataFrame, label: str = "quality", pooling: float = 0.2, ridge: float = 0.05
) -> Model:
    """Fit to the rows of ``labels`` (doc_id, label 0 or 1) that have statistics in ``measured``.

    Every labelled row counts, once for each time it occurs.  Tasks add up moments, and the
    driver gets their sums: a few hundred numbers.  ``pooling`` draws each class covariance
    towards the pooled one, ``ridge`` towards a sphere.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1))
    joined = measured.join(rows, "doc_id").select("label", "x")
    d = len(STATISTICS)

    def moments(batches):
        sums = np.zeros((2, d + 1, d + 1))
        for batch in batches:
            y = batch.column("label").to_numpy()
            x = np.array(batch.column("x").to_pylist(), float).reshape(-1, d)
            x = np.hstack([np.ones((len(x), 1)), x])
            for value in (0, 1):
                own = x[y == value]
                sums[value] += own.T @ own
        yield pa.RecordBatch.from_pydict(
            {"at": pa.array(np.arange(sums.size), pa.int32()), "sum": pa.array(sums.ravel(), pa.float64())}
        )

    found = map_arrow(joined, moments, "at int, sum double").groupBy("at").agg(F.sum("sum").alias("sum")).collect()
    sums = np.zeros(2 * (d + 1) ** 2)
    for row in found:
        sums[row["at"]] = row["sum"]
    return _solved(sums.reshape(2, d + 1, d + 1), pooling, ridge)


def _solved(sums: np.ndarray, pooling: float, ridge: float) -> Model:
    """The model that moment matrices (of 1 and the statistics, per class) give."""
    d = sums.shape[1] - 1
    counts = sums[:, 0, 0]
    if counts.min() < 1:
        share = counts[1] / counts.sum() if counts.sum() else 0.5
        return Model(np.zeros(d), np.ones(d), (), float(share))
    both = sums.sum(axis=0)
    centre = both[0, 1:] / counts.sum()
    scale = np.sqrt(np.maximum(np.diag(both)[1:] / counts.sum() - centre**2, 1e-6))
    means = (sums[:, 0, 1:] / counts[:, None] - centre) / scale
    covariances = []
    for own, n in zip(sums, counts, strict=True):
        mean = own[0, 1:] / n
        covariances.append((own[1:, 1:] / n - np.outer(mean, mean)) / np.outer(scale, scale))
    pooled = sum(n * c for n, c in zip(counts, covariances, strict=True)) / counts.sum()
    classes = []
    for mean, own, n in zip(means, covariances, counts, strict=True):
        # Few rows lean more on the pooled covariance.
        weight = max(pooling, d / (d + n))
        shrunk = (1 - weight) * own + weight * pooled
        shrunk = (1 - ridge) * shrunk + ridge * np.eye(d)
        factor = np.linalg.cholesky(shrunk)
        classes.append((float(np.log(n / counts.sum())), mean, np.linalg.inv(factor)))
    return Model(centre, scale, tuple(classes), float(counts[1] / counts.sum()))


def score(measured: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, score): the probability of label 1.  Texts without words share one score."""
    shared = measured.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "score": pa.array(shared.value.scores(x), pa.float64())}
            )

    return map_arrow(measured, scored, "doc_id long, score double")


def classify(
    docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Train on ``labels`` and score every row of ``docs``: rows (doc_id, score).

    Null and empty texts have all-zero statistics and one score.  Repeated rows repeat their
    results and count repeatedly in training; labels without a document are ignored; an empty
    table gives no rows; other columns are not read.
    """
    measured = cut_lineage(document_statistics(docs, key, text))
    return score(measured, train(measured, labels, label))
