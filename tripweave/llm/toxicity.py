"""Toxic documents and the sentences that make them so, learnt from document labels alone.

A document is a bag of sentences.  A sentence offends with probability p = 1 - exp(-s), where
s is the softplus of a linear score of its words, and the document is toxic if any sentence
offends: 1 - prod(1 - p) (noisy-or).  The labels of documents thus train the sentences, and a
trained model names the sentences that a verdict rests on.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import WORKER_CACHE, key_and_text, map_arrow
from tripweave.plans.lineage import cut_lineage

#: Weights, a power of two; a word and its beginnings are hashed onto them.
WIDTH = 1 << 18
#: Lengths of the beginnings of a longer word that count as features besides the word.
STEMS = (4, 5, 6)
#: Words scored at once.
TOGETHER = 200_000
_TOKEN = re.compile(r"\S+")
_EDGES = ".,;:!?\"'()[]{}*#$%&|<>…«»¿¡"


def word_features(token: str) -> list[int]:
    """Where a white-space token's word and its beginnings lie among the weights."""
    word = token.strip(_EDGES)
    if not word:
        return []
    parts = [f"w {word}", *(f"{n} {word[:n]}" for n in STEMS if len(word) > n)]
    return [zlib.crc32(p.encode()) % WIDTH for p in parts]


def _ends(tokens: list[str]) -> np.ndarray:
    """Index after the last token of each sentence; a sentence ends with . ! or ?"""
    closed = np.fromiter((t[-1] in ".!?" for t in tokens), bool, len(tokens))
    if len(tokens):
        closed[-1] = True
    return np.flatnonzero(closed) + 1


@dataclass(frozen=True)
class Model:
    """Weights and bias of a sentence; ``prior`` answers where there is nothing to go by."""

    weights: np.ndarray
    bias: float
    prior: float


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def screened(having: np.ndarray, sizes: np.ndarray, least: float = 4.0) -> np.ndarray:
    """Which features tell the classes apart: the shares of documents that have a feature differ
    between them by ``least`` standard errors.  ``having`` counts those documents, a row a class."""
    share = having.sum(axis=0) / sizes.sum()
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / sizes[0] + 1 / sizes[1]))
    return np.abs(having[1] / sizes[1] - having[0] / sizes[0]) >= least * error


def fit(
    labels: np.ndarray,
    weight: np.ndarray,
    sentences: np.ndarray,
    words: np.ndarray,
    features: np.ndarray,
    use: np.ndarray,
    epochs: int = 20,
    rate: float = 0.3,
    decay: float = 1e-6,
    batches: int = 16,
) -> tuple[np.ndarray, float]:
    """Noisy-or likelihood by Adagrad over parts of the documents.

    ``sentences`` counts the sentences of each document, ``words`` the features of each
    sentence, both laid end to end as ``features`` are.  Every document has a sentence.
    Features that are not in ``use`` keep the weight 0.
    """
    sentence = np.repeat(np.arange(len(words)), words)
    kept = use[features]
    features, words = features[kept], np.bincount(sentence[kept], minlength=len(words))
    weights, bias = np.zeros(WIDTH), -5.0
    seen, seen_bias = np.full(WIDTH, 1e-6), 1e-6
    first_sentence = np.cumsum(sentences) - sentences
    first_feature = np.cumsum(words) - words
    order = np.random.default_rng(7).permutation(len(labels))
    for _ in range(epochs):
        for part in np.array_split(order, min(batches, len(order))):
            rows = _ranges(first_sentence[part], sentences[part])
            own = features[_ranges(first_feature[rows], words[rows])]
            of = np.repeat(np.arange(len(rows)), words[rows])
            z = np.bincount(of, weights[own], minlength=len(rows)) + bias
            total = np.add.reduceat(_softplus(z), np.cumsum(sentences[part]) - sentences[part])
            # d log likelihood / d total: -1 where clean, exp(-t) / (1 - exp(-t)) where toxic.
            pull = np.where(labels[part] > 0, 1.0 / np.expm1(np.clip(total, 1e-6, 50.0)), -1.0)
            pull *= weight[part] / weight[part].mean() / len(part)
            slope = np.repeat(pull, sentences[part]) / (1 + np.exp(-np.clip(z, -50.0, 50.0)))
            step = np.bincount(own, slope[of], minlength=WIDTH) - decay * weights
            seen += step * step
            weights += rate * step / np.sqrt(seen)
            seen_bias += slope.sum() ** 2
            bias += rate * slope.sum() / seen_bias**0.5
    return weights, float(bias)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] places, then the same for the next."""
    turns = np.cumsum(sizes) - sizes
    return np.repeat(starts - turns, sizes) + np.arange(int(sizes.sum()))


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    key: str = "doc_id",
    text: str = "text",
    per_class: int = 3_000,
    longest: int = 120_000,
) -> Model:
    """Fit a model to the documents that ``labels`` (key and a 0/1 label, nulls left out) covers.

    The fit sees at most ``per_class`` documents of each label, those whose keys hash lowest,
    of at most ``longest`` characters; the class counts that weight them are of all labelled
    documents.  Only keys and labels are shuffled; the texts of the sample, whose number and
    length are bounded, go to one task, and the driver gets the weights.  Without documents of
    both labels the model answers the share of label 1, or 0 without any label.
    """
    known = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    rows = key_and_text(docs, key, text)
    sized = rows.select("doc_id", F.length("text").alias("size"), (F.trim("text") != "").alias("filled"))
    pool = cut_lineage(sized.join(known, "doc_id"))
    counts = {r["label"]: r["n"] for r in pool.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    usable = pool.filter((F.col("size") <= longest) & F.col("filled")).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = None
    for value in (0, 1):
        own = usable.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = own if chosen is None else chosen.unionByName(own)
    # Twice per_class rows of two numbers: safe to broadcast.  A key's copies count once.
    drawn = (
        rows.filter(F.length("text") <= longest)
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "label")
        .agg(F.min("text").alias("text"))
        .select("text", "label")
    )

    def fitted(batches):
        labels, sentences, words, features = [], [], [], []
        having = np.zeros((2, WIDTH), np.int64)
        known: dict[str, bytes] = {}

        def coded(token: str) -> bytes:
            more = known.get(token)
            if more is None:
                more = np.array(word_features(token), np.int32).tobytes()
                if len(known) < WORKER_CACHE:
                    known[token] = more
            return more

        for batch in batches:
            for one, value in zip(
                batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True
            ):
                tokens = one.lower().split()
                ends = _ends(tokens).tolist()
                if not ends:
                    continue
                own = [b"".join([coded(t) for t in tokens[a:b]]) for a, b in zip([0, *ends], ends, strict=False)]
                words += [len(x) // 4 for x in own]
                features.append(np.frombuffer(b"".join(own), np.int32))
                having[value, np.unique(features[-1])] += 1
                labels.append(value)
                sentences.append(len(ends))
        known.clear()
        labels_ = np.array(labels, np.int64)
        there = np.bincount(labels_, minlength=2)
        if not there.all():
            return
        share = np.array([counts[0] / there[0], counts[1] / there[1]])
        weights, bias = fit(
            labels_,
            share[labels_],
            np.array(sentences, np.int64),
            np.array(words, np.int64),
            np.concatenate(features),
            screened(having, there),
        )
        yield pa.RecordBatch.from_pydict(
            {"weights": pa.array([weights.astype("<f4").tobytes()], pa.binary()), "bias": pa.array([bias])}
        )

    found = map_arrow(drawn.coalesce(1), fitted, "weights binary, bias double").collect()
    if not found:
        return Model(np.zeros(WIDTH, np.float32), -50.0, prior)
    return Model(np.frombuffer(found[0]["weights"], "<f4"), found[0]["bias"], prior)


class _Scorer:
    """Sentence scores with what a token adds kept per worker."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, float] = {}

    def value(self, token: str) -> float:
        found = self.known.get(token)
        if found is None:
            weights = self.model.weights
            found = float(sum(weights[i] for i in word_features(token)))
            if len(self.known) < WORKER_CACHE and len(token) <= 64:
                self.known[token] = found
        return found

    def totals(self, tokens: list[str], ends: np.ndarray) -> np.ndarray:
        """-log(1 - p) of each sentence."""
        known = self.known
        try:
            values = [known[t] for t in tokens]
        except KeyError:
            values = list(map(self.value, tokens))
        sums = np.add.reduceat(np.array(values), np.append(0, ends[:-1]))
        return _softplus(sums + self.model.bias)

    def documents(self, texts: list[str]):
        """The totals of the sentences of each text, many texts at once."""
        at = 0
        while at < len(texts):
            tokens: list[str] = []
            bounds, counts = [], []
            while at < len(texts) and (not counts or len(tokens) < TOGETHER):
                own = texts[at].lower().split()
                ends = _ends(own)
                bounds.append(ends + len(tokens))
                counts.append(len(ends))
                tokens += own
                at += 1
            sums = self.totals(tokens, np.concatenate(bounds)) if tokens else np.zeros(0)
            yield from np.split(sums, np.cumsum(counts)[:-1])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, score, sentences, worst, worst_score): the probability that the document is
    toxic, its number of sentences, and the place and probability of its worst sentence.

    Null, empty and blank texts have no sentence, so nothing in them offends: score 0 and null
    for the worst.  Repeated rows repeat their results, an empty table gives none, and other
    columns are not read.  Very long texts are scored whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        scorer = _Scorer(shared.value)
        for batch in batches:
            total, number, worst, worst_score = [], [], [], []
            for own in scorer.documents(batch.column("text").to_pylist()):
                number.append(len(own))
                total.append(float(own.sum()))
                top = int(own.argmax()) if len(own) else None
                worst.append(top)
                worst_score.append(None if top is None else -float(np.expm1(-own[top])))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "score": pa.array(-np.expm1(-np.array(total)), pa.float64()),
                    "sentences": pa.array(number, pa.int64()),
                    "worst": pa.array(worst, pa.int64()),
                    "worst_score": pa.array(worst_score, pa.float64()),
                }
            )

    return map_arrow(
        key_and_text(docs, key, text),
        scored,
        "doc_id long, score double, sentences long, worst long, worst_score double",
    )


def passing(docs: DataFrame, model: Model, below: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that score less than ``below``; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        scorer = _Scorer(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            total = np.array([own.sum() for own in scorer.documents(texts)])
            yield batch.filter(pa.array(-np.expm1(-total) < below))

    return map_arrow(docs, keep, docs.schema)


def offending_sentences(
    docs: DataFrame, model: Model, least: float = 0.5, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Rows (doc_id, sentence, start, end, score) of the sentences that offend with probability
    ``least`` or more: the sentence's place, and its characters in the text as given."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def located(batches):
        scorer = _Scorer(shared.value)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, one in zip(
                batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True
            ):
                spans = [m.span() for m in _TOKEN.finditer(one)]
                tokens = [one[a:b].lower() for a, b in spans]
                if not tokens:
                    continue
                ends = _ends(tokens)
                p = -np.expm1(-scorer.totals(tokens, ends))
                begins = np.append(0, ends[:-1])
                rows += [
                    (doc_id, int(i), spans[begins[i]][0], spans[ends[i] - 1][1], float(p[i]))
                    for i in np.flatnonzero(p >= least)
                ]
            names = ("doc_id", "sentence", "start", "end", "score")
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_pydict(
                {n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))}
            )

    return map_arrow(
        key_and_text(docs, key, text), located, "doc_id long, sentence long, start long, end long, score double"
    )
