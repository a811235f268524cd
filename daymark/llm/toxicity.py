"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a probability of being toxic, a logistic
function of the word stems in it; the document's probability is their noisy-or. Only document
labels are known: the sentence weights are trained through the noisy-or, and then point at the
sentences that offend.

Features are whole words and word beginnings of three to six letters, so inflected forms are met
too. Counts by label choose the features: those much more frequent in toxic documents. A sentence
without any of them counts as harmless. In training a small leak probability takes up labels that
no sentence explains; scores leave it out.

Training uses at most about ``MAX_LABELLED`` labelled documents, chosen by a hash of the id, so
what reaches the driver is bounded: their sentences in terms of the chosen features.

Defined results: null and empty texts score 0; unlabelled, null-labelled and null-id rows are not
trained on; a document labelled twice counts as toxic if one label says so; without toxic training
documents all scores are 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymark.llm.words import add_columns

#: Labelled documents in training, at most and approximately (a hash threshold).
MAX_LABELLED = 12_000
MAX_FEATURES = 3000
#: A feature is in at least so many toxic documents,
MIN_TOXIC = 3
#: and in so many times the share of toxic documents than of others.
MIN_LIFT = 5.0
THRESHOLD = 0.3
#: A sentence offends from this probability on.
OFFENDS = 0.3

_LETTERS = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def stems(word: str) -> list[str]:
    """Feature names of a lower-case word: the word itself and its beginnings."""
    return [word + "$", *(word[:k] for k in range(3, min(len(word), 6) + 1))]


@dataclass
class Model:
    """Weights by feature, and the bias of a sentence that has features."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0

    def __post_init__(self):
        self._known: dict[str, tuple[str, ...]] = {}

    def features(self, word: str) -> tuple[str, ...]:
        found = self._known.get(word)
        if found is None:
            if len(self._known) > 500_000:
                self._known.clear()
            found = tuple(s for s in stems(word) if s in self.weights)
            self._known[word] = found
        return found

    def sentences(self, text: str | None) -> Iterator[tuple[int, int, set[str]]]:
        """(start, end, features) of the sentences that have features."""
        if not text or not any(map(self.features, set(_LETTERS.findall(text.lower())))):
            return
        for m in _SENTENCE.finditer(text):
            held = {f for w in set(_LETTERS.findall(m[0].lower())) for f in self.features(w)}
            if held:
                yield m.start(), m.end(), held

    def judge(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """Noisy-or of the sentences, and every sentence's place and probability."""
        clean, places = 0.0, []
        for start, end, held in self.sentences(text):
            z = self.bias + sum(self.weights[f] for f in held)
            clean -= float(np.logaddexp(0.0, z))
            places.append((start, end, 1.0 / (1.0 + float(np.exp(-min(max(z, -700.0), 700.0))))))
        return 1.0 - float(np.exp(clean)) if places else 0.0, places


def labelled_texts(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id",
                   text_column: str = "text", label_column: str = "toxic",
                   limit: int = MAX_LABELLED) -> DataFrame:
    """(text, toxic) of about ``limit`` labelled documents at most, chosen by a hash of the id."""
    known = (
        labels.select(F.col(id_column).alias("labelled"), F.col(label_column).alias("toxic"))
        .filter("labelled IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("labelled").agg(F.max("toxic").cast("bigint").alias("toxic")))
    share = min(1.0, limit / max(1, known.count()))
    chosen = known.filter(
        F.pmod(F.xxhash64("labelled", F.lit(11)), F.lit(1_000_000)) < int(share * 1_000_000))
    # Bounded by ``limit``: ids and labels of the chosen documents.
    return docs.select(F.col(id_column).alias("labelled"), F.col(text_column).alias("text")).join(
        F.broadcast(chosen), "labelled").select("text", "toxic")


def feature_counts(sample: DataFrame) -> DataFrame:
    """(feature, toxic, clean): documents of either label that hold a feature.

    Counted in each task first, then by feature.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = (Counter(), Counter())
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
                held = {s for w in set(_LETTERS.findall((text or "").lower())) for s in stems(w)}
                counts[toxic > 0].update(held)
            names = list(counts[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()),
                 pa.array([counts[1][n] for n in names], pa.int64()),
                 pa.array([counts[0][n] for n in names], pa.int64())],
                names=["feature", "toxic", "clean"])
            rest = [n for n in counts[0] if n not in counts[1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rest, pa.string()), pa.array([0] * len(rest), pa.int64()),
                 pa.array([counts[0][n] for n in rest], pa.int64())],
                names=["feature", "toxic", "clean"])

    return sample.mapInArrow(run, "feature string, toxic bigint, clean bigint").groupBy(
        "feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def train(sample: DataFrame, max_features: int = MAX_FEATURES) -> Model:
    """A model from (text, toxic) rows, of which there are boundedly many."""
    size = sample.agg(F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)), F.count("*")).first()
    n_toxic, n_clean = int(size[0] or 0), int(size[1] - (size[0] or 0))
    if not n_toxic or not n_clean:
        return Model()
    lift = (F.col("toxic") / n_toxic) / ((F.col("clean") + 0.5) / n_clean)
    chosen = [r[0] for r in feature_counts(sample).filter(F.col("toxic") >= MIN_TOXIC)
              .filter(lift >= MIN_LIFT)
              .orderBy((F.col("toxic") * F.log(lift)).desc(), "feature")
              .limit(max_features).select("feature").collect()]
    if not chosen:
        return Model()
    at = {name: i for i, name in enumerate(chosen)}
    probe = Model(dict.fromkeys(chosen, 0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [[sorted(at[f] for f in held) for _, _, held in probe.sentences(t)]
                    for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["toxic"], pa.array(bags, pa.list_(pa.list_(pa.int32())))],
                names=["toxic", "bag"])

    rows = sample.mapInArrow(run, "toxic bigint, bag array<array<int>>").collect()
    rows.sort(key=lambda r: (r[0], str(r[1])))  # the fit does not depend on the order of arrival
    weights, bias = fit_noisy_or([(r[0] > 0, r[1]) for r in rows], len(chosen))
    return Model(dict(zip(chosen, weights.tolist())), bias)


def fit_noisy_or(bags: list[tuple[bool, list[list[int]]]], n_features: int, steps: int = 400,
                 rate: float = 0.05, shrink: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that maximise the likelihood of the bags' labels, by gradient steps."""
    owner, instance, feature = [], [], []
    for doc, (_, bag) in enumerate(bags):
        for held in bag:
            instance += [len(owner)] * len(held)
            feature += held
            owner.append(doc)
    y = np.array([b[0] for b in bags], float)
    if not owner:
        return np.zeros(n_features), 0.0
    owner, instance, feature = map(np.array, (owner, instance, feature))
    theta = np.zeros(n_features + 2)  # weights, bias, logit of the leak
    theta[:n_features], theta[-2], theta[-1] = 0.5, -2.0, -4.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        z = theta[-2] + np.bincount(instance, theta[feature], len(owner))
        p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        leak = 1 / (1 + np.exp(-theta[-1]))
        clean = np.bincount(owner, -np.logaddexp(0, z), len(y)) + np.log1p(-leak)
        stay = np.exp(clean)
        pull = np.where(y > 0, -stay / np.maximum(1 - stay, 1e-12), 1.0)  # d loss / d(-clean)
        dz = pull[owner] * p
        grad = np.zeros_like(theta)
        grad[:n_features] = np.bincount(feature, dz[instance], n_features) / len(y)
        grad[-2] = dz.sum() / len(y)
        grad[-1] = (pull * leak).sum() / len(y)
        grad[:n_features] += shrink * theta[:n_features]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        theta -= rate * (first / (1 - 0.9 ** step)) / (
            np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return theta[:n_features], float(theta[-2])


def score(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """``docs`` with score, and the start, end and probability of the sentences that offend."""

    def start():
        ready = Model(model.weights, model.bias)

        def compute(texts):
            scores, starts, ends, chances = [], [], [], []
            for text in texts:
                value, places = ready.judge(text)
                bad = [p for p in places if p[2] >= OFFENDS]
                scores.append(value)
                starts.append([p[0] for p in bad])
                ends.append([p[1] for p in bad])
                chances.append([p[2] for p in bad])
            return scores, starts, ends, chances

        return compute

    return add_columns(docs, [text_column], {
        "score": "double", "bad_starts": "array<bigint>", "bad_ends": "array<bigint>",
        "bad_chances": "array<double>"}, start)
