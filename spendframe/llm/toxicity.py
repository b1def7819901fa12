"""Toxicity: a classifier chain over categories, fitted with out-of-fold predictions.

The labels know only toxic or not, so the narrower categories get weak labels: a toxic text is in a category if
it holds one of the category's seed words. The chain predicts the categories one after another and toxicity
last; every model is linear in the words of the text, the beginnings of these words, and the log odds of the
categories before it. In training these come from models that have not seen the row, so later models learn how far
earlier ones can be trusted on new texts.
"""

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

# The seed words of the weakly labelled categories.
SEEDS = {
    "insult": ["idiot", "moron", "stupid", "clown", "loser"],
    "contempt": ["trash", "scum", "worthless", "pathetic", "disgusting"],
}
CHAIN = ["insult", "contempt", "toxic"]
PREFIXES = (4, 5, 6, 7)
MOST_FEATURES = 4096
LEAST_TEXTS = 3
FOLDS = 3
ROUNDS, RATE, PENALTY = 300, 0.5, 0.3
WORDS = re.compile(r"[^\W\d_]+")
NO_WORD = re.compile(r"[\W\d_]")
PIECE_CHARS = 1 << 22
RESULT = pa.struct([(name, pa.float64()) for name in CHAIN])
RESULT_DDL = ", ".join(f"{name} double" for name in CHAIN)


def features(text: str) -> set[str]:
    """Words of the lower-case text, and beginnings of longer words (with a hyphen); each counts once."""
    words: set[str] = set()
    start = 0
    while start < len(text):  # pieces bound memory; they end between words
        cut = NO_WORD.search(text, min(len(text), start + PIECE_CHARS))
        stop = cut.start() if cut else len(text)
        words.update(WORDS.findall(text[start:stop].lower()))
        start = stop
    return words.union(*({word[:size] + "-" for word in words if len(word) > size} for size in PREFIXES))


def logistic(value):
    return 1 / (1 + np.exp(-np.clip(value, -30, 30)))


class Rows:
    """Feature numbers of texts as one array, with the row of each."""

    def __init__(self, found: list[set[str]], names: dict[str, int]):
        own = [[names[name] for name in row if name in names] for row in found]
        self.rows = np.repeat(np.arange(len(own)), [len(row) for row in own])
        self.columns = np.array([number for row in own for number in row], np.int64)
        self.count, self.width = len(own), len(names)

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights[self.columns], self.count)

    def gradient(self, errors: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, errors[self.rows], self.width)


def _names(found: list[set[str]], labels: np.ndarray) -> dict[str, int]:
    """The features that tell the labels apart best (largest standardised difference of rates), at most MOST_FEATURES."""
    counts: dict[str, list[int]] = {}
    for row, label in zip(found, labels.astype(int)):
        for name in row:
            counts.setdefault(name, [0, 0])[label] += 1
    names = sorted(name for name, both in counts.items() if sum(both) >= LEAST_TEXTS)
    if not names:
        return {}
    both = np.array([counts[name] for name in names], np.float64)
    sizes = np.array([np.sum(labels == 0), np.sum(labels == 1)], np.float64)
    rates, all_rate = both / np.maximum(sizes, 1), both.sum(axis=1) / sizes.sum()
    score = np.abs(rates[:, 1] - rates[:, 0]) / np.sqrt(all_rate * (1 - all_rate) + 1e-3)
    best = np.argsort(-score, kind="stable")[:MOST_FEATURES]
    return {names[at]: number for number, at in enumerate(sorted(best.tolist()))}


@dataclass
class Linear:
    weights: np.ndarray  # of the features
    earlier: np.ndarray  # of the log odds of the categories before
    offset: float

    def logit(self, rows: Rows, before: np.ndarray) -> np.ndarray:
        return rows.times(self.weights) + before @ self.earlier + self.offset


def _fit_linear(rows: Rows, before: np.ndarray, labels: np.ndarray) -> Linear:
    """Logistic regression with an L1 penalty on the features, by proximal steps scaled for each feature (AdaGrad)."""
    share = np.clip(labels.mean() if len(labels) else 0.5, 0.001, 0.999)
    model = Linear(np.zeros(rows.width), np.zeros(before.shape[1]), float(np.log(share / (1 - share))))
    if len(set(labels.tolist())) < 2:
        return model
    squares, extra = np.full(rows.width, 1e-3), np.full(before.shape[1] + 1, 1e-3)
    for _ in range(ROUNDS):
        errors = logistic(model.logit(rows, before)) - labels
        gradient = rows.gradient(errors)
        squares += gradient * gradient
        step = RATE / np.sqrt(squares)
        weights = model.weights - step * gradient
        model.weights = np.sign(weights) * np.maximum(np.abs(weights) - step * PENALTY, 0)
        gradient = np.append(errors @ before, errors.sum())
        extra += gradient * gradient
        change = RATE * gradient / np.sqrt(extra)
        model.earlier -= change[:-1]
        model.offset -= change[-1]
    return model


@dataclass
class Chain:
    names: dict[str, int]
    models: list[Linear]
    threshold: float = 0.5  # of the last probability
    shift: float = 0.0  # from the log odds of the sample to those of all texts

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """A row per text with the probability of each category, in the chain's order.

        The chain runs on the sample's log odds, as it was fitted; the shift is added to what is reported only.
        """
        rows = Rows([features(text) for text in texts], self.names)
        before = np.zeros((len(texts), 0))
        for model in self.models:
            before = np.column_stack((before, np.clip(model.logit(rows, before), -10, 10)))
        return logistic(before + self.shift)


def fit(sample: list[tuple[str, int]], share: float | None = None) -> Chain:
    """Learns the chain from (text, toxic 0 or 1). `share` is the true rate of toxic texts where the sample's differs."""
    found = [features(text) for text, _ in sample]
    toxic = np.array([label for _, label in sample], np.float64)
    targets = [np.array([label and not row.isdisjoint(SEEDS[name]) for row, label in zip(found, toxic)], np.float64) for name in CHAIN[:-1]]
    targets.append(toxic)
    names = _names(found, toxic)
    rows = Rows(found, names)
    folds = np.arange(len(sample)) % FOLDS
    parts = []
    for fold in range(FOLDS):
        inside, outside = np.flatnonzero(folds != fold), np.flatnonzero(folds == fold)
        own = _names([found[i] for i in inside], toxic[inside])
        parts.append((inside, outside, Rows([found[i] for i in inside], own), Rows([found[i] for i in outside], own)))
    before, models = np.zeros((len(sample), 0)), []
    for target in targets:
        models.append(_fit_linear(rows, before, target))
        unseen = np.zeros(len(sample))
        for inside, outside, own, other in parts:
            model = _fit_linear(own, before[inside], target[inside])
            unseen[outside] = model.logit(other, before[outside])
        before = np.column_stack((before, np.clip(unseen, -10, 10)))
    shift = 0.0
    if share is not None and 0 < share < 1 and 0 < toxic.mean() < 1:
        odds = lambda p: np.log(p / (1 - p))
        shift = float(odds(share) - odds(toxic.mean()))
    threshold = _threshold(before[:, -1] + shift, toxic, np.exp(-shift)) if 0 < toxic.sum() < len(toxic) else 0.5
    return Chain(names, models, threshold, shift)


def _threshold(logits: np.ndarray, labels: np.ndarray, weight: float) -> float:
    """The probability with the best F1 on out-of-fold predictions, in the middle of the gap around it; a negative counts `weight` times."""
    order = np.argsort(-logits, kind="stable")
    hits, wrong = np.cumsum(labels[order]), np.cumsum(1 - labels[order]) * weight
    f1 = 2 * hits / (hits + wrong + labels.sum())
    best = int(f1.argmax())
    after = logits[order[best + 1]] if best + 1 < len(order) else logits[order[best]] - 1
    return float(logistic((logits[order[best]] + after) / 2))


def classify(docs: DataFrame, chain: Chain, text: str = "text", result: str = "toxicity") -> DataFrame:
    """Adds the chain's probabilities for each whole text, however long.

    Null counts as empty; an empty text has the probabilities of a text without known words. Rows and other columns
    stay, repeated rows too; a column that already has the result's name is replaced. An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    @arrow_udf(RESULT_DDL)
    def run(column: pa.Array) -> pa.Array:
        found = []
        for start in range(0, len(column), 512):
            found.append(shared.value.probabilities([value.as_py() or "" for value in column[start : start + 512]]))
        values = np.concatenate(found) if found else np.zeros((0, len(CHAIN)))
        return pa.StructArray.from_arrays([pa.array(values[:, k]) for k in range(len(CHAIN))], fields=list(RESULT))

    return docs.withColumn(result, run(F.col(text)))
