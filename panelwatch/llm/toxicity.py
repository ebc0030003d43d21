"""Toxicity by a classifier chain.

Categories are label columns in a fixed order. The model of each category is a logistic
regression on indicators of words, their beginnings and word pairs, those that tell the labels
apart, plus the log odds of all earlier categories. While
learning, these odds come from models that have not seen the row (out of fold); while scoring,
from the earlier model itself. All models are fitted on one bounded sample of labelled rows
(``MAX_LABELLED``); every document is scored over its whole text.

Defined cases: null and empty texts get the probabilities of the bias. A category without both
labels in the sample has the smoothed share of label 1 as its probability everywhere. Labels
that are null or contradict each other for an id are not learned from.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .hashed_text import distinct_word_hashes, fitted, held_out, labelled_sample, scored, sigmoid, word_hashes

#: Most labelled rows that the chain is fitted on; the first by hash of the id.
MAX_LABELLED = 8_000
#: The categories that the labels have, in chain order.
CATEGORIES = ("quality", "toxic")
THRESHOLD = 0.5
PASSES = 8
RATE = 0.5
PENALTY = 1e-4
#: A word or pair is learned from this many rows on, if its share differs this clearly.
LEAST = 3
DEVIATIONS = 4.5
FOLDS = 3
CLIP = 6.0


def vocabulary(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Hashes whose share differs between the labels by more than ``DEVIATIONS`` standard errors."""
    none = np.empty(0, np.int64)
    every, n = np.unique(np.concatenate([none, *rows]), return_counts=True)
    inside, k = np.unique(np.concatenate([none, *[r for r, label in zip(rows, y) if label == 1]]), return_counts=True)
    ones = np.zeros(len(every))
    ones[np.searchsorted(every, inside)] = k
    n1, n0 = max(1.0, y.sum()), max(1.0, len(y) - y.sum())
    share = n / (n1 + n0)
    error = np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0)) + 1e-12
    return every[(n >= LEAST) & (np.abs(ones / n1 - (n - ones) / n0) > DEVIATIONS * error)]


class Linear:
    """Logistic regression over chosen hashes and a few dense inputs, by adaptive gradient steps."""

    def __init__(self, words: np.ndarray, w: np.ndarray, v: np.ndarray, b: float):
        self.words, self.w, self.v, self.b = words, w, v, b

    def odds(self, row: np.ndarray, dense) -> float:
        at = np.searchsorted(self.words, row)
        at[at == len(self.words)] = 0
        hit = np.unique(at[self.words[at] == row]) if len(self.words) else at[:0]
        return float(self.w[hit].sum() + self.v @ np.asarray(dense, dtype=float) + self.b)

    @classmethod
    def learned(cls, rows: list[np.ndarray], dense: np.ndarray, y: np.ndarray) -> "Linear":
        share = (y.sum() + 1.0) / (len(y) + 2.0)
        count = dense.shape[1]
        model = cls(np.empty(0, np.int64), np.empty(0), np.zeros(count), float(np.log(share / (1 - share))))
        if not len(y) or y.min() == y.max():
            return model
        model.words = vocabulary(rows, y)
        model.w = np.zeros(len(model.words))
        hits = [np.searchsorted(model.words, r[np.isin(r, model.words, assume_unique=True)]) for r in rows]
        rng = np.random.default_rng(11)
        gw, gv, gb = np.full(len(model.w), 1e-8), np.full(count, 1e-8), 1e-8
        for _ in range(PASSES):
            for i in rng.permutation(len(y)):
                hit, d = hits[i], dense[i]
                g = sigmoid(model.w[hit].sum() + model.v @ d + model.b) - y[i]
                step = g + PENALTY * model.w[hit]
                gw[hit] += step * step
                model.w[hit] -= RATE * step / np.sqrt(gw[hit])
                gv += (g * d) ** 2
                model.v -= RATE * g * d / np.sqrt(gv)
                gb += g * g
                model.b -= RATE * g / np.sqrt(gb)
        return model


def fit(labels: list[tuple], rows: list[np.ndarray]) -> bytes:
    """The chain as bytes: per category its hashes, weights, weights for earlier categories, bias."""
    y = np.array(labels, dtype=float)
    models: list[Linear] = []
    earlier, fold = np.zeros((len(rows), 0)), np.arange(len(rows)) % FOLDS
    for k in range(y.shape[1] if len(rows) else 0):
        target = y[:, k]
        models.append(Linear.learned(rows, earlier, target))
        outside = np.zeros(len(rows))
        for f in range(FOLDS):
            part = fold != f
            model = Linear.learned([r for r, keep in zip(rows, part) if keep], earlier[part], target[part])
            for i in np.flatnonzero(~part):
                outside[i] = np.clip(model.odds(rows[i], earlier[i]), -CLIP, CLIP)
        earlier = np.column_stack([earlier, outside])
    return pickle.dumps([(m.words, m.w, m.v, m.b) for m in models])


def scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    categories: tuple[str, ...] = CATEGORIES, most: int = MAX_LABELLED, threshold: float = THRESHOLD,
) -> DataFrame:
    """(id, held_out, one probability per category, predicted for the last category)."""
    sample = labelled_sample(docs, labels, list(categories), id_col, text_col, lambda: distinct_word_hashes, most)
    chain = [Linear(*parts) for parts in pickle.loads(fitted(sample, fit, list(categories)))]

    def score(row: np.ndarray) -> tuple[float, ...]:
        odds: list[float] = []
        for k in range(len(categories)):
            x = chain[k].odds(row, np.clip(odds, -CLIP, CLIP)) if chain else 0.0
            odds.append(x)
        return tuple(float(sigmoid(x)) for x in odds)

    names = [f"p_{c}" for c in categories]
    found = scored(docs, id_col, text_col, lambda: word_hashes, names, score)
    return found.select(
        id_col, held_out(F.col(id_col)).alias("held_out"), *names,
        (F.col(names[-1]) >= threshold).cast("int").alias("predicted"),
    )
