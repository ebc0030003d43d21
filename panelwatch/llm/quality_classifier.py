"""Quality classifier: n-gram indicators scaled by naive Bayes ratios, in a linear hinge-loss model.

The ratio of an n-gram is the log of its smoothed share among label 1 over its share among
label 0. Rows of scaled indicators have unit length; dual coordinate descent fits the hinge loss
with a cost per class that balances them. Margins become probabilities by a sigmoid fitted on
out-of-fold margins. Ratios, model and sigmoid are learned from one bounded sample of labelled
rows (``MAX_LABELLED``); every document is scored over its whole text.

Defined cases: null and empty texts have no n-grams and get the score of the bias. If the sample
lacks one of the classes, every score is the smoothed share of label 1. Labels that are null or
contradict each other for an id are not learned from. A null id is not held out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .hashed_text import MAX_LABELLED, SIZE, fitted, held_out, labelled_sample, scored, sigmoid, table_places

THRESHOLD = 0.3
PASSES = 12
COST = 1.0
SHRINK = 0.75
FOLDS = 3


def ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Log-count ratio of every place."""
    shares = []
    for label in (1, 0):
        chosen = [r for r, y in zip(rows, labels) if y == label]
        counts = np.bincount(np.concatenate([np.empty(0, np.int64), *chosen]), minlength=SIZE) + 1.0
        shares.append(counts / (len(chosen) + 2.0))
    return np.log(shares[0] / shares[1])


def _scaled(row: np.ndarray, r: np.ndarray) -> np.ndarray:
    values = r[row]
    norm = np.sqrt(values @ values)
    return values / norm if norm else values


def hinge(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias by dual coordinate descent, rows in a fixed random order."""
    rng = np.random.default_rng(7)
    signs = np.where(labels == 1, 1.0, -1.0)
    cost = np.where(labels == 1, 1 / np.mean(labels == 1), 1 / np.mean(labels == 0)) * COST / 2
    w, b, alpha = np.zeros(SIZE), 0.0, np.zeros(len(rows))
    lengths = np.array([v @ v for v in values]) + 1.0
    for _ in range(PASSES):
        for i in rng.permutation(len(rows)):
            row, value = rows[i], values[i]
            slope = signs[i] * (w[row] @ value + b) - 1
            new = min(max(alpha[i] - slope / lengths[i], 0.0), cost[i])
            step = (new - alpha[i]) * signs[i]
            if step:
                alpha[i] = new
                w[row] += step * value
                b += step
    return w, b


def _model(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    r = ratios(rows, labels)
    w, b = hinge(rows, [_scaled(x, r) for x in rows], labels)
    # between the model and its mean weight, as naive Bayes would have it
    return r, (1 - SHRINK) * np.abs(w).mean() + SHRINK * w, b


def margin(row: np.ndarray, r: np.ndarray, w: np.ndarray, b: float) -> float:
    return float(w[row] @ _scaled(row, r) + b)


def _sigmoid_fit(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the log odds, by Newton steps with smoothed targets."""
    n1, n0 = int(labels.sum()), int((1 - labels).sum())
    goal = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(x @ beta)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (goal - p) - 1e-6 * beta)
        beta = beta + step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-10:
            break
    return float(beta[0]), float(beta[1])


def fit(labels: list[tuple], rows: list[np.ndarray]) -> bytes:
    """The model as bytes: slope, offset, bias, then scaled weights and ratios."""
    y = np.array([int(x[0]) for x in labels])
    if min(int((y == 1).sum()), int((y == 0).sum())) < FOLDS:
        share = (y.sum() + 1.0) / (len(y) + 2.0)
        head = np.array([0.0, np.log(share / (1 - share)), 0.0])
        return np.concatenate([head, np.zeros(2 * SIZE)]).astype("<f4").tobytes()
    # folds run through each class, so that both are in all of them
    fold = np.empty(len(y), dtype=int)
    for label in (0, 1):
        fold[y == label] = np.arange((y == label).sum()) % FOLDS
    margins = np.empty(len(y))
    for k in range(FOLDS):
        part = _model([r for r, f in zip(rows, fold) if f != k], y[fold != k])
        for i in np.flatnonzero(fold == k):
            margins[i] = margin(rows[i], *part)
    slope, offset = _sigmoid_fit(margins, y)
    r, w, b = _model(rows, y)
    return np.concatenate([[slope, offset, b], w, r]).astype("<f4").tobytes()


def scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    most: int = MAX_LABELLED,
) -> DataFrame:
    """(id, held_out, score, predicted) of every document."""
    sample = labelled_sample(docs, labels, [label_col], id_col, text_col, table_places, most)
    model = np.frombuffer(fitted(sample, fit, [label_col]), dtype="<f4")

    def score(row: np.ndarray) -> tuple[float]:
        slope, offset, b = (float(x) for x in model[:3])
        w, r = model[3 : 3 + SIZE], model[3 + SIZE :]
        return (float(sigmoid(slope * margin(row, r, w, b) + offset)),)

    found = scored(docs, id_col, text_col, table_places, ["score"], score)
    return found.select(
        id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
