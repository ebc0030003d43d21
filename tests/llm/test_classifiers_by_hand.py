"""The two classifiers against plain loops over dense matrices and counted n-grams."""

import math
import pickle
import random
import re
import zlib

import numpy as np
import pytest

from panelwatch.llm import hashed_text, quality_classifier, toxicity

WORDS = "good fine clear sound bad awful nasty grim the and of to river stone cloud".split()


def made_texts(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        quality = rng.random() < 0.5
        toxic = rng.random() < (0.2 if quality else 0.6)
        pool = WORDS[8:] * 2 + (WORDS[:4] * 2 if quality else []) + (WORDS[4:8] * 3 if toxic else [])
        rows.append((i, " ".join(rng.choice(pool) for _ in range(rng.randint(4, 25))), int(quality), int(toxic)))
    return rows


def n_grams(text):
    """Words, pairs, three bytes in a row, and the shares of repeated neighbours, as plain values."""
    words = re.findall(r"[^\W_]+", text.lower())
    found = {("w", w) for w in words} | {("p", a, b) for a, b in zip(words, words[1:])}
    data = text.encode()
    found |= {("b", data[i : i + 3]) for i in range(len(data) - 2)}
    for gap in (1, 2):
        pairs = list(zip(words[gap:], words))
        if pairs:
            found.add(("s", gap, math.ceil(4 * sum(a == b for a, b in pairs) / len(pairs))))
    return found


def test_ratios_are_those_of_counted_n_grams():
    rows = made_texts(60, 1)
    places_of = hashed_text.table_places()
    places = [places_of(text) for _, text, _, _ in rows]
    grams = [n_grams(text) for _, text, _, _ in rows]
    assert len(set().union(*map(set, places))) == len(set().union(*grams))  # nothing collides
    y = np.array([q for _, _, q, _ in rows])
    got = quality_classifier.ratios(places, y)
    ones, zeros = int(y.sum()), int((1 - y).sum())

    def ratio(gram):
        k1, k0 = (sum(gram in g for g, label in zip(grams, y) if label == want) for want in (1, 0))
        return math.log(((k1 + 1) / (ones + 2)) / ((k0 + 1) / (zeros + 2)))

    for p, g in zip(places, grams):
        assert np.allclose(sorted(got[p]), sorted(map(ratio, g)), atol=1e-12)


def test_hinge_fit_closes_the_duality_gap(monkeypatch):
    rows = made_texts(80, 2)
    places_of = hashed_text.table_places()
    places = [places_of(text) for _, text, _, _ in rows]
    y = np.array([t for _, _, _, t in rows])
    r = quality_classifier.ratios(places, y)
    values = [quality_classifier._scaled(p, r) for p in places]
    used = np.unique(np.concatenate(places))
    x = np.zeros((len(rows), len(used) + 1))
    for i, (p, v) in enumerate(zip(places, values)):
        x[i, np.searchsorted(used, p)] = v
    x[:, -1] = 1.0
    sign = np.where(y == 1, 1.0, -1.0)
    cost = np.where(y == 1, 1 / y.mean(), 1 / (1 - y.mean())) / 2
    # the dense dual by projected coordinate steps until nothing moves
    q = (sign[:, None] * x) @ (sign[:, None] * x).T
    alpha = np.zeros(len(rows))
    for _ in range(3000):
        for i in range(len(rows)):
            alpha[i] = min(max(alpha[i] - (q[i] @ alpha - 1) / q[i, i], 0.0), cost[i])
    best = alpha.sum() - alpha @ q @ alpha / 2

    def primal(w, b):
        full = np.append(w[used], b)
        return full @ full / 2 + (cost * np.maximum(0, 1 - sign * (x @ full))).sum()

    assert primal(*quality_classifier.hinge(places, values, y)) - best < 0.1 * abs(best)
    monkeypatch.setattr(quality_classifier, "PASSES", 400)
    w, b = quality_classifier.hinge(places, values, y)
    assert abs(primal(w, b) - best) < 1e-4 * abs(best)
    assert np.allclose(np.append(w[used], b), (sign * alpha) @ x, atol=1e-3)


def learned_rows(rows):
    """What may be learned from: outside the held-out part, in order of id."""
    return [r for r in sorted(rows) if zlib.crc32(str(r[0]).encode()) % 5]


def frames(spark, rows):
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(r[0], *r[2:]) for r in rows], "doc_id long, quality int, toxic int")
    return docs, labels


def test_quality_scores_against_a_plain_loop(spark):
    rows = made_texts(150, 3)
    known = learned_rows(rows)
    places_of = hashed_text.table_places()
    places, y = [places_of(r[1]) for r in known], np.array([r[2] for r in known])

    def model(keep):
        part = [p for p, k in zip(places, keep) if k]
        ratios = quality_classifier.ratios(part, y[keep])
        w, b = quality_classifier.hinge(part, [quality_classifier._scaled(p, ratios) for p in part], y[keep])
        return ratios, 0.25 * np.abs(w).mean() + 0.75 * w, b

    def margin(p, ratios, w, b):
        length = math.sqrt(sum(ratios[i] ** 2 for i in p)) or 1.0
        return sum(w[i] * ratios[i] / length for i in p) + b

    fold = np.zeros(len(y), dtype=int)
    seen = {0: 0, 1: 0}
    for i, label in enumerate(y.tolist()):
        fold[i], seen[label] = seen[label] % 3, seen[label] + 1
    outside = np.zeros(len(y))
    for k in range(3):
        part = model(fold != k)
        for i in np.flatnonzero(fold == k):
            outside[i] = margin(places[i], *part)
    slope, offset = quality_classifier._sigmoid_fit(outside, y)
    whole = model(np.ones(len(y), dtype=bool))
    want = {r[0]: 1 / (1 + math.exp(-(slope * margin(places_of(r[1]), *whole) + offset))) for r in rows}
    got = {r.doc_id: r.score for r in quality_classifier.scores(*frames(spark, rows)).collect()}
    assert got.keys() == want.keys()
    assert all(got[d] == pytest.approx(want[d], abs=1e-4) for d in want)


def plain_logistic(hits, dense, y, n_words):
    """The same adaptive steps on a dense matrix of words, earlier odds and bias."""
    x = np.zeros((len(y), n_words + dense.shape[1] + 1))
    for i, h in enumerate(hits):
        x[i, h] = 1.0
    x[:, n_words:-1] = dense
    x[:, -1] = 1.0
    share = (y.sum() + 1) / (len(y) + 2)
    w = np.zeros(x.shape[1])
    w[-1] = math.log(share / (1 - share))
    squares = np.full(x.shape[1], 1e-8)
    rng = np.random.default_rng(11)
    for _ in range(toxicity.PASSES):
        for i in rng.permutation(len(y)):
            g = 1 / (1 + math.exp(-x[i] @ w)) - y[i]
            step = g * x[i]
            step[:n_words] += toxicity.PENALTY * w[:n_words] * x[i, :n_words]
            squares += step**2
            w -= toxicity.RATE * step / np.sqrt(squares)
    return w


def plain_vocabulary(rows, y):
    found = []
    n1, n0 = max(1, y.sum()), max(1, len(y) - y.sum())
    for word in sorted(set().union(*map(set, rows))):
        k1 = sum(word in set(r) for r, label in zip(rows, y) if label == 1)
        k0 = sum(word in set(r) for r, label in zip(rows, y) if label == 0)
        share = (k1 + k0) / (n1 + n0)
        error = math.sqrt(share * (1 - share) * (1 / n1 + 1 / n0)) + 1e-12
        if k1 + k0 >= toxicity.LEAST and abs(k1 / n1 - k0 / n0) > toxicity.DEVIATIONS * error:
            found.append(word)
    return found


def test_chain_against_a_plain_loop_that_fits_each_fold(spark):
    rows = made_texts(220, 4)
    known = learned_rows(rows)
    words = [hashed_text.distinct_word_hashes(r[1]).tolist() for r in known]
    labels = np.array([r[2:] for r in known], dtype=float)

    def learn(keep, k, earlier):
        part = [w for w, x in zip(words, keep) if x]
        y = labels[keep, k]
        vocabulary = plain_vocabulary(part, y)
        at = {w: i for i, w in enumerate(vocabulary)}
        hits = [sorted(at[w] for w in set(r) if w in at) for r in part]
        weights = plain_logistic(hits, earlier[keep], y, len(vocabulary))

        def odds(text_words, dense):
            bag = sum(weights[at[w]] for w in set(text_words) if w in at)
            return bag + sum(a * b for a, b in zip(weights[len(vocabulary) : -1], dense)) + weights[-1]

        return odds

    everything, fold = np.ones(len(known), dtype=bool), np.arange(len(known)) % 3
    earlier, chain = np.zeros((len(known), 0)), []
    for k in range(2):
        chain.append(learn(everything, k, earlier))
        outside = np.zeros(len(known))
        for f in range(3):
            one = learn(fold != f, k, earlier)
            for i in np.flatnonzero(fold == f):
                outside[i] = min(6, max(-6, one(words[i], earlier[i])))
        earlier = np.column_stack([earlier, outside])
    got = {r.doc_id: r for r in toxicity.scores(*frames(spark, rows)).collect()}
    assert len(got) == len(rows)
    for d, text, *_ in rows:
        bag = hashed_text.word_hashes(text).tolist()
        first = chain[0](bag, [])
        second = chain[1](bag, [min(6, max(-6, first))])
        assert got[d].p_quality == pytest.approx(1 / (1 + math.exp(-first)), abs=1e-6)
        assert got[d].p_toxic == pytest.approx(1 / (1 + math.exp(-second)), abs=1e-6)
        assert got[d].predicted == (got[d].p_toxic >= 0.5)
    assert len(pickle.loads(toxicity.fit([tuple(x) for x in labels.astype(int).tolist()], [np.array(w) for w in words]))) == 2
