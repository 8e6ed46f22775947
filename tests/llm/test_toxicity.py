import random

import numpy as np
import pytest
from paperloom.llm import toxicity as X


def corpus(n, seed=3):
    random.seed(seed)
    clean = [f"{a}{b}" for a in ("lo", "mi", "ra", "te") for b in ("na", "ko", "su", "pe", "di")]
    rows, labels = [], []
    for i in range(n):
        words = [random.choice(clean) for _ in range(random.randint(5, 80))]
        toxic = i % 9 == 0
        if toxic:
            for _ in range(random.randint(1, 3)):
                words.insert(random.randrange(len(words)), random.choice(["Scumbag", "zorkvile", "zorkmean", "zorkbad"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out(spark, make):
    rows, labels = corpus(1500)
    labelled = spark.createDataFrame(labels, "doc_id long, toxic int")
    docs = make(rows)
    model = X.train(docs, labelled.filter("doc_id % 4 <> 1"))
    got = {r.doc_id: r for r in X.score(docs, model).collect()}
    held = [(i, y) for i, y in labels if i % 4 == 1]
    assert len(got) == len(rows)
    assert sum(got[i].predicted == y for i, y in held) >= 0.98 * len(held)
    # a word never seen raises the score by its seen beginning
    extra = X.score(make([(1, "zorkunseen " + rows[1][1]), (2, rows[1][1])]), model).collect()
    scores = {r.doc_id: r.score for r in extra}
    assert scores[1] > 1.5 * scores[2] and scores[2] < X.THRESHOLD
    kept = X.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def test_without_positives_and_odd_rows(spark, make):
    from llm_cases import ODD

    none = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    docs = make(ODD)
    assert X.train(docs, none.filter("doc_id IS NOT NULL")) is None
    assert {(r.score, r.predicted) for r in X.score(docs, None).collect()} == {(0.0, 0)}
    rows, labels = corpus(400)
    model = X.train(make(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = X.score(docs, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert X.score(make([]), model).count() == 0 and X.drop_toxic(make([]), model).count() == 0


@pytest.mark.parametrize("prior", [0.1, 0.9])
def test_fit_follows_the_risk(prior):
    # the risk as written, over a dense matrix, with gradients by differences; at prior 0.9 the corrected part falls below zero
    rng = np.random.default_rng(5)
    x = (rng.random((60, 7)) < 0.4).astype(float)
    p, u = (rng.random(60) < 0.3).astype(float), (rng.random(60) < 0.8).astype(float)
    x[p == 1, 0] = 1
    owner, cols = np.nonzero(x)
    soft = lambda f: np.log1p(np.exp(f))

    def parts(theta):
        f = x @ theta[:-1] + theta[-1]
        mean = lambda w, loss: (w * loss).sum() / w.sum()
        return prior * mean(p, soft(-f)), mean(u, soft(f)) - prior * mean(p, soft(f))

    def slope(g, theta):
        unit = np.eye(len(theta)) * 1e-5
        return np.array([(g(theta + e) - g(theta - e)) / 2e-5 for e in unit])

    theta, m, v, fell = np.append(np.zeros(7), np.log(prior / (1 - prior))), 0.0, 0.0, 0
    for t in range(1, 41):
        above = parts(theta)[1] >= 0
        fell += not above
        grad = slope((lambda z: sum(parts(z))) if above else (lambda z: -parts(z)[1]), theta)
        grad[:-1] += 1e-4 * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    model = X._fit(p, u, owner, cols, np.arange(7), prior, steps=40)
    assert np.allclose(np.append(model.weights, model.bias), theta, atol=2e-3)
    assert (fell > 0) == (prior == 0.9)
