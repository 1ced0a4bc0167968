import random
import zlib

import numpy as np

from obsengine.llm import quality_classifier as qc


def test_fourier_features_approximate_the_gaussian_kernel(monkeypatch):
    monkeypatch.setattr(qc, "FEATURES", 20_000)
    x = np.random.default_rng(1).normal(size=(12, len(qc.STATISTICS)))
    z = qc.fourier(x, np.zeros(x.shape[1]), np.ones(x.shape[1]))[:, :-1]
    distance = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert abs(z @ z.T - np.exp(-distance / (2 * qc.BANDWIDTH**2))).max() < 0.05


def test_isotonic_is_the_best_rising_fit():
    rng = np.random.default_rng(2)
    n = rng.integers(1, 9, 40)
    good = rng.binomial(n, np.linspace(0.1, 0.9, 40))
    at, share = qc.isotonic(np.arange(40.0), n, good)
    assert (np.diff(at) > 0).all() and (np.diff(share) > 0).all()
    # max-min formula of isotonic regression
    want = [max(min(good[a : b + 1].sum() / n[a : b + 1].sum() for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    assert sorted(set(np.round(want, 12))) == sorted(np.round(share, 12))


def tables(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(1600):
        good = rng.random() < 0.6
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(60)]
        text = " ".join(words) + "." if good else " | ".join(w.upper() + "!!" for w in words[:20]) + " x y" * 20
        docs.append((i, text, 1.0))
        if i % 4:
            labels.append((i, int(good) if i % 50 else None, "n"))
    docs += [(3000, None, 1.0), (3001, "", 1.0), (None, "a b", 1.0), (5, "| " * 200_000, 1.0), (5, "| " * 200_000, 1.0)]
    return spark.createDataFrame(docs, "doc_id long, text string, label double"), spark.createDataFrame(labels, "doc_id long, quality int, x string")


def test_normal_equations_match_one_matrix(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(50, len(qc.STATISTICS))), rng.integers(0, 2, 50).astype(float)
    mean, dev = x.mean(0), x.std(0)
    rows = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "x array<double>, label double").repartition(5)
    gram, target = qc.normal_equations(rows, mean, dev)
    z = qc.fourier(x, mean, dev)
    assert np.allclose(gram, z.T @ z) and np.allclose(target, z.T @ y)


def test_classify(spark):
    docs, labels = tables(spark)
    got = qc.classify(docs, labels).collect()
    truth = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(got) == 1605 and len(held) > 200
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert qc.classify(docs.limit(0), labels).count() == 0
    assert {r.score for r in qc.classify(docs.limit(3), labels.limit(0)).collect()} == {0.5}
