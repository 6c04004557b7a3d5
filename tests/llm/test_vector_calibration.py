"""op10's visits are calibrated against all vectors, however small the fitting sample is."""

import numpy as np
import pytest

from quernspark.llm import vectordedup


@pytest.mark.parametrize("sample,cell", [(20_000, 16), (300, 16), (300, 1)])
def test_recall_with_a_small_sample(spark, monkeypatch, sample, cell):
    monkeypatch.setattr(vectordedup, "SAMPLE", sample)
    monkeypatch.setattr(vectordedup, "CELL", cell)  # a cell of one vector: a fine grid
    rng = np.random.default_rng(3)
    x = rng.normal(size=(5000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    far = rng.normal(size=(900, 16))
    base = x[:900]
    far -= (far * base).sum(axis=1, keepdims=True) * base
    far /= np.linalg.norm(far, axis=1, keepdims=True)
    cos = rng.uniform(0.9801, 0.999, size=(900, 1))
    v = np.concatenate([x, cos * base + np.sqrt(1 - cos**2) * far])
    label = np.arange(len(v)) % 900 % 3
    label[5000:] = label[:900]
    rows = spark.createDataFrame([(i, r.tolist(), int(g)) for i, (r, g) in enumerate(zip(v, label))], "vec_id long, embedding array<double>, label int")
    got = {r.key: r.n_links for r in vectordedup.near_vectors(rows.repartition(4)).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    link = (u @ u.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(link, False)
    n = np.array([got[i] for i in range(len(v))])
    assert (n <= link.sum(axis=1)).all() and n.sum() >= 0.99 * link.sum() > 0


def test_ranks_and_visits():
    rank = np.arange(1, 3000)
    up = vectordedup.rounded_up(rank)
    assert (up >= rank).all() and (up <= rank * 1.1 + 1).all() and len(np.unique(up)) < 100
    assert vectordedup.enough_visits(np.array([5, 1, 9]), np.array([1.0, 8.0, 1.0]), 0.9) == 5
