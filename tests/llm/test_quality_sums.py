"""What the driver gets while the quality classifier learns does not follow the number of tasks."""

import random

import numpy as np
import pytest
from pyspark.sql import DataFrame

from nestfold.llm import quality


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    made = []
    for i in range(400):
        q = i % 3 % 2
        x = [rng.gauss(0.4 * q, 1) for _ in quality.NAMES]
        made.append((q, x))
    return spark.createDataFrame(made, "quality int, x array<float>")


@pytest.fixture
def collected(monkeypatch):
    got = []
    real = DataFrame.collect

    def counting(self):
        out = real(self)
        got.append(sum(len(str(tuple(r))) if len(r) > 3 else len(r) for r in out))
        return out

    monkeypatch.setattr(DataFrame, "collect", counting)
    return got


def test_sums_are_made_on_the_executors(spark, rows, collected):
    models, sizes = [], []
    for parts in (4, 64):
        collected.clear()
        models.append(quality.fit_pairs(rows.repartition(parts)))
        sizes.append(list(collected))
    for a, b in zip(*(m.__dict__.values() for m in models), strict=True):
        assert np.allclose(a, b, rtol=1e-9)
    assert sizes[0] == sizes[1]


def test_places_and_spreads_are_exact(rows):
    x = np.array([r["x"] for r in rows.collect()], np.float32).astype(float)
    q = np.array([r["quality"] for r in rows.collect()])
    (bad, good), mean, deviation = quality._spreads(rows)
    assert (bad, good) == (int((q == 0).sum()), int(q.sum()))
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(deviation, x.std(axis=0))
    m = quality.Model(np.linspace(-1, 1, x.shape[1]), mean, deviation, 0.0, 1.0)
    u = m.utility(x)
    places = [(None, 0), (None, 399), (0, bad // 2), (1, good // 2), (1, 0)]
    expected = [np.sort(u if k is None else u[q == k])[p] for k, p in places]
    assert quality._at_places(rows, m, places) == expected
