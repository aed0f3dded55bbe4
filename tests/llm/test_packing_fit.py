"""The least-squares fit of pattern packing against a plain solver, and its patterns against all."""

import random
from itertools import combinations_with_replacement

import numpy as np
import pytest

from nestfold.llm import packing


def plain_fit(p, counts, rounds=4000):
    """Coordinate by coordinate to the least weighted squares with no negative repeat."""
    size = len(counts)
    weight = np.sqrt(np.arange(size) / (size - 1))
    a = np.zeros((size, len(p)))
    for j, row in enumerate(p):
        for v in row:
            a[v, j] += weight[v] if v else 0
    target, x = weight * counts, np.zeros(len(p))
    rest, norms = target.copy(), (a * a).sum(axis=0)
    for _ in range(rounds):
        for j in range(len(p)):
            new = max(0.0, x[j] + a[:, j] @ rest / norms[j])
            rest += a[:, j] * (x[j] - new)
            x[j] = new
    return x, a, target


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fit_is_the_least_squares(seed):
    rng = random.Random(seed)
    most = 24
    counts = np.zeros(most + 1)
    for v in rng.sample(range(1, most + 1), 10):
        counts[v] = rng.randint(1, 200)
    p = packing.patterns(np.flatnonzero(counts), most)
    assert len(p) > 3
    x, a, target = plain_fit(p, counts)
    got = packing.fit(p, counts, steps=6000)
    error = lambda y: float(((a @ y - target) ** 2).sum())
    assert (got >= 0).all() and error(got) == pytest.approx(error(x), rel=1e-3, abs=1e-3)
    assert error(packing.fit(p, counts)) <= 1.05 * error(x) + 0.01 * float(target @ target)  # with the usual number of steps


def test_patterns_are_all_that_fill_a_sequence():
    there, most = [1, 3, 4, 7, 8, 12], 12
    made = {tuple(sorted(v for v in row if v)) for row in packing.patterns(np.array(there), most).tolist()}
    assert made == {c for n in (1, 2, 3) for c in combinations_with_replacement(there, n) if sum(c) == most}


def test_whole_plan_holds_each_piece_and_few_sequences():
    rng = np.random.default_rng(4)
    counts = np.bincount(rng.integers(1, 65, 3000), minlength=65)
    plan = packing.plan(counts, 64)
    held = np.zeros(65, int)
    for lengths, repeats in plan:
        assert sum(lengths) <= 64
        for v in lengths:
            held[v] += repeats
    assert (held == counts).all()
    least = -(-int(counts @ np.arange(65)) // 64)
    assert sum(r for _, r in plan) <= 1.02 * least + 1
