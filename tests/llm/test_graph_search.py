"""Graph search against brute force: recall, ties, copies, vectors that take no part."""

import math

import numpy as np
import pytest

from nestfold.llm import graph_search, queries


def slow(vectors, k=20):
    """{query id: ids and scores of the k nearest}; vectors: {id: array}."""
    ids = sorted(vectors)
    m = np.stack([vectors[i] for i in ids])
    out = {}
    for i in (i for i in ids if i % 20 == 0):
        scores = (m * vectors[i]).sum(axis=1)
        out[i] = sorted(((-s, j) for s, j in zip(scores.tolist(), ids, strict=True) if j != i))[:k]
    return out


def found(spark, rows, tmp_path):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, node int").repartition(4).write.parquet(str(tmp_path / "embeddings.parquet"))
    out = {}
    for r in queries.op12_graph_search(spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    made = centres[rng.integers(0, 30, 4000)] + 0.3 * rng.normal(size=(4000, 16))
    made *= rng.uniform(0.3, 3, (4000, 1))
    made[100:400] = made[100]  # copies
    return made.astype(np.float32)


def test_recall_against_brute_force(spark, vectors, tmp_path):
    bad = [(9000, None), (9020, []), (9040, [0.0] * 16), (9060, [math.nan] + [1.0] * 15), (9080, [math.inf] + [1.0] * 15), (9100, [None] + [1.0] * 15), (9120, [1.0, 2.0]), (None, [1.0] * 16), (40, [float(x) for x in vectors[40]])]
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(vectors)] + [(i, v, 2) for i, v in bad]
    got, expected = found(spark, rows, tmp_path), slow({i: v.astype(float) for i, v in enumerate(vectors)})
    assert set(got) == set(expected)
    hits = 0
    for i, want in expected.items():
        assert len(got[i]) == 20 and got[i] == sorted(got[i]) and i not in {j for _, j in got[i]}
        exact = {j: (vectors[i].astype(float) * vectors[j].astype(float)).sum() for _, j in got[i]}
        assert all(math.isclose(-s, exact[j], rel_tol=1e-12) for s, j in got[i])
        hits += len({j for _, j in got[i]} & {j for _, j in want})
    assert hits >= 0.95 * 20 * len(expected)
    assert [j for _, j in got[100]] == [j for _, j in expected[100]]  # copies come in the order of their ids


def test_few_vectors_are_all_given(spark, vectors, tmp_path):
    rows = [(i, [float(x) for x in vectors[i + 95]], 1) for i in range(12)]
    got = found(spark, rows, tmp_path)
    assert {i: [j for _, j in x] for i, x in got.items()} == {i: [j for _, j in x] for i, x in slow({i: vectors[i + 95].astype(float) for i in range(12)}).items()}


def test_nothing_and_one(spark, tmp_path):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    one = spark.createDataFrame([(20, [1.0, 2.0])], "vec_id long, embedding array<float>")
    for rows in (none, one):
        fit = graph_search.fit_vectors(rows)
        assert graph_search.search(graph_search.index(fit), fit).count() == 0


def test_every_node_can_be_reached():
    rng = np.random.default_rng(1)
    far = np.concatenate([rng.normal(size=(1, 8)) * 0.001 * rng.normal(size=(700, 1)) + c for c in np.eye(8) * 5])
    g = graph_search.Graph(far + 1e-5 * rng.normal(size=far.shape)).build()
    seen = set(g.entries.tolist())
    ask = list(seen)
    while ask:
        new = {int(e) for e in g.edges[ask.pop()] if e >= 0} - seen
        seen |= new
        ask += new
    assert len(seen) == len(far) and (g.edges >= 0).sum(axis=1).max() <= graph_search.SLACK
    nodes, products = g.beam(g.x[:50], 10)
    assert (products[:, 0] >= np.einsum("ij,ij->i", g.x[:50], g.x[:50]) - 1e-5).all() and (np.diff(products) <= 0).all() and (nodes >= 0).all()


def test_pruning_keeps_diverse_edges():
    """Of three on a line the far one is dropped for the near one that is beside it; one in another direction stays."""
    angle = np.array([0.0, 0.1, 0.15, -0.3])
    g = graph_search.Graph(np.stack([np.cos(angle), np.sin(angle)], axis=1))
    assert g.pruned(np.array([0]), np.array([[2, 3, 1, 1, -1, 0]]))[0, :3].tolist() == [1, 3, -1]
