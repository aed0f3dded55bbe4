"""Matching within tolerance, a network of sets, and invented events."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nestfold.operators import set_network
from nestfold.sources.datasets import sample_rows, synthetic_events
from nestfold.tools.scoring import compare, unmatched


def slow_unmatched(got, expected, rtol, atol):
    """The largest number of pairs by augmenting paths, value by value; what is left of ``got``."""
    near = [[j for j, q in enumerate(expected) if (p != p and q != q) or p == q or (math.isfinite(p) and math.isfinite(q) and abs(p - q) <= atol + rtol * abs(q))] for p in got]
    owner = {}

    def place(i, seen):
        for j in near[i]:
            if j not in seen:
                seen.add(j)
                if j not in owner or place(owner[j], seen):
                    owner[j] = i
                    return True
        return False

    return len(got) - sum(place(i, set()) for i in range(len(got)))


@pytest.mark.parametrize(("seed", "rtol", "atol"), [(1, 0.0, 1.0), (2, 0.125, 0.0), (3, 0.0, 0.0), (4, 0.0, 40.0)])
def test_matching_equals_brute_force(spark, seed, rtol, atol):
    """Whole numbers, so that many differ by just the tolerance; more ranges than values need."""
    rng = random.Random(seed)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    for k in range(2):
        a, b = ([float(rng.randrange(-60, 60) if rng.random() < 0.8 else rng.choice([7, math.nan, math.inf, -math.inf])) for _ in range(90)] for _ in "ab")
        frames = [spark.createDataFrame([(x,) for x in xs], "value double") for xs in (a, b)]
        if k:
            frames = [f.repartition(5) for f in frames]
        assert unmatched(*frames, rtol, atol) == slow_unmatched(a, b, rtol, atol)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_wrong_value_of_many_is_one(spark):
    values = spark.range(1000).select((F.col("id") * 1.5).alias("value"))
    wrong = values.withColumn("value", F.when(F.col("value") == 300, 1e6).otherwise(F.col("value")))
    assert compare(wrong, values) == (False, "1 of 1000 values differ") and compare(values, values)[0]
    nulls = values.withColumn("value", F.when(F.col("value") > 9, F.col("value")))
    assert compare(nulls, nulls)[0] and not compare(nulls, values)[0]
    assert compare(values.limit(3), values) == (False, "3 values, expected 1000")


def test_slope_of_the_loss():
    rng = np.random.default_rng(1)
    counts = np.array([3, 0, 5, 1])
    x, y, flat = rng.normal(size=(9, 4)), rng.normal(size=4), set_network.start(4, 6, 2)
    loss, slope = set_network.gradient(flat, 6, x, counts, y)
    w = set_network.cut(flat, 4, 6)
    relu = lambda v: np.maximum(v, 0)
    value = [(relu(sum((relu(relu(o @ w[0] + w[1]) @ w[2] + w[3]) for o in part), np.zeros(6)) @ w[4] + w[5]) @ w[6] + w[7])[0] for part in np.split(x, np.cumsum(counts)[:-1])]
    assert loss == pytest.approx(((np.array(value) - y) ** 2).sum())
    for i in rng.integers(0, len(flat), 40):
        step = np.zeros(len(flat))
        step[i] = 1e-6
        two = [set_network.gradient(flat + s * step, 6, x, counts, y)[0] for s in (1, -1)]
        assert (two[0] - two[1]) / 2e-6 == pytest.approx(slope[i], abs=1e-4)


def plainly(x, counts, y, hidden, epochs, rate, seed=0):
    """Weights after steps over all events at once."""
    flat = set_network.start(x.shape[1], hidden, seed)
    speed, spread = np.zeros(len(flat)), np.zeros(len(flat))
    for k in range(1, epochs + 1):
        slope = set_network.gradient(flat, hidden, x, counts, y)[1] / len(y)
        speed, spread = 0.9 * speed + 0.1 * slope, 0.999 * spread + 0.001 * slope**2
        flat = flat - rate * (speed / (1 - 0.9**k)) / (np.sqrt(spread / (1 - 0.999**k)) + 1e-8)
    return flat


def test_network_learns_what_sums_of_products_do_not_give():
    rng = np.random.default_rng(1)
    counts = rng.poisson(3, 800)
    x, event = rng.normal(size=(counts.sum(), 2)), np.repeat(np.arange(800), counts)
    y = np.bincount(event, np.maximum(0, 0.7 - np.abs(x[:, 0])), 800)
    y = (y - y.mean()) / y.std()
    flat = plainly(x[event < 600], counts[:600], y[:600], 16, 300, 1e-2)
    value = set_network.forward(set_network.cut(flat, 2, 16), x[event >= 600], counts[600:])[0]
    sums = np.stack([np.bincount(event, v, 800) for v in (np.ones(len(x)), x[:, 0], x[:, 1], x[:, 0] ** 2, x[:, 1] ** 2, x[:, 0] * x[:, 1])] + [np.ones(800)], axis=1)
    linear = sums[600:] @ np.linalg.lstsq(sums[:600], y[:600], rcond=None)[0]
    assert ((value - y[600:]) ** 2).mean() < ((linear - y[600:]) ** 2).mean() / 2


def test_training_in_spark_is_the_plain_one(spark):
    events = synthetic_events(spark, 600, 4.0, 7, parts=3)
    network, score, told = set_network.train(events, hidden=8, epochs=6, steps=1, rate=2e-2)
    rows = events.selectExpr("jets", "met_pt", "pmod(xxhash64(event_id), 5) = 0 AS test").collect()
    x = np.array([[j[f] for f in network.fields] for r in rows for j in r["jets"]])
    assert np.allclose(network.centre, x.mean(axis=0)) and np.allclose(network.scale, x.std(axis=0))
    met = np.array([r["met_pt"] for r in rows])
    mine = [r for r in rows if not r["test"]]
    scaled = (np.array([[j[f] for f in network.fields] for r in mine for j in r["jets"]]) - network.centre) / network.scale
    y = (np.array([r["met_pt"] for r in mine]) - met.mean()) / met.std()
    assert np.allclose(plainly(scaled, np.array([len(r["jets"]) for r in mine]), y, 8, 6, 2e-2), network.flat, atol=1e-8)
    assert told[-1] < told[0] and len(told) == 6 and score < 1
    turned = events.withColumn("jets", F.reverse("jets"))
    a, b = ({r["event_id"]: r["value"] for r in set_network.predict(network, e).select("event_id", "value").collect()} for e in (events, turned))
    assert len(a) == 600 and all(math.isclose(a[i], b[i], rel_tol=1e-9, abs_tol=1e-9) for i in a)
    assert math.isnan(set_network.r2(set_network.predict(network, events.limit(0)), "met_pt"))


def test_steps_add_up_to_one_gradient(spark):
    rows = spark.createDataFrame([([[float(i), 1.0]] * (i % 4), float(i)) for i in range(50)], "x array<array<double>>, y double")
    flat = set_network.start(2, 3, 1)
    x = np.array([[float(i), 1.0] for i in range(50) for _ in range(i % 4)])
    whole = set_network.gradient(flat, 3, x, np.array([i % 4 for i in range(50)]), np.arange(50.0))
    for parts in (1, 40):
        n, loss, slope = set_network._step(rows.repartition(parts), flat, 3, 2, fan=3)
        assert n == 50 and loss == pytest.approx(whole[0]) and np.allclose(slope, whole[1])


def test_sample_events(spark):
    a, b = sample_rows(spark, 2000, 3, parts=2), sample_rows(spark, 2000, 3, triggers=False, parts=7)
    assert a.drop("HLT_IsoMu24", "HLT_IsoMu27").exceptAll(b).count() == 0 and b.count() == 2000
    assert a.schema.simpleString() == "struct<run:int,luminosityBlock:int,event:bigint,MET_pt:double,MET_phi:double,Jet_pt:array<double>,Jet_eta:array<double>,Jet_phi:array<double>,Jet_mass:array<double>,Muon_pt:array<double>,Muon_eta:array<double>,Muon_phi:array<double>,Muon_mass:array<double>,Muon_charge:array<int>,HLT_IsoMu24:boolean,HLT_IsoMu27:boolean>"
    r = a.agg(F.min(F.size("Jet_pt")), F.max(F.size("Jet_pt")), F.max(F.size("Muon_pt")), F.avg("MET_pt"), F.avg(F.get("Jet_pt", F.lit(0))), F.avg(F.get("Muon_charge", F.lit(0)))).first()
    assert tuple(r)[:3] == (0, 7, 4) and abs(r[3] - 30) < 3 and abs(r[4] - 55) < 5 and abs(r[5]) < 0.1
    fired = a.where("HLT_IsoMu24")
    assert fired.where("array_max(Muon_pt) <= 24").count() == 0 and 0.8 < fired.count() / a.where("array_max(Muon_pt) > 24").count() < 0.97
    assert sample_rows(spark, 2000, 4).exceptAll(a).count() > 1990
    assert "LocalTableScan" not in sample_rows(spark, 10**8)._jdf.queryExecution().executedPlan().toString()
