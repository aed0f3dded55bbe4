"""Exact places of an order by digits, and lookup of intervals, against plain ones."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from nestfold.functions import selection, statistics
from nestfold.functions.keys import ShardMap, owners
from nestfold.operators import tables
from nestfold.plans.queries import QUERIES


def bits(x):
    b = struct.unpack("<Q", struct.pack("<d", abs(x)))[0]
    return -b if x < 0 else b


def test_bits_of_doubles_keep_their_order(spark):
    rng = random.Random(1)
    xs = [0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, 1.7976931348623157e308, -1.7976931348623157e308, 1.0, 3.0]
    xs += [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(2000)]
    xs += [float(x) for k in range(-1073, 1024) for x in (2.0**k, np.nextafter(2.0**k, 0), np.nextafter(2.0**k, np.inf))]
    xs = [x for x in xs if np.isfinite(x)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", selection.ordered_bits(F.col("x")).alias("b")).collect()
    assert [r["b"] for r in got] == [bits(r["x"]) for r in got]


def test_quantiles_of_groups_and_columns(spark):
    rng = random.Random(2)
    rows = [(i % 3 or None, rng.choice([rng.gauss(0, 1), float(rng.randrange(5)), -3.5]), rng.random() * 1e9 if i % 7 else rng.choice([None, float("nan"), float("inf")])) for i in range(1500)]
    df = spark.createDataFrame(rows, "g int, a double, b double")
    shares = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
    found = {(r["g"], r["column"], r["share"]): r["value"] for r in selection.quantiles(df, ["a", "b"], shares, ["g"]).collect()}
    for g in (None, 1, 2):
        for c, k in (("a", 1), ("b", 2)):
            v = [r[k] for r in rows if r[0] == g and r[k] is not None and np.isfinite(r[k])]
            for s in shares:
                assert found[(g, c, s)] == pytest.approx(np.quantile(v, s), rel=1e-12)
    assert len(found) == 36 and selection.quantiles(df.where("false"), ["a"], shares).count() == 0
    made = {(r["g"], r["column"]): r for r in statistics.summaries(df, ["a", "b"], ["g"]).collect()}
    assert made[(None, "b")]["n"] == 500 and made[(None, "b")]["n_nonfinite"] > 20 and made[(1, "a")]["q0"] == -3.5


def test_no_quantile_sorts_by_ranges(spark):
    """One value that nearly all rows have is in no single task: rows are counted where they are."""
    df = spark.range(5000).select(F.when(F.col("id") < 4900, 7.0).otherwise(F.col("id").cast("double")).alias("v"))
    plan = selection.quantiles(df, ["v"], [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    assert statistics.quantiles(df, "v", [0.5, 0.98, 1.0]) == [7.0, pytest.approx(np.quantile([7.0] * 4900 + [*range(4900, 5000)], 0.98)), 4999.0]


@pytest.mark.parametrize("gap", [1, 1 << 40])
def test_ranges_of_equal_counts_of_sparse_keys(spark, gap):
    rng = random.Random(3)
    keys = sorted({rng.randrange(1 << 20) * gap + rng.randrange(3) for _ in range(700)})
    events = spark.createDataFrame([(k,) for k in keys], "event_id long")
    made = tables.event_ranges(events, 90)
    sizes = [sum(a <= k < b for k in keys) for a, b in made]
    assert sum(sizes) == len(keys) and max(sizes) - min(sizes) <= 1 and max(sizes) <= 90 and len(made) == -(-len(keys) // 90)
    assert all(x[1] == y[0] for x, y in zip(made, made[1:], strict=False))


def test_lookup_in_many_intervals_has_a_plan_of_constant_size(spark):
    few, many = (ShardMap([(f"s, {k}", 10 * k + 5, 10 * k + 12) for k in range(n)]) for n in (3, 100_000))
    rows = spark.createDataFrame([(x,) for x in (0, 4, 5, 11, 12, 15, 500_007, 999_995, 1_000_001, 1_000_002, 1 << 50, None)], "x long")
    size = lambda m: rows.select(m.column(F.col("x")).alias("s"))._jdf.queryExecution().analyzed().expressions().mkString().count("CASE")
    assert size(few) == size(many)
    got = [r["s"] for r in rows.select(many.column(F.col("x")).alias("s")).collect()]
    assert got == [None, None, "s, 0", "s, 0", None, "s, 1", "s, 50000", "s, 99999", "s, 99999", None, None, None]
    open_ended = ShardMap([("a", 0, 2), ("b", 2, None)])
    assert [r[0] for r in rows.select(open_ended.column(F.col("x"))).collect()][:3] == ["a", "b", "b"]


@pytest.mark.parametrize("rows", [7, 100, 10**6])
def test_owners_among_intervals_that_are_rows(spark, rows):
    rng = random.Random(rows)
    edges = sorted({rng.randrange(-(2**62), 2**62) for _ in range(300)} | set(range(0, 400, 2)))
    edges = edges[: len(edges) // 2 * 2]
    split = [(f"p{i}", lo, hi) for i, (lo, hi) in enumerate(zip(edges[::2], edges[1::2], strict=True))] + [("rest", 2**62 + 5, None)]
    keys = [e + d for e in edges for d in (-1, 0, 1)] + [None, None, 0, 0, 0, 2**62 + 4, 2**62 + 5, 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "key long, n int")
    found = owners(df, "key", spark.createDataFrame(split, "name string, start long, stop long"), "who", rows)
    want = [next((s for s, lo, hi in split if k is not None and lo <= k and (hi is None or k < hi)), None) for k in keys]
    assert found.columns == ["key", "n", "who"]
    assert [tuple(r) for r in found.orderBy("n").collect()] == [(k, n, w) for n, (k, w) in enumerate(zip(keys, want, strict=True))]


def test_interval_query_keeps_no_interval_on_the_driver(spark):
    made = QUERIES["interval_lookup"](spark, "/root/testdata/sf0.001")
    assert "part17" not in made._jdf.queryExecution().optimizedPlan().toString() and made.where("shard = 'part17'").count() == 2


def test_no_filter_works_out_the_keys_of_values(spark, monkeypatch):
    """A filter shares no steps, so a key that one repeats costs many logarithms for each value."""
    real, plans = selection.written, []

    def seen(df, label):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, label)

    monkeypatch.setattr(selection, "written", seen)
    rows = spark.range(64).select((F.col("id") % 3).alias("g"), (F.col("id") * 1.5 - 7).alias("v"))
    found = selection.quantiles(rows, ["v"], [0.0, 0.5, 1.0], ["g"])
    assert {(r["g"], r["share"]): r["value"] for r in found.collect()}[(0, 0.5)] == 31.5 * 1.5 - 7
    assert any("LOG2" in p for p in plans)
    assert not [line for p in plans for line in p.splitlines() if "Filter" in line and "LOG2" in line]
