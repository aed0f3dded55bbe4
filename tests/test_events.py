"""Nested events: micro events with known answers, round trips, keys, loading."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nestfold.functions import lists, statistics
from nestfold.functions.keys import KeyLayout, Manifest, ShardMap, check_conversion
from nestfold.operators import nesting, record, regression, shards, tables
from nestfold.plans import adl
from nestfold.sources.datasets import DIMUON, NANOAOD, chunks, keyed, read, sample_rows, synthetic_events
from nestfold.sources.datasets import tables as tables_of
from nestfold.streaming.ingest import ingest_new

OBJECT = "array<struct<pt:double,eta:double,phi:double,mass:double,charge:int>>"


def event(spark, met=(100.0, 0.0), jets=(), muons=()):
    full = lambda xs: [(*x, 1)[:5] if len(x) < 5 else x for x in xs]
    return spark.createDataFrame([(1, *map(float, met), full(jets), full(muons))], f"event_id long, met_pt double, met_phi double, jets {OBJECT}, muons {OBJECT}")


def values(df):
    return [r["value"] for r in df.collect()]


def test_q8_formula(spark):
    e = event(spark, muons=[(45.0, 0.0, 0.0, 0.105, 1), (45.0, 0.0, math.pi, 0.105, -1), (30.0, 0.0, 0.3, 0.105, 1)])
    assert values(adl.q8(e)) == [pytest.approx(math.sqrt(2 * 30 * 100 * (1 - math.cos(0.3))))]
    assert values(adl.q5(e)) == [100.0]


def test_q6_needs_three_jets(spark):
    three = [(50.0, 0.0, 0.0, 5.0), (60.0, 0.0, 2.0, 5.0), (70.0, 0.5, -2.0, 5.0)]
    x = sum(p * math.cos(phi) for p, _, phi, _ in three)
    y = sum(p * math.sin(phi) for p, _, phi, _ in three)
    assert values(adl.q6(event(spark, jets=three))) == [pytest.approx(math.hypot(x, y))]
    assert values(adl.q6(event(spark, jets=three[:2]))) == []


def test_q7_drops_jets_near_muons(spark):
    jets = [(50.0, 0.0, 0.0, 1.0), (60.0, 0.0, 2.0, 1.0)]
    assert values(adl.q7(event(spark, jets=jets, muons=[(20.0, 0.02, 0.02, 0.1, 1)]))) == [60.0]
    assert values(adl.q7(event(spark))) == [0.0]


def test_flat_and_nested_round_trip(spark, tmp_path):
    sample_rows(spark, 120, 1).coalesce(1).write.parquet(str(tmp_path / "s"))
    made = tables_of(keyed(read(spark, str(tmp_path / "s"), NANOAOD), NANOAOD, 3), NANOAOD)
    flags = made["events"].select("hlt_mu17_mu8_dz").distinct().collect()
    assert [r[0] for r in flags] == [None]
    nest = nesting.nest(made["events"], {"jets": made["jets"], "muons": made["muons"]}, {"jets": "jet_index", "muons": "muon_index"}, check=True)
    assert nest.where("size(jets) <> n_jets OR size(muons) <> n_muons").count() == 0
    back = nesting.unnest(nest, "jets", "jet_index")
    assert back.exceptAll(made["jets"].select(back.columns)).count() == 0 == made["jets"].count() - back.count()
    assert adl.q1(nest).count() == 120 and adl.q2(nest).count() == made["jets"].count()
    with pytest.raises(ValueError, match="without an event"):
        nesting.nest(made["events"].where("n_jets < 3"), {"jets": made["jets"]}, {"jets": "jet_index"}, check=True)


def test_wide_slots(spark):
    cols = {"Run": 1, "Event": 7, "Type": "GG", "M": 91.0} | {f"{f}{i}": float(i) for f in ("E", "px", "py", "pz", "pt", "eta", "phi") for i in (1, 2)} | {"Q1": 1, "Q2": -1, "entry": 0}
    rows = spark.createDataFrame([tuple(cols.values())], list(cols))
    made = tables_of(keyed(rows, DIMUON), DIMUON)
    assert [(r["muon_index"], r["charge"]) for r in made["muons"].orderBy("muon_index").collect()] == [(0, 1), (1, -1)]
    assert made["events"].first()["n_muons"] == 2
    with pytest.raises(ValueError, match="missing"):
        DIMUON.check(rows.drop("Q1"))


def test_keys(spark):
    layout, narrow = KeyLayout(), KeyLayout(31)
    df = spark.createDataFrame([(5, 7), (0, 0)], "f long, e long").withColumn("event_id", layout.pack(F.col("f"), F.col("e")))
    assert {r["event_id"] for r in df.collect()} == {layout.key(5, 7), 0}
    assert df.where((layout.file_of(F.col("event_id")) == F.col("f")) & (layout.entry_of(F.col("event_id")) == F.col("e"))).count() == 2
    assert {r[0] for r in df.select(layout.converted(F.col("event_id"), narrow)).collect()} == {narrow.key(5, 7), 0}
    with pytest.raises(ValueError):
        check_conversion(df, layout, KeyLayout(2))
    with pytest.raises(ValueError):
        KeyLayout(63)
    with pytest.raises(Exception, match="does not fit"):
        df.select(KeyLayout(2).pack(F.col("f"), F.col("e"))).collect()
    m = Manifest()
    m.add("/a")
    with pytest.raises(ValueError):
        m.add("/a")
    assert Manifest.from_json(m.to_json()).file_id("/a") == 0
    assert ShardMap.split(10, 3).shard_for(9) == "shard2" and ShardMap.from_json(ShardMap.split(4, 2).to_json()).shard_for(0) == "shard0"


def test_loading_is_idempotent_and_migrates(spark, tmp_path):
    m = Manifest()
    for n, size in enumerate((30, 20)):
        path = str(tmp_path / f"f{n}")
        sample_rows(spark, size, n).coalesce(1).write.parquet(path)
        m.add(path, size)
    root = str(tmp_path / "db")
    record.ingest(spark, m, NANOAOD, root)
    first = sorted(r["event_id"] for r in tables.stored(spark, root, "events").collect())
    record.ingest(spark, m, NANOAOD, root)
    assert sorted(r["event_id"] for r in tables.stored(spark, root, "events").collect()) == first and len(first) == 50
    lo, hi = m.layout.range_of(1)
    assert tables.stored(spark, root, "events", (lo, hi), m.layout).count() == 20
    tables.migrate(spark, root, str(tmp_path / "db31"), ["events", "jets"], m.layout, KeyLayout(31))
    moved = tables.stored(spark, str(tmp_path / "db31"), "events")
    assert sorted(r["event_id"] for r in moved.collect()) == sorted(KeyLayout(31).key(*m.layout.split(k)) for k in first)
    ranges = tables.event_ranges(tables.stored(spark, root, "events"), 12)
    sizes = [sum(a <= k < b for k in first) for a, b in ranges]
    assert len(ranges) == 5 and sum(sizes) == 50 and max(sizes) - min(sizes) <= 1 and max(sizes) <= 12
    assert tables.event_ranges(tables.stored(spark, root, "events"), 50) is None
    m.add(str(tmp_path / "none"))
    with pytest.raises(ValueError, match="nothing was loaded"):
        record.ingest(spark, m, NANOAOD, root)


def test_stream_takes_only_what_is_new(spark, tmp_path):
    folder, m = tmp_path / "in", Manifest()
    args = (spark, str(folder), m, NANOAOD, str(tmp_path / "db"), str(tmp_path / "cp"))
    for n, size in enumerate((15, 25)):
        sample_rows(spark, size, n).coalesce(1).write.mode("append").parquet(str(folder))
        for f in sorted(folder.glob("*.parquet")):
            if str(f) not in {x["path"] for x in m.files}:
                m.add(str(f), size)
        ingest_new(*args)
    assert tables.stored(spark, str(tmp_path / "db"), "events").count() == 40


def test_stream_refuses_what_is_not_listed(spark, tmp_path):
    folder = tmp_path / "in put+é"
    sample_rows(spark, 10, 1).coalesce(1).write.parquet(str(folder))
    args = (spark, str(folder), Manifest(), NANOAOD, str(tmp_path / "db"))
    with pytest.raises(Exception, match="not in the manifest"):
        ingest_new(*args, str(tmp_path / "cp1"))
    m = Manifest()
    for f in folder.glob("*.parquet"):
        m.add(str(f), 10, 4)
    ingest_new(spark, str(folder), m, NANOAOD, str(tmp_path / "db"), str(tmp_path / "cp2"))
    ids = {r["event_id"] for r in tables.stored(spark, str(tmp_path / "db"), "events").collect()}
    assert ids == {m.layout.key(4, i) for i in range(10)}


def test_a_folder_of_several_files_has_no_places(spark, tmp_path):
    sample_rows(spark, 40, 1).repartition(3).write.parquet(str(tmp_path / "many"))
    sample_rows(spark, 40, 1).coalesce(1).write.parquet(str(tmp_path / "one"))
    assert [c.count() for c in chunks(spark, str(tmp_path / "one"), NANOAOD, 15, 5)] == [15, 15, 5]
    sizes = [c.count() for c in chunks(spark, str(tmp_path / "one"), NANOAOD, "8 kB")]
    assert sum(sizes) == 40 and 1 < len(sizes) < 40 and len(set(sizes[:-1])) == 1
    assert len(list(chunks(spark, str(tmp_path / "one"), NANOAOD, "100 MB"))) == 1
    with pytest.raises(ValueError, match="nor a size"):
        list(chunks(spark, str(tmp_path / "one"), NANOAOD, "many"))
    with pytest.raises(ValueError, match="file id of its own"):
        read(spark, str(tmp_path / "many"), NANOAOD)


def test_migration_in_place_and_check_only(spark, tmp_path):
    """From 4 to 6 bits of entries, where new keys of one file are old keys of another."""
    root, old, new = str(tmp_path / "db"), KeyLayout(4), KeyLayout(6)
    keys = [(f, e) for f in range(6) for e in range(4)]
    rows = spark.createDataFrame([(old.key(f, e), 10 * f + e) for f, e in keys], "event_id long, v int")
    tables.load({"events": rows, "jets": rows}, root, old)
    tables.migrate(spark, root, root, ["events", "jets"], old, new, check_only=True)
    assert {r["event_id"] for r in tables.stored(spark, root, "jets").collect()} == {old.key(f, e) for f, e in keys}
    tables.migrate(spark, root, root, ["events", "jets"], old, new)
    for name in ("events", "jets"):
        assert {(r["event_id"], r["v"]) for r in tables.stored(spark, root, name).collect()} == {(new.key(f, e), 10 * f + e) for f, e in keys}
    with pytest.raises(ValueError, match="does not fit"):
        tables.migrate(spark, root, root, ["events"], new, KeyLayout(1), check_only=True)


def made_file(spark, path, n, seed, muons=True):
    rows = sample_rows(spark, n, seed)
    if not muons:
        rows = rows.withColumns({c: F.slice(c, 1, 0) for c in rows.columns if c.startswith("Muon_")})
    rows.coalesce(1).write.mode("overwrite").parquet(path)


def test_replacing_a_file_takes_all_its_old_rows(spark, tmp_path):
    """Also from tables for which it has no rows any more."""
    path, root, m = str(tmp_path / "f"), str(tmp_path / "db"), Manifest()
    made_file(spark, path, 20, 1)
    m.add(path)
    assert record.ingest(spark, m, NANOAOD, root) == 20
    assert tables.stored(spark, root, "muons").count() > 0
    made_file(spark, path, 20, 1, muons=False)
    record.ingest(spark, m, NANOAOD, root)
    assert tables.stored(spark, root, "muons").count() == 0
    assert tables.stored(spark, root, "events").count() == 20


def test_replacing_a_range_of_entries_leaves_the_others(spark, tmp_path):
    path, root, m = str(tmp_path / "f"), str(tmp_path / "db"), Manifest()
    made_file(spark, path, 20, 1)
    m.add(path)
    everything = lambda: {n: sorted(map(str, tables.stored(spark, root, n).collect())) for n in ("events", "jets", "muons")}
    record.ingest(spark, m, NANOAOD, root)
    before = everything()
    assert record.ingest(spark, m, NANOAOD, root, entries=(0, 5)) == 5
    assert everything() == before
    for entries in ((0, 7), (7, 13), (13, None)):  # in chunks, to another root
        record.ingest(spark, m, NANOAOD, f"{root}2", entries=entries)
    root = f"{root}2"
    assert everything() == before
    tables.truncate(spark, root, ["events", "jets"])
    assert tables.stored(spark, root, "events").count() == 0 < tables.stored(spark, root, "muons").count()
    tables.create(spark, root, {"muons": tables.stored(spark, root, "muons").schema}, drop=True)
    assert tables.stored(spark, root, "muons").count() == 0


def test_shards(spark, tmp_path):
    m, root = Manifest(), str(tmp_path / "db")
    for n, size in enumerate((12, 8, 10)):
        path = str(tmp_path / f"f{n}")
        made_file(spark, path, size, n)
        m.add(path)
    with pytest.raises(ValueError, match="no shard owns"):
        record.ingest(spark, m, NANOAOD, root, shards=ShardMap([("a", 0, 2)]))
    split = ShardMap([("a", 0, 2), ("b", 2, 3), ("empty", 3, None)])
    assert record.ingest(spark, m, NANOAOD, root, shards=split) == 30
    both = shards.fetch(spark, root, split)
    ids = [r["event_id"] for r in both.select("event_id").collect()]
    assert ids == sorted(ids) and len(ids) == 30
    assert shards.fetch_shard(spark, root, "b", "met_pt > 0", ["jets"], ["event_id"]).columns == ["event_id", "jets"]
    few = shards.fetch(spark, root, split, "n_jets >= 5", [], ["event_id", "n_jets"])
    assert few.count() == both.where("size(jets) >= 5").count()
    assert shards.misrouted(spark, root, split, "events", m.layout).count() == 0
    found = shards.map_events(spark, root, split, lambda e: {"n": len(e), "met": e.column("met_pt").to_numpy(), "in": {"jets": sum(map(len, e.column("jets").to_pylist()))}})
    assert {(r["shard"], *r["path"]): r["whole"] for r in found.where("item IS NULL").collect()} == {("a", "n"): 20, ("b", "n"): 10, **{(s, "in", "jets"): shards.fetch_shard(spark, root, s).agg(F.sum(F.size("jets"))).first()[0] for s in "ab"}}
    whole = shards.as_result(shards.merged(found))
    assert whole["n"] == 30 and whole["in"]["jets"] == both.agg(F.sum(F.size("jets"))).first()[0]
    assert whole["met"] == sorted(r["met_pt"] for r in both.collect())
    few = shards.map_events(spark, root, split, len, where=f"event_id < {2 << 40} AND met_pt > 20", collections=())
    assert {r["shard"]: r["whole"] for r in few.collect()} == {"a": both.where(f"event_id < {2 << 40} AND met_pt > 20").count()}
    assert shards.as_result(shards.merged(few)) == few.first()["whole"]
    assert shards.as_result(shards.merged(shards.map_events(spark, root, split, lambda e: 1 / 0, where="met_pt < 0"))) is None
    means = shards.map_events(spark, root, split, lambda e: {"sum": float(np.sum(e.column("met_pt").to_numpy())), "none": None}, event_columns=["event_id", "met_pt"], collections=())
    assert shards.as_result(shards.merged(means)) == {"sum": pytest.approx(both.agg(F.sum("met_pt")).first()[0])}

    def task(name, first, stop):
        if name != "b":
            raise RuntimeError(f"{name} is down")
        return first, stop

    with pytest.raises(shards.ShardError, match="2 of 3 shards failed") as e:
        shards.scatter(spark, split, task)
    assert set(e.value.failed) == {"a", "empty"} and e.value.done == {"b": (2, 3)}
    assert shards.shard_keys(split, "empty", m.layout) == (3 << 40, 1 << 63)


def test_stored_nested_table_needs_no_shuffle(spark):
    nested = synthetic_events(spark, 200, seed=3)
    stored = tables.store_nested(nested, "nested_events_of_a_test", 4)
    met = stored.join(stored.select("event_id", F.size("jets").alias("n")), "event_id").where("n >= 0")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert met.count() == 200 and "Exchange hashpartitioning" not in met._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE nested_events_of_a_test")


def test_plans_compute_vectors_once(spark):
    """No filter holds a copy of the four-vectors, whose arithmetic has exponentials."""
    e = event(spark)
    for f in (adl.q5, adl.q7, adl.q8, adl.zmumu_flat, adl.zmumu_jagged):
        plan = f(e)._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.splitlines() if "Filter" in line and ("exp(" in line.lower() or "EXP(" in line)], f.__name__


def test_synthetic_events(spark):
    a, b = synthetic_events(spark, 3000, 4.0, 7, parts=2), synthetic_events(spark, 3000, 4.0, 7, parts=5)
    assert a.exceptAll(b).count() == 0
    n, mean, least = a.agg(F.count("*"), F.avg(F.size("jets")), F.min(F.size("jets"))).first()
    assert n == 3000 and abs(mean - 4.0) < 0.2 and least == 0
    assert regression.train(regression.dataset(a))[1] > 0.8
    assert regression.throughput(a, repeats=1)["objects"] == a.agg(F.sum(F.size("jets"))).first()[0]
    x = nesting.tensor(a, "jets", ["pt"]).where("count > 0").first()
    assert sum(x["mask"]) == x["count"] and all(o["pt"] == 0 for o, real in zip(x["x"], x["mask"], strict=True) if not real)
    assert nesting.tensor(a.limit(0), "jets", ["pt"]).count() == 0


def test_list_functions(spark):
    df = spark.createDataFrame([([3.0, None, 1.0, 1.0],), ([],), (None,)], "x array<double>")
    x = F.col("x")
    made = {
        "n": lists.count(x), "sum": lists.sum_(x), "mean": lists.mean(x), "var": lists.var(x), "argmin": lists.argmin(x), "argmax": lists.argmax(x), "runs": lists.run_lengths(x), "pad": lists.pad_none(x, 5, clip=True), "all": lists.all_(x, lambda v: v > 0),
        "fill": lists.fill_none(x, F.lit(9.0)), "cut": lists.unflatten(x, F.when(F.size(x) > 0, F.array(F.lit(1), F.lit(3))).otherwise(F.array().cast("array<int>"))), "firsts": lists.firsts(x), "diff": lists.diff(x), "ptp": lists.ptp(x), "order": lists.argsort(x),
    }
    full, empty, none = (r.asDict() for r in df.select(*[c.alias(k) for k, c in made.items()]).collect())
    assert (full["n"], full["sum"], full["mean"], full["ptp"], full["argmin"], full["argmax"], full["all"]) == (3, 5.0, pytest.approx(5 / 3), 2.0, 2, 0, True)
    assert full["var"] == pytest.approx(8 / 9) and full["runs"] == [1, 1, 2] and full["cut"] == [[3.0], [None, 1.0, 1.0]]
    assert full["pad"] == [3.0, None, 1.0, 1.0, None] and full["fill"] == [3.0, 9.0, 1.0, 1.0] and full["diff"] == [None, None, 0.0]
    assert (empty["n"], empty["sum"], empty["mean"], empty["var"], empty["argmin"], empty["runs"], empty["all"], empty["cut"], empty["firsts"]) == (0, 0.0, None, None, None, [], True, [], None)
    assert none["sum"] is None and none["argmax"] is None
    with pytest.raises(Exception, match="do not add up"):
        df.limit(1).select(lists.unflatten(x, F.array(F.lit(3)))).collect()


def test_statistics(spark):
    df = spark.createDataFrame([(float(x),) for x in range(10)] + [(float("nan"),), (None,)], "v double")
    r = statistics.summary(df, "v").first()
    assert (r["n"], r["n_nonfinite"], r["mean"], r["q0"], r["q25"], r["q50"], r["q100"]) == (12, 2, 4.5, 0.0, 2.25, 4.5, 9.0)
    assert {x["bin"]: x["n"] for x in statistics.histogram(df, "v", 3, 0.0, 9.0).collect()} == {0: 3, 1: 3, 2: 4}
    none = statistics.summary(df.where("false"), "v").first()
    assert (none["n"], none["mean"], none["q50"]) == (0, None, None)
    assert math.isnan(statistics.metric(df.where("false").withColumnRenamed("v", "value")).first()["mean"])
    parts = [df.limit(0), None, statistics.histogram(df, "v", 3, 0.0, 9.0)]
    assert statistics.combined([None, None]) is None
    assert {r["bin"]: r["n"] for r in statistics.combined([parts[2], None, parts[2]], ["bin"]).collect()} == {0: 6, 1: 6, 2: 8}


def test_dense_blocks(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([],)], "x array<double>")
    got = df.select(nesting.dense(F.col("x"), 2, F.lit(0.0)), nesting.mask(F.col("x"), 2)).collect()
    assert [tuple(map(list, r)) for r in got] == [([1.0, 2.0], [True, True]), ([0.0, 0.0], [False, False])]
