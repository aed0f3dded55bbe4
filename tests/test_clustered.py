"""Clustered flat tables: joins without an exchange, row groups that are skipped."""

import zlib
from pathlib import Path
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from nestfold.operators import clustered, nesting
from nestfold.plans.queries import QUERIES
from nestfold.sources.datasets import NANOAOD, keyed, read, sample_rows
from nestfold.sources.datasets import tables as tables_of


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("source") / "s")
    sample_rows(spark, 3000, 5).coalesce(1).write.parquet(path)
    flat = tables_of(keyed(read(spark, path, NANOAOD), NANOAOD), NANOAOD)
    flat |= {n: clustered.with_vectors(flat[n].withColumnRenamed(f"{n[:-1]}_index", "i")) for n in ("jets", "muons")}
    clustered.store(flat, "of_a_test", 3, group_bytes=4096)
    yield flat
    for n in flat:
        spark.sql(f"DROP TABLE of_a_test_{n}")


@pytest.fixture
def plain_joins(spark):
    """As with tables that are too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("query", [clustered.trijet, clustered.zmumu_pairs, clustered.zmumu_two])
def test_self_joins_need_no_exchange(spark, stored, plain_joins, query):
    made = query(spark, "of_a_test")
    assert "Exchange" not in plan(made) and "SortMergeJoin" in plan(made) and made.count() > 50


def test_events_and_their_objects_meet_in_buckets(spark, stored, plain_joins):
    events, jets = clustered.fetch(spark, "of_a_test", "jets", "met_pt > 40 AND n_jets >= 2")
    assert "Exchange" not in plan(jets)
    expected = nesting.fetch(stored["events"], stored["jets"], "met_pt > 40 AND n_jets >= 2")[1]
    assert jets.select(expected.columns).exceptAll(expected).count() == 0 and jets.count() == expected.count() > 0
    by_event = jets.groupBy("event_id").agg(F.sum("pt").alias("pt")).join(events, "event_id")
    assert "Exchange" not in plan(by_event)


def rows_scanned(df):
    """How many rows leave the scan, before any filter."""
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        query = df._jdf.queryExecution()
        query.toRdd().count()
        leaves = query.executedPlan().collectLeaves()
        return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))
    finally:
        df.sparkSession.conf.unset("spark.sql.adaptive.enabled")


def test_a_range_of_keys_skips_row_groups(spark, stored):
    whole = clustered.table(spark, "of_a_test", "jets")
    few = clustered.table(spark, "of_a_test", "jets", (1000, 1100))
    n = whole.count()
    assert few.count() == stored["jets"].where("event_id >= 1000 AND event_id < 1100").count() > 0
    assert rows_scanned(whole) == n and few.count() <= rows_scanned(few) < n / 3


def test_rows_lie_in_order_and_pairs_agree_with_lists(spark, stored):
    part = clustered.table(spark, "of_a_test", "muons").withColumn("_p", F.spark_partition_id()).collect()
    for p in {r["_p"] for r in part}:
        keys = [(r["event_id"], r["i"]) for r in part if r["_p"] == p]
        assert keys == sorted(keys)
    plain = stored["muons"].alias("a").join(stored["muons"].alias("b"), "event_id").where("a.i < b.i AND a.charge <> b.charge")
    v = {c: F.col(f"a.{c}") + F.col(f"b.{c}") for c in ("e", "px", "py", "pz")}
    masses = plain.select(F.sqrt(v["e"] ** 2 - v["px"] ** 2 - v["py"] ** 2 - v["pz"] ** 2).alias("m")).where("m > 60 AND m < 120")
    found = sorted(r["value"] for r in clustered.zmumu_pairs(spark, "of_a_test").collect())
    assert found == pytest.approx(sorted(r["m"] for r in masses.collect()))


@pytest.mark.parametrize("query", ["zmumu_flat_clustered", "zmumu_jagged_clustered"])
def test_what_another_session_left_in_the_warehouse_is_not_met(spark, query):
    folder = "/root/testdata/sf0.001"
    for name in ("events", "jets", "muons"):  # as earlier sessions named the tables
        left = Path(urlsplit(spark.conf.get("spark.sql.warehouse.dir")).path) / f"clustered_{zlib.crc32(folder.encode()):08x}_{name}"
        left.mkdir(parents=True, exist_ok=True)
        (left / "part-0").write_text("left")
    first, again = QUERIES[query](spark, folder), QUERIES[query](spark, folder)  # the second call leaves the first one's tables
    assert sorted(first.collect()) == sorted(again.collect()) != []
