"""Versions of stored tables, and loading many files at once."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from nestfold.functions.keys import KeyLayout, Manifest, ShardMap
from nestfold.operators import record, shards, snapshots, tables
from nestfold.sources.datasets import NANOAOD, sample_rows
from nestfold.sources.root import write_root
from nestfold.storage import children, qualified, qualified_all

NAMES = ("events", "jets", "muons")
LAYOUT = KeyLayout()


def made_files(spark, folder, sizes, manifest, seed=0):
    for n, size in enumerate(sizes):
        path = f"{folder}/f{seed}-{n}"
        sample_rows(spark, size, seed + n).coalesce(1).write.parquet(path)
        manifest.add(path)
    return manifest


def everything(spark, root, at=None):
    return {n: sorted(map(str, tables.stored(spark, root, n, at=at).collect())) for n in NAMES}


def rows_of(spark, keys, value):
    layout = KeyLayout()
    made = spark.createDataFrame([(layout.key(f, e), value) for f, e in keys], "event_id long, v int")
    return {n: made for n in NAMES}


class Stopped(Exception):
    pass


def test_a_stop_anywhere_leaves_old_or_new_rows_in_all_tables(spark, tmp_path, monkeypatch):
    """Every step that touches storage is stopped in turn, before it and after it."""
    old, new = [(0, 0), (1, 0), (1, 1)], [(1, 0), (1, 2)]
    seen = set()
    steps = ("write", "folders", "put_text", "move_new")
    for step in steps:
        for after in (False, True):
            root = str(tmp_path / f"{step}-{after}")
            tables.load(rows_of(spark, old, 1), root, KeyLayout())
            before = everything(spark, root)
            real = getattr(snapshots, step)

            def stopping(*args, real=real, after=after, **kinds):
                if after:
                    real(*args, **kinds)
                raise Stopped

            monkeypatch.setattr(snapshots, step, stopping)
            with pytest.raises(Stopped):
                tables.load(rows_of(spark, new, 2), root, KeyLayout())
            monkeypatch.setattr(snapshots, step, real)
            found = everything(spark, root)
            assert len(set(map(str, found.values()))) == 1, "a mixture of old and new"
            seen.add(found == before)
            assert (found == before) == (step != "move_new" or not after)
            tables.load(rows_of(spark, new, 2), root, KeyLayout())
            assert sorted((r["event_id"] >> 40, r["v"]) for r in tables.stored(spark, root, "jets").collect()) == [(0, 1), (1, 2), (1, 2)]
    assert seen == {True, False}


def test_versions_are_pinned_and_vacuumed(spark, tmp_path):
    root = str(tmp_path / "db")
    tables.load(rows_of(spark, [(0, 0), (1, 0)], 1), root, KeyLayout())
    pinned = tables.stored(spark, root, "events")
    first = snapshots.versions(spark, root)[-1]
    tables.load(rows_of(spark, [(1, 0), (1, 1)], 2), root, KeyLayout())
    tables.load(rows_of(spark, [(1, 5)], 3), root, KeyLayout())
    assert pinned.count() == 2 and tables.stored(spark, root, "events", at=first).count() == 2
    now = everything(spark, root)
    assert snapshots.vacuum(spark, root, keep=1) and everything(spark, root) == now  # young folders stay
    gone = snapshots.vacuum(spark, root, keep=1, hours=-1)
    assert any("file_id=1" in p for p in gone) and any(p.endswith(snapshots.version(spark, root).history[1]) for p in gone)
    assert everything(spark, root) == now and snapshots.versions(spark, root) == [snapshots.version(spark, root).number]
    with pytest.raises(ValueError, match="no version"):
        tables.stored(spark, root, "events", at=first)


def test_of_two_writers_one_starts_again(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "db")
    tables.load(rows_of(spark, [(0, 0), (1, 0)], 1), root, KeyLayout())
    real, asked = snapshots.move_new, []

    def second_first(*args):
        if not asked:
            asked.append(1)
            tables.load(rows_of(spark, [(2, 0)], 5), root, KeyLayout())
        return real(*args)

    monkeypatch.setattr(snapshots, "move_new", second_first)
    tables.load(rows_of(spark, [(1, 0)], 2), root, KeyLayout())
    assert {r["event_id"] >> 40: r["v"] for r in tables.stored(spark, root, "events").collect()} == {0: 1, 1: 2, 2: 5}
    asked.clear()
    monkeypatch.setattr(snapshots, "move_new", lambda *a: (asked.append(1), tables.load(rows_of(spark, [(1, 0)], 6), root, KeyLayout()))[0] and real(*a) if not asked else real(*a))
    with pytest.raises(snapshots.Conflict):
        tables.load(rows_of(spark, [(1, 0)], 7), root, KeyLayout())
    assert {r["event_id"] >> 40: r["v"] for r in tables.stored(spark, root, "events").collect()} == {0: 1, 1: 6, 2: 5}


def jobs_of(spark, group, f):
    """How many Spark jobs f starts."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(group, "")
    try:
        f()
        return len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_jobs_do_not_follow_the_number_of_files(spark, tmp_path):
    few, many = (made_files(spark, tmp_path, [4] * n, Manifest(), 100 * n) for n in (2, 9))
    counts = [jobs_of(spark, f"group {n}", lambda m=m, n=n: record.ingest_record(spark, m, NANOAOD, str(tmp_path / f"db{n}")).collect()) for n, m in enumerate((few, many))]
    assert counts[0] == counts[1] <= 25
    assert tables.stored(spark, str(tmp_path / "db1"), "events").count() == 36


def test_a_record_is_loaded_resumed_and_told(spark, tmp_path, monkeypatch):
    root, m = str(tmp_path / "db"), made_files(spark, tmp_path, [20, 15, 12, 10], Manifest())
    bad = tmp_path / "bad.parquet"
    bad.write_text("not a file of columns")
    m.add(str(bad))
    sample_rows(spark, 5, 3).drop("MET_pt").coalesce(1).write.parquet(str(tmp_path / "less"))
    m.add(str(tmp_path / "less"))
    m.add(str(tmp_path / "missing"))
    real, calls = snapshots.commit, []

    def stopping(*args):
        calls.append(1)
        if len(calls) == 2:
            raise Stopped
        return real(*args)

    monkeypatch.setattr(snapshots, "commit", stopping)
    with pytest.raises(Stopped):  # after the first commit of two files
        record.ingest_record(spark, m, NANOAOD, root, per_commit=2)
    monkeypatch.setattr(snapshots, "commit", real)
    assert tables.stored(spark, root, "events").select("file_id").distinct().count() == 2
    told = record.ingest_record(spark, m, NANOAOD, root, retries=1)
    status = {(r["file_id"], r["attempt"]): r["status"] for r in told.collect()}
    assert status == {(2, 1): "ok", (3, 1): "ok", **{(i, a): "failed" for i in (4, 5, 6) for a in (1, 2)}}
    errors = {r["file_id"]: r["error"] for r in told.where("status = 'failed'").collect()}
    assert "missing columns ['MET_pt']" in errors[5] and "not there" in errors[6]
    whole = made_files(spark, tmp_path / "again", [20, 15, 12, 10], Manifest())
    record.ingest(spark, whole, NANOAOD, str(tmp_path / "whole"))
    assert everything(spark, root) == everything(spark, str(tmp_path / "whole"))
    assert record.log(spark, root).where("status = 'ok'").agg(F.sum("rows")).first()[0] == 57
    assert record.ingest_record(spark, m, NANOAOD, root, retries=0).where("status = 'ok'").count() == 0


def test_a_file_that_breaks_off_does_not_stop_the_others(spark, tmp_path):
    m = made_files(spark, tmp_path, [400, 30], Manifest())
    file = next(p for p in (tmp_path / "f0-0").glob("*.parquet"))
    data = bytearray(file.read_bytes())
    data[200 : len(data) // 2] = bytes(len(data) // 2 - 200)  # pages are gone, the footer is whole
    file.write_bytes(data)
    for crc in file.parent.glob(".*.crc"):
        crc.unlink()
    root = str(tmp_path / "db")
    told = {r["file_id"]: r for r in record.ingest_record(spark, m, NANOAOD, root, retries=0).collect()}
    assert told[0]["status"] == "failed" and told[1]["status"] == "ok" and told[1]["rows"] == 30
    assert {n: tables.stored(spark, root, n).where("file_id = 0").count() for n in NAMES} == dict.fromkeys(NAMES, 0)


def test_files_of_two_layouts_and_shards(spark, tmp_path):
    m, root = made_files(spark, tmp_path, [10, 8], Manifest()), str(tmp_path / "db")
    sample_rows(spark, 6, 9, triggers=False).coalesce(1).write.parquet(str(tmp_path / "plain"))
    m.add(str(tmp_path / "plain"))
    split = ShardMap([("a", 0, 1), ("b", 1, None)])
    write_root(sample_rows(spark, 7, 4).coalesce(1), str(tmp_path / "tree.root"))
    m.add(str(tmp_path / "tree.root"))
    told = record.ingest_record(spark, m, NANOAOD, root, split)
    assert told.where("status = 'ok'").agg(F.sum("rows")).first()[0] == 31
    both = shards.table(spark, root, split, "events")
    assert {(r["shard"], r["file_id"], r["n"]) for r in both.groupBy("shard", "file_id").agg(F.count("*").alias("n")).collect()} == {("a", 0, 10), ("b", 1, 8), ("b", 2, 6), ("b", 3, 7)}
    assert both.where("file_id = 2 AND hlt_isomu24 IS NOT NULL").count() == 0 < both.where("hlt_isomu24 IS NOT NULL").count()
    assert json.loads(snapshots.version(spark, f"{root}/b").to_json())["number"] == 1


def test_files_written_do_not_follow_the_number_of_tasks(spark, tmp_path):
    root, n = str(tmp_path / "r"), 40
    rows = spark.range(0, 2000, numPartitions=16).select(LAYOUT.pack(F.col("id") % n, F.floor(F.col("id") / n)).alias("event_id"), F.col("id").cast("double").alias("met"))
    tables.load({"events": rows}, root, LAYOUT)
    assert len(list(Path(root).glob("events/*/*/*.parquet"))) == n
    tables.load({"events": rows.where(LAYOUT.file_of(F.col("event_id")) == 3).withColumn("met", F.lit(-1.0))}, root, LAYOUT)
    found = tables.stored(spark, root, "events")  # more folders than are listed one by one
    want = sorted((LAYOUT.key(i % n, i // n), -1.0 if i % n == 3 else float(i), i % n) for i in range(2000))
    assert sorted(map(tuple, found.collect())) == want
    assert sorted(map(tuple, tables.stored(spark, root, "events", at=1).collect())) == sorted((k, float((k & LAYOUT.max_entry) * n + f), f) for k, _, f in want)


def test_children_of_any_names(spark, tmp_path):
    names = ["a b", "c, d", "z=1", "é+%20x", "e,f"]
    for name in names:
        (tmp_path / name).mkdir()
    assert children(spark, f"file://{tmp_path}") == children(spark, str(tmp_path)) == sorted(names)
    assert children(spark, f"{tmp_path}/z=1") == children(spark, f"{tmp_path}/none") == []


def test_a_record_of_many_files_is_packed(spark, tmp_path, monkeypatch):
    """Files written do not follow the files loaded; rows, fates, versions and what is replaced are those of folders for each file."""
    m = made_files(spark, tmp_path / "a +%20é", [5, 3, 0, 4, 6, 2], Manifest())
    broken = next(p for p in (tmp_path / "a +%20é" / "f0-4").glob("*.parquet"))
    data = bytearray(broken.read_bytes())
    data[4 : len(data) // 3] = bytes(len(data) // 3 - 4)
    broken.write_bytes(data)
    for crc in broken.parent.glob(".*.crc"):
        crc.unlink()
    m.add(str(tmp_path / "missing"))
    found = {}
    for limit in (100, 2):
        monkeypatch.setattr(snapshots, "OWN_FOLDERS", limit)
        root = str(tmp_path / f"db{limit}")
        told = {(r["file_id"], r["status"], r["rows"]) for r in record.ingest_record(spark, m, NANOAOD, root, retries=0).collect()}
        states = [told, everything(spark, root)]
        events = tables.stored(spark, root, "events").drop("file_id")
        again = events.where(LAYOUT.file_of(F.col("event_id")).isin(1, 3)).withColumn("met_pt", F.lit(-1.0))
        tables.load({"events": again}, root, LAYOUT, ranges={1: (0, None), 3: (1, 3), 5: (0, None)})  # 3 > 2: packed too
        states += [everything(spark, root), everything(spark, root, at=1)]
        tables.load({"events": again.where(LAYOUT.file_of(F.col("event_id")) == 1)}, root, LAYOUT)  # a folder over packed rows
        snapshots.vacuum(spark, root, keep=1, hours=-1)
        found[limit] = [*states, everything(spark, root)]
    assert {i for i, s, _ in found[2][0] if s == "failed"} == {4, 6}
    assert found[2] == found[100]
    assert not list(Path(tmp_path / "db2").glob("jets/*/file_id=*")) and list(Path(tmp_path / "db100").glob("jets/*/file_id=*"))


def test_packed_rows_of_scattered_files(spark, tmp_path, monkeypatch):
    """Single files replaced in a packed commit, in more runs than a condition lists, and by partial ranges."""
    monkeypatch.setattr(snapshots, "FOLDERS", 3)
    root, n = str(tmp_path / "db"), snapshots.OWN_FOLDERS + 10
    rows = spark.range(0, 4 * n, numPartitions=3).select(LAYOUT.pack(F.col("id") % n, F.floor(F.col("id") / n)).alias("event_id"), F.col("id").alias("v"))
    tables.load({"events": rows}, root, LAYOUT)
    assert len(list(Path(root).glob("events/*/*.parquet"))) <= 3 and not list(Path(root).glob("events/*/file_id=*"))
    odd = rows.where((LAYOUT.file_of(F.col("event_id")) % 2 == 1) & (LAYOUT.entry_of(F.col("event_id")) < 2)).withColumn("v", F.lit(-1).cast("long"))
    tables.load({"events": odd}, root, LAYOUT, ranges={i: (0, 2) for i in range(1, n, 2)})
    want = sorted((LAYOUT.key(i % n, i // n), -1 if i % n % 2 and i // n < 2 else i, i % n) for i in range(4 * n))
    assert sorted(map(tuple, tables.stored(spark, root, "events").collect())) == want
    assert tables.stored(spark, root, "events", keys=(LAYOUT.key(5, 0), LAYOUT.key(6, 0)), layout=LAYOUT).count() == 4


def test_qualified_all(spark, tmp_path):
    paths = [f"{tmp_path}/a b", f"{tmp_path}//c%20", f"file://{tmp_path}/d=1/", f"file:{tmp_path}/é:x", f"{tmp_path}/e/..", "/tmp", "relative"]
    assert qualified_all(spark, paths) == [qualified(spark, p) for p in paths]
