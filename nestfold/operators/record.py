"""Loading a whole record, many files at once, as one distributed job a table.

Footers are read on the executors. All files that fit go through one scan for each layout they have,
joined to the list of files by the path of each row, which gives ids from the row's place in its file.
Each file's number of rows is then held against its footer. A version (see ``snapshots``) names what was
loaded, so a run that was stopped goes on with the rest, and every file's fate is in a log.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import replace as replace_fields
from functools import reduce
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nestfold.functions.keys import Manifest, ShardMap
from nestfold.operators import snapshots
from nestfold.sources.datasets import Dataset, Wide, keyed, tables
from nestfold.sources.root import Opened, described, read_root
from nestfold.storage import children, exists, make_folder, move, qualified_all, remove

#: A list of more files than this meets the rows in a shuffled join.
BROADCAST_FILES = 200_000
LOG = "commit string, file_id long, path string, status string, rows long, error string, attempt int, at timestamp"


def _one_file(path: str) -> tuple[str, object]:
    """The one Parquet file at a path, which may be a folder of it, and its file system."""
    from pyarrow import fs

    system, name = (fs.LocalFileSystem(), re.sub("^file:/*", "/", path)) if path.startswith("file:") else fs.FileSystem.from_uri(path)
    info = system.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"{path} is not there")
    if info.type == fs.FileType.File:
        return path, (system, name)
    inside = [f for f in system.get_file_info(fs.FileSelector(name, recursive=True)) if f.is_file and not re.search(r"(^|/)[._][^/]*$", f.path)]
    if len(inside) != 1:
        raise ValueError(f"{path} has {len(inside)} files; each needs a file id of its own")
    return path.rstrip("/") + inside[0].path[len(name.rstrip("/")) :], (system, inside[0].path)


def footers(spark: SparkSession, files: list[tuple[int, str]], dataset: Dataset) -> DataFrame:
    """(file_id, path, file, rows, columns, layout, error) of (file id, path): what each file's footer says, read on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import parquet

        for b in batches:
            told = []
            for path in b["path"]:
                try:
                    file, (system, name) = _one_file(path)
                    if file.endswith(".root"):
                        with Opened(file, dataset.tree) as o:
                            told.append((file, o.tree.entries, [*o.tree.branches], f"root {described(o.tree)}", None))
                        continue
                    with system.open_input_file(name) as f:
                        found = parquet.ParquetFile(f)
                        schema = found.schema_arrow.remove_metadata()
                        told.append((file, found.metadata.num_rows, schema.names, re.sub(r"\s+", " ", str(schema)), None))
                except Exception as e:  # noqa: BLE001 - told for each file
                    told.append((None, None, None, None, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"))
            yield pd.concat([b.reset_index(drop=True), pd.DataFrame(told, columns=["file", "rows", "columns", "layout", "error"]).astype({"rows": "Int64"})], axis=1)

    named = list(zip([i for i, _ in files], qualified_all(spark, [p for _, p in files]), strict=True))
    parts = max(1, min(len(named), spark.sparkContext.defaultParallelism * 4))
    schema = "file_id long, path string, file string, rows long, columns array<string>, layout string, error string"
    return spark.createDataFrame(named, "file_id long, path string").repartition(parts).mapInPandas(run, schema)


def row_path() -> Column:
    """The path of a row's file as file systems write it: in the metadata it is a URL."""
    return F.regexp_replace(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")


def checked(spark: SparkSession, manifest: Manifest, dataset: Dataset, files: list[dict], entries: tuple[int, int | None], shards: ShardMap | None = None) -> list[dict]:
    """``files`` with what their footers say: file, layout, first, stop (of entries), and error (None: can be loaded)."""
    told = {r["file_id"]: r for r in footers(spark, [(f["file_id"], f["path"]) for f in files], dataset).collect()}
    out = []
    for f in files:
        found = told[f["file_id"]]
        error, rows = found["error"], found["rows"]
        if not error and (missing := [c for c in dataset.required() if c not in found["columns"]]):
            error = f"missing columns {missing}"
        if not error and f["entries"] is not None and f["entries"] > rows:
            error = f"{rows} entries, the manifest has {f['entries']}"
        if shards and not error:
            try:
                shards.shard_for(f["file_id"])
            except KeyError:
                error = f"no shard owns file {f['file_id']}"
        stop = min(x for x in (entries[1], f["entries"], rows) if x is not None) if not error else 0
        out.append({"file_id": f["file_id"], "path": f["path"], "file": found["file"], "layout": found["layout"], "first": entries[0], "stop": max(stop, entries[0]), "error": error})
    return out


def scan(spark: SparkSession, files: list[dict], dataset: Dataset, manifest: Manifest, skip_corrupt: bool = False) -> DataFrame:
    """The rows of all ``files`` (see ``checked``) with event_id: a scan for each layout, joined to the list by path."""
    of = {re.sub("^file:/+", "file:/", f["file"]): (f["file_id"], f["first"], f["stop"]) for f in files}
    layouts: dict[str, list[str]] = {}
    for f in files:
        layouts.setdefault(f["layout"], []).append(f["file"])
    found = []
    for layout, paths in layouts.items():
        if layout.startswith("root "):
            rows = read_root(spark, paths, dataset).withColumn("_path", F.regexp_replace("path", "^file:/+", "file:/")).drop("path")
            found.append(_placed(rows, {p: p for p in of}, of, dataset, manifest))
            continue
        rows = spark.read.schema(spark.read.parquet(paths[0]).schema).option("ignoreCorruptFiles", skip_corrupt).parquet(*paths)
        dataset.check(rows)
        # rows keep their path as the metadata has it, a URL: decoding is for each file, not for each row
        urls = {u: re.sub("^file:/+", "file:/", unquote(u)) for u in rows.inputFiles()}
        placed = rows.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("entry"))
        found.append(_placed(placed, _as_in_rows(urls), of, dataset, manifest))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def _as_in_rows(urls: dict[str, str]) -> dict[str, str]:
    """``urls`` with ``file:`` in both ways that it is written, as the metadata may have either."""
    return urls | {re.sub("^file:/+", s, u): p for u, p in urls.items() if u.startswith("file:/") for s in ("file:/", "file:///")}


def _placed(rows: DataFrame, paths: dict[str, str], of: dict[str, tuple], dataset: Dataset, manifest: Manifest) -> DataFrame:
    """``rows``, of which _path is one of ``paths`` (as rows have it: the file), that their file's part of ``of`` asks for, with event_id."""
    named = rows.sparkSession.createDataFrame([(p, *of[f]) for p, f in paths.items() if f in of], "_path string, _file long, _first long, _stop long")
    named = F.broadcast(named) if len(of) <= BROADCAST_FILES else named
    met = rows.join(named, "_path").where("entry >= _first AND entry < _stop")
    return keyed(met, dataset, F.col("_file"), manifest.layout).drop("_path", "_file", "_first", "_stop", "entry")


def _counts(spark: SparkSession, root: str, named: str, dataset: Dataset, shard: str | None) -> tuple[dict, dict]:
    """({file id: events}, {file id: a table that lacks rows}) of what a commit wrote."""
    there = lambda name: f"{root}/{name}/commit={named}" + (f"/shard={shard}" if shard else "")
    by_file = lambda name, *more: {r["file_id"]: r for r in spark.read.parquet(there(name)).groupBy("file_id").agg(F.count("*").alias("n"), *more).collect()} if any(n.startswith("file_id=") or n.endswith(".parquet") for n in children(spark, there(name))) else {}
    expected = {c: F.sum(n).alias(c) for n, c in dataset.counts.items()}
    events = by_file("events", *expected.values())
    short = {}
    for c in dataset.collections:
        got = by_file(c.name) if c.name in expected or isinstance(c, Wide) else None
        for i, r in events.items() if got is not None else ():
            want = r["n"] * len(c.slots) if isinstance(c, Wide) else r[c.name]
            if want != (got[i]["n"] if i in got else 0):
                short[i] = c.name
    return {i: r["n"] for i, r in events.items()}, short


def _attempt(spark, files, manifest, dataset, root, shards, replace, ranges, tolerant) -> tuple[str, dict[int, str | None], dict[int, int]]:
    """Load ``files`` in one commit: its id, an error or None for each file, and how many events it has."""
    named, owner = snapshots.new_commit(), {f["file_id"]: shards.shard_for(f["file_id"]) for f in files} if shards else {}
    homes = sorted(set(owner.values())) if shards else [""]
    made = tables(scan(spark, files, dataset, manifest, tolerant), dataset)
    dealt = {n: df.withColumn("file_id", manifest.layout.file_of(F.col("event_id"))) for n, df in made.items()}
    whole = ranges is None or all(r == (0, None) for r in ranges.values())
    if not whole and replace:  # rows of the same files out of the range stay
        dealt = {n: df.unionByName(_outside(spark, root, n, df, homes, owner, manifest, ranges)) for n, df in dealt.items()}
    packed = len(files) > snapshots.OWN_FOLDERS
    staging = f"{root}/_staging-{named}" if shards else root
    for name, df in dealt.items():
        keys = ["shard", "file_id"] if shards else ["file_id"]
        df = df.withColumn("shard", shards.column(F.col("file_id"))) if shards else df
        writer, into = df.sortWithinPartitions(*keys, "event_id").write, keys[:-1] if packed else keys
        (writer.partitionBy(*into) if into else writer).parquet(f"{staging}/{name}/commit={named}")
    errors: dict[int, str | None] = {}
    events: dict[int, int] = {}
    for shard in homes:
        mine = [f for f in files if not shards or owner[f["file_id"]] == shard]
        n, short = _counts(spark, staging, named, dataset, shard or None)
        for f in mine:
            i, want = f["file_id"], f["stop"] - f["first"]
            errors[i] = f"{short[i]}: fewer rows than the events tell" if i in short else None
            events[i] = n.get(i, 0)
            if whole and n.get(i, 0) != want:
                errors[i] = f"{n.get(i, 0)} of {want} entries could be read"
        home, good = f"{root}/{shard}" if shard else root, {f["file_id"] for f in mine if not errors[f["file_id"]]}
        for name in dealt if shard else ():
            if exists(spark, f"{staging}/{name}/commit={named}/shard={shard}"):
                make_folder(spark, f"{home}/{name}")
                move(spark, f"{staging}/{name}/commit={named}/shard={shard}", f"{home}/{name}/commit={named}")
        there = {name: snapshots.folders(spark, home, name, named, packed) for name in dealt}
        wrote = {name: [i for i in ids if i in good] for name, ids in there.items()}
        schemas = {name: made[name].schema.json() for name in made}
        sizes = {name: len(ids) for name, ids in there.items()}

        def change(v: snapshots.Version, wrote=wrote, good=good, schemas=schemas, sizes=sizes) -> snapshots.Version:
            v = replace_fields(v, schemas=schemas | v.schemas).with_files(named, wrote, good if replace else set(), packed)
            parts = {n: {c: replace_fields(p, wrote=sizes[n]) if c == named and n in sizes else p for c, p in of.items()} for n, of in v.parts.items()}
            return replace_fields(v, parts=parts)

        snapshots.commit(spark, home, change)
    if shards:
        remove(spark, staging)
    return named, errors, events


def _outside(spark, root, name, df, homes, owner, manifest, ranges) -> DataFrame:
    """What the files of ``ranges`` have out of their ranges now."""
    old, entry = df.limit(0), manifest.layout.entry_of(F.col("event_id"))
    for shard in homes:
        home = f"{root}/{shard}" if shard else root
        now = snapshots.version(spark, home)
        mine = {i for i in ranges if not shard or owner[i] == shard} & now.file_ids(name)
        if mine:
            first, stop = next(iter(ranges.values()))
            out = (entry < first) | (F.lit(False) if stop is None else entry >= stop)
            old = old.unionByName(snapshots.read(spark, home, name, now, mine).where(out))
    return old


def ingest(spark: SparkSession, manifest: Manifest, dataset: Dataset, root: str, entries: tuple[int, int | None] = (0, None), replace: bool = True, shards: ShardMap | None = None) -> int:
    """Load every file of the manifest, or the same range of entries of each, in one commit; the number of events.

    All files are checked first; if one is bad, nothing is loaded. With ``replace``, a run again
    gives the same rows. With ``shards``, each file goes to the folder of the shard that owns it.
    """
    files = checked(spark, manifest, dataset, manifest.files, entries, shards)
    if bad := [f"{f['path']}: {f['error']}" for f in files if f["error"]]:
        raise ValueError("nothing was loaded; bad files: " + "; ".join(bad))
    if not files:
        return 0
    ranges = {f["file_id"]: entries for f in files}
    _attempt(spark, files, manifest, dataset, root, shards, replace, ranges, False)
    return sum(f["stop"] - f["first"] for f in files)


def ingest_record(spark: SparkSession, manifest: Manifest, dataset: Dataset, root: str, shards: ShardMap | None = None, retries: int = 1, per_commit: int | None = None) -> DataFrame:
    """Load the files of the manifest that no earlier run has loaded; the log of this run (see ``log``).

    Files go in commits of ``per_commit`` (default: all in one), with the same number of jobs each. A
    file that cannot be read, lacks columns or has fewer entries than it should is told and left out,
    after ``retries`` further attempts of such files alone; the others are loaded. A run that was
    stopped left whole commits, which the next one does not load again.
    """
    done = set()
    for home in [f"{root}/{s}" for s, _, _ in shards.shards] if shards else [root]:
        done |= snapshots.version(spark, home).file_ids()
    todo = [f for f in manifest.files if f["file_id"] not in done]
    commits = []
    for at in range(0, len(todo), per_commit or max(len(todo), 1)):
        files, attempt = todo[at : at + (per_commit or len(todo))], 1
        while files:
            found = checked(spark, manifest, dataset, files, (0, None), shards)
            good = [f for f in found if not f["error"]]
            named, errors, events = _attempt(spark, good, manifest, dataset, root, shards, True, None, True) if good else (snapshots.new_commit(), {}, {})
            errors |= {f["file_id"]: f["error"] for f in found if f["error"]}
            rows = [(named, f["file_id"], f["path"], "failed" if errors[f["file_id"]] else "ok", None if errors[f["file_id"]] else events[f["file_id"]], errors[f["file_id"]], attempt) for f in found]
            told = spark.createDataFrame(rows, LOG.rpartition(",")[0]).withColumn("at", F.current_timestamp())
            told.coalesce(1).write.mode("append").parquet(f"{root}/_log")
            commits.append(named)
            files = [f for f in files if errors[f["file_id"]]] if attempt <= retries else []
            attempt += 1
    return log(spark, root).where(F.col("commit").isin(commits))


def log(spark: SparkSession, root: str) -> DataFrame:
    """(commit, file_id, path, status, rows, error, attempt, at): every attempt at every file, ``ok`` or ``failed``."""
    return spark.read.schema(LOG).parquet(f"{root}/_log") if exists(spark, f"{root}/_log") else spark.createDataFrame([], LOG)
