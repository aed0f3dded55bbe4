"""Tables that are split over shards: a folder each, under one root, by ranges of file ids.

A query over all shards is one DataFrame over all folders, and so is a function of their events. What
has to be done to shards one by one is handed to a few threads, each of which submits Spark jobs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestfold.functions.keys import KeyLayout, ShardMap
from nestfold.operators import nesting, tables
from nestfold.storage import written


class ShardError(RuntimeError):
    """What went wrong, shard by shard, in ``failed``; what the others gave, in ``done``."""

    def __init__(self, failed: dict[str, Exception], done: dict[str, object]):
        self.failed, self.done = failed, done
        told = "; ".join(f"{name}: {str(e).splitlines()[0] if str(e) else type(e).__name__}" for name, e in failed.items())
        super().__init__(f"{len(failed)} of {len(failed) + len(done)} shards failed: {told}")


def scatter(spark: SparkSession, shards: ShardMap, task: Callable[[str, int, int | None], object], workers: int = 8) -> dict[str, object]:
    """task(shard, first file id, the one after the last or None) of each shard, by its name, in the order of the map.

    All shards run to their end; if any failed, one ShardError tells of all of them.
    """
    done, failed = {}, {}
    with ThreadPoolExecutor(max(1, min(workers, len(shards.shards) or 1))) as pool:
        asked = {s[0]: pool.submit(inheritable_thread_target(spark)(task), *s) for s in shards.shards}
        for name, future in asked.items():
            try:
                done[name] = future.result()
            except Exception as e:  # noqa: BLE001 - all failures are told at once
                failed[name] = e
    if failed:
        raise ShardError(failed, done)
    return done


def shard_keys(shards: ShardMap, name: str, layout: KeyLayout) -> tuple[int, int]:
    """The half-open range of keys that a shard owns."""
    first, stop = next((lo, hi) for n, lo, hi in shards.shards if n == name)
    return first << layout.entry_bits, (layout.max_file + 1 if stop is None else stop) << layout.entry_bits


def table(spark: SparkSession, root: str, shards: ShardMap, name: str) -> DataFrame:
    """A table over all shards that have it, with the column ``shard``."""
    there = [s for s, _, _ in shards.shards if tables.has(spark, f"{root}/{s}", name)]
    if not there:
        raise ValueError(f"no shard under {root} has the table {name}")
    return reduce(DataFrame.unionByName, [tables.stored(spark, f"{root}/{s}", name).withColumn("shard", F.lit(s)) for s in there])


def fetch_shard(spark: SparkSession, root: str, shard: str, where: str | None = None, collections: Sequence[str] = ("jets", "muons"), event_columns: list[str] | None = None, ordered: bool = True) -> DataFrame:
    """The nested events of one shard that ``where``, a condition on events, selects; by default ordered by event_id."""
    events = tables.stored(spark, f"{root}/{shard}", "events").drop("file_id")
    return _nested(events, lambda c: tables.stored(spark, f"{root}/{shard}", c).drop("file_id"), where, collections, event_columns, ordered)


def fetch(spark: SparkSession, root: str, shards: ShardMap, where: str | None = None, collections: Sequence[str] = ("jets", "muons"), event_columns: list[str] | None = None, ordered: bool = True) -> DataFrame:
    """The same over all shards, in one query."""
    events = table(spark, root, shards, "events").drop("file_id", "shard")
    return _nested(events, lambda c: table(spark, root, shards, c).drop("file_id", "shard"), where, collections, event_columns, ordered)


def _nested(events, objects, where, collections, event_columns, ordered) -> DataFrame:
    picked = None
    found = {}
    for name in collections:
        picked, found[name] = nesting.fetch(events, objects(name), where, event_columns=event_columns)
    if picked is None:
        picked = nesting.fetch(events, events, where, event_columns=event_columns)[0]
    made = nesting.nest(picked, found, {n: n.rstrip("s") + "_index" for n in found})
    return made.orderBy("event_id") if ordered else made


PARTIAL = "shard string, path array<string>, whole long, number double, items array<double>"


def _leaves(result, path: tuple[str, ...] = ()) -> Iterator[tuple]:
    """(path, whole, number, items) of each number and each sequence of numbers of a result; nothing of None."""
    if isinstance(result, Mapping):
        for name, inner in result.items():
            yield from _leaves(inner, (*path, str(name)))
    elif result is None:
        return
    elif np.ndim(result):
        yield [*path], None, None, np.asarray(result, float).tolist()
    elif isinstance(result, int | np.integer | bool | np.bool_):
        yield [*path], int(result), None, None
    else:
        yield [*path], None, float(result), None


def map_events(spark: SparkSession, root: str, shards: ShardMap, f: Callable[[pa.Table], object], where: str | None = None, collections: Sequence[str] = ("jets", "muons"), event_columns: list[str] | None = None) -> DataFrame:
    """(shard, path, whole, number, item): f(nested events), next to each shard's data, and its results put together.

    f runs on the executors, on one batch of a shard's events after another, so no shard needs to fit a
    task. It gives a number, a sequence of numbers, a mapping of names to such, nested or not, or None.
    Numbers are added up for each shard, whole ones exactly, in a row for each path of names;
    sequences are joined, in a row for each item, in no order. Of a shard without events that
    ``where`` selects there are no rows, and f is not asked. All shards are one job.
    """
    columns = None if event_columns is None else [*event_columns, "shard"]
    events = table(spark, root, shards, "events").drop("file_id")
    nested = _nested(events, lambda c: table(spark, root, shards, c).drop("file_id", "shard"), where, collections, columns, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summed: dict[tuple, list] = {}
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            for shard in rows.column("shard").unique().to_pylist():
                mine = rows.filter(pa.compute.equal(rows.column("shard"), shard)).drop_columns("shard")
                lists = []
                for path, whole, number, items in _leaves(f(mine)) if len(mine) else ():
                    if items is not None:
                        lists.append((shard, path, None, None, items))
                    else:
                        have = summed.setdefault((shard, *path), [None, None])
                        for k, x in ((0, whole), (1, number)):
                            have[k] = have[k] if x is None else x + (have[k] or 0)
                yield _partial(lists)
        yield _partial([(shard, [*path], *numbers, None) for (shard, *path), numbers in summed.items()])

    made = written(nested.mapInArrow(run, PARTIAL), "partial-results")
    numbers = made.where("items IS NULL").groupBy("shard", "path").agg(F.sum("whole").alias("whole"), F.sum("number").alias("number"), F.lit(None).cast("double").alias("item"))
    return numbers.unionByName(made.where("items IS NOT NULL").select("shard", "path", F.lit(None).cast("long").alias("whole"), F.lit(None).cast("double").alias("number"), F.explode("items").alias("item")))


def _partial(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"shard": pa.string(), "path": pa.list_(pa.string()), "whole": pa.int64(), "number": pa.float64(), "items": pa.list_(pa.float64())}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], list(kinds))


def merged(found: DataFrame) -> DataFrame:
    """(path, whole, number, item): what ``map_events`` gave, of all shards together."""
    numbers = found.where("item IS NULL").groupBy("path").agg(F.sum("whole").alias("whole"), F.sum("number").alias("number"), F.lit(None).cast("double").alias("item"))
    return numbers.unionByName(found.where("item IS NOT NULL").select("path", "whole", "number", "item"))


def as_result(found: DataFrame):
    """Small rows of ``merged`` as f gives them, on the driver: a number, a list in order of size, or a dict; None if there are none."""
    out: dict = {}
    lists: list[list] = []
    for path, whole, number, item in found.select("path", "whole", "number", "item").toLocalIterator():
        home = out
        for step in path[:-1]:
            home = home.setdefault(step, {})
        name = path[-1] if path else None
        if item is None:
            home[name] = whole if number is None else number + (whole or 0)
        else:
            if name not in home:
                lists.append(home.setdefault(name, []))
            home[name].append(item)
    for x in lists:
        x.sort()
    return out.get(None) if set(out) <= {None} else out


def misrouted(spark: SparkSession, root: str, shards: ShardMap, name: str, layout: KeyLayout) -> DataFrame:
    """(shard, owner, n): rows of a table that are in another shard than the one that owns them (null: none does)."""
    rows = table(spark, root, shards, name)
    owner = shards.column(layout.file_of(F.col("event_id")))
    return rows.withColumn("owner", owner).where(~F.col("shard").eqNullSafe(F.col("owner"))).groupBy("shard", "owner").agg(F.count("*").alias("n"))
