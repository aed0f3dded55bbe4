"""Stored tables: schemas, idempotent loading as versions (see ``snapshots``) by file or range of entries, migration of keys, verification, ranges of work."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from nestfold.functions import selection
from nestfold.functions.keys import KeyLayout, ShardMap, check_conversion
from nestfold.operators import snapshots

Ranges = dict[int, tuple[int, int | None]]
#: So many bits of entries of one file are written by one task.
TASK_BITS = 20


def has(spark: SparkSession, root: str, name: str | None = None) -> bool:
    """Whether there is a table under ``root``, or any."""
    there = snapshots.version(spark, root).schemas
    return bool(there) if name is None else name in there


def _plain(schema: StructType) -> str:
    return StructType([f for f in schema if f.name != "file_id"]).json()


def create(spark: SparkSession, root: str, schemas: dict[str, StructType], drop: bool = False) -> None:
    """Empty tables under ``root``. One that is there keeps its rows, unless ``drop``."""

    def change(v: snapshots.Version) -> snapshots.Version:
        parts = {n: p for n, p in v.parts.items() if not (drop and n in schemas)}
        new = {n: _plain(s) for n, s in schemas.items() if drop or n not in v.schemas}
        return replace(v, schemas=v.schemas | new, parts=parts)

    snapshots.commit(spark, root, change)


def truncate(spark: SparkSession, root: str, names: list[str]) -> None:
    """Remove all rows of the tables, which stay."""
    snapshots.commit(spark, root, lambda v: replace(v, parts={n: p for n, p in v.parts.items() if n not in names}))


def load(made: dict[str, DataFrame], root: str, layout: KeyLayout, replace_rows: bool = True, ranges: Ranges | None = None) -> None:
    """Write each table under ``root`` by file_id, as one version.

    With ``replace_rows``, what each file had in its range of entries goes, from all of these tables,
    also from those for which it has no rows now; other rows stay. ``ranges`` is file id -> (first
    entry, the entry after the last or None for all); by default, all entries of the files of
    ``made``'s events. A run that stops anywhere leaves either the old rows in all tables or the new
    ones. Raises ``Conflict`` if another writer changed one of the files meanwhile.
    """
    spark = next(iter(made.values())).sparkSession
    dealt = {n: df.withColumn("file_id", layout.file_of(F.col("event_id"))) for n, df in made.items()}
    if replace_rows and ranges is None:
        ranges = {r["file_id"]: (0, None) for r in dealt["events"].select("file_id").distinct().collect()}
    base, gone = snapshots.version(spark, root), set(ranges or ())
    part = {f: r for f, r in (ranges or {}).items() if r != (0, None)} if replace_rows else {}
    if part:
        limits = spark.createDataFrame([(f, first, stop) for f, (first, stop) in part.items()], "file_id long, _first long, _stop long")
        entry = layout.entry_of(F.col("event_id"))
        for name in [n for n in dealt if n in base.schemas]:
            old = snapshots.read(spark, root, name, base, set(part)).join(F.broadcast(limits), "file_id")
            outside = (entry < F.col("_first")) | F.coalesce(entry >= F.col("_stop"), F.lit(False))
            dealt[name] = dealt[name].unionByName(old.where(outside).drop("_first", "_stop"))
    named = snapshots.new_commit()
    packed = len(gone) > snapshots.OWN_FOLDERS
    if not packed:  # else each task writes into all folders
        part_of_file = F.shiftright(layout.entry_of(F.col("event_id")), TASK_BITS)
        dealt = {n: df.repartition("file_id", part_of_file) for n, df in dealt.items()}
    wrote = snapshots.write(dealt, root, named, packed)

    def change(v: snapshots.Version) -> snapshots.Version:
        mine = lambda of: {n: {c: [i for i in p.ids if i in gone] for c, p in of.parts.get(n, {}).items() if gone & {*p.ids}} for n in dealt}
        if replace_rows and mine(v) != mine(base):
            raise snapshots.Conflict(f"another writer changed files of {sorted(gone)[:5]} under {root}")
        v = replace(v, schemas={n: _plain(df.schema) for n, df in made.items()} | v.schemas)
        return v.with_files(named, wrote, gone if replace_rows else set(), packed)

    snapshots.commit(spark, root, change)


def stored(spark: SparkSession, root: str, name: str, keys: tuple[int, int] | None = None, layout: KeyLayout | None = None, at: int | None = None) -> DataFrame:
    """A stored table, as version ``at`` has it (default: the last). A key range is also put on file_id, so that whole folders are skipped; rows lie in the order of keys, so row groups are skipped too."""
    df = snapshots.read(spark, root, name, at)
    if keys:
        bits = (layout or KeyLayout()).entry_bits
        df = df.where(F.col("file_id").between(keys[0] >> bits, (keys[1] - 1) >> bits) & (F.col("event_id") >= keys[0]) & (F.col("event_id") < keys[1]))
    return df


def store_nested(nested: DataFrame, table: str, buckets: int) -> DataFrame:
    """Nested events as a stored table of ``buckets`` by event_id: queries scan it, and joins by event_id need no shuffle."""
    nested.write.bucketBy(buckets, "event_id").sortBy("event_id").mode("overwrite").saveAsTable(table)
    return nested.sparkSession.table(table)


def migrate(spark: SparkSession, root: str, to: str, names: list[str], old: KeyLayout, new: KeyLayout, check_only: bool = False) -> None:
    """Rewrite stored tables to another key layout under ``to``, which may be ``root``; all are checked before any is written.

    In place it is one new version: until that is there, the old keys stay, so old and new keys that
    collide never meet. With ``check_only``, it only raises if a key does not fit.
    """
    found = {n: stored(spark, root, n) for n in names}
    for df in found.values():
        check_conversion(df, old, new)
    if check_only:
        return
    files = set().union(*[snapshots.version(spark, root).file_ids(n) for n in names])
    made = {n: df.drop("file_id").withColumn("event_id", old.converted(F.col("event_id"), new)) for n, df in found.items()}
    load(made, to, new, ranges={i: (0, None) for i in files})


def misplaced(df: DataFrame, shards: ShardMap, layout: KeyLayout) -> DataFrame:
    """Rows per shard (null: none owns them) with the least and greatest key."""
    shard = shards.column(layout.file_of(F.col("event_id")))
    return df.groupBy(shard.alias("shard")).agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


def event_ranges(events: DataFrame, chunk: int) -> list[tuple[int, int]] | None:
    """Half-open key ranges that together hold all events, of ``chunk`` events at most and of equal numbers but for one; None if one holds all.

    The first keys of the ranges are found by digits (see ``selection``), over all files at once, so
    gaps between keys do not matter. Keys are unique.
    """
    n, last = events.agg(F.count("*"), F.max("event_id")).first()
    if n <= chunk:
        return None
    ranges = math.ceil(n / chunk)
    spark = events.sparkSession
    wanted = spark.range(ranges).select(F.expr(f"id * {n} div {ranges}").alias("place"))
    starts = sorted(r["value"] for r in selection.at_places(events.select("event_id"), wanted, key="event_id").collect())
    return list(zip(starts, [*starts[1:], last + 1], strict=True))
