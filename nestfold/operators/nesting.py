"""Between flat tables and nested events, and from nested events to dense blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def orphans(events: DataFrame, objects: DataFrame, key: str = "event_id") -> DataFrame:
    """Objects whose event is not there."""
    return objects.join(events.select(key), key, "left_anti")


def nest(events: DataFrame, collections: dict[str, DataFrame], index: dict[str, str], key: str = "event_id", check: bool = False) -> DataFrame:
    """Events with one array of structs per collection, objects in index order, none as an empty array.

    With ``check``, an object without an event raises before the result is returned.
    """
    out = events
    for name, objects in collections.items():
        if check and orphans(events, objects, key).take(1):
            raise ValueError(f"{name} has objects without an event")
        fields = [c for c in objects.columns if c not in (key, index[name])]
        made = F.sort_array(F.collect_list(F.struct(index[name], *fields)))
        packed = objects.groupBy(key).agg(F.transform(made, _taker(fields)).alias(name))
        out = out.join(packed, key, "left").withColumn(name, F.coalesce(name, F.array()))
    return out


def _taker(fields: list[str]):
    return lambda o: F.struct(*[o[f].alias(f) for f in fields])


def nest_present(objects: DataFrame, name: str, index: str, key: str = "event_id") -> DataFrame:
    """Like ``nest`` for one collection, of the events that have an object."""
    fields = [c for c in objects.columns if c not in (key, index)]
    made = F.sort_array(F.collect_list(F.struct(index, *fields)))
    return objects.groupBy(key).agg(made.alias(name))


def unnest(nested: DataFrame, name: str, index: str, key: str = "event_id") -> DataFrame:
    """One row per object with its place in its event; empty events give none."""
    return nested.select(key, F.posexplode(name).alias(index, "_o")).select(key, index, "_o.*")


def fetch(events: DataFrame, objects: DataFrame, where: str | None = None, keys: tuple[int, int] | None = None, event_columns: list[str] | None = None, object_columns: list[str] | None = None, key: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """The selected events, and their objects.

    ``where`` is a SQL condition in the scope of ``events``, also as ``events.column``. ``keys`` is a
    half-open range; Catalyst carries it over to the objects. Column lists must have the key.
    """
    for asked in (event_columns, object_columns):
        if asked is not None and key not in asked:
            raise ValueError(f"{key} must be among the columns")
    picked = events.alias("events")
    picked = picked.where((F.col(key) >= keys[0]) & (F.col(key) < keys[1])) if keys else picked
    picked = picked.where(F.expr(where)) if where else picked
    found = objects.join(picked.select(key), key, "left_semi")
    return picked.select(*(event_columns or events.columns)), found.select(*(object_columns or objects.columns))


def pairs(items: Column, f, keep=None) -> Column:
    """f(a, b) for every pair of an array, in the order of first and then second place; ``keep`` filters pairs first."""
    n = F.size(items)

    def of(a, i):
        rest = F.slice(items, i + 2, n)
        rest = F.filter(rest, lambda b: keep(a, b)) if keep else rest
        return F.transform(rest, lambda b: f(a, b))

    return F.flatten(F.transform(items, of))


def dense(items: Column, width: int, pad: Column) -> Column:
    """The first ``width`` elements, padded to ``width``."""
    if not width:
        return F.array()
    return F.slice(F.concat(items, F.array_repeat(pad, width)), 1, width)


def mask(items: Column, width: int) -> Column:
    """``width`` booleans: whether an element is real."""
    if not width:
        return F.array().cast("array<boolean>")
    return F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: i <= F.size(items))


def tensor(nested: DataFrame, name: str, fields: list[str], width: int | None = None, pad: float = 0.0, key: str = "event_id") -> DataFrame:
    """(key, x, mask, count): an event's objects as ``width`` structs of doubles, padded, which are real, and how many there were.

    By default ``width`` is the largest number of objects of any event; with a smaller one, later
    objects are cut off, which count tells.
    """
    if width is None:
        width = max(nested.agg(F.max(F.size(name))).first()[0] or 0, 0)
    full = F.transform(name, lambda o: F.struct(*[o[f].cast("double").alias(f) for f in fields]))
    empty = F.struct(*[F.lit(float(pad)).alias(f) for f in fields])
    return nested.select(key, dense(full, width, empty).alias("x"), mask(F.col(name), width).alias("mask"), F.size(name).alias("count"))


def standardised(objects: DataFrame, fields: list[str]) -> DataFrame:
    """``objects`` with each field less its mean over its standard deviation (population; below 1e-6 counts as 1)."""
    stats = objects.agg(*[f(c).alias(f"_{k}_{c}") for c in fields for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    met = objects.crossJoin(F.broadcast(stats))  # one row
    width = lambda c: F.when(F.col(f"_s_{c}") < 1e-6, 1.0).otherwise(F.col(f"_s_{c}"))
    return met.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / width(c) for c in fields}).select(objects.columns)


def tiled(df: DataFrame, times: int, stride: int, key: str = "event_id") -> DataFrame:
    """``df`` repeated, each repeat with its keys moved on by ``stride``."""
    copies = F.explode(F.sequence(F.lit(0), F.lit(times - 1)))
    return df.withColumn("_k", copies).withColumn(key, F.col(key) + F.col("_k") * F.lit(stride)).drop("_k")
