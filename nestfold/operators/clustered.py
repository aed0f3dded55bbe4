"""Flat tables that lie next to each other: events and their objects in the same buckets, in the order of their keys.

All tables of a set have the same number of buckets by event_id, a file each, with rows in the order of
event_id and then their place. So joins of events and objects, of objects with each other and groups by
event need no exchange, and a range of keys skips the row groups that are out of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestfold.functions.kinematics import p4
from nestfold.operators.nesting import fetch as _fetch

VECTOR = ("pt", "eta", "phi", "mass")


def with_vectors(objects: DataFrame) -> DataFrame:
    """Objects of (pt, eta, phi, mass) with their energy and Cartesian components, so that no query makes them anew."""
    vector = p4(*[F.col(c) for c in VECTOR]).alias("_v")
    return objects.select("*", vector).select(*objects.columns, "_v.*")


def store(flat: dict[str, DataFrame], prefix: str, buckets: int, group_bytes: int = 8 << 20, key: str = "event_id", folder: str | None = None) -> None:
    """Write each table as ``<prefix>_<name>``, in place of one of that name; row groups are of ``group_bytes``.

    A column that ends in ``_index``, or ``i``, is an object's place, by which rows of an event are ordered.
    Choose ``buckets`` so that one has about as many bytes as a task should read. With ``folder``, the
    tables' files go there instead of the warehouse.
    """
    for name, df in flat.items():
        order = [key, *[c for c in df.columns if c == "i" or c.endswith("_index")]]
        rows = df.repartition(buckets, key).sortWithinPartitions(*order)
        at = {"path": f"{folder}/{name}"} if folder else {}
        rows.write.bucketBy(buckets, key).sortBy(*order).options(**{"parquet.block.size": group_bytes}, **at).mode("overwrite").saveAsTable(f"{prefix}_{name}")


def table(spark: SparkSession, prefix: str, name: str, keys: tuple[int, int] | None = None, key: str = "event_id") -> DataFrame:
    """A stored table, or its rows of a half-open range of keys."""
    df = spark.table(f"{prefix}_{name}")
    return df if keys is None else df.where((F.col(key) >= keys[0]) & (F.col(key) < keys[1]))


def fetch(spark: SparkSession, prefix: str, name: str, where: str | None = None, keys: tuple[int, int] | None = None, event_columns: list[str] | None = None, object_columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The selected events and their objects (see ``nesting.fetch``), bucket by bucket."""
    return _fetch(table(spark, prefix, "events", keys), table(spark, prefix, name, keys), where, None, event_columns, object_columns)


_MASS = "sqrt(greatest({e} * {e} - {x} * {x} - {y} * {y} - {z} * {z}, 0D))"


def _mass(*who: str) -> str:
    return _MASS.format(**{k: "(" + " + ".join(f"{w}.{c}" for w in who) + ")" for k, c in (("e", "e"), ("x", "px"), ("y", "py"), ("z", "pz"))})


def trijet(spark: SparkSession, prefix: str) -> DataFrame:
    """(event_id, value): transverse momentum of the three jets whose mass is nearest to 172.5, the first of equally near ones; jets with vectors."""
    return spark.sql(f"""
        SELECT event_id, sqrt(best.x * best.x + best.y * best.y) AS value FROM (
          SELECT event_id, min_by(struct(x, y), struct(abs(m - 172.5D), i, j, k)) AS best FROM (
            SELECT a.event_id, a.i, b.i AS j, c.i AS k, {_mass("a", "b", "c")} AS m, a.px + b.px + c.px AS x, a.py + b.py + c.py AS y
            FROM {prefix}_jets a JOIN {prefix}_jets b ON a.event_id = b.event_id AND a.i < b.i JOIN {prefix}_jets c ON b.event_id = c.event_id AND b.i < c.i)
          GROUP BY event_id)""")


def zmumu_pairs(spark: SparkSession, prefix: str) -> DataFrame:
    """(event_id, i, j, value): mass of each pair of muons of opposite charge between 60 and 120; muons with vectors."""
    return spark.sql(f"""
        SELECT event_id, i, j, value FROM (
          SELECT a.event_id, a.i, b.i AS j, {_mass("a", "b")} AS value
          FROM {prefix}_muons a JOIN {prefix}_muons b ON a.event_id = b.event_id AND a.i < b.i AND a.charge <> b.charge)
        WHERE value > 60 AND value < 120""")


def zmumu_two(spark: SparkSession, prefix: str) -> DataFrame:
    """(event_id, value): mass of the two muons of events that have just two, of opposite charge, from 60 to 120."""
    return spark.sql(f"""
        SELECT event_id, value FROM (
          SELECT a.event_id, {_mass("a", "b")} AS value
          FROM {prefix}_muons a JOIN {prefix}_muons b ON a.event_id = b.event_id AND a.i = 0 AND b.i = 1 AND a.charge <> b.charge
          JOIN {prefix}_events e ON e.event_id = a.event_id AND e.n_muons = 2)
        WHERE value BETWEEN 60 AND 120""")
