"""Connected components of links between integer nodes, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestfold.storage import drop, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over (u, v), as a written table. Least neighbours are a written table too, so that the join with
    a node of very many links has two plain exchanges, whose partitions Spark can split."""
    both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")) if not large else edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    met = both.join(least, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    made = written(out.where("u <> v").distinct(), "edges")
    drop(least)
    return made


def components(edges: DataFrame) -> DataFrame:
    """(node, component_id): each node of ``edges`` (u, v) and the smallest node that it reaches.

    Nodes without links to others are not in the result. Repeated and self links are harmless.
    Every step is a written table, which goes once the next one is there; links never go to the
    driver, only their number and checksum.
    """
    edges = written(edges.where("u <> v").distinct(), "edges")
    seen = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == seen or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component_id")).union(edges.select(F.col("v"), F.col("v"))).distinct()
        seen = now
        larger = _star(edges, True)
        smaller = _star(larger, False)
        drop(edges)
        drop(larger)
        edges = smaller
