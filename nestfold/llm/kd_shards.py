"""Sharding by a k-d tree over document metadata.

Every leaf is split at the weighted median of its bytes along its widest dimension until there are
as many leaves as shards. The dimensions are computed from the text alone (its bytes, code points
per byte, spaces, lines, and a digest), each scaled to 0..1 over all documents. Medians are exact
up to one group of equal texts: they are found by radix on counts, 13 bits a pass over a narrow
written table, and never by sorting a leaf in one task.

Equal texts are one point of that space, which no cut can divide, so a heavy group of them would make
leaves uneven. Groups of more than 1/32 of a shard are therefore given to shards first, the heaviest
first, each to the shard that has the least; the tree then aims at what each shard still lacks. Only a
group that outweighs a whole shard is not kept together: its rows are told apart by their ids.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestfold.llm.tables import parts_for
from nestfold.ranks import slots, spread
from nestfold.storage import written

DIMENSIONS = ("d_bytes", "d_wide", "d_space", "d_line", "d_hash")
_RADIX, _BITS = 13, 52  # of an order key: 18 bits of the dimension, then 34 of the text's digest


def metadata(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, size, text_crc32, digest, five dimensions) of (key, text). size: UTF-8 bytes plus 1; null text has none."""
    text = F.coalesce("text", F.lit(""))
    n = F.octet_length(text).cast("double")
    return docs.select(
        key,
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("digest"),
        F.log2(n + 1).alias("d_bytes"),
        ((n - F.length(text)) / (n + 1)).alias("d_wide"),
        ((n - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))) / (n + 1)).alias("d_space"),
        ((n - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))) / (n + 1)).alias("d_line"),
        (F.pmod(F.xxhash64(text), F.lit(1 << 30)) / float(1 << 30)).alias("d_hash"),
    )


def _cuts(rows: DataFrame, halves: dict[int, float]) -> dict[int, int]:
    """For each node the order key to cut at: the weight of all rows up to it is nearest to what is wanted.

    rows: (node, order, size). Each pass fixes 13 more bits of every node's key, from the sums of a
    histogram of at most 2^13 bins a node.
    """
    found = {node: (0, 0) for node in halves}  # bits fixed so far, weight below them
    cuts = {}
    for shift in range(_BITS - _RADIX, -1, -_RADIX):
        fixed = F.create_map(*[F.lit(x) for node, (k, _) in found.items() for x in (node, k)])
        near = rows.where(F.shiftright("order", shift + _RADIX) == fixed[F.col("node")])
        sums: dict[int, list] = {node: [] for node in halves}
        for node, k, w in near.groupBy("node", F.shiftright("order", shift).alias("bin")).agg(F.sum("size")).collect():
            sums[node].append((k, w))
        for node, bins in sums.items():
            below = found[node][1]
            bins.sort()
            for k, w in bins:
                if below + w >= halves[node] or k == bins[-1][0]:
                    break
                below += w
            found[node] = (k, below)
            if not shift:
                cuts[node] = k if abs(below + w - halves[node]) <= abs(below - halves[node]) else k - 1
    return cuts


def placed(heavy: list[tuple[int, int]], shards: int) -> tuple[dict[int, int], list[int]]:
    """The shard of each (digest, weight), the heaviest first to the shard that has the least, and what each shard then has."""
    load, home = [0] * shards, {}
    for digest, weight in sorted(heavy, key=lambda h: (-h[1], h[0])):
        home[digest] = at = min(range(shards), key=lambda s: (load[s], s))
        load[at] += weight
    return home, load


def _chosen(of: Column, values: dict[int, int], otherwise: Column) -> Column:
    """values[of], or ``otherwise``."""
    if not values:
        return otherwise
    return F.coalesce(F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[of], otherwise)


def tree(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` (see ``metadata``) with ``shard`` from 0 to ``shards`` - 1.

    A node that has to become some shards is cut so that the left half of them gets its part of what
    they all still lack. Equal texts have equal metadata and stay together, up to a whole shard's
    bytes (see above). What the driver holds is fewer than 32 groups a shard and the histograms.
    """
    rows = written(rows, "metadata")
    spans = rows.agg(F.sum("size"), *[f(d) for d in DIMENSIONS for f in (F.min, F.max)]).first()
    total = spans[0] or 0
    low = dict(zip(DIMENSIONS, spans[1::2], strict=True))
    width = {d: (high - low[d]) or 1.0 for d, high in zip(DIMENSIONS, spans[2::2], strict=True)} if total else {}
    if not total:
        return rows.withColumn("shard", F.lit(0))
    leaf = total / shards
    heavy = rows.groupBy("digest").agg(F.sum("size").alias("_w")).where(F.col("_w") > leaf / 32)
    heavy = [tuple(r) for r in heavy.collect()]
    giant = [digest for digest, weight in heavy if weight > leaf]
    home, load = placed([h for h in heavy if h[1] <= leaf], shards)
    lacks = [max(leaf - have, 0.0) for have in load]
    tie = F.when(F.col("digest").isin(giant), F.xxhash64("digest", "doc_id")).otherwise(F.col("digest")) if giant else F.col("digest")
    rows = rows.withColumns({"_home": _chosen(F.col("digest"), home, F.lit(-1)), "_tie": F.shiftrightunsigned(tie, 64 - 34)})
    rows = rows.withColumn("node", F.when(F.col("_home") < 0, 0))  # null: not in the tree
    todo = {0: (0, shards)}  # node: its first shard, and the one after its last
    for _ in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        split = {n: (a, z) for n, (a, z) in todo.items() if z - a > 1}
        inside = rows.where(F.col("node").isin(list(split))).groupBy("node").agg(F.sum("size").alias("w"), *[((F.max(d) - F.min(d)) / width[d]).alias(d) for d in DIMENSIONS]).collect()
        widest = {r["node"]: max(DIMENSIONS, key=lambda d: (r[d], d)) for r in inside}
        halves = {r["node"]: r["w"] * _share(lacks, *split[r["node"]]) for r in inside}
        scaled = F.lit(0.0)
        for node, d in widest.items():
            scaled = F.when(F.col("node") == node, (F.col(d) - low[d]) / width[d]).otherwise(scaled)
        place = F.least(F.floor(scaled * (1 << 18)), F.lit((1 << 18) - 1)).cast("long")
        rows = rows.withColumn("order", F.shiftleft(place, 34).bitwiseOR(F.col("_tie")))
        cuts = _cuts(rows.select("node", "order", "size"), halves) if halves else {}
        right, following = F.lit(0), {}
        for node, (a, z) in todo.items():
            middle = a + max((z - a) // 2, 1)
            following[2 * node] = (a, middle)
            if node in cuts:
                right = F.when((F.col("node") == node) & (F.col("order") > F.lit(cuts[node])), 1).otherwise(right)
            if z > middle:
                following[2 * node + 1] = (middle, z)
        rows = rows.withColumn("node", F.col("node") * 2 + right).drop("order")
        todo = following
    shard = _chosen(F.col("node"), {node: a for node, (a, _) in todo.items()}, F.col("_home"))
    return rows.withColumn("shard", shard.cast("int")).drop("node", "_tie", "_home")


def _share(lacks: list[float], first: int, stop: int) -> float:
    """The part of what the shards from ``first`` lack that the left half of them does."""
    middle = first + (stop - first) // 2
    whole = sum(lacks[first:stop])
    return sum(lacks[first:middle]) / whole if whole else (middle - first) / (stop - first)


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of (doc_id, text) under the law ``bytes``.

    ``docs`` has one row per id (see ``tables.texts``). slot numbers a shard's documents from 0 by
    bucket and id. An empty table gives an empty result.
    """
    made = tree(metadata(docs), shards).select("doc_id", "size", "text_crc32", "shard")
    buckets = parts_for(docs.sparkSession, 0)
    made = written(made.withColumn("_bucket", spread(F.col("doc_id"), buckets)), "shards")
    placed = slots(made, ["shard"], "_bucket", ["doc_id"], "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
