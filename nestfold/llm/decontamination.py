"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is contained in a document if at least ``share`` of its distinct word shingles are. Items
are partitioned by the power of two below their number of shingles n. An item's MinHash sketch is its
k smallest shingle hashes, k being one number for a partition: the largest n - ceil(share * n) + 1 of
its items, so that a document with enough of an item must hold one of its sketch. So the search loses
nothing, however long the document is and however short the item. Documents' shingles probe the
sketches; candidates are verified by exact shingle containment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestfold.storage import written

#: So many sketch rows may be broadcast (16 bytes each); above, they meet documents in a shuffled join.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    """The lower-cased runs of letters and digits of a text; an empty array for none or null."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda w: w != "")


def shingles(tokens: Column, width: int) -> Column:
    """All runs of ``width`` words, joined by spaces; none if there are fewer words."""
    last = F.size(tokens) - width
    runs = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(tokens, i + 1, width), " "))
    return F.when(last >= 0, runs).otherwise(F.array().cast("array<string>"))


def item_shingles(items: DataFrame, width: int = 5) -> DataFrame:
    """(item_id, shingle, h, n): the distinct shingles of each item, their hash, and how many there are.

    An item of fewer words is one shingle, of all its words; an item without words has none and is
    in no document. Of repeated item ids, the item with the smallest text counts.
    """
    rows = items.where(F.col("item_id").isNotNull()).groupBy("item_id").agg(F.min("text").alias("text"))
    tokens = rows.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    short = F.array(F.array_join("w", " "))
    runs = F.array_distinct(F.when(F.size("w") < width, short).otherwise(shingles(F.col("w"), width)))
    made = tokens.select("item_id", F.least(F.size("w"), F.lit(width)).alias("width"), runs.alias("runs"))
    each = made.select("item_id", "width", F.size("runs").alias("n"), F.explode("runs").alias("shingle"))
    return each.withColumn("h", F.xxhash64("shingle"))


def contained(docs: DataFrame, items: DataFrame, share: float = 0.8, width: int = 5) -> DataFrame:
    """(doc_id, item_id, matched, n_shingles, containment): every document that contains ``share`` of an item.

    ``docs`` is (doc_id, text) with one row per id. Documents without words contain nothing. An item
    text that is in many items counts for each of them.
    """
    parts = written(item_shingles(items, width), "items")
    lengths = [r["width"] for r in parts.select("width").distinct().collect()]  # at most ``width`` values
    need = F.ceil(F.lit(share) * F.col("n") - 1e-9)
    size = F.floor(F.log2("n")).alias("partition")
    k = parts.groupBy(size).agg(F.max(F.col("n") - need + 1).cast("int").alias("k"))  # 31 partitions at most
    items_of = parts.groupBy("item_id", size).agg(F.sort_array(F.collect_list("h")).alias("hs"))
    smallest = items_of.join(F.broadcast(k), "partition").select("item_id", F.slice("hs", 1, F.col("k")).alias("hs"))
    sketch = written(smallest.select("item_id", F.explode("hs").alias("h")), "sketch")
    keys = sketch.select("h").distinct()
    keys = F.broadcast(keys) if sketch.count() <= BROADCAST_ROWS else keys

    def runs(rows: DataFrame) -> Column:
        by_length = [shingles(F.col("w"), k) for k in lengths] or [F.array().cast("array<string>")]
        return F.concat(*by_length)

    tokens = docs.select("doc_id", words(F.col("text")).alias("w"))
    hashed = tokens.select("doc_id", F.explode(F.transform(runs(tokens), lambda s: F.xxhash64(s))).alias("h"))
    hits = hashed.join(keys, "h", "left_semi").distinct()
    pairs = written(hits.join(sketch, "h").select("doc_id", "item_id").distinct(), "candidates")
    few = docs.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", words(F.col("text")).alias("w"))
    exact = few.select("doc_id", F.explode(F.array_distinct(runs(few))).alias("shingle"))
    known = parts.select("item_id", "shingle", "n")
    known = F.broadcast(known) if parts.count() <= BROADCAST_ROWS // 8 else known
    met = exact.join(known, "shingle").groupBy("doc_id", "item_id").agg(F.count("*").alias("matched"), F.first("n").cast("long").alias("n_shingles"))
    return met.join(pairs, ["doc_id", "item_id"], "left_semi").where(F.col("matched") >= F.ceil(F.lit(share) * F.col("n_shingles") - 1e-9)).withColumn("containment", F.col("matched") / F.col("n_shingles"))


def clean(docs: DataFrame, items: DataFrame, share: float = 0.8, width: int = 5) -> DataFrame:
    """The rows of ``docs`` that contain no item."""
    found = written(contained(docs.select("doc_id", "text"), items, share, width).select("doc_id").distinct(), "leaks")
    return docs.join(found, "doc_id", "left_anti")
