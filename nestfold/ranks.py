"""Gapless numbering inside groups of any size, without putting a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slots(df: DataFrame, groups: list[str], bucket: str, order: list[str], name: str) -> DataFrame:
    """Number the rows of every group from 0, by ``bucket`` and then ``order``.

    ``bucket`` must be a small integer column that spreads each group over many tasks. Only the
    (group, bucket) counts are put in order as a whole; rows are ordered inside their bucket.
    ``df`` should be a written table, as it is read twice.
    """
    counts = df.groupBy(*groups, bucket).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*groups, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*groups, bucket).orderBy(*order)
    numbered = df.withColumn("_i", F.row_number().over(inside))
    return (
        numbered.join(starts, [*groups, bucket], "left")
        .withColumn(name, (F.col("_start") + F.col("_i") - 1).cast("long"))
        .drop("_start", "_i")
    )


def spread(key: Column, buckets: int) -> Column:
    """A bucket from 0 to ``buckets`` - 1 that depends on the key alone."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
