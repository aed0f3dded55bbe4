"""Reading the text tables, and the rules that all operators here share.

Rows with a null id cannot be named in a result, so operators whose result is keyed by an id leave
them out. Where an id is repeated, one row counts: the one with the smallest text (null before any).
A null text is an empty text. Columns besides those that an operator names are never looked at, so
extra columns with clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, key: str = "doc_id", text: str = "text", *extra: str) -> DataFrame:
    """(key, text, *extra): one row for each id that is not null, text never null.

    Whether ids repeat is asked of the ids alone; only if they do, rows are gathered by id.
    """
    rows = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text), *extra).where(F.col(key).isNotNull())
    again = df.select(key).where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1")
    if not again.take(1):
        return rows
    first = F.min(F.struct(F.col(text), *[F.col(c) for c in extra])).alias("_row")
    return rows.groupBy(key).agg(first).select(key, "_row.*")


def small_batches(spark: SparkSession, n_bytes: int = 4 << 20) -> None:
    """Texts go to Python in batches of ``n_bytes`` or one text, so a worker's memory does not follow the length of texts.

    The session's own bound is kept where it is smaller.
    """
    have = int(spark.conf.get(BATCH_BYTES).rstrip("b"))
    if have <= 0 or have > n_bytes:
        spark.conf.set(BATCH_BYTES, str(n_bytes))


def parts_for(spark: SparkSession, n_bytes: float, each: float = 8e6, least: int = 1) -> int:
    """So many partitions that each holds about ``each`` bytes, and at least as many as the session shuffles to."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")), int(n_bytes / each) + 1)
