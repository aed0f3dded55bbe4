"""Summaries, histograms, and merging of partial results."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestfold.functions import selection


def finite(name: str):
    c = F.col(name)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def quantiles(df: DataFrame, value: str, shares: Sequence[float]) -> list[float | None]:
    """Exact quantiles, interpolated between neighbours, of the values that are finite; None for each if there is none.

    Found digit by digit (see ``selection``), so nothing is sorted; only the quantiles go to the driver.
    """
    found = {r["share"]: r["value"] for r in selection.quantiles(df, [value], list(shares)).collect()}
    return [found.get(float(s)) for s in shares]


QUARTILES = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q100": 1.0}


def summary(df: DataFrame, value: str) -> DataFrame:
    """One row: n, n_nonfinite (nulls too), mean, std (population) and exact quantiles of the finite values."""
    return summaries(df, [value]).drop("column")


def summaries(df: DataFrame, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, column, n, n_nonfinite, mean, std, q0, q25, q50, q75, q100): a ``summary`` of each column in each group, in the same few passes.

    A group without finite values has null quantiles; without rows and ``by``, n is 0.
    """
    by, made = list(by), []
    for v in values:
        ok = F.when(finite(v), F.col(v))
        stats = df.groupBy(*by) if by else df
        made.append(stats.agg(F.lit(v).alias("column"), F.count("*").alias("n"), F.coalesce(F.sum(F.when(finite(v), 0).otherwise(1)), F.lit(0)).alias("n_nonfinite"), F.avg(ok).alias("mean"), F.stddev_pop(ok).alias("std")))
    found = selection.quantiles(df, values, list(QUARTILES.values()), by)
    wide = found.groupBy(*by, "column").agg(*[F.max(F.when(F.col("share") == q, F.col("value"))).alias(k) for k, q in QUARTILES.items()])
    both = reduce(DataFrame.unionByName, made).alias("s").join(wide.alias("q"), _equal("s", "q", [*by, "column"]), "left")
    return both.select(*[f"s.{c}" for c in (*by, "column", "n", "n_nonfinite", "mean", "std")], *[f"q.{k}" for k in QUARTILES])


def _equal(a: str, b: str, columns: Sequence[str]) -> Column:
    """Whether rows agree in ``columns``, nulls too."""
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns])


def metric(df: DataFrame, value: str = "value") -> DataFrame:
    """One row: n, and the mean, which is NaN of no values."""
    return df.agg(F.count(value).alias("n"), F.coalesce(F.avg(value), F.lit(float("nan"))).alias("mean"))


def histogram(df: DataFrame, value: str, bins: int, low: float, high: float) -> DataFrame:
    """(bin, n) for bins 0 to ``bins`` - 1 of equal width, the last closed on the right; empty bins have no row."""
    c = F.col(value)
    at = F.least(F.floor((c - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return df.where(finite(value) & c.between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def combined(parts: Iterable[DataFrame | None], by: Sequence[str] | None = None) -> DataFrame | None:
    """Partial results as one. Without ``by``, the rows of all; with it, the sums of all other columns for each key.

    A part that is None counts for nothing; None if all are.
    """
    there = [p for p in parts if p is not None]
    if not there:
        return None
    rows = reduce(DataFrame.unionByName, there)
    if by is None:
        return rows
    return rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in rows.columns if c not in by])
