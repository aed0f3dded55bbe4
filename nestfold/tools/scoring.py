"""Comparing an answer with a reference answer, both of any size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestfold.functions.statistics import finite
from nestfold.storage import written


STATE = "part int, matched long, value array<double>, a array<long>, b array<long>"


def _counted(got: DataFrame, expected: DataFrame) -> DataFrame:
    """(value, a, b): how often each value is in either multiset; equal values are one row, however many they are."""
    one = lambda df, a, b: df.select((F.col("value").cast("double") + 0.0).alias("value"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    return one(got, 1, 0).unionByName(one(expected, 0, 1)).groupBy("value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def paired(value: np.ndarray, a: np.ndarray, b: np.ndarray, rtol: float, atol: float) -> tuple[int, list[tuple[float, int, int]]]:
    """How many values of a and b, counted at sorted ``value``, pair up within tolerance of b's, from the least on; and what is left that a greater value than the last may still pair with."""
    x, y = ([[v, n] for v, n in zip(value.tolist(), c.tolist(), strict=True) if n] for c in (a, b))
    i = j = matched = 0
    while i < len(x) and j < len(y):
        (p, n), (q, m) = x[i], y[j]
        if abs(p - q) <= atol + rtol * abs(q):
            k = min(n, m)
            matched += k
            x[i][1] -= k
            y[j][1] -= k
            i, j = i + (x[i][1] == 0), j + (y[j][1] == 0)
        elif p < q:
            i += 1
        else:
            j += 1
    last = value[-1] if len(value) else -np.inf
    left = [(p, n, 0) for p, n in x[i:] if p >= last - atol - rtol * abs(last)] + [(q, 0, m) for q, m in y[j:] if q + atol + rtol * abs(q) >= last]
    return matched, left


def unmatched(got: DataFrame, expected: DataFrame, rtol: float = 1e-6, atol: float = 1e-6) -> int:
    """How many of the values of ``got`` (value) have no partner of their own in ``expected`` (value) within tolerance.

    Exact: the largest possible number of pairs is made. Values go in ranges, each of which is paired from
    its least value on. What a range leaves over near its end is handed to the next one, which is
    done again if it had not begun with that; in the usual case only a few are. Null, NaN and
    infinities pair with their like.
    """
    counts = written(_counted(got, expected), "counted-values")
    n = got.count()
    odd = counts.where(~finite("value") | F.col("value").isNull()).agg(F.sum(F.least("a", "b"))).first()[0] or 0
    ranges = counts.where(finite("value")).repartitionByRange("value").sortWithinPartitions("value").withColumn("part", F.spark_partition_id())
    ranges = written(ranges, "value-ranges")
    parts = [r["part"] for r in ranges.groupBy("part").agg(F.min("value").alias("low")).orderBy("low").collect()]
    came: dict[int, list] = {p: [] for p in parts}
    done: dict[int, tuple[int, list]] = {}
    todo = list(parts)
    while todo:
        handed = {p: came[p] for p in todo}

        def run(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("value")
            part = rows.column("part")[0].as_py()
            v, a, b = (np.concatenate([np.array([x[k] for x in handed[part]], t), rows.column(c).to_numpy()]) for k, (c, t) in enumerate((("value", float), ("a", np.int64), ("b", np.int64))))
            matched, left = paired(v, a, b, rtol, atol)  # noqa: B023
            return pa.table({"part": pa.array([part], pa.int32()), "matched": [matched], **{c: pa.array([[x[k] for x in left]], pa.list_(t)) for k, (c, t) in enumerate((("value", pa.float64()), ("a", pa.int64()), ("b", pa.int64())))}})

        for r in ranges.where(F.col("part").isin(todo)).groupBy("part").applyInArrow(run, STATE).collect():
            done[r["part"]] = r["matched"], list(zip(r["value"], r["a"], r["b"], strict=True))
        todo = []
        for before, p in zip(parts, parts[1:], strict=False):
            if came[p] != done[before][1]:
                came[p] = done[before][1]
                todo.append(p)
    return n - odd - sum(matched for matched, _ in done.values())


def compare(got: DataFrame, expected: DataFrame, rtol: float = 1e-6, atol: float = 1e-6) -> tuple[bool, str]:
    """Whether two multisets of (value) are equal within tolerance, and how many values differ if not (see ``unmatched``).

    No values go to the driver, but for those at the ends of ranges. NaN, infinities and nulls equal only themselves.
    """
    sizes = got.count(), expected.count()
    if sizes[0] != sizes[1]:
        return False, f"{sizes[0]} values, expected {sizes[1]}"
    wrong = unmatched(got.select("value"), expected.select("value"), rtol, atol)
    return not wrong, f"{wrong} of {sizes[0]} values differ" if wrong else f"{sizes[0]} values agree"
