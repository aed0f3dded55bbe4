"""Values at given places of an order, exactly and without a sort: by digits, from the highest down.

Numbers are turned into whole numbers in the same order (of doubles, their IEEE bits), which are read as
four digits of 16 bits. A pass counts, for each group and each prefix that is still in question, how many
values have each next digit; running sums of these counts tell in which digit each wanted place
lies. After four passes the value is known. Counts are summed before they are shuffled, so no group
is ever in one task, however large; what moves are at most 65,536 counts for each prefix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nestfold.storage import written

_DIGITS = (48, 32, 16, 0)


def ordered_bits(x: Column) -> Column:
    """A long in the same order as the finite doubles: IEEE bits without sign, taken negative for negative numbers; -0.0 as 0.0."""
    a = F.abs(x)
    guess = F.floor(F.log2(a))
    power = lambda e: F.pow(F.lit(2.0), e)
    e = guess + F.when(a < power(guess), -1).when(a >= power(guess + 1), 1).otherwise(0)  # the logarithm is rounded
    normal = (e + 1023) * F.lit(1 << 52) + ((a / power(e) - 1) * F.lit(float(1 << 52))).cast("long")
    tiny = (a * F.lit(2.0**537) * F.lit(2.0**537)).cast("long")
    bits = F.when(a < F.lit(2.0**-1022), tiny).otherwise(normal)
    return F.when(x < 0, -bits).otherwise(bits)


def _located(counts: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """``wanted`` (by, _place, ...) with the digit in which each place lies, and the place inside of it. counts: (by, _digit, _n)."""
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*by, "_digit", F.coalesce(before, F.lit(0)).alias("_place"))
    rest = [c for c in wanted.columns if c not in (*by, "_place")]
    both = starts.withColumn("_asks", F.lit(0)).unionByName(wanted.withColumn("_asks", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy(*by).orderBy("_place", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(F.when(F.col("_asks") == 0, F.col(c)), ignorenulls=True).over(order)
    met = both.withColumns({"_in": last("_digit"), "_start": last("_place")}).where("_asks = 1")
    return met.select(*by, *rest, F.col("_in").alias("_digit"), (F.col("_place") - F.col("_start")).alias("_place"))


def at_places(values: DataFrame, wanted: DataFrame, by: Sequence[str] = (), key: str = "key", value: str | None = None) -> DataFrame:
    """``wanted`` (by, place, ...) with ``value``: that of the row of ``values`` at this place, from 0, in the order of ``key``, a long.

    values: (by, key, value); by default the value is the key. Every place must be one of its group.
    ``values`` is read four times, so it should be cheap to read.
    """
    by, named = list(by), value or key
    rows = values.select(*by, F.col(key).alias("_key"), F.col(named).alias("_value"))
    ask = written(wanted.withColumnRenamed("place", "_place").withColumns({"place": F.col("_place"), "_prefix": F.lit(0).cast("long")}), "places")
    for shift in _DIGITS:
        digit = F.shiftright("_key", shift) if shift == 48 else F.shiftright("_key", shift).bitwiseAND(F.lit(0xFFFF))
        prefix = F.lit(0).cast("long") if shift == 48 else F.shiftright("_key", shift + 16)
        each = rows.select(*by, prefix.alias("_prefix"), digit.alias("_digit"), "_value")
        if shift != 48:  # prefixes in question only; equal keys of null groups meet too
            live = ask.select(*by, "_prefix").distinct()
            same = lambda c: F.col(f"e.{c}").eqNullSafe(F.col(f"l.{c}"))
            on = same("_prefix")  # a plain = would add a filter that works out the key again, for every value and without shared steps
            for c in by:
                on &= same(c)
            each = each.alias("e").join(live.alias("l"), on, "left_semi")
        counts = each.groupBy(*by, "_prefix", "_digit").agg(F.count("*").alias("_n"), *([F.min("_value").alias("_value")] if not shift else []))
        counts = written(counts, "digits")
        found = _located(counts.drop("_value"), ask, [*by, "_prefix"])
        if shift:
            ask = written(found.withColumn("_prefix", F.when(F.lit(shift == 48), F.col("_digit")).otherwise(F.shiftleft("_prefix", 16).bitwiseOR(F.col("_digit")))).drop("_digit"), "places")
        else:
            on = F.col("f._prefix").eqNullSafe(F.col("c._prefix")) & (F.col("f._digit") == F.col("c._digit"))
            for c in by:
                on &= F.col(f"f.{c}").eqNullSafe(F.col(f"c.{c}"))
            rest = [F.col(f"f.{c}") for c in found.columns if c not in ("_place", "_prefix", "_digit")]
            return found.alias("f").join(counts.alias("c"), on).select(*rest, F.col("c._value").alias("value"))
    raise AssertionError


def quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, column, share, value): exact quantiles of several columns and of all groups at once, interpolated between neighbours.

    Values that are null or not finite do not count; a group without others has no row for that column.
    """
    by = list(by)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns]))
    values = df.select(*by, each.alias("_o")).select(*by, "_o.column", "_o.v").where("v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('inf')")
    values = values.select(*by, "column", ordered_bits(F.col("v")).alias("key"), "v")
    n = values.groupBy(*by, "column").agg(F.count("*").alias("_count"))
    at = n.select(*by, "column", "_count", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")).withColumn("_at", F.col("share") * (F.col("_count") - 1))
    low, high = F.floor("_at").cast("long"), F.least(F.ceil("_at").cast("long"), F.col("_count") - 1)
    wanted = at.select(*by, "column", "share", (F.col("_at") - low).alias("_rest"), F.explode(F.array(F.struct(low.alias("place"), F.lit(0).alias("up")), F.struct(high.alias("place"), F.lit(1).alias("up")))).alias("_w"))
    found = at_places(values, wanted.select(*by, "column", "share", "_rest", "_w.place", "_w.up"), [*by, "column"], "key", "v")
    side = lambda up: F.max(F.when(F.col("up") == up, F.col("value")))
    return found.groupBy(*by, "column", "share").agg((side(0) + (side(1) - side(0)) * F.max("_rest")).alias("value"))
