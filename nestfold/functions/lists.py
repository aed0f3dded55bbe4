"""Operations on array columns, one value or one array a row, and on whole numeric columns.

All are built-in expressions. Elements that are null are no elements: reductions pass over them. An
empty list has no minimum, maximum, mean, spread or place (null); its sum is 0, its product 1, its
count 0; ``all`` of it is true, ``any`` false.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def there(items: Column) -> Column:
    """Without nulls."""
    return F.filter(items, lambda x: x.isNotNull())


def count(items: Column) -> Column:
    return F.size(there(items))


def count_nonzero(items: Column) -> Column:
    return F.size(F.filter(items, lambda x: x != 0))


def sum_(items: Column) -> Column:
    return F.aggregate(there(items), F.lit(0.0), lambda s, x: s + x)


def prod(items: Column) -> Column:
    return F.aggregate(there(items), F.lit(1.0), lambda s, x: s * x)


def mean(items: Column) -> Column:
    return F.when(count(items) > 0, sum_(items) / count(items))


def moment(items: Column, n: int) -> Column:
    """The mean of the ``n``-th powers."""
    return mean(F.transform(items, lambda x: F.pow(x, F.lit(float(n)))))


def var(items: Column, ddof: int = 0) -> Column:
    """The variance, in two passes; null where there are ``ddof`` elements or fewer."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("n"))
    sums = F.aggregate(there(items), start, lambda a, x: F.struct((a["s"] + x).alias("s"), (a["n"] + 1).alias("n")))
    # the sums are bound once, as the element of an array of one
    of = lambda t: F.aggregate(there(items), F.lit(0.0), lambda s, x: s + (x - t["s"] / t["n"]) * (x - t["s"] / t["n"])) / (t["n"] - ddof)
    return F.get(F.transform(F.array(sums), lambda t: F.when(t["n"] > ddof, of(t))), F.lit(0))


def std(items: Column, ddof: int = 0) -> Column:
    return F.sqrt(var(items, ddof))


def ptp(items: Column) -> Column:
    """Peak to peak: the largest less the least."""
    return F.array_max(items) - F.array_min(items)


def any_(items: Column, f: Callable[[Column], Column] = lambda x: x) -> Column:
    return F.exists(items, lambda x: F.coalesce(f(x), F.lit(False)))


def all_(items: Column, f: Callable[[Column], Column] = lambda x: x) -> Column:
    return F.forall(items, lambda x: F.coalesce(f(x), F.lit(True)))


def argsort(items: Column, descending: bool = False) -> Column:
    """Places in the order of their elements; of ties, the first place first."""
    key = (lambda x: -x) if descending else (lambda x: x)
    numbered = F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i")))
    return F.transform(F.array_sort(numbered), lambda s: s["i"])


def argmin(items: Column) -> Column:
    """The first place of the least element."""
    return F.array_min(F.transform(items, lambda x, i: F.when(x.isNotNull(), F.struct(x.alias("k"), i.alias("i")))))["i"]


def argmax(items: Column) -> Column:
    """The first place of the largest element."""
    return -F.array_max(F.transform(items, lambda x, i: F.when(x.isNotNull(), F.struct(x.alias("k"), (-i).alias("i")))))["i"]


def cartesian(a: Column, b: Column, f: Callable[[Column, Column], Column] = lambda x, y: F.struct(x.alias("0"), y.alias("1"))) -> Column:
    """f of every element of ``a`` with every one of ``b``, in the order of ``a``."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: f(x, y))))


def argcartesian(a: Column, b: Column) -> Column:
    return cartesian(local_index(a), local_index(b))


def local_index(items: Column) -> Column:
    return F.transform(items, lambda x, i: i)


def argcombinations(items: Column, n: int) -> Column:
    """Places i < j (n = 2) or i < j < k (n = 3) as structs with fields 0, 1, 2."""
    size, at = F.size(items), local_index(items)
    later = lambda i: F.slice(at, i + 2, size)
    if n == 2:
        return F.flatten(F.transform(at, lambda i: F.transform(later(i), lambda j: F.struct(i.alias("0"), j.alias("1")))))
    if n == 3:
        third = lambda i, j: F.transform(later(j), lambda k: F.struct(i.alias("0"), j.alias("1"), k.alias("2")))
        return F.flatten(F.transform(at, lambda i: F.flatten(F.transform(later(i), lambda j: third(i, j)))))
    raise ValueError("n must be 2 or 3")


def combinations(items: Column, n: int) -> Column:
    """Elements at ``argcombinations``, in the same order."""
    pick = lambda c: F.struct(*[F.get(items, c[str(i)]).alias(str(i)) for i in range(n)])
    return F.transform(argcombinations(items, n), pick)


def firsts(items: Column) -> Column:
    """The first element, null of an empty list."""
    return F.get(items, F.lit(0))


def singletons(value: Column) -> Column:
    """A list of the value, empty for null."""
    return F.filter(F.array(value), lambda x: x.isNotNull())


def fill_none(items: Column, value: Column) -> Column:
    return F.transform(items, lambda x: F.coalesce(x, value))


def pad_none(items: Column, width: int, clip: bool = False) -> Column:
    """At least ``width`` elements, nulls at the end; with ``clip``, exactly so many."""
    made = F.concat(items, F.array_repeat(F.lit(None), F.greatest(F.lit(width) - F.size(items), F.lit(0))))
    return F.slice(made, 1, width) if clip and width else F.filter(made, lambda x: F.lit(False)) if clip else made


def run_lengths(items: Column) -> Column:
    """How long each run of equal neighbours is; nulls are equal."""
    n = F.size(items)
    starts = F.filter(local_index(items), lambda i: (i == 0) | ~F.get(items, i).eqNullSafe(F.get(items, i - 1)))
    return F.transform(starts, lambda s, k: F.coalesce(F.get(starts, k + 1), n) - s)


def unflatten(items: Column, counts: Column) -> Column:
    """``items`` cut into lists of ``counts`` elements each; counts must add up to the number of elements."""
    before = lambda k: F.aggregate(F.slice(counts, 1, k), F.lit(0), lambda s, c: s + c)
    made = F.transform(counts, lambda c, k: F.slice(items, before(k) + 1, c))
    total = F.aggregate(counts, F.lit(0), lambda s, c: s + c)
    return F.when(items.isNull() | counts.isNull(), None).when(total == F.size(items), made).otherwise(F.raise_error(F.lit("counts do not add up to the number of elements")))


def sort(items: Column, descending: bool = False) -> Column:
    return F.sort_array(items, asc=not descending)


def unique(items: Column) -> Column:
    """Distinct elements, sorted."""
    return F.array_sort(F.array_distinct(items))


def cumsum(items: Column) -> Column:
    return F.transform(items, lambda x, i: F.aggregate(F.slice(items, 1, i + 1), F.lit(0.0), lambda s, y: s + y))


def diff(items: Column) -> Column:
    """Each element but the first less the one before."""
    return F.zip_with(F.slice(items, 2, F.greatest(F.size(items), F.lit(1))), F.slice(items, 1, F.greatest(F.size(items) - 1, F.lit(0))), lambda a, b: a - b)


def where(condition: Column, a: Column, b: Column) -> Column:
    """Element by element: of ``a`` where the condition's element is true, else of ``b``."""
    both = F.arrays_zip(condition.alias("c"), a.alias("a"), b.alias("b"))
    return F.transform(both, lambda z: F.when(z["c"], z["a"]).otherwise(z["b"]))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def nan_to_num(x: Column, nan: float = 0.0, inf: float = 1.7976931348623157e308) -> Column:
    """NaN and infinities as numbers; null stays null."""
    return F.when(F.isnan(x), F.lit(nan)).when(x == float("inf"), F.lit(inf)).when(x == float("-inf"), F.lit(-inf)).otherwise(x)


def nan_to_none(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def isfinite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def digitize(x: Column, edges: list[float]) -> Column:
    """How many of the ascending ``edges`` are at or below the value."""
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= x))


def linspace(low: float, high: float, n: int) -> Column:
    """An array of ``n`` numbers from ``low`` to ``high``, both included."""
    if n < 2:
        return F.array(*[F.lit(float(low))] * n)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(float(low)) + i * ((high - low) / (n - 1)))


def quantile(items: Column, share: float | Column) -> Column:
    """The quantile of a list's numbers that are neither null nor NaN, interpolated between neighbours; null of none."""
    ordered = F.array_sort(F.filter(items, lambda x: x.isNotNull() & ~F.isnan(x)))
    at = (F.lit(share) if isinstance(share, float | int) else share) * (F.size(ordered) - 1)
    low = F.floor(at).cast("int")
    below, above = F.get(ordered, low), F.get(ordered, F.ceil(at).cast("int"))
    return F.when(F.size(ordered) > 0, below + (above - below) * (at - low))


def median(items: Column) -> Column:
    return quantile(items, 0.5)


def searchsorted(items: Column, x: Column, right: bool = False) -> Column:
    """Where ``x`` would go in a sorted list: before equal elements, or after them if ``right``. Elements that are null do not count."""
    return F.size(F.filter(items, lambda v: F.coalesce(v <= x if right else v < x, F.lit(False))))
