"""Learning an event's value from its objects, whatever their number and order.

Each object is mapped to its standardised fields and their squares and products, which are summed
over the event: the model, linear in those sums, cannot depend on order. Everything is Spark ML.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.ml import Model
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestfold.operators.nesting import standardised, unnest
from nestfold.tools.timing import drain, timed

FIELDS = ("pt", "eta", "phi", "mass")


def dataset(events: DataFrame, collection: str = "jets", fields: tuple[str, ...] = FIELDS, target: str = "met_pt") -> DataFrame:
    """(event_id, features, label): one row per event with a target; events without objects have sums of 0.

    The label is the target less its mean over its standard deviation (below 1e-6 counts as 1).
    """
    each = standardised(unnest(events.select("event_id", collection), collection, "_index"), list(fields))
    terms = {"n": F.lit(1.0)} | {f: F.col(f) for f in fields} | {f"{a}_{b}": F.col(a) * F.col(b) for a, b in combinations_with_replacement(fields, 2)}
    sums = each.groupBy("event_id").agg(*[F.sum(c.cast("double")).alias(f"_{k}") for k, c in terms.items()])
    rows = events.where(F.col(target).isNotNull()).select("event_id", F.col(target).alias("_target")).join(sums, "event_id", "left").fillna(0.0)
    mean, std = rows.agg(F.avg("_target"), F.stddev_pop("_target")).first()
    std = 1.0 if std is None or std < 1e-6 else std
    packed = VectorAssembler(inputCols=[f"_{k}" for k in terms], outputCol="features").transform(rows)
    return packed.select("event_id", "features", ((F.col("_target") - (mean or 0.0)) / std).alias("label"))


def train(rows: DataFrame, held_out: int = 5, l2: float = 1e-4, trees: bool = False) -> tuple[Model, float]:
    """A model, and its R2 on the rows of which the hash of event_id leaves 0 by ``held_out``.

    Linear in the sums by default; with ``trees``, boosted trees over them, which learn what is not linear.
    """
    test = F.pmod(F.xxhash64("event_id"), F.lit(held_out)) == 0
    kind = GBTRegressor(maxIter=30, maxDepth=5, seed=1) if trees else LinearRegression(regParam=l2)
    model = kind.fit(rows.where(~test))
    return model, RegressionEvaluator(metricName="r2").evaluate(model.transform(rows.where(test)))


def throughput(events: DataFrame, target: str = "met_pt", repeats: int = 3) -> dict[str, float]:
    """Events and objects a second, from nested events to features, and how many there are."""
    n, objects = events.agg(F.count("*"), F.sum(F.size("jets"))).first()
    took = timed(lambda: drain(dataset(events, target=target)), repeats).median
    return {"events": n, "objects": objects or 0, "seconds": round(took, 3), "events_per_second": round(n / took, 1), "objects_per_second": round((objects or 0) / took, 1)}
