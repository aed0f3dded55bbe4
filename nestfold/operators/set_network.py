"""A learned function of an event's objects that cannot depend on their order or number.

Two layers turn each object into hidden numbers, which are summed over the event; two more turn the sums
into the target. Weights are learned by steps over a bucket of the events each: tasks add up the
gradient of their events, a second round adds up those of some tasks each, and the driver gets a few
vectors as long as the weights, whatever the number of events. No event leaves the executors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestfold.operators.nesting import unnest
from nestfold.operators.regression import FIELDS
from nestfold.storage import written

SUM = "of int, n long, loss double, slope binary"


def layers(width: int, hidden: int) -> list[tuple[int, ...]]:
    """Shapes of weights and offsets: two layers for objects, two for sums."""
    return [(width, hidden), (hidden,), (hidden, hidden), (hidden,), (hidden, hidden), (hidden,), (hidden, 1), (1,)]


def cut(flat: np.ndarray, width: int, hidden: int) -> list[np.ndarray]:
    ends = np.cumsum([math.prod(s) for s in layers(width, hidden)])
    return [x.reshape(s) for x, s in zip(np.split(flat, ends[:-1]), layers(width, hidden), strict=True)]


def start(width: int, hidden: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(0, math.sqrt(2 / s[0]), s).ravel() if len(s) > 1 else np.zeros(s) for s in layers(width, hidden)])


def forward(w: list[np.ndarray], x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, tuple]:
    """The value of each event, and what the way back needs; x: all objects, event after event."""
    a = x @ w[0] + w[1]
    b = np.maximum(a, 0) @ w[2] + w[3]
    event = np.repeat(np.arange(len(counts)), counts)
    ends = np.concatenate([[0], np.cumsum(counts)])
    total = np.diff(np.concatenate([np.zeros((1, b.shape[1])), np.cumsum(np.maximum(b, 0), axis=0)])[ends], axis=0)
    c = total @ w[4] + w[5]
    return (np.maximum(c, 0) @ w[6] + w[7])[:, 0], (a, b, event, total, c)


def gradient(flat: np.ndarray, hidden: int, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Sum over the events of the squared error, and its slope by the weights."""
    w = cut(flat, x.shape[1], hidden)
    value, (a, b, event, total, c) = forward(w, x, counts)
    off = value - y
    d = 2 * off[:, None]
    out = [np.maximum(c, 0).T @ d, d.sum(axis=0)]
    d = (d @ w[6].T) * (c > 0)
    out = [total.T @ d, d.sum(axis=0), *out]
    d = (d @ w[4].T)[event] * (b > 0)
    out = [np.maximum(a, 0).T @ d, d.sum(axis=0), *out]
    d = (d @ w[2].T) * (a > 0)
    out = [x.T @ d, d.sum(axis=0), *out]
    return float(off @ off), np.concatenate([g.ravel() for g in out])


@dataclass
class Network:
    """Weights, and how objects and the target were scaled."""

    flat: np.ndarray
    hidden: int
    fields: tuple[str, ...]
    centre: np.ndarray
    scale: np.ndarray
    mean: float
    deviation: float

    def value(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = cut(self.flat, len(self.fields), self.hidden)
        return forward(w, (x - self.centre) / self.scale, counts)[0] * self.deviation + self.mean


def _objects(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All objects of a batch, and how many each event has."""
    lists = batch.column("x")
    return lists.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, width), np.diff(lists.offsets.to_numpy())


def _arrays(events: DataFrame, collection: str, fields: tuple[str, ...]) -> DataFrame:
    return events.withColumn("x", F.transform(collection, lambda o: F.array(*[o[f].cast("double") for f in fields])))


def _step(rows: DataFrame, flat: np.ndarray, hidden: int, width: int, fan: int = 16) -> tuple[int, float, np.ndarray]:
    """(events, summed loss, summed slope) of ``rows`` (x, y), added up in two rounds."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n, loss, slope = 0, 0.0, np.zeros(len(flat))
        for b in batches:
            x, counts = _objects(b, width)
            more = gradient(flat, hidden, x, counts, b.column("y").to_numpy())
            n, loss, slope = n + len(counts), loss + more[0], slope + more[1]
        yield _row(TaskContext.get().partitionId() % fan, n, loss, slope)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, slope = 0, 0.0, np.zeros(len(flat))
        for b in batches:
            for r in b.to_pylist():
                n, loss, slope = n + r["n"], loss + r["loss"], slope + np.frombuffer(r["slope"])
        yield _row(0, n, loss, slope)

    first = rows.select("x", "y").mapInArrow(each, SUM)
    found = first.repartition(fan, "of").mapInArrow(together, SUM).collect()  # ``fan`` vectors at most
    return sum(r["n"] for r in found), sum(r["loss"] for r in found), sum(np.frombuffer(r["slope"]) for r in found)


def _row(of: int, n: int, loss: float, slope: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([of], pa.int32()), pa.array([n], pa.int64()), pa.array([loss], pa.float64()), pa.array([slope.tobytes()], pa.binary())], ["of", "n", "loss", "slope"])


def train(events: DataFrame, collection: str = "jets", fields: tuple[str, ...] = FIELDS, target: str = "met_pt", hidden: int = 32, epochs: int = 15, steps: int = 4, rate: float = 5e-3, held_out: int = 5, seed: int = 0) -> tuple[Network, float, list[float]]:
    """A network, its R2 on the events of which the hash of event_id leaves 0 by ``held_out``, and the mean loss of each epoch.

    Each epoch goes over all other events in ``steps`` buckets. Events without objects count, those
    without a target do not. Objects and the target are scaled to mean 0 and deviation 1 (below 1e-6 counts as 1).
    """
    there = events.where(F.col(target).isNotNull()).select("event_id", collection, F.col(target).cast("double").alias("_t"))
    each = unnest(there.select("event_id", collection), collection, "_i")
    row = each.agg(*[f(F.col(c).cast("double")) for c in fields for f in (F.avg, F.stddev_pop)]).first()
    centre = np.array([row[2 * k] or 0.0 for k in range(len(fields))])
    scale = np.array([s if (s := row[2 * k + 1]) and s >= 1e-6 else 1.0 for k in range(len(fields))])
    mean, deviation = there.agg(F.avg("_t"), F.stddev_pop("_t")).first()
    mean, deviation = mean or 0.0, deviation if deviation and deviation >= 1e-6 else 1.0
    scaled = F.transform(collection, lambda o: F.array(*[(o[f].cast("double") - float(m)) / float(s) for f, m, s in zip(fields, centre, scale, strict=True)]))
    hashed = F.xxhash64("event_id")
    rows = there.select("event_id", scaled.alias("x"), ((F.col("_t") - mean) / deviation).alias("y"), F.when(F.pmod(hashed, F.lit(held_out)) == 0, -1).otherwise(F.pmod(F.shiftright(hashed, 32), F.lit(steps))).cast("int").alias("bucket"))
    rows = written(rows, "set-network")
    flat = start(len(fields), hidden, seed)
    speed, spread, told, k = np.zeros(len(flat)), np.zeros(len(flat)), [], 0
    for _ in range(epochs):
        n, loss = 0, 0.0
        for step in range(steps):
            seen, error, slope = _step(rows.where(F.col("bucket") == step), flat, hidden, len(fields))
            if not seen:
                continue
            k, n, loss, slope = k + 1, n + seen, loss + error, slope / seen
            speed, spread = 0.9 * speed + 0.1 * slope, 0.999 * spread + 0.001 * slope**2
            flat = flat - rate * (speed / (1 - 0.9**k)) / (np.sqrt(spread / (1 - 0.999**k)) + 1e-8)
        told.append(loss / n if n else math.nan)
    network = Network(flat, hidden, tuple(fields), centre, scale, mean, deviation)
    test = events.where(F.col(target).isNotNull() & (F.pmod(hashed, F.lit(held_out)) == 0))
    return network, r2(predict(network, test, collection), target), told


def predict(network: Network, events: DataFrame, collection: str = "jets") -> DataFrame:
    """``events`` with ``value``."""
    rows = _arrays(events, collection, network.fields)
    known = events.sparkSession.sparkContext.broadcast(network)

    @F.pandas_udf("double")
    def value(x):
        import pandas as pd

        counts = np.array([len(v) for v in x], np.int64)
        flat = np.array([o for v in x for o in v], float).reshape(-1, len(known.value.fields))
        return pd.Series(known.value.value(flat, counts))

    return rows.withColumn("value", value("x")).drop("x")


def r2(predicted: DataFrame, target: str) -> float:
    """1 less the squared error over the variance of ``target``; NaN of no rows."""
    t = F.col(target).cast("double")
    error, n, spread = predicted.agg(F.sum((t - F.col("value")) ** 2), F.count("*"), F.var_pop(t)).first()
    return 1 - error / ((n * spread) or 1.0) if n else math.nan
