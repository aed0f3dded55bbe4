"""A quality classifier by Bradley-Terry ranking.

Every labelled good document is preferred to every labelled bad one. From all such pairs, weights
are learned by logistic loss on the differences of their features; a document's utility is its
weighted features. The threshold is a quantile of the utilities of all labelled documents: the share
of them that is labelled bad.

Pairs are never listed. The loss of a pair depends on the difference of two utilities alone, so each
row is spread over NEAR nodes of a grid of utilities by the weights of Lagrange's interpolation, rows
are summed by node, and nodes meet in pairs. Every row and pair counts; what differs from a sum over
pairs is an error of interpolation, at most 4e-10 in the loss and 1.2e-9 in the slope of 20,000 pairs
that were tried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestfold.functions import selection
from nestfold.llm.tables import small_batches
from nestfold.storage import drop, written

NAMES = (
    "log_bytes", "upper", "digit", "space", "newline", "bang", "bar", "symbol", "stop", "comma", "other_ascii", "high",
    "word_len", "long_words", "distinct_words", "distinct_pairs", "caps_words", "odd_words", "repeated_lines", "short_lines", "sentence_lines",
)
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_LOWER = np.array([97 <= b <= 122 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_SYMBOL = np.array([chr(b) in "#$%&*+<=>@^_~\\{}[]/" for b in range(256)])
_ASCII = np.arange(256) < 128
STEP, NEAR = 0.25, 12
_OFFSETS = np.arange(NEAR) - NEAR // 2 + 1
_TRIANGLE = np.triu_indices(len(NAMES) + 1)
_ODD = re.compile(rb"[^\w\x80-\xff.,;:'\"()?-]")


def features(text: str | None) -> np.ndarray:
    """The features of a whole text, in the order of NAMES; all 0 for an empty or null one."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return np.zeros(len(NAMES))
    n = len(raw)
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    k = len(words)
    distinct = set(words)
    pairs = set(zip(words, words[1:], strict=False))
    lines = [x for x in raw.split(b"\n") if x]
    lengths = np.fromiter(map(len, words), float, k)
    known = c[_UPPER].sum() + c[_LOWER].sum() + c[_DIGIT].sum() + c[_SYMBOL].sum() + c[32] + c[10] + c[33] + c[124] + c[46] + c[44]
    return np.array(
        [
            np.log1p(n) / 10, c[_UPPER].sum() / n, c[_DIGIT].sum() / n, c[32] / n, c[10] / n, c[33] / n, c[124] / n, c[_SYMBOL].sum() / n, c[46] / n, c[44] / n, (c[_ASCII].sum() - known) / n, c[~_ASCII].sum() / n,
            lengths.mean() / 10, (lengths > 15).mean(), len(distinct) / k, len(pairs) / max(k - 1, 1), sum(w.isupper() for w in words) / k, sum(1 for w in words if _ODD.search(w)) / k, 1 - len(set(lines)) / len(lines), sum(len(x) < 40 for x in lines) / len(lines), sum(x[-1:] == b"." for x in lines) / len(lines),
        ]
    )


@dataclass
class Model:
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    threshold: float
    slope: float

    def utility(self, x: np.ndarray) -> np.ndarray:
        """Row by row, so that a row's utility does not depend on the rows beside it."""
        return ((x - self.centre) / self.scale * self.weights).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; 0.5 at the threshold."""
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.utility(x) - self.threshold), -30, 30)))


def _spread(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The grid's cell of each utility, and its weights on the NEAR nodes around that cell."""
    cell = np.floor(u / STEP)
    beyond = (u / STEP - cell)[:, None] - _OFFSETS
    weights = [np.delete(beyond, k, axis=1).prod(axis=1) / np.delete(o - _OFFSETS, k).prod() for k, o in enumerate(_OFFSETS.astype(float))]
    return cell.astype(np.int64), np.stack(weights, axis=1)


def node_sums(z: np.ndarray, u: np.ndarray, into: dict[int, np.ndarray]) -> None:
    """Add to each node its weighted sums of the products of (1, z) with themselves: counts, features and their squares."""
    if not len(u):
        return
    one = np.hstack([np.ones((len(z), 1)), z])
    cells, weights = _spread(u)
    order = np.argsort(cells, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(cells[order])) + 1):
        sums = 0
        for i in range(0, len(rows), 500):  # small products, so that a worker's memory stays small
            x, near = one[rows[i : i + 500]], weights[rows[i : i + 500]]
            sums = sums + (near[:, :, None] * x[:, None, :]).reshape(len(x), -1).T @ x
        for o, s in zip(_OFFSETS, sums.reshape(NEAR, one.shape[1], one.shape[1]), strict=True):
            at = int(cells[rows[0]] + o)
            into[at] = into[at] + s if at in into else s


def pair_loss(good: dict[int, np.ndarray], bad: dict[int, np.ndarray], chunk: int = 500) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean logistic loss over all pairs of good and bad rows, its descent by the weights, and its curvature."""
    up, down = np.array(sorted(good)), np.array(sorted(bad))
    g, b = np.stack([good[i] for i in up]), np.stack([bad[i] for i in down])
    loss, width = 0.0, g.shape[1] - 1
    slope, bend = np.zeros(width), np.zeros((width, width))
    for i in range(0, len(up), chunk):
        some, t = g[i : i + chunk], STEP * (up[i : i + chunk, None] - down)
        p = np.exp(-np.logaddexp(0, t))  # how wrong each pair still is
        k = p * np.exp(-np.logaddexp(0, -t))
        loss += some[:, 0, 0] @ np.logaddexp(0, -t) @ b[:, 0, 0]
        slope += some[:, 0, 1:].T @ (p @ b[:, 0, 0]) - b[:, 0, 1:].T @ (p.T @ some[:, 0, 0])
        cross = some[:, 0, 1:].T @ k @ b[:, 0, 1:]
        bend += np.tensordot(k @ b[:, 0, 0], some[:, 1:, 1:], 1) + np.tensordot(k.T @ some[:, 0, 0], b[:, 1:, 1:], 1) - cross - cross.T
    pairs = g[:, 0, 0].sum() * b[:, 0, 0].sum()
    return float(loss / pairs), slope / pairs, bend / pairs


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(NAMES))


def _kind(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("quality").to_numpy(zero_copy_only=False)


def _spreads(rows: DataFrame) -> tuple[list[int], np.ndarray, np.ndarray]:
    """How many rows are bad and good; mean and deviation of their features."""
    each = [F.col("x")[i].cast("double") for i in range(len(NAMES))]
    n, good, *found = rows.agg(F.count("*"), F.sum("quality"), *[F.avg(c) for c in each], *[F.stddev_pop(c) for c in each]).first()
    if not n:
        return [0, 0], np.zeros(len(NAMES)), np.ones(len(NAMES))
    return [n - good, good], np.array(found[: len(NAMES)]), np.maximum(np.array(found[len(NAMES) :]), 1e-6)


def _all_pairs(rows: DataFrame, model: Model) -> tuple[float, np.ndarray, np.ndarray]:
    """``pair_loss`` of a model. Sums by node are added up on the executors, so the driver gets one of each node."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: tuple[dict, dict] = ({}, {})
        for b in batches:
            x, kind = _matrix(b), _kind(b)
            z, u = (x - model.centre) / model.scale, model.utility(x)
            for q in (0, 1):
                node_sums(z[kind == q], u[kind == q], sums[q])
        of = TaskContext.get().partitionId()
        for q in (0, 1):
            yield _node_rows([(q, node, of, s[_TRIANGLE]) for node, s in sums[q].items()])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, at = None, None  # rows of a node are side by side, in the order of tasks
        for b in batches:
            for q, node, s in zip(*(b.column(c).to_pylist() for c in ("good", "node", "s")), strict=True):
                if at != (q, node):
                    if at:
                        yield _node_rows([(*at, 0, have)])
                    have, at = np.zeros(len(_TRIANGLE[0])), (q, node)
                have = have + np.frombuffer(s)
        if at:
            yield _node_rows([(*at, 0, have)])

    schema = "good long, node long, task long, s binary"
    made = rows.mapInArrow(part, schema).repartition("good", "node").sortWithinPartitions("good", "node", "task").mapInArrow(together, schema)
    found: tuple[dict, dict] = ({}, {})
    for r in made.select("good", "node", "s").collect():
        s = np.zeros((len(NAMES) + 1,) * 2)
        s[_TRIANGLE] = np.frombuffer(r["s"])
        found[r["good"]][r["node"]] = s + np.triu(s, 1).T
    return pair_loss(found[1], found[0])


def _node_rows(rows: list[tuple]) -> pa.RecordBatch:
    whole = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
    return pa.RecordBatch.from_arrays([*whole, pa.array([r[3].tobytes() for r in rows], pa.binary())], ["good", "node", "task", "s"])


def _at_places(rows: DataFrame, model: Model, places: list[tuple[int | None, int]]) -> list[float]:
    """The exact utility at each (quality or None for all, place from 0 in ascending order), found digit by digit (see ``selection``)."""

    def utilities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"q": pa.array(_kind(b), pa.int64()), "u": model.utility(_matrix(b))})

    spark = rows.sparkSession
    found = written(rows.mapInArrow(utilities, "q long, u double"), "utilities")
    values = found.select(F.explode(F.array("q", F.lit(-1).cast("long"))).alias("q"), selection.ordered_bits(F.col("u")).alias("key"), "u")
    wanted = spark.createDataFrame([(-1 if q is None else q, place, k) for k, (q, place) in enumerate(places)], "q long, place long, k int")
    out = {r["k"]: r["value"] for r in selection.at_places(values, wanted, ["q"], "key", "u").collect()}
    drop(found)
    return [out[k] for k in range(len(places))]


def fit_pairs(rows: DataFrame, l2: float = 1e-3, steps: int = 50) -> Model:
    """Newton's method on the logistic loss of all pairs of (quality, x), good minus bad; a step that raises the loss is halved.

    With labels of one kind only, or none, there are no pairs: all weights are 0 and every score is
    1 if bad ones are missing, else 0. ``rows`` should be a written table, as each step reads it.
    """
    (bad, good), centre, scale = _spreads(rows)
    w = np.zeros(len(NAMES))
    if not good or not bad:
        return Model(w, centre, scale, 30.0 if bad else -30.0, 1.0)
    at = lambda w: Model(w, centre, scale, 0.0, 1.0)
    loss, slope, bend = _all_pairs(rows, at(w))
    for _ in range(steps):
        step = np.linalg.solve(bend + l2 * np.eye(len(w)), slope - l2 * w)
        if np.abs(step).max() < 1e-6:
            w = w + step
            break
        while True:
            new = _all_pairs(rows, at(w + step))
            if new[0] + l2 / 2 * (w + step) @ (w + step) <= loss + l2 / 2 * w @ w + 1e-12 or np.abs(step).max() < 1e-6:
                break
            step = step / 2
        w, (loss, slope, bend) = w + step, new
    middle = [(q, place) for q, n in ((0, bad), (1, good)) for place in ((n - 1) // 2, n // 2)]
    below, above, *mid = _at_places(rows, at(w), [(None, bad - 1), (None, bad), *middle])
    gap = (mid[2] + mid[3] - mid[0] - mid[1]) / 2
    return Model(w, centre, scale, (below + above) / 2, 8 / max(gap, 1e-6))


def labelled_rows(labels: DataFrame) -> DataFrame:
    """(doc_id, quality): every label, 1 for good and 0 for bad.

    Rows with a null id or another quality teach nothing; a repeated id counts once, as good if any row says so.
    """
    return labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))


def featured(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and x, the features of the whole text, row by row."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("array<float>")
    def x(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([features(t).astype("float32") for t in texts], dtype=object)

    return docs.select(*keep, x("text").alias("x"))


def learned(found: DataFrame, labels: DataFrame) -> Model:
    """A model from all labelled rows of (doc_id, x), as ``featured`` gives them, and (doc_id, quality).

    Only features meet the labels; texts are not shuffled.
    """
    both = found.select("doc_id", "x").join(labelled_rows(labels), "doc_id")
    rows = written(both.sortWithinPartitions("doc_id", "x").select("quality", "x"), "quality-labelled")
    model = fit_pairs(rows)
    drop(rows)
    return model


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from all labelled rows of (doc_id, text) and (doc_id, quality)."""
    return learned(featured(docs, "doc_id"), labels)


def scored(found: DataFrame, model: Model, *keep: str) -> DataFrame:
    """``scores`` of rows whose features, as ``featured`` gives them, are there already."""
    shared = found.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for xs in batches:
            yield pd.Series(shared.value.score(np.array(list(xs), float).reshape(len(xs), len(NAMES))))

    return found.select(*keep, score("x").alias("score"))


def scores(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """``keep`` and score, row by row over whole texts. Null and empty texts are scored on features that are all 0.

    Only the text goes to Python, and only the score comes back.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([features(t).astype("float32") for t in texts], float).reshape(len(texts), len(NAMES))
            yield pd.Series(shared.value.score(x))

    return docs.select(*keep, score("text").alias("score"))
