"""Packing token sequences by patterns of lengths.

Documents are cut only where they are longer than a sequence. The histogram of piece lengths, which
the longest length bounds, goes to the driver; there patterns of up to three lengths that fill a
sequence exactly are enumerated, their repeat counts fitted to the histogram by non-negative least
squares and rounded, and what is left is packed best-fit, longest first. Pieces find their places by
their rank among the pieces of their length, so no piece ever goes to the driver.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestfold.llm.tables import parts_for, small_batches
from nestfold.ranks import slots, spread
from nestfold.storage import written

#: Texts of only such characters have the same pre-tokens in both tokenizer libraries; others are left to ``tokenizers``.
_PLAIN = re.compile(r"[\n\t\x20-\x7e¡-ɏ‐-‧€]*")
_SPECIAL = "<|endoftext|>"


class Encoder:
    """Token ids as ``tokenizers`` gives them for a vocabulary file.

    ``tokenizers`` is the definition. Where ``ranks``, the same vocabulary for ``tiktoken``, is
    given, plain texts are encoded by that, which takes a quarter of the time for the same ids.
    """

    def __init__(self, vocabulary: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(vocabulary)
        self.fast = None
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast and _SPECIAL not in text and _PLAIN.fullmatch(text):
            return self.fast.encode_ordinary(text)
        return self.whole.encode(text, add_special_tokens=False).ids


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: whole sequences, and before them what is over."""
    first = n % most
    starts = [0, *range(first, n, most)] if first else [*range(0, n, most)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n], strict=True)]


def pieces(docs: DataFrame, vocabulary: str, ranks: str | None = None, pattern: str | None = None, most: int = 2048, end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document of (doc_id, text), ``end`` after its ids."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(vocabulary, ranks, pattern)
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                ids = np.array([*encoder.ids(text or ""), end], "<u4")
                rows += [(doc_id, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), most))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def patterns(there: np.ndarray, most: int) -> np.ndarray:
    """All (a, b, c), a >= b >= c >= 0, of lengths that are there and fill a sequence exactly; c, or b and c, may be 0."""
    ok = np.zeros(most + 1, bool)
    ok[there] = True
    ok[0] = True
    out = []
    for a in there:
        rest = most - a
        if rest <= 0:
            if rest == 0:
                out.append(np.array([[a, 0, 0]]))
            continue
        b = np.arange(-(-rest // 2), min(a, rest) + 1)
        b = b[ok[b] & ok[rest - b]]
        out.append(np.stack([np.full(len(b), a), b, rest - b], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 3), int)


def fit(p: np.ndarray, counts: np.ndarray, steps: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that least-squares fit: the lengths in x patterns come to ``counts``.

    Longer lengths weigh more, as they are harder to place later. Accelerated projected gradient.
    """
    if not len(p):
        return np.zeros(0)
    size = len(counts)
    weight = np.sqrt(np.arange(size) / max(size - 1, 1))
    weight[0] = 0
    target = weight * counts

    def forward(x):
        y = sum(np.bincount(p[:, j], x, size) for j in range(3))
        return y * weight

    def back(r):
        r = r * weight
        return r[p].sum(axis=1)

    v = np.random.default_rng(3).random(len(p))
    for _ in range(12):
        v = back(forward(v))
        norm = np.linalg.norm(v)
        v /= max(norm, 1e-12)
    rate = 1 / (norm * 1.05 + 1e-12)
    x = y = np.zeros(len(p))
    t = 1.0
    for _ in range(steps):
        x1 = np.maximum(y - rate * back(forward(y) - target), 0)
        t1 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = x1 + (t - 1) / t1 * (x1 - x), x1, t1
    return x


def best_fit(left: np.ndarray, most: int) -> list[tuple[tuple[int, ...], int]]:
    """Pack what is left, longest first, each into the fullest sequence that holds it: (lengths, repeats).

    Works on counts: equal sequences are one entry, so its time depends on the number of lengths.
    """
    open_: dict[int, list[list]] = defaultdict(list)  # room left: [lengths, repeats]
    rooms: list[int] = []
    done: list[tuple[tuple[int, ...], int]] = []

    def put(lengths, repeats):
        room = most - sum(lengths)
        if room:
            if not open_[room]:
                insort(rooms, room)
            open_[room].append([lengths, repeats])
        else:
            done.append((lengths, repeats))

    for length in range(most, 0, -1):
        n = int(left[length])
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                per = most // length  # no open sequence holds one: fill new ones with this length
                if n >= per:
                    put((length,) * per, n // per)
                if n % per:
                    put((length,) * (n % per), 1)
                break
            room = rooms[at]
            lengths, repeats = open_[room].pop()
            if not open_[room]:
                rooms.pop(at)
            per = min(room // length, n)
            k = min(repeats, n // per)
            if k < repeats:
                if not open_[room]:
                    insort(rooms, room)
                open_[room].append([lengths, repeats - k])
            put(lengths + (length,) * per, k)
            n -= k * per
    return done + [(tuple(x), k) for entries in open_.values() for x, k in entries]


def plan(counts: np.ndarray, most: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that hold every piece of the histogram exactly once."""
    left = counts.astype(np.int64).copy()
    p = patterns(np.flatnonzero(left[1:]) + 1, most)
    x = fit(p, left.astype(float))
    # rounding carries the rest over to the next pattern, which shares its longest length
    want = np.diff(np.floor(np.concatenate([[0.0], np.cumsum(x)]) + 0.5)).astype(np.int64)
    out = []
    for i in np.flatnonzero(want):
        lengths = tuple(int(v) for v in p[i] if v)
        can = min(int(want[i]), *(int(left[v]) // lengths.count(v) for v in set(lengths)))
        if can:
            for v in lengths:
                left[v] -= can
            out.append((lengths, can))
    return out + best_fit(left, most)


def pack(made: DataFrame, most: int = 2048) -> DataFrame:
    """``made`` (see ``pieces``; a written table, read more than once) with sequence_id and offset.

    An empty table gives an empty result. Pieces of equal length are interchangeable; which of them
    gets which place follows their ids, so the result is the same on every run.
    """
    spark = made.sparkSession
    histogram = made.groupBy("length").count().collect()  # at most ``most`` rows
    counts = np.zeros(most + 1, np.int64)
    for length, n in histogram:
        counts[length] = n
    at: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # length: (first rank, first sequence, offset)
    used, sequence = np.zeros(most + 1, np.int64), 0
    for lengths, repeats in plan(counts, most):
        offset = 0
        for v in lengths:
            at[v].append((int(used[v]), sequence, offset))
            used[v] += repeats
            offset += v
        sequence += repeats
    places = spark.sparkContext.broadcast({v: np.array(rows, np.int64).T for v, rows in at.items()})
    buckets = parts_for(spark, 40.0 * counts.sum())
    ranked = slots(made.withColumn("_bucket", spread(F.col("doc_id"), buckets)), ["length"], "_bucket", ["doc_id", "piece"], "_rank")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = np.empty((2, len(b)), np.int64)
            length, rank = b["length"].to_numpy(), b["_rank"].to_numpy()
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(rows):
                    first, seq, offset = places.value[int(length[rows[0]])]
                    i = np.searchsorted(first, rank[rows], "right") - 1
                    out[0, rows], out[1, rows] = seq[i] + rank[rows] - first[i], offset[i]
            yield b.drop(columns="_rank").assign(sequence_id=out[0], offset=out[1])

    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.select(*kept, "_rank").mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed(docs: DataFrame, vocabulary: str, ranks: str | None = None, pattern: str | None = None, most: int = 2048, end: int = 0) -> DataFrame:
    """Cut and pack (doc_id, text); null text is empty, so a document has at least one piece."""
    return pack(written(pieces(docs, vocabulary, ranks, pattern, most, end), "pieces"), most)
