"""Periodic runs of words by Main and Lorentz's divide and conquer.

A run is a stretch of consecutive words with smallest period q, of at least ``least`` and at least 2 q
words, that no neighbouring word extends. Words are interned as numbers; those of a whole batch of
documents lie in one array, each document closed by a number of its own, which no run can cross.

A block of words is cut at its midpoint. A repetition with period q that crosses it, of ``least`` or
2 q words inside the block, has one of two anchors: the word before the midpoint equals the one q
later, or the midpoint's word equals the one q earlier. How far an anchor and its partner agree to
either side are the values of Z-functions at the midpoint, of the halves and of their mirror images.
All blocks of a level go at once. At least six words of a run agree with those q later, so four of
them lie on one side of the anchor: values under four are passed over by one comparison of fours,
the others are found by halving steps over prefix sums of hashes, beyond the block too, which extends
the repetition. Hashes only propose: at the end every run is compared word by word, and a batch in
which one fails is done again without hashes. Equal intervals become one, with the smallest period.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestfold.llm.tables import small_batches

#: Two primes under 2^31, so that products fit 64 bits, and a base for each.
_FIELDS = ((2147483647, 1103515245), (2147483629, 69069691))
_EACH = 1 << 20  # so many anchors are extended at once
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Stretches:
    """An array of word numbers, and whether stretches of it, of ``longest`` at most, are alike: by prefix sums of hashes, or, if ``plain``, word by word."""

    def __init__(self, ids: np.ndarray, longest: int, plain: bool = False):
        self.ids, self.n, self.longest, self.plain = ids, len(ids), longest, plain
        self.sums, self.powers = [], []
        mixed = ids.astype(np.uint64) * _MIX
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        for k, (prime, base) in enumerate(() if plain else _FIELDS):
            power, have = np.ones(self.n + 1, np.int64), 1
            while have <= self.n:
                more = min(have, self.n + 1 - have)
                power[have : have + more] = power[:more] * pow(base, have, prime) % prime
                have += more
            value = (mixed >> np.uint64(3 + 30 * k) & np.uint64(0x3FFFFFFF)).astype(np.int64) + 1
            self.sums.append(np.concatenate([[0], np.cumsum(value * power[:-1] % prime)]) % prime)
            self.powers.append(power)

    def same(self, at: np.ndarray, p: np.ndarray, length: int) -> np.ndarray:
        """Whether ``length`` words from ``at`` equal those p later; not so where they are not all there."""
        ok = (at >= 0) & (at + p + length <= self.n)
        a, q = at[ok], p[ok]
        if self.plain:
            ok[ok] = [np.array_equal(self.ids[x : x + length], self.ids[x + y : x + y + length]) for x, y in zip(a.tolist(), q.tolist(), strict=True)]
            return ok
        alike = np.ones(len(a), bool)
        for (prime, _), s, w in zip(_FIELDS, self.sums, self.powers, strict=True):
            alike &= (s[a + length] - s[a]) % prime * w[q] % prime == (s[a + q + length] - s[a + q]) % prime
        ok[ok] = alike
        return ok

    def z(self, at: np.ndarray, p: np.ndarray, forward: bool) -> np.ndarray:
        """How many words from ``at`` on (or before it, going back) equal those p later."""
        out = np.zeros(len(at), np.int64)
        for k in range(self.longest.bit_length() - 1, -1, -1):
            out += self.same(at + out if forward else at - out - (1 << k), p, 1 << k).astype(np.int64) << k
        return out


def anchors(ids: np.ndarray, longest: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, periods) at the midpoints of all blocks, level by level, where four words equal those a period later.

    Of a run, ``least`` words or two periods lie around the midpoint of some block that holds them;
    no period is above half of ``longest``, the number of words of the longest document.
    """
    n, block = len(ids), 1
    while block < least:
        block *= 2
    pad = longest // 2 + 4
    fours = np.zeros(n + 2 * pad, np.uint64)
    fours[pad : pad + n] = ids
    fours = (((fours[:-3] * _MIX ^ fours[1:-2]) * _MIX) ^ fours[2:-1]) * _MIX ^ fours[3:]
    while block // 2 < n:
        half = block // 2
        most = min(half, longest // 2)
        rows = np.lib.stride_tricks.sliding_window_view(fours, most + 1)
        for shift in (-1, -4):  # from the word before the midpoint on, or up to it
            near = rows[pad + half + shift : pad + n + shift : block]
            i, j = np.nonzero(near[:, 1:] == near[:, :1])
            yield half + shift + i * block, j + 1
        for shift in (0, -3):  # from the midpoint's word on, or up to it
            near = rows[pad + half + shift - most : pad + n + shift - most : block]
            i, j = np.nonzero(near[:, :-1] == near[:, -1:])
            yield half + shift + i * block - (most - j), most - j
        block *= 2


def _once(found: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) in order, one for each interval: that with the smallest period."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    return found[np.concatenate([[True], (found[1:, :2] != found[:-1, :2]).any(axis=1)])] if len(found) else found


def runs_of(ids: np.ndarray, longest: int, least: int = 12, plain: bool = False) -> np.ndarray:
    """Rows (start, end, period), by start and period, of the runs of ``ids`` that have ``least`` and two periods of words."""
    made = Stretches(ids, longest, plain)
    found = np.zeros((0, 3), np.int64)
    for places, periods in anchors(ids, longest, least):
        for lo in range(0, len(places), _EACH):
            at, p = places[lo : lo + _EACH], periods[lo : lo + _EACH]
            ok = made.same(at, p, 4)
            at, p = at[ok], p[ok]
            start, end = at - made.z(at, p, False), at + made.z(at, p, True) + p
            ok = end - start >= np.maximum(least, 2 * p)
            found = _once(np.concatenate([found, np.stack([start[ok], end[ok], p[ok]], axis=1)]))
    if not plain and not all(np.array_equal(ids[s : e - p], ids[s + p : e]) for s, e, p in found.tolist()):
        return runs_of(ids, longest, least, True)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def find(docs: DataFrame, least: int = 12, change: Callable[[int, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of (doc_id, text), a row for each row.

    Words are what ASCII white space separates; ``change`` may alter a document's words first. runs is
    an array of (start, length, period) by start, then period, none for null and empty texts and texts
    under ``least`` words. collapsed has the words that stay, joined by a space, where each run gives
    up what follows its first period, in whichever run a word lies; '' without words. Equal texts
    have equal results; a text is never cut, so a worker holds a batch of texts or one text.
    """
    small_batches(docs.sparkSession)
    if least < 7:
        raise ValueError("least must be 7 or more: else a run may have no four words beside its anchor")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            words = [(t or "").encode().split() for t in b.column(1).to_pylist()]
            if change:
                words = [change(i, w) for i, w in zip(ids, words, strict=True)]
            yield _result(b.column(0), words, least)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def _result(doc_id: pa.Array, words: list[list[bytes]], least: int) -> pa.RecordBatch:
    sizes = np.array([len(w) for w in words], np.int64)
    known: dict[bytes, int] = defaultdict(count().__next__)
    numbers = np.empty(int(sizes.sum()) + len(words), np.int64)
    first = np.concatenate([[0], np.cumsum(sizes + 1)])
    for w, at in zip(words, first.tolist(), strict=False):
        numbers[at : at + len(w)] = np.fromiter(map(known.__getitem__, w), np.int64, len(w))
    numbers[first[1:] - 1] = len(known) + np.arange(len(words))
    found = runs_of(numbers, int(sizes.max(initial=0)), least)
    of = np.searchsorted(first, found[:, 0], "right") - 1
    cover = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(cover, found[:, 0] + found[:, 2], 1)
    np.add.at(cover, found[:, 1], -1)
    gone = np.cumsum(cover)[:-1] > 0
    has = np.bincount(of, minlength=len(words))
    text = [b" ".join(compress(w, (~gone[a : a + len(w)]).tolist()) if n else w) for w, a, n in zip(words, first.tolist(), has.tolist(), strict=False)]
    parts = [pa.array(x, pa.int64()) for x in (found[:, 0] - first[of], found[:, 1] - found[:, 0], found[:, 2])]
    offsets = pa.array(np.concatenate([[0], np.cumsum(has)]), pa.int32())
    listed = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, ["start", "length", "period"]))
    return pa.RecordBatch.from_arrays([doc_id, pa.array(sizes), listed, pa.array(text, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])


def longest(found: Column) -> Column:
    """(start, length, period) of the run with the greatest length; of equal ones that with the smallest start, then period; null if there is none."""
    least = F.array_min(F.transform(found, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    return F.when(least.isNotNull(), F.struct(least["start"].alias("start"), (-least["less"]).alias("length"), least["period"].alias("period")))
