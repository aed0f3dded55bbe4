"""Exact passage deduplication with sparse suffix arrays.

Of all suffixes, only those at minimiser positions stay: where the hash of the next ``seed`` words is
the least of any in a window. Every passage of ``length`` words has such a position with its seed
words inside. Suffixes whose seed words occur once are dropped. The others are sorted by their words,
group by group of the same seed, and each is compared with its neighbour word by word: how many words
both have in common to the right, and, in the order of the words before them, to the left. Two
suffixes match where both together make ``length`` words. A match is as wide as the words on both
sides allow; what comes out is the union of all passages of ``length`` words or more that are
somewhere before: in a document of smaller id, or earlier in the same one without overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestfold.llm.batches import whole
from nestfold.llm.tables import small_batches
from nestfold.storage import written

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: So many keys of 8 bytes may be broadcast; above, they meet suffixes in a shuffled join.
BROADCAST_ROWS = 500_000
#: Bits of the filter that tells Python which seeds repeat, at most: 16 MB, whatever the input.
FILTER_BITS = 1 << 27
_WORD = re.compile(r"\S+")
_SPANS = "doc_id long, first long, last long, source long"


class Hasher:
    """Hashes of all runs of words of a text; word hashes are kept between texts, up to a bound."""

    def __init__(self, length: int, seed: int):
        self.length, self.seed, self.window = length, seed, length - seed + 1
        self.known: dict[str, int] = {}
        self.powers = np.ones(1, np.uint64)
        self.inverses = np.ones(1, np.uint64)

    def sums(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > 100_000:
            known.clear()
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 7)
            out.append(h)
        n = len(out)
        if len(self.powers) <= n:
            size = 2 * n + 1024
            self.powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, _BASE, np.uint64))])
            self.inverses = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, _INVERSE, np.uint64))])
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.array(out, np.uint64) * self.powers[:n])])

    def between(self, sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The mixed hash of the words from each ``lo`` to before each ``hi``."""
        h = (sums[hi] - sums[lo]) * self.inverses[lo]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        return h

    def suffixes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions, seed hashes, context hashes) at the minimiser positions of a text of ``length`` words or more.

        A context is all words from which a match of ``length`` words with the seed inside can be made.
        """
        n = len(words)
        if n < self.length:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        sums = self.sums(words)
        starts = np.arange(n - self.seed + 1)
        h = self.between(sums, starts, starts + self.seed)
        least = _slide(h, self.window, np.minimum)
        edge = np.zeros(self.window - 1, np.uint64)
        most = _slide(np.concatenate([edge, least, edge]), self.window, np.maximum)
        at = np.flatnonzero(most == h)
        lo, hi = np.maximum(at - (self.window - 1), 0), np.minimum(at + self.length, n)
        context = self.between(sums, lo, hi) ^ (((at - lo) * 1000 + (hi - at)).astype(np.uint64) * _BASE)
        return at, h[at], context


def _slide(x: np.ndarray, size: int, f) -> np.ndarray:
    """f over each run of ``size`` elements, by doubling."""
    have = 1
    while have * 2 <= size:
        x = f(x[:-have], x[have:])
        have *= 2
    return f(x[: len(x) - (size - have)], x[size - have :]) if size > have else x


def _grouped(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts by ``columns``, the first one first, and where in it a new combination starts."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
    return order, np.flatnonzero(new)


def seeds(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """(key, doc_id, n, contexts): each seed of a document, how often and in how many contexts it is there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher(length, seed)
        for b in batches:
            for lo in range(0, len(b), 500):
                out = []
                for d, text in zip(b["doc_id"][lo : lo + 500], b["text"][lo : lo + 500], strict=True):
                    at, keys, context = hasher.suffixes((text or "").split())
                    if not len(at):
                        continue
                    order, first = _grouped(keys, context)
                    keys = keys[order][first]  # one for each context
                    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                    sizes = np.diff(np.concatenate([first, [len(at)]]))
                    out.append((keys[heads].view(np.int64), np.full(len(heads), d, np.int64), np.add.reduceat(sizes, heads), np.diff(np.concatenate([heads, [len(keys)]]))))
                if out:
                    yield pd.DataFrame(dict(zip(("key", "doc_id", "n", "contexts"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return docs.select("doc_id", "text").mapInPandas(run, "key long, doc_id long, n long, contexts long")


def bloom(keys: DataFrame, n: int, most: int = FILTER_BITS) -> np.ndarray:
    """A bit for each of ``n`` keys by its low bits, of 32 bits a key, as words of 64 bits: what the driver gets is ``most`` bits at most."""
    size = min(most, 1 << max(10, (32 * n).bit_length()))
    low = F.col("key").bitwiseAND(F.lit(size - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), low.bitwiseAND(F.lit(63)).cast("int"))
    rows = keys.groupBy(F.shiftright(low, 6).alias("w")).agg(F.bit_or(bit).alias("bits")).toPandas()
    out = np.zeros(size // 64, np.uint64)
    out[rows["w"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _in_bloom(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    low = keys & np.uint64(64 * len(table) - 1)
    return (table[low >> np.uint64(6)] >> (low & np.uint64(63)) & np.uint64(1)).astype(bool)


def contexts(docs: DataFrame, length: int, seed: int, table: np.ndarray | None) -> DataFrame:
    """(key, doc_id, pos, left, right): the suffixes of each document, those with equal context as one row.

    pos has their positions; right the words from there on, left the words before in reverse order,
    each followed by a space. Suffixes whose seed is not in the filter ``table`` are left out. Without
    a table, ``docs`` has a column keys, the seeds that are wanted.
    """
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, table = Hasher(length, seed), shared.value
        names = ("key", "doc_id", "pos", "left", "right")
        out: list[tuple] = []
        for b in batches:
            for i, (d, text) in enumerate(zip(b["doc_id"], b["text"], strict=True)):
                words = (text or "").split()
                at, keys, context = hasher.suffixes(words)
                if not len(at):
                    continue
                wanted = _in_bloom(table, keys) if table is not None else np.isin(keys, np.asarray(b["keys"].iloc[i], np.int64).view(np.uint64))
                at, keys, context = at[wanted], keys[wanted], context[wanted]
                if not len(at):
                    continue
                order, first = _grouped(keys, context)  # positions stay in order
                for key, group in zip(keys[order][first].view(np.int64).tolist(), np.split(at[order], first[1:]), strict=True):
                    p = int(group[0])
                    before = words[max(0, p - length + seed) : p]
                    out.append((key, d, group, " ".join([*before[::-1], ""]), " ".join([*words[p : p + length], ""])))
                while len(out) >= 5000:
                    yield pd.DataFrame(out[:5000], columns=names)
                    out = out[5000:]
        if out:
            yield pd.DataFrame(out, columns=names)

    more = [] if table is not None else ["keys"]
    return docs.select("doc_id", "text", *more).mapInPandas(run, "key long, doc_id long, pos array<long>, left string, right string")


def common_words(a: str, b: str) -> int:
    """How many words two texts have in common at their start; every word is followed by a space."""
    if a == b:
        return a.count(" ")
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return a.count(" ", 0, lo)


def neighbours(group: np.ndarray, texts: list[str]) -> np.ndarray:
    """Common words of each text with the one before it, of sorted texts; -1 where a new group starts."""
    out = np.full(len(texts), -1)
    for i in np.flatnonzero(group[1:] == group[:-1]) + 1:
        out[i] = common_words(texts[i - 1], texts[i])
    return out


class Found:
    """Places that are repeats, widened offset by offset."""

    def __init__(self, doc: np.ndarray, pos: list[np.ndarray], length: int):
        self.row = np.repeat(np.arange(len(doc)), [len(p) for p in pos])
        self.doc, self.pos, self.length = doc[self.row], np.concatenate([np.asarray(p, np.int64) for p in pos]), length
        self.start, self.end = np.full(len(self.pos), np.iinfo(np.int64).max), np.full(len(self.pos), -1)
        self.source = np.full(len(self.pos), np.iinfo(np.int64).max)

    def add(self, offset: int, rows: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> None:
        """``rows`` have the ``length`` words from ``offset`` before them first in document ``doc``, at its place ``pos``."""
        at = np.full(int(self.row[-1]) + 1, -1)
        at[rows] = np.arange(len(rows))
        mine = np.flatnonzero(at[self.row] >= 0)
        lead = at[self.row[mine]]
        hit = (doc[lead] < self.doc[mine]) | (pos[lead] + self.length <= self.pos[mine])  # in the same document: without overlap
        mine, lead = mine[hit], lead[hit]
        self.start[mine] = np.minimum(self.start[mine], self.pos[mine] - offset)
        self.end[mine] = np.maximum(self.end[mine], self.pos[mine] - offset + self.length)
        self.source[mine] = np.minimum(self.source[mine], doc[lead])

    def spans(self) -> pd.DataFrame:
        """(doc_id, first, last, source), merged where those of a document touch or overlap."""
        found = np.flatnonzero(self.end >= 0)
        doc, start, end, source = self.doc[found], self.start[found], self.end[found], self.source[found]
        order = np.lexsort((start, doc))
        doc, start, end, source = doc[order], start[order], end[order], source[order]
        if not len(doc):
            return pd.DataFrame({"doc_id": doc, "first": start, "last": end, "source": source})
        rank = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]])) * (int(end.max()) + 1)
        reach = np.maximum.accumulate(end + rank)
        heads = np.flatnonzero(np.concatenate([[True], (start + rank)[1:] > reach[:-1]]))
        return pd.DataFrame({"doc_id": doc[heads], "first": start[heads], "last": np.maximum.reduceat(end, heads), "source": np.minimum.reduceat(source, heads)})


def repeated(b: pd.DataFrame, length: int, seed: int) -> pd.DataFrame:
    """Spans that are repeats, of suffixes sorted by (key, right); all suffixes of a key must be there."""
    key, doc, pos = b["key"].to_numpy(), b["doc_id"].to_numpy(), list(b["pos"])
    left, right = list(b["left"]), list(b["right"])
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    first = np.array([p[0] for p in pos], np.int64)
    n_left, n_right = np.array([t.count(" ") for t in left]), np.array([t.count(" ") for t in right])
    to_right = neighbours(group, right)
    by_left = np.array(sorted(range(len(b)), key=lambda i: (group[i], left[i])), np.int64)
    to_left = neighbours(group[by_left], [left[i] for i in by_left])
    found = Found(doc, pos, length)
    same_left = np.zeros(len(b), np.int64)
    for offset in range(length - seed + 1):
        rows = np.flatnonzero((n_left >= offset) & (n_right >= length - offset))
        if not len(rows):
            continue
        same_right = np.cumsum(to_right < length - offset)
        same_left[by_left] = np.cumsum(to_left < offset)
        class_ = same_right[rows] * (len(b) + 1) + same_left[rows]
        order = np.lexsort((first[rows], doc[rows], class_))
        heads = np.concatenate([[True], class_[order][1:] != class_[order][:-1]])
        lead = rows[order[np.flatnonzero(heads)[np.cumsum(heads) - 1]]]
        found.add(offset, rows[order], doc[lead], first[lead])
    return found.spans()


def spans(docs: DataFrame, length: int = 50, seed: int = 25, hot: int = 20_000, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, spans): array of (first, last, source), the words from ``first`` to before ``last`` that are in ``source`` before.

    ``docs`` is (doc_id, text) with one row per id; words are what white space separates. ``source``
    is the smallest id that has a part of the span, which may be the document itself. Spans of a
    document are merged where they touch or overlap. Documents without spans, and so empty and null
    texts and those of fewer than ``length`` words, are not in the result.

    Equal contexts of a document are one row, so a line that a document repeats counts once. A seed
    with more than ``hot`` rows is not gathered in one task (see ``_hot``). Up to a quarter of
    ``filter_bits`` repeating seeds, a filter of fixed size keeps other suffixes in Python; above,
    seeds meet in shuffled joins, and texts are shuffled once, to their documents' repeating seeds.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    each = seeds(docs, length, seed)
    keys = written(each.groupBy("key").agg(F.sum("n").alias("n"), F.sum("contexts").alias("rows")).where("n > 1").select("key", "rows"), "seeds")
    n = keys.count()
    if n <= filter_bits // 4:
        made = contexts(docs, length, seed, bloom(keys, n, filter_bits))
    else:
        wanted = each.join(keys, "key").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
        made = contexts(docs.join(wanted, "doc_id"), length, seed, None)
    rows = written(made, "suffixes")
    many = keys.where(F.col("rows") > hot).select("key")
    n_many = many.count()
    near = F.broadcast(many) if n_many <= BROADCAST_ROWS else many

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole(batches):
            yield repeated(b, length, seed)

    cold = rows.join(near, "key", "left_anti") if n_many else rows
    found = cold.repartition("key").sortWithinPartitions("key", "right").mapInPandas(local, _SPANS)
    if n_many:
        found = found.unionByName(_hot(rows.join(near, "key"), length, seed))

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "spans": [merge(x) for x in b["spans"]]})

    by = found.groupBy("doc_id").agg(F.collect_set(F.struct("first", "last", "source")).alias("spans"))
    return by.mapInPandas(merged, "doc_id long, spans array<struct<first:long,last:long,source:long>>")


def _twice(*columns: Column) -> list[Column]:
    """Two hashes, 128 bits together."""
    return [F.xxhash64(*columns).alias("h1"), F.xxhash64(F.lit(1), *columns).alias("h2")]


def _hot(rows: DataFrame, length: int, seed: int) -> DataFrame:
    """The same spans, of seeds that very many rows have.

    Equal contexts of all documents are made one, by sums before the shuffle. Each of them meets
    others by its runs of ``length`` words with the seed inside (by 128 bits of their hash), again by
    sums before the shuffle. No task gathers a seed.
    """
    rows = written(rows.withColumns({"c1": _twice(F.col("key"), F.col("left"), F.col("right"))[0], "c2": _twice(F.col("key"), F.col("left"), F.col("right"))[1], "p": F.get("pos", F.lit(0))}), "hot")
    distinct = rows.groupBy("c1", "c2", "key", "left", "right").agg(F.min(F.struct("doc_id", "p")).alias("lead"))
    count = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    start = lambda c, n: F.call_function("substring_index", c, F.lit(" "), n)

    def run(offset: Column) -> Column:
        fits = (count(F.col("left")) >= offset) & (count(F.col("right")) >= length - offset)
        return F.when(fits, F.struct(offset.alias("o"), *_twice(F.col("key"), offset, start(F.col("left"), offset), start(F.col("right"), length - offset))))

    runs = F.transform(F.sequence(F.lit(0), F.lit(length - seed)), run)
    each = written(distinct.select("c1", "c2", "lead", F.explode(F.filter(runs, lambda r: r.isNotNull())).alias("r")).select("c1", "c2", "lead", "r.*"), "runs")
    leads = each.groupBy("o", "h1", "h2").agg(F.min("lead").alias("lead"))
    of = each.drop("lead").join(leads, ["o", "h1", "h2"]).groupBy("c1", "c2").agg(F.collect_list(F.struct("o", F.col("lead.doc_id").alias("d"), F.col("lead.p").alias("p"))).alias("leads"))

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            found = Found(b["doc_id"].to_numpy(), list(b["pos"]), length)
            flat = np.array([(x["o"], i, x["d"], x["p"]) for i, of in enumerate(b["leads"]) for x in of], np.int64).reshape(-1, 4)
            for offset in np.unique(flat[:, 0]):
                at = flat[flat[:, 0] == offset]
                found.add(int(offset), at[:, 1], at[:, 2], at[:, 3])
            yield found.spans()

    return rows.select("c1", "c2", "doc_id", "pos").join(of, ["c1", "c2"]).select("doc_id", "pos", "leads").mapInPandas(local, _SPANS)


def merge(found) -> list[tuple[int, int, int]]:
    """Overlapping or touching (first, last, source) made one, with the least source."""
    out: list[list[int]] = []
    for x in sorted((int(s["first"]), int(s["last"]), int(s["source"])) for s in found):
        if out and x[0] <= out[-1][1]:
            out[-1][1], out[-1][2] = max(out[-1][1], x[1]), min(out[-1][2], x[2])
        else:
            out.append(list(x))
    return [tuple(x) for x in out]


def cut(text: str, found: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans, and without the white space after each of them."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for first, last in found:
        out.append(text[at : places[first][0]])
        at = places[last][0] if last < len(places) else len(text)
    return "".join(out) + text[at:]


def remove(docs: DataFrame, length: int = 50, seed: int = 25, broadcast_spans: int = 1_000_000) -> DataFrame:
    """The rows of ``docs``, each text without the passages that an earlier document has.

    n_chars, where ``docs`` has it, follows the new text. A document left without words is dropped
    if it had some: all of it is elsewhere. Up to ``broadcast_spans`` documents and spans (about 40
    bytes each) are broadcast, so that no text is shuffled; above, all texts are shuffled, once.
    """
    found = written(spans(docs.select("doc_id", "text"), length, seed), "spans")
    size = found.agg(F.sum(F.size("spans") + 1)).first()[0] or 0
    found = found.withColumnRenamed("spans", "_spans")
    met = docs.join(F.broadcast(found) if size <= broadcast_spans else found, "doc_id", "left")

    @F.pandas_udf("string")
    def cleaned(text: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or t is None else cut(t, [(s["first"], s["last"]) for s in p]) for t, p in zip(text, places, strict=True)], dtype=object)

    same = F.col("_spans").isNull()
    made = met.withColumn("_clean", cleaned(F.when(~same, F.col("text")), F.col("_spans")))  # other texts stay out of Python
    made = made.where(same | (F.length(F.trim("_clean")) > 0))
    if "n_chars" in docs.columns:
        new = F.length("_clean").cast(docs.schema["n_chars"].dataType)
        made = made.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(new))
    return made.withColumn("text", F.when(same, F.col("text")).otherwise(F.col("_clean"))).select(docs.columns)
