"""SimHash near-duplicates with bit-sliced comparison.

Documents with equal fingerprints meet first. The distinct fingerprints are dealt into buckets: of m
blocks of bits, any m - r agree for two fingerprints that differ in at most r bits, so each choice
of m - r blocks is a key, and no link is lost. m grows with the number of fingerprints, which keeps
buckets small. Inside a bucket the bit planes lie vertically, carry-save counters add up 64
distances a word, and blocks are abandoned once all their distances exceed the radius. A bucket
passes on a spanning star for each of its groups, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestfold.llm.batches import whole
from nestfold.llm.components import components
from nestfold.llm.tables import small_batches
from nestfold.storage import written

_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
SMALL, PAIRS, LANES, QUERIES = 64, 1 << 18, 4096, 256
FINER, FINEST = 3, 12


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of a whole text; zero without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return 0
    flat = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    ends = (starts + sizes)[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(flat[a:b], seed) for a, b in zip(starts.tolist(), ends, strict=False)], "<u8")
    return int(majority(h[:, None])[0])


def majority(hashes: np.ndarray) -> np.ndarray:
    """The bits that are set in over half of the rows of (rows, words)."""
    width = 64 * hashes.shape[1]
    counts = np.zeros(width, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = np.ascontiguousarray(hashes[at : at + (1 << 15)].astype("<u8", copy=False))
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of (doc_id, text), fp as a signed long; null text is empty."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = np.array([fingerprint(t, width, seed) for t in b["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fps.view(np.int64)})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, fp long")


def planes(fps: np.ndarray) -> np.ndarray:
    """(bits, words): row b holds bit b of every fingerprint, 64 fingerprints a word; spare lanes are 0. fps: one or more words each."""
    bits = np.unpackbits(np.ascontiguousarray(fps.astype("<u8", copy=False)).view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little").T
    packed = np.packbits(bits, axis=1, bitorder="little")
    spare = -packed.shape[1] % 8
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, spare)))).view("<u8")


def near(vertical: np.ndarray, queries: np.ndarray, radius: int) -> np.ndarray:
    """(queries, lanes) booleans: within ``radius`` bits. vertical: see ``planes``.

    Counters are saturating sums in carry-save form: adding a plane of differences ripples through
    one word per counter bit, and a lane whose count passes the radius is over for good. After
    every eight planes, queries whose lanes are all over are abandoned.
    """
    lanes = vertical.shape[1]
    out = np.zeros((len(queries), lanes), np.uint64)
    alive, q = np.arange(len(queries)), queries.astype(np.uint64).reshape(len(queries), -1)
    digits = max(radius + 1, 1).bit_length()
    start = (1 << digits) - 1 - radius  # counters begin so high that they overflow past the radius
    count = [np.full((len(q), lanes), _ONES if start >> i & 1 else np.uint64(0)) for i in range(digits)]
    over = np.zeros((len(q), lanes), np.uint64)
    for b, plane in enumerate(vertical):
        carry = plane[None, :] ^ np.where(q[:, b // 64] >> np.uint64(b % 64) & np.uint64(1), _ONES, np.uint64(0))[:, None]
        for i in range(digits):
            count[i], carry = count[i] ^ carry, count[i] & carry
        over |= carry
        if b % 8 == 7 and b > radius:
            keep = ~(over == _ONES).all(axis=1)
            if not keep.any():
                return _lanes(out)
            if not keep.all():
                alive, q, over, count = alive[keep], q[keep], over[keep], [c[keep] for c in count]
    out[alive] = ~over
    return _lanes(out)


def _lanes(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").astype(bool)


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Whether a[i] and b[i] are within ``radius`` bits, by the same counters with the pairs as lanes."""
    return near(planes(a ^ b), np.zeros_like(a[:1]), radius)[0][: len(a)] if len(a) else np.zeros(0, bool)


def bucket_links(fps: np.ndarray, nodes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(node, root) for each node that links to others in this bucket, directly or not; one root a group.

    A first block of fingerprints is compared with all. What is not in the largest group then is
    compared with all too, so of two that link, one was, or both are in that group already.
    """
    n = len(nodes)
    order = np.argsort(nodes, kind="stable")
    vertical = [planes(fps[order[lo : lo + LANES]]) for lo in range(0, n, LANES)]
    root = np.arange(n)

    def ask(places: np.ndarray) -> None:
        nonlocal root
        for at in range(0, len(places), QUERIES):
            block = places[at : at + QUERIES]
            for k, part in enumerate(vertical):
                i, j = np.nonzero(near(part, fps[order[block]], radius)[:, : n - k * LANES])
                a, b = block[i], j + k * LANES
                new = root[a] != root[b]
                root = roots(n, a[new], b[new], root)

    ask(np.arange(min(QUERIES, n)))
    if n > QUERIES:
        largest = np.bincount(root).argmax()
        ask(QUERIES + np.flatnonzero(root[QUERIES:] != largest))
    moved = np.flatnonzero(root != np.arange(n))
    return list(zip(nodes[order[moved]].tolist(), nodes[order[root[moved]]].tolist(), strict=True))


def blocks(n: int, radius: int, each: float = 4.0) -> int:
    """The least number of blocks of which n random fingerprints leave ``each`` or fewer in a bucket."""
    m = radius + 1
    while m < 64 and n / 2 ** (64 * (m - radius) / m) > each:
        m += 1
    return m


def links(nodes: DataFrame, n: int, radius: int = 4, hot: int = 4096, m: int | None = None) -> DataFrame:
    """(u, v) that connect the rows of (fp, node) just as all pairs within ``radius`` would; fp is unique.

    The fingerprints of buckets of more than ``hot`` are dealt anew by FINER more blocks, which tell
    them apart by more of their bits. Buckets that are still so large at FINEST blocks are cut into
    chunks, and each pair of chunks is a bucket of its own: exact, and no task gets more than two.
    """
    m = m or blocks(n, radius)
    edges = [round(64 * i / m) for i in range(m + 1)]
    masks = [sum(((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in c) for c in combinations(range(m), m - radius)]
    signed = [x - (1 << 64) if x >> 63 else x for x in masks]
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(x))) for i, x in enumerate(signed)])
    dealt = nodes.select("fp", "node", F.explode(keys).alias("key"))
    large = written(dealt.groupBy("key").count().where(F.col("count") > hot), "hot")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole(batches):
            found = linked(b["key"].to_numpy(), b["fp"].to_numpy().view(np.uint64), b["node"].to_numpy(), radius)
            if found:
                yield pd.DataFrame(sorted(found), columns=["u", "v"])

    def near_in(rows: DataFrame) -> DataFrame:
        return rows.repartition("key").sortWithinPartitions("key").mapInPandas(run, "u long, v long")

    if not large.take(1):
        return near_in(dealt)
    if m + FINER > FINEST:
        return near_in(chunked(dealt, large, hot))
    crowd = written(dealt.join(large, "key", "left_semi").select("fp", "node").distinct(), "crowd")
    return near_in(dealt.join(large, "key", "left_anti")).unionByName(links(crowd, n, radius, hot, m + FINER))


def chunked(dealt: DataFrame, large: DataFrame, hot: int, node: str = "node") -> DataFrame:
    """``dealt`` (key, node, ...) with each key of ``large`` (key, count) cut into chunks of about ``hot`` rows, and a key for each pair of them."""
    if not large.take(1):
        return dealt
    met = dealt.join(large, "key", "left")
    chunks = F.ceil(F.col("count") / hot)
    own = F.pmod(F.xxhash64(node), chunks)
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), chunks - 1), lambda j: F.xxhash64("key", F.least(own, j), F.greatest(own, j)))
    others = [c for c in dealt.columns if c != "key"]
    return met.select(*others, F.explode(F.when(F.col("count").isNull(), F.array("key")).otherwise(pairs)).alias("key"))


def linked(key: np.ndarray, fps: np.ndarray, node: np.ndarray, radius: int, fits=None) -> set[tuple[int, int]]:
    """(u, v) that connect the rows of each key, sorted, just as all pairs within ``radius`` would: a star for each part.

    The pairs of small buckets are the lanes of one comparison. Pairs of which ``fits`` of two arrays
    of places is false may be left out, as the caller can tell that they are no links.
    """
    if not len(key):
        return set()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([first, [len(key)]]))
    small = np.repeat(size, size) <= SMALL
    ones, others = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s in range(1, SMALL):
        i = np.flatnonzero((key[s:] == key[:-s]) & small[: len(key) - s])
        if not len(i):
            break
        i = i[fits(i, i + s)] if fits else i
        ones.append(i)
        others.append(i + s)
    a, b = np.concatenate(ones), np.concatenate(others)
    hit = [near_pairs(fps[a[at : at + PAIRS]], fps[b[at : at + PAIRS]], radius) for at in range(0, len(a), PAIRS)]
    hit = np.concatenate([np.zeros(0, bool), *hit])
    root = roots(len(key), a[hit], b[hit])
    moved = np.flatnonzero(root != np.arange(len(key)))
    u, v = node[moved], node[root[moved]]
    found = set(zip(np.minimum(u, v).tolist(), np.maximum(u, v).tolist(), strict=True))
    for at, k in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        found.update(bucket_links(fps[at : at + k], node[at : at + k], radius))
    return found


def roots(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """For each of ``n`` places the least one that it reaches over links between ``a`` and ``b``, and those that gave ``root``."""
    root = np.arange(n) if root is None else root
    while len(a):
        new, least = root.copy(), np.minimum(root[a], root[b])
        for side in (a, b, root[a], root[b]):
            np.minimum.at(new, side, least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) of (doc_id, text): the smallest id that a document reaches over links.

    ``docs`` has one row per id (see ``tables.texts``). Texts without words have fingerprint zero and
    link like any other. An empty table gives an empty result.
    """
    fps = written(fingerprints(docs, width, seed), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    found = written(components(links(nodes, nodes.count(), radius)), "components")
    rooted = written(nodes.join(found, "node", "left").select("fp", F.coalesce("component_id", "node").alias("component_id")), "rooted")
    return fps.join(rooted, "fp").select("doc_id", "fp", "component_id")


def hexed(fp) -> F.Column:
    """16 lowercase hex digits of a signed long."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
