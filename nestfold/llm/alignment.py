"""Aligning the tokens that two tokenizers make of the same texts, by their bytes.

Both tokenizers spell the same bytes, so a byte offset where tokens of both end cuts a text into groups,
and two tokens are linked where their ranges of bytes overlap. How many documents hold a pair of ids
linked is counted over all of them: pairs are packed into int64 keys, ``np.unique`` makes partial counts
in each partition, a range-partitioned sort brings equal keys side by side, and their counts are summed
run by run. Every partition of the sorted counts becomes a shard of two plain arrays in the shared
folder, which the tasks of the last pass map into memory and search with ``searchsorted``: no task
holds the counts, whose number grows with the corpus, and no driver sees them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestfold.llm.packing import Encoder
from nestfold.llm.tables import small_batches
from nestfold.storage import make_folder, new_path, written

#: Partial counts are merged beyond so many new keys, and given out beyond so many keys.
_MERGE, _HELD = 1 << 18, 1 << 22
#: Bytes of a batch, which holds many more bytes of tokens, places and names in Python.
_BATCH = 1 << 20


@dataclass(frozen=True)
class Files:
    """Where the two vocabularies are: a byte-level BPE (``tokenizers``; as ``tiktoken`` ranks too, for speed) and a SentencePiece model."""

    byte_level: str
    pieces: str
    ranks: str | None = None
    pattern: str | None = None


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 for itself, the others by turns from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteLevel(Encoder):
    """A byte-level BPE, to which the strings of special tokens are plain text."""

    def __init__(self, files: Files):
        super().__init__(files.byte_level, files.ranks, files.pattern)
        self.whole.encode_special_tokens = True

    def table(self) -> list[bytes]:
        """The bytes of each id."""
        letters, entries = byte_letters(), self.whole.get_vocab(with_added_tokens=True)
        out = [b""] * (max(entries.values(), default=-1) + 1)
        for entry, i in entries.items():
            out[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        return out


class Pieces:
    """A SentencePiece model, which puts a space before a text."""

    def __init__(self, files: Files):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=files.pieces)

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)

    def table(self) -> list[bytes]:
        """The bytes of each id: its piece with spaces for U+2581, or the byte that it names."""
        m = self.model
        pieces = [(m.id_to_piece(i), m.is_byte(i)) for i in range(m.get_piece_size())]
        return [bytes([int(p[3:-1], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in pieces]


def tokens(docs: DataFrame, files: Files) -> DataFrame:
    """(doc_id, a, b): the ids of each whole text by both tokenizers, ``a`` of a space and the text.

    Both are empty where a text is null or empty, and where the bytes of either do not spell the space and the text.
    """
    small_batches(docs.sparkSession, _BATCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, other = ByteLevel(files), Pieces(files)
        spelled, pieces = one.table().__getitem__, other.table().__getitem__
        for batch in batches:
            a, b = [], []
            for text in batch.column(1).to_pylist():
                x, y = (one.ids(" " + text), other.ids(text)) if text else ([], [])
                whole = (" " + (text or "")).encode()
                fits = text and b"".join(map(spelled, x)) == whole == b"".join(map(pieces, y))
                a.append(np.array(x if fits else [], np.int32))
                b.append(np.array(y if fits else [], np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(a), _lists(b)], ["doc_id", "a", "b"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, a array<int>, b array<int>")


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *rows]), pa.int32()))


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists, and where each list begins and the last one ends."""
    values, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    return values.astype(np.int64), (offsets - offsets[0]).astype(np.int64)


class Aligned:
    """The tokens of a batch of documents side by side. a, b: all ids; a_at, b_at: where each document's begin."""

    def __init__(self, batch: pa.RecordBatch, a_bytes: np.ndarray, b_bytes: np.ndarray):
        self.a, self.a_at = _flat(batch.column("a"))
        self.b, self.b_at = _flat(batch.column("b"))
        a_end, b_end = np.cumsum(a_bytes[self.a]), np.cumsum(b_bytes[self.b])
        ends = np.zeros(int(max(a_end[-1:].sum(), b_end[-1:].sum())) + 1, np.uint8)
        ends[a_end] |= 1
        ends[b_end] |= 2
        ends[0] = 0
        self.a_last, self.b_last = ends[a_end] == 3, ends[b_end] == 3  # whether a token is the last of its group
        at = np.flatnonzero(ends)
        one, other = ends[at] & 1, ends[at] >> 1
        self.link_a, self.link_b = self.a[np.cumsum(one) - one], self.b[np.cumsum(other) - other]
        stop = np.concatenate([[0], a_end])[self.a_at]
        self.link_at = np.searchsorted(at, stop, "right")  # where each document's links begin
        self.both_at = np.searchsorted(at[ends[at] == 3], stop, "right")

    def keys(self) -> np.ndarray:
        return self.link_a << 32 | self.link_b

    def once(self) -> tuple[np.ndarray, np.ndarray]:
        """(keys, numbers of documents) of this batch, keys in order."""
        wide = int(self.link_b.max(initial=0)) + 1
        pair = self.link_a * wide + self.link_b
        size = int(pair.max(initial=0)) + 1
        of = np.repeat(np.arange(len(self.link_at) - 1), np.diff(self.link_at))
        pair, n = np.unique(np.unique(of * size + pair) % size, return_counts=True)
        return (pair // wide) << 32 | pair % wide, n

    def groups(self, names: list[bytes], n_a: int, n_b: int) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each document. names: see ``_names``."""
        a_group = np.cumsum(self.a_last) - self.a_last
        b_group = np.cumsum(self.b_last) - self.b_last
        order = np.empty(len(self.a) + len(self.b), np.int64)
        order[np.arange(len(self.a)) + np.searchsorted(b_group, a_group, "left")] = self.a + n_a * self.a_last
        order[np.arange(len(self.b)) + np.searchsorted(a_group, b_group, "right")] = 2 * n_a + self.b + n_b * self.b_last
        at = (self.a_at + self.b_at).tolist()
        return [b"".join(map(names.__getitem__, order[lo:hi].tolist()))[:-1] for lo, hi in zip(at, at[1:], strict=False)]


def _names(n_a: int, n_b: int) -> list[bytes]:
    """Ids of the first vocabulary as written inside a group and at the end of its half, then those of the second."""
    return [b"%d%s" % (i, mark) for n, marks in ((n_a, (b",", b"|")), (n_b, (b",", b";"))) for mark in marks for i in range(n)]


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over runs of equal keys; keys are in order."""
    if not len(keys):
        return keys, n
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    return _summed(keys[order], n[order])


def _counted(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["key", "n"])


def partial_counts(aligned: DataFrame, a_bytes: np.ndarray, b_bytes: np.ndarray) -> DataFrame:
    """(key, n): packed pairs of linked ids and numbers of documents, a row for each key and partition, or a few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, new = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
        for batch in batches:
            parts.append(Aligned(batch, a_bytes, b_bytes).once())
            new += len(parts[-1][0])
            if new > _MERGE:
                parts, new = [_merged(parts)], 0
                if len(parts[0][0]) > _HELD:
                    yield _counted(*parts.pop())
                    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        yield _counted(*_merged(parts))

    return aligned.select("a", "b").mapInArrow(run, "key long, n long")


def _run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sums of runs of equal keys of sorted batches; a run may go on in the next batch."""
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for batch in batches:
        new = (batch.column(i).to_numpy() for i in (0, 1))
        keys, n = _summed(*(np.concatenate(x) for x in zip(held, new, strict=True)))
        held = keys[-1:], n[-1:]
        yield keys[:-1], n[:-1]
    yield held


def _sorted(partial: DataFrame) -> DataFrame:
    return partial.select("key", "n").repartitionByRange("key").sortWithinPartitions("key")


def counts(partial: DataFrame) -> DataFrame:
    """(key, n): each key once, in order within and across partitions. partial: a written table, which ranges are sampled from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n in _run_lengths(batches):
            yield _counted(keys, n)

    return _sorted(partial).mapInArrow(run, "key long, n long")


@dataclass(frozen=True)
class Shards:
    """Sorted counts as plain arrays in the shared folder: paths, the first key of each, and the highest count of each first id."""

    paths: list[str]
    first: np.ndarray
    best: np.ndarray

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """The counts of ``keys``, which are in order and all there."""
        out = np.zeros(len(keys), np.int64)
        cut = np.searchsorted(keys, self.first[1:], "left").tolist()
        for path, lo, hi in zip(self.paths, [0, *cut], [*cut, len(keys)], strict=True):
            if lo < hi:
                there, n = _array(path)
                out[lo:hi] = n[np.searchsorted(there, keys[lo:hi])]
        return out


def _file_system(path: str):
    from pyarrow import fs

    at = urlsplit(path)
    return (fs.LocalFileSystem(), unquote(at.path)) if at.scheme in ("", "file") else fs.FileSystem.from_uri(path)


def _array(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The (keys, counts) of a shard: mapped into memory from a mounted folder, read from another store."""
    if urlsplit(path).scheme in ("", "file"):
        name = unquote(urlsplit(path).path)
        return np.memmap(f"{name}.keys", np.int64, "r"), np.memmap(f"{name}.n", np.int64, "r")
    found = []
    for end in ("keys", "n"):
        system, name = _file_system(f"{path}.{end}")
        with system.open_input_file(name) as f:
            found.append(np.frombuffer(f.read_buffer(), np.int64))
    return found[0], found[1]


def shards(partial: DataFrame, n_a: int) -> Shards:
    """The ``counts`` of ``partial``, each partition written as a shard of two files as its runs are summed.

    A task may run again: every try has files of its own, and only those of tries that ended are
    told to the driver, with a row for each first id of a pair (``n_a`` and one a shard at most).
    """
    spark = partial.sparkSession
    folder = new_path(spark, "pair-counts")
    make_folder(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, best, first = f"{folder}/{uuid.uuid4().hex}", {}, None
        system, name = _file_system(path)
        with system.open_output_stream(f"{name}.keys") as some, system.open_output_stream(f"{name}.n") as others:
            for keys, n in _run_lengths(batches):
                if len(keys):
                    first = int(keys[0]) if first is None else first
                    some.write(memoryview(np.ascontiguousarray(keys)).cast("B"))
                    others.write(memoryview(np.ascontiguousarray(n)).cast("B"))
                    one = keys >> 32
                    at = np.flatnonzero(np.concatenate([[True], one[1:] != one[:-1]]))
                    for a, most in zip(one[at].tolist(), np.maximum.reduceat(n, at).tolist(), strict=True):
                        best[a] = max(best.get(a, 0), most)
        if best:
            rows = [pa.array([path] * len(best)), pa.array([first] * len(best), pa.int64()), pa.array([*best], pa.int64()), pa.array([*best.values()], pa.int64())]
            yield pa.RecordBatch.from_arrays(rows, ["path", "first", "a", "best"])

    told = written(_sorted(partial).mapInArrow(run, "path string, first long, a long, best long"), "shards")
    at = told.select("path", "first").distinct().orderBy("first").collect()
    best = np.zeros(n_a, np.int64)
    for a, n in told.groupBy("a").agg(F.max("best")).collect():
        best[a] = n
    return Shards([r["path"] for r in at], np.array([r["first"] for r in at], np.int64), best)


def align(docs: DataFrame, files: Files) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of (doc_id, text): a row for each row.

    groups spells the ids of each group, ``a1,a2|b1;a3|b2,b3``. n_best: links whose pair has the
    highest count of its first id, ties too. count_sum: the counts of all links. Texts without tokens
    (see ``tokens``) have zeros and ''; equal texts have equal rows, and each counts as a document.
    """
    spark = docs.sparkSession
    names_a, names_b = ByteLevel(files).table(), Pieces(files).table()
    lengths = np.array([*map(len, names_a)]), np.array([*map(len, names_b)])
    n_a, n_b = len(names_a), len(names_b)
    aligned = written(tokens(docs, files), "tokens")
    partial = written(partial_counts(aligned, *lengths), "partial-counts")
    known = spark.sparkContext.broadcast(shards(partial, n_a))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, found = _names(n_a, n_b), known.value
        for batch in batches:
            rows = Aligned(batch, *lengths)
            keys, of = np.unique(rows.keys(), return_inverse=True)
            n = found.look_up(keys)[of]
            best = n == found.best[rows.link_a]
            sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[rows.link_at]) for x in (best, n)]
            numbers = [np.diff(x) for x in (rows.a_at, rows.b_at, rows.both_at, rows.link_at)]
            spelled = pa.array(rows.groups(names, n_a, n_b), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in (*numbers, *sums)], spelled], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    small_batches(spark, _BATCH)
    return aligned.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
