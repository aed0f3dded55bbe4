"""The parts of the ROOT file format that trees of numbers and lists of numbers need.

A file is a header, records that each begin with a key, and a directory that lists keys. A tree's record
describes its branches: the type, and for each basket where its record is and its first entry. So
a reader needs the tree's record and then only the baskets of the asked branches and entries. All
numbers are big-endian. Streamed objects carry their length, by which unknown ends are passed over.
"""

from __future__ import annotations

import lzma
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

# Fixed values of the format.
COUNTED, CLASS, NEW_CLASS = 0x40000000, 0x80000000, 0xFFFFFFFF
BEGIN, MAP_OFFSET, BITS, DATE = 100, 2, 0x03000000, (5 << 26) | (1 << 22) | (1 << 17)
#: By the last letter of a leaf's class: its type in the file, and the Arrow type of signed and unsigned values.
LEAVES = {"B": (">i1", pa.int8(), pa.int16()), "S": (">i2", pa.int16(), pa.int32()), "I": (">i4", pa.int32(), pa.int64()), "L": (">i8", pa.int64(), pa.int64()), "F": (">f4", pa.float32(), pa.float32()), "D": (">f8", pa.float64(), pa.float64()), "O": ("?", pa.bool_(), pa.bool_())}
IO_FEATURES = bytes.fromhex("4000000700001aa12f1000")  # of length 7, without a version, its checksum, no features


def is_tree_class(name: str) -> bool:
    """Whether a class is a tree: TTree, or RNTuple in any namespace."""
    return name == "TTree" or name.rpartition("::")[2] == "RNTuple"


class Cursor:
    """Reads one value after another of a buffer; ``shift`` is what precedes the buffer in its record."""

    def __init__(self, data: bytes, at: int = 0, shift: int = 0):
        self.data, self.at, self.shift = data, at, shift
        self.known: dict[int, object] = {}

    def take(self, form: str):
        form = ">" + form
        out = struct.unpack_from(form, self.data, self.at)
        self.at += struct.calcsize(form)
        return out[0] if len(out) == 1 else out

    def string(self) -> str:
        n = self.take("B")
        n = self.take("i") if n == 255 else n
        self.at += n
        return self.data[self.at - n : self.at].decode()

    def begin(self) -> tuple[int, int]:
        """(version, end) of a counted object."""
        n = self.take("I")
        return self.take("H"), self.at - 2 + (n & ~COUNTED)

    def skip(self) -> None:
        self.at = self.begin()[1]

    def base(self) -> None:
        """A TObject."""
        self.take("H")
        if self.take("II")[1] & 16:
            self.take("H")

    def named(self) -> tuple[str, str]:
        _, end = self.begin()
        self.base()
        out = self.string(), self.string()
        self.at = end
        return out

    def numbers(self, form: str, n: int) -> np.ndarray:
        """An array that a flag precedes."""
        self.take("B")
        out = np.frombuffer(self.data, form, n, self.at)
        self.at += out.nbytes
        return out.astype(form[1:])

    def objects(self, read) -> list:
        """A TObjArray; read(cursor, class name, end) of each object."""
        _, end = self.begin()
        self.base()
        self.string()
        n, _ = self.take("ii")
        out = [self.any(read) for _ in range(n)]
        self.at = end
        return out

    def any(self, read):
        """An object that its class precedes, one seen before, or None."""
        start, tag, end = self.at + self.shift + MAP_OFFSET, self.take("I"), None
        if tag & COUNTED and tag != NEW_CLASS and not tag & CLASS:
            end = self.at + (tag & ~COUNTED)
            place, tag = self.at + self.shift + MAP_OFFSET, self.take("I")
            if tag == NEW_CLASS:
                stop = self.data.index(b"\0", self.at)
                self.known[place] = self.data[self.at : stop].decode()
                self.at, name = stop + 1, self.known[place]
            else:
                name = self.known[tag & ~CLASS]
            made = read(self, name, end)
            self.known[start] = made
            self.at = end
            return made
        return self.known.get(tag) if tag else None


@dataclass
class Key:
    bytes: int
    size: int
    head: int
    cycle: int
    seek: int
    kind: str
    name: str


def _key(c: Cursor) -> Key:
    n, version, size, _, head, cycle = c.take("iHiIHH")
    seek, _ = c.take("qq" if version > 1000 else "ii")
    out = Key(n, size, head, cycle, seek, c.string(), c.string())
    c.string()
    return out


def unpacked(data: bytes, size: int) -> bytes:
    """The blocks of a record that is ``size`` bytes long without compression."""
    if len(data) == size:
        return data
    out, at = [], 0
    while at < len(data):
        kind, small, large = data[at : at + 2], int.from_bytes(data[at + 3 : at + 6], "little"), int.from_bytes(data[at + 6 : at + 9], "little")
        block, at = data[at + 9 : at + 9 + small], at + 9 + small
        if kind == b"ZL":
            out.append(zlib.decompress(block))
        elif kind == b"XZ":
            out.append(lzma.decompress(block))
        elif kind == b"ZS":
            out.append(pa.decompress(block, large, "zstd", asbytes=True))
        elif kind == b"L4":  # a checksum precedes the block
            out.append(pa.Codec("lz4_raw").decompress(block[8:], large, asbytes=True))
        else:
            raise ValueError(f"unknown compression {kind!r}")
    return b"".join(out)


@dataclass
class Branch:
    name: str
    letter: str
    unsigned: bool
    width: int
    count: str | None
    entries: np.ndarray  # the first entry of each basket, and the end
    seeks: np.ndarray
    sizes: np.ndarray

    @property
    def arrow(self) -> pa.DataType:
        item = LEAVES[self.letter][2 if self.unsigned else 1]
        return pa.list_(item) if self.count or self.width > 1 else item


@dataclass
class Tree:
    name: str
    entries: int
    branches: dict[str, Branch] = field(default_factory=dict)


def _leaf(c: Cursor, kind: str, end: int) -> dict:
    c.begin()
    _, inner = c.begin()
    name, _ = c.named()
    width, _, _ = c.take("iii")
    _, unsigned = c.take("??")
    count = c.any(_leaf)
    c.at = inner
    return {"name": name, "letter": kind[-1], "width": width, "unsigned": unsigned, "count": count and count["name"]}


def _branch(c: Cursor, kind: str, end: int) -> Branch | None:
    if kind != "TBranch":
        return None
    version, _ = c.begin()
    if version < 12:
        raise ValueError(f"branches of version {version} are not read")
    name, _ = c.named()
    c.skip()  # fill attributes
    _, _, _, baskets, _ = c.take("iiiiq")
    if version > 12:
        c.skip()  # features
    _, most, _, entries, _, _, _ = c.take("iIiqqqq")
    inside, leaves = c.objects(_branch), c.objects(_leaf)
    c.skip()  # baskets that were never written
    sizes, starts, seeks = c.numbers(">i4", most), c.numbers(">i8", most), c.numbers(">i8", most)
    if inside or len(leaves) != 1 or leaves[0]["letter"] not in LEAVES:
        return None
    leaf = leaves[0]
    return Branch(name, leaf["letter"], leaf["unsigned"], leaf["width"], leaf["count"], np.append(starts[:baskets], entries), seeks[:baskets], sizes[:baskets])


class File:
    """A ROOT file that is open for reading; ``source`` can seek."""

    def __init__(self, source):
        self.source = source
        head = Cursor(self.bytes(0, 64))
        if head.data[:4] != b"root":
            raise ValueError("not a ROOT file")
        head.at = 4
        version, begin = head.take("ii")
        name_at = 12 + (8 + 8 + 4 + 4 if version >= 1000000 else 4 + 4 + 4 + 4)
        place = begin + Cursor(head.data, name_at).take("i")
        c = Cursor(self.bytes(place, 64))
        kind = c.take("H")
        c.take("IIii")
        _, _, keys = c.take("qqq" if kind > 1000 else "iii")
        c = Cursor(self.record(keys)[1])
        self.keys = [_key(c) for _ in range(c.take("i"))]

    def bytes(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def record(self, at: int) -> tuple[Key, bytes]:
        first = self.bytes(at, 8)
        data = self.bytes(at, struct.unpack_from(">i", first)[0])
        key = _key(Cursor(data))
        return key, unpacked(data[key.head :], key.size)

    def tree(self, name: str | None = None) -> Tree:
        """The tree of this name, or the first one of the file."""
        there = [k for k in self.keys if is_tree_class(k.kind)] if name is None else [k for k in self.keys if k.name == name]
        if not there:
            raise ValueError(f"no tree {name or ''} found; there are {sorted({k.name for k in self.keys})}")
        key = max((k for k in there if k.name == there[0].name), key=lambda k: k.cycle)
        if key.kind != "TTree":
            raise ValueError(f"{key.name} is of class {key.kind}, which is not read; TTree is")
        return self._tree(key)

    def _tree(self, key: Key) -> Tree:
        head, data = self.record(key.seek)
        c = Cursor(data, 0, head.head)
        version, _ = c.begin()
        if version < 19:
            raise ValueError(f"trees of version {version} are not read")
        name, _ = c.named()
        for _ in range(3):  # line, fill, marker
            c.skip()
        entries = c.take("qqqqqdiiii")[0]
        ranges = c.take("i")
        c.take("qqqqqq")
        c.numbers(">i8", ranges)
        c.numbers(">i8", ranges)
        if version > 19:
            c.skip()
        found = [b for b in c.objects(_branch) if b]
        return Tree(name, entries, {b.name: b for b in found})

    def _baskets(self, branch: Branch, first: int, stop: int) -> Iterable[tuple[int, int, bytes, np.ndarray | None]]:
        """(first entry, entries, content, ends of the entries if they are told) of the baskets that overlap a range."""
        for k in range(max(bisect_right(branch.entries, first) - 1, 0), bisect_left(branch.entries, stop)):
            if k == len(branch.seeks):
                break
            data = self.bytes(int(branch.seeks[k]), int(branch.sizes[k]))
            c = Cursor(data)
            key = _key(c)
            _, _, _, n, last = c.take("Hiiii")
            whole, border = unpacked(data[key.head :], key.size), last - key.head
            ends = None
            if len(whole) > border:
                starts = np.frombuffer(whole, ">i4", n, border + 4).astype(np.int64) - key.head
                ends = np.append(starts[1:], border)
            yield int(branch.entries[k]), n, whole[:border], ends

    def read(self, tree: Tree, name: str, first: int, stop: int) -> pa.Array:
        """The entries from ``first`` to before ``stop`` of a branch."""
        branch = tree.branches[name]
        kind = np.dtype(LEAVES[branch.letter][0])
        kind = np.dtype(kind.str.replace("i", "u")) if branch.unsigned and branch.letter in "BSIL" else kind
        values, sizes = [np.zeros(0, kind.newbyteorder("="))], [np.zeros(0, np.int64)]
        for at, n, content, ends in self._baskets(branch, first, stop):
            items = np.frombuffer(content, kind)
            lo, hi = max(first - at, 0), min(stop - at, n)
            if branch.count:
                if ends is None:
                    counts = self.read(tree, branch.count, at, at + n).to_numpy().astype(np.int64)
                    ends = np.cumsum(counts) * kind.itemsize
                edges = np.concatenate([[0], ends]) // kind.itemsize
                values.append(items[edges[lo] : edges[hi]].astype(kind.newbyteorder("=")))
                sizes.append(np.diff(edges)[lo:hi])
            else:
                values.append(items[lo * branch.width : hi * branch.width].astype(kind.newbyteorder("=")))
                sizes.append(np.full(hi - lo, branch.width))
        item = branch.arrow.value_type if pa.types.is_list(branch.arrow) else branch.arrow
        flat = pa.array(np.concatenate(values)).cast(item, safe=False)
        if not pa.types.is_list(branch.arrow):
            return flat
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), pa.int32()), flat)


def _string(text: str) -> bytes:
    raw = text.encode()
    return (bytes([len(raw)]) if len(raw) < 255 else b"\xff" + struct.pack(">i", len(raw))) + raw


def _counted(version: int, body: bytes) -> bytes:
    return struct.pack(">IH", COUNTED | (len(body) + 2), version) + body


_OBJECT = struct.pack(">HII", 1, 0, BITS)


def _named(name: str, title: str) -> bytes:
    return _counted(1, _OBJECT + _string(name) + _string(title))


def _packed(data: bytes) -> bytes:
    """``data`` in compressed blocks, or as it is if that is shorter."""
    out = []
    for at in range(0, len(data), (1 << 24) - 1):
        part = data[at : at + (1 << 24) - 1]
        small = zlib.compress(part, 1)
        out.append(b"ZL\x08" + len(small).to_bytes(3, "little") + len(part).to_bytes(3, "little") + small)
    made = b"".join(out)
    return made if len(made) < len(data) else data


class _Out:
    """A buffer of streamed objects that knows where classes and objects were written; ``shift`` as in Cursor."""

    def __init__(self, shift: int):
        self.data, self.shift, self.classes = bytearray(), shift, {}

    def here(self) -> int:
        return len(self.data) + self.shift + MAP_OFFSET

    def counted(self, version: int, write) -> None:
        at = len(self.data)
        self.data += struct.pack(">IH", 0, version)
        write()
        struct.pack_into(">I", self.data, at, COUNTED | (len(self.data) - at - 4))

    def any(self, kind: str, write) -> int:
        """Write an object after its class; where it is, for later references."""
        at, place = len(self.data), self.here()
        self.data += bytes(4)
        if kind in self.classes:
            self.data += struct.pack(">I", self.classes[kind] | CLASS)
        else:
            self.classes[kind] = self.here()
            self.data += struct.pack(">I", NEW_CLASS) + kind.encode() + b"\0"
        write()
        struct.pack_into(">I", self.data, at, COUNTED | (len(self.data) - at - 4))
        return place

    def objects(self, writers: list) -> None:
        def body():
            self.data.extend(_OBJECT + b"\0" + struct.pack(">ii", len(writers), 0))
            for w in writers:
                w()

        self.counted(3, body)


@dataclass
class _Column:
    name: str
    letter: str
    count: str | None
    title: str
    seeks: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)
    total: int = 0
    packed: int = 0


LETTERS = {pa.int8(): "B", pa.int16(): "S", pa.int32(): "I", pa.int64(): "L", pa.float32(): "F", pa.float64(): "D", pa.bool_(): "O"}


class Writer:
    """One tree in one file, made in memory: ``add`` batches of columns, then ``done``.

    Columns are numbers, booleans, or lists of them; a list ``Jet_pt`` is counted by a branch ``nJet``,
    which it shares with all lists ``Jet_*``. Each batch is a cluster: one basket for each branch.
    """

    def __init__(self, schema: pa.Schema, tree: str = "Events", name: str = "part.root"):
        self.tree, self.name, self.entries = tree, name, 0
        self.columns: dict[str, _Column] = {}
        for f in schema:
            lists = pa.types.is_list(f.type)
            letter = LETTERS.get(f.type.value_type if lists else f.type)
            if not letter:
                raise ValueError(f"{f.name} is of type {f.type}, which a tree cannot hold")
            count = f"n{f.name.partition('_')[0]}" if lists else None
            if count and count not in self.columns:
                self.columns[count] = _Column(count, "I", None, f"{count}/I")
            if f.name in self.columns:
                raise ValueError(f"{f.name} is the name of a list's count")
            self.columns[f.name] = _Column(f.name, letter, count, f"{f.name}[{count}]/{letter}" if count else f"{f.name}/{letter}")
        self.data = bytearray(BEGIN)
        self.title_at = len(self._key_head("TFile", name, "", 0, 0, 0)) + len(_string(name)) + 1
        body = _string(name) + _string("") + bytes(64)
        self.data += self._key_head("TFile", name, "", len(body), len(body), BEGIN) + body

    def _key_head(self, kind: str, name: str, title: str, size: int, packed: int, seek: int, parent: int = 0, more: bytes = b"", cycle: int = 1) -> bytes:
        texts = _string(kind) + _string(name) + _string(title)
        head = 26 + len(texts) + len(more)
        return struct.pack(">iHiIHHii", head + packed, 4, size, DATE, head, cycle, seek, parent) + texts + more

    def _record(self, kind: str, name: str, title: str, body: bytes, pack: bool = True) -> tuple[int, int]:
        at, packed = len(self.data), _packed(body) if pack else body
        self.data += self._key_head(kind, name, title, len(body), len(packed), at, BEGIN) + packed
        return at, len(self.data) - at

    def _basket(self, c: _Column, content: bytes, ends: np.ndarray | None, n: int) -> None:
        more = lambda last: struct.pack(">HiiiiB", 3, 32000, 1000 if ends is not None else max(len(content) // max(n, 1), 1), n, last, 0)
        head = 26 + len(_string("TBasket") + _string(c.name) + _string(self.tree)) + len(more(0))
        body = content
        if ends is not None:
            starts = np.concatenate([[0], ends[:-1]])[: len(ends)] + head
            body += struct.pack(">i", n + 1) + starts.astype(">i4").tobytes() + bytes(4)
        packed, at = _packed(body), len(self.data)
        self.data += self._key_head("TBasket", c.name, self.tree, len(body), len(packed), at, BEGIN, more(head + len(content)), 0) + packed
        c.seeks.append(at)
        c.sizes.append(len(self.data) - at)
        c.starts.append(self.entries)
        c.total += head + len(body)
        c.packed += len(self.data) - at

    def add(self, batch: pa.RecordBatch) -> None:
        n, counts = len(batch), {}
        if not n:
            return
        for f, a in zip(batch.schema, batch.columns, strict=True):
            if a.null_count or pa.types.is_list(a.type) and a.flatten().null_count:
                raise ValueError(f"{f.name} has nulls, which a tree cannot hold")
            c = self.columns[f.name]
            kind = np.dtype(LEAVES[c.letter][0])
            if not c.count:
                self._basket(c, a.to_numpy(zero_copy_only=False).astype(kind).tobytes(), None, n)
                continue
            offsets = a.offsets.to_numpy().astype(np.int64)
            sizes = np.diff(offsets)
            if (counts.setdefault(c.count, sizes) != sizes).any():
                raise ValueError(f"{f.name} and other lists that {c.count} counts differ in length")
            content = a.flatten().to_numpy(zero_copy_only=False).astype(kind).tobytes()
            self._basket(c, content, (offsets[1:] - offsets[0]) * kind.itemsize, n)
        for count, sizes in counts.items():
            self._basket(self.columns[count], sizes.astype(">i4").tobytes(), None, n)
        self.entries += n

    def _leaf(self, out: _Out, c: _Column, places: dict[str, int]) -> None:
        def inner():
            out.data.extend(_named(c.name, c.title.partition("/")[0]))
            width = np.dtype(LEAVES[c.letter][0]).itemsize
            out.data.extend(struct.pack(">iii??", 1, width, 0, False, False))
            out.data.extend(struct.pack(">I", places[c.count] if c.count else 0))

        def body():
            out.counted(2, inner)
            out.data.extend(bytes(2 * np.dtype(LEAVES[c.letter][0]).itemsize))

        places[c.name] = out.any(f"TLeaf{c.letter}", lambda: out.counted(1, body))

    def _branch(self, out: _Out, c: _Column, places: dict[str, int]) -> None:
        def body():
            most = max(len(c.seeks), 1)
            out.data.extend(_named(c.name, c.title) + _counted(2, struct.pack(">hh", 0, 1001)))
            out.data.extend(struct.pack(">iiiiq", 101, 32000, 1000 if c.count else 0, len(c.seeks), self.entries) + IO_FEATURES)
            out.data.extend(struct.pack(">iIiqqqq", 0, most, 0, self.entries, 0, c.total, c.packed))
            out.objects([])
            out.objects([lambda: self._leaf(out, c, places)])
            out.objects([])
            pad = lambda x: np.array([*x, *[0] * (most - len(x))])
            for form, x in ((">i4", c.sizes), (">i8", c.starts), (">i8", c.seeks)):
                out.data.extend(b"\1" + pad(x).astype(form).tobytes())
            out.data.extend(_string(""))

        out.any("TBranch", lambda: out.counted(13, body))

    def done(self) -> bytes:
        head = 26 + len(_string("TTree") + _string(self.tree) + _string(""))
        out, places = _Out(head), {}
        order = sorted(self.columns.values(), key=lambda c: bool(c.count))  # counts before what they count

        def body():
            out.data.extend(_named(self.tree, "") + _counted(2, struct.pack(">hhh", 602, 1, 1)) + _counted(2, struct.pack(">hh", 0, 1001)) + _counted(2, struct.pack(">hhf", 1, 1, 1.0)))
            total, packed = (sum(getattr(c, k) for c in order) for k in ("total", "packed"))
            out.data.extend(struct.pack(">qqqqqdiiii", self.entries, total, packed, 0, 0, 1.0, 0, 25, 0, 1000))
            out.data.extend(struct.pack(">iqqqqqq", 0, 10**12, 10**12, 0, -300000000, -30000000, 1000000) + b"\0\0" + IO_FEATURES)
            out.objects([lambda c=c: self._branch(out, c, places) for c in order])
            out.objects([lambda c=c: out.data.extend(struct.pack(">I", places[c.name])) for c in order])
            out.data.extend(struct.pack(">IiiIIII", 0, 0, 0, 0, 0, 0, 0))  # no aliases, index, friends, notes or references

        out.counted(20, body)
        tree_at, _ = self._record("TTree", self.tree, "", bytes(out.data))
        listed = Cursor(bytes(self.data), tree_at)
        _key(listed)
        info_at, info_bytes = self._record("TList", "StreamerInfo", "Doubly linked list", _counted(5, _OBJECT + b"\0" + struct.pack(">i", 0)), False)
        keys_at, keys_bytes = self._record("TFile", self.name, "", struct.pack(">i", 1) + bytes(self.data[tree_at : listed.at]), False)
        end = len(self.data) + 26 + len(_string("TFile") + _string(self.name) + _string("")) + 10
        free_at, free_bytes = self._record("TFile", self.name, "", struct.pack(">Hii", 1, end, 2_000_000_000), False)
        if end > 2_000_000_000:
            raise ValueError("a file of over 2 GB; write smaller ones")
        struct.pack_into(">4siiiiiiiBiii", self.data, 0, b"root", 62400, BEGIN, end, free_at, free_bytes, 1, self.title_at, 4, 101, info_at, info_bytes)
        struct.pack_into(">HIIiiiii", self.data, BEGIN + self.title_at, 5, DATE, DATE, keys_bytes, self.title_at, BEGIN, 0, keys_at)
        return bytes(self.data)
