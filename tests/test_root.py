"""ROOT files: round trips row for row, choice of a tree, pruning, ranges of baskets, tables as from Parquet."""

import io
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nestfold.sources import root, root_format
from nestfold.sources.datasets import NANOAOD, keyed, sample_rows, tables
from nestfold.sources.datasets import read as read_rows


def lists(rng, counts, values):
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values))


def made(n, seed=1):
    rng = np.random.default_rng(seed)
    jets, muons = rng.integers(0, 8, n), rng.integers(0, 3, n)
    return pa.table({
        "run": pa.array(rng.integers(-5, 5, n), pa.int32()), "event": pa.array(rng.integers(-(1 << 62), 1 << 62, n)), "MET_pt": pa.array(rng.normal(size=n)), "flag": pa.array(rng.random(n) < 0.5),
        "small": pa.array(rng.integers(-9, 9, n), pa.int8()), "short": pa.array(rng.integers(-999, 999, n), pa.int16()), "real": pa.array(rng.normal(size=n).astype("f4")),
        "Jet_pt": lists(rng, jets, rng.normal(size=jets.sum())), "Jet_eta": lists(rng, jets, rng.normal(size=jets.sum()).astype("f4")), "Muon_charge": lists(rng, muons, rng.choice([-1, 1], muons.sum()).astype("i4")),
    })


@pytest.mark.parametrize("n", [0, 1, 500])
def test_file_round_trip(n):
    rows = made(n)
    f = root_format.File(io.BytesIO(root.to_bytes(rows, cluster=60)))
    tree = f.tree()
    assert (tree.name, tree.entries) == ("Events", n) and [*tree.branches][-3:] == ["Jet_pt", "Jet_eta", "Muon_charge"]
    for name in rows.column_names:
        for a, b in ((0, n), (n // 3, n // 2), (n // 2, n // 2)):
            assert f.read(tree, name, a, b).to_pylist() == rows.column(name).to_pylist()[a:b]
    assert f.read(tree, "nJet", 0, n).to_pylist() == [len(x) for x in rows.column("Jet_pt").to_pylist()]


def test_sizes_of_lists_may_come_from_their_count():
    """As in baskets that store no offsets."""
    rows = made(100)

    class Without(root_format.Writer):
        def _basket(self, c, content, ends, n):
            super()._basket(c, content, None, n)

    w = Without(rows.schema)
    for b in rows.to_batches(30):
        w.add(b)
    f = root_format.File(io.BytesIO(w.done()))
    assert f.read(f.tree(), "Jet_eta", 25, 95).to_pylist() == rows.column("Jet_eta").to_pylist()[25:95]


def test_header_points_to_what_it_names():
    data = root.to_bytes(made(20))
    magic, version, begin, end, free, free_bytes, n_free, name_bytes, units, compress, info, info_bytes = struct.unpack_from(">4siiiiiiiBiii", data)
    assert (magic, begin, end, n_free, units) == (b"root", 100, len(data), 1, 4)
    f = root_format.File(io.BytesIO(data))
    for at, kind in ((free, "TFile"), (info, "TList"), (begin, "TFile"), (f.keys[0].seek, "TTree")):
        assert f.record(at)[0].kind == kind
    assert struct.unpack_from(">i", data, info)[0] == info_bytes and struct.unpack_from(">i", data, free)[0] == free_bytes


def test_the_tree_that_is_taken():
    assert all(map(root_format.is_tree_class, ("TTree", "ROOT::RNTuple", "ROOT::Experimental::RNTuple"))) and not root_format.is_tree_class("TH1F")
    f = root_format.File(io.BytesIO(root.to_bytes(made(5), tree="Runs")))
    assert f.tree().name == f.tree("Runs").name == "Runs"
    with pytest.raises(ValueError, match=r"no tree Events found; there are \['Runs'\]"):
        f.tree("Events")
    f.keys.insert(0, root_format.Key(0, 0, 0, 1, 0, "TH1F", "histogram"))
    assert f.tree().name == "Runs"
    f.keys.insert(1, root_format.Key(0, 0, 0, 1, 0, "ROOT::RNTuple", "Ntuple"))
    with pytest.raises(ValueError, match="RNTuple, which is not read"):
        f.tree()
    with pytest.raises(ValueError, match="not a ROOT file"):
        root_format.File(io.BytesIO(b"PAR1" * 30))


def test_compressed_blocks_of_other_kinds():
    import lzma

    text = b"some words, " * 500
    block = lambda kind, data: kind + b"\0" + len(data).to_bytes(3, "little") + len(text).to_bytes(3, "little") + data
    assert root_format.unpacked(block(b"XZ", lzma.compress(text)), len(text)) == text
    assert root_format.unpacked(block(b"ZS", pa.compress(text, "zstd", asbytes=True)), len(text)) == text
    assert root_format.unpacked(block(b"L4", bytes(8) + pa.Codec("lz4_raw").compress(text, asbytes=True)), len(text)) == text
    with pytest.raises(ValueError, match="unknown compression"):
        root_format.unpacked(block(b"??", b"x"), len(text))


def test_spark_round_trip_prunes_and_splits(spark, tmp_path):
    rows = sample_rows(spark, 700, 4)
    path = str(tmp_path / "r")
    root.write_root(rows.coalesce(1), path, cluster=50)
    back = root.read_root(spark, path, entries=120)
    assert {f.name for f in back.schema} == {*rows.columns, "nJet", "nMuon", "entry", "path"}
    same = back.orderBy("entry").select(rows.columns)
    assert same.exceptAll(rows).count() == 0 == rows.exceptAll(same).count()
    assert back.rdd.getNumPartitions() == 5 and sorted(r["entry"] for r in back.select("entry").collect()) == list(range(700))
    few = root.read_root(spark, path, columns=["MET_pt", "Jet_pt"])
    assert few.columns == ["MET_pt", "Jet_pt", "entry", "path"]
    file = next((tmp_path / "r").glob("*.root"))
    data = bytearray(file.read_bytes())
    f = root_format.File(io.BytesIO(bytes(data)))
    for seek, size in zip(f.tree().branches["Muon_pt"].seeks, f.tree().branches["Muon_pt"].sizes, strict=True):
        data[seek + 60 : seek + size] = bytes(size - 60)  # a branch that nothing asks for is gone
    file.write_bytes(data)
    assert few.agg(F.sum(F.size("Jet_pt"))).first()[0] == rows.agg(F.sum(F.size("Jet_pt"))).first()[0]
    root.write_root(rows.repartition(3), path, mode="append")
    assert root.read_root(spark, path, columns=["run"]).count() == 1400
    root.write_root(rows.repartition(2), path, mode="overwrite", bytes=1)
    assert root.read_root(spark, path, columns=["run"]).count() == 700
    with pytest.raises(Exception, match="has nulls"):
        root.write_root(spark.sql("SELECT CAST(NULL AS INT) AS a"), str(tmp_path / "n"))
    with pytest.raises(Exception, match="differ in length"):
        root.write_root(spark.sql("SELECT array(1, 2) AS J_a, array(1) AS J_b"), str(tmp_path / "d"))


def test_trees_and_columns_give_the_same_tables(spark, tmp_path):
    rows = sample_rows(spark, 300, 8).coalesce(1)
    rows.write.parquet(str(tmp_path / "p"))
    root.write_root(rows, str(tmp_path / "r"))
    made = [tables(keyed(r, NANOAOD, 3), NANOAOD) for r in (read_rows(spark, str(tmp_path / "p"), NANOAOD), root.read_root(spark, str(tmp_path / "r"), NANOAOD))]
    for name in ("events", "jets", "muons"):
        a, b = (m[name] for m in made)
        assert a.schema.names == b.schema.names and a.exceptAll(b).count() == 0 == b.exceptAll(a).count() and a.count() > 0
    with pytest.raises(ValueError, match="missing columns"):
        root.write_root(rows.drop("MET_pt"), str(tmp_path / "less"))
        root.read_root(spark, str(tmp_path / "less"), NANOAOD)
