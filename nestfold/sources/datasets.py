"""Declared source layouts, and the flat tables that follow from them."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nestfold.functions.keys import KeyLayout
from nestfold.storage import total_bytes


@dataclass(frozen=True)
class Jagged:
    """Lists of equal length, stored as parallel columns; ``count`` says which one gives the length."""

    name: str
    fields: dict[str, str]
    count: str


@dataclass(frozen=True)
class Wide:
    """A fixed number of slots, stored as columns with the slot number at the end."""

    name: str
    fields: dict[str, str]
    slots: tuple[int, ...]


@dataclass(frozen=True)
class Dataset:
    name: str
    scalars: dict[str, str]
    collections: tuple[Jagged | Wide, ...]
    tree: str | None = None
    flags: dict[str, str] = field(default_factory=dict)
    constants: dict[str, int] = field(default_factory=dict)
    counts: dict[str, str] = field(default_factory=dict)
    id_column: str | None = None

    def required(self) -> list[str]:
        out = list(self.scalars.values()) + ([self.id_column] if self.id_column else [])
        for c in self.collections:
            out += list(c.fields.values()) if isinstance(c, Jagged) else [f"{s}{i}" for s in c.fields.values() for i in c.slots]
        return out

    def check(self, df: DataFrame) -> None:
        missing = [c for c in self.required() if c not in df.columns]
        if missing:
            raise ValueError(f"missing columns {missing}; there are {df.columns}")


DIMUON = Dataset(
    "dimuon",
    {"run": "Run", "event_number": "Event", "muon_type": "Type", "mass": "M"},
    (Wide("muons", {"e": "E", "px": "px", "py": "py", "pz": "pz", "pt": "pt", "eta": "eta", "phi": "phi", "charge": "Q"}, (1, 2)),),
    constants={"n_muons": 2},
)
NANOAOD = Dataset(
    "nanoaod",
    {"run": "run", "lumi": "luminosityBlock", "event_number": "event", "met_pt": "MET_pt", "met_phi": "MET_phi"},
    (
        Jagged("jets", {f: f"Jet_{f}" for f in ("pt", "eta", "phi", "mass")}, "Jet_pt"),
        Jagged("muons", {f: f"Muon_{f}" for f in ("pt", "eta", "phi", "mass", "charge")}, "Muon_pt"),
    ),
    tree="Events",
    flags={"hlt_isomu24": "HLT_IsoMu24", "hlt_isomu27": "HLT_IsoMu27", "hlt_mu17_mu8_dz": "HLT_Mu17_TrkIsoVVL_Mu8_TrkIsoVVL_DZ"},
    counts={"n_jets": "jets", "n_muons": "muons"},
)
DATASETS = {d.name: d for d in (DIMUON, NANOAOD)}


def read(spark: SparkSession, path: str, dataset: Dataset, first: int = 0, stop: int | None = None) -> DataFrame:
    """A Parquet file, or a ROOT file if its name ends in .root, in the source layout, with ``entry``: a row's place in its file.

    A folder stands for the one file in it; with more, places would not be unique, so that is an error.
    """
    if path.rstrip("/").endswith(".root"):
        from nestfold.sources.root import files_of, read_root

        rows, files = read_root(spark, path, dataset).drop("path"), files_of(path)
    else:
        rows = spark.read.parquet(path)
        files = rows.inputFiles()
        dataset.check(rows)
        rows = rows.withColumn("entry", F.col("_metadata.row_index"))
    if len(files) > 1:
        raise ValueError(f"{path} has {len(files)} files; each needs a file id of its own")
    rows = rows.where(F.col("entry") >= first) if first else rows
    return rows if stop is None else rows.where(F.col("entry") < stop)


def entries_of(spark: SparkSession, path: str) -> int:
    """How many entries a file has."""
    if path.rstrip("/").endswith(".root"):
        from nestfold.sources.root import Opened, files_of

        total = 0
        for file in files_of(path):
            with Opened(file, None) as o:
                total += o.tree.entries
        return total
    return spark.read.parquet(path).count()


def entries_in(spark: SparkSession, path: str, step: int | str) -> int:
    """So many entries of a file as ``step`` says: a number, or a size such as ``100 MB``, of which the file's own bytes an entry tell how many they are."""
    if isinstance(step, int):
        return step
    told = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([kMG]?B)\s*", step)
    if not told:
        raise ValueError(f"{step!r} is neither a number of entries nor a size such as 100 MB")
    size = float(told[1]) * {"B": 1, "kB": 1e3, "MB": 1e6, "GB": 1e9}[told[2]]
    n = entries_of(spark, path)
    return max(1, int(size * n / max(total_bytes(spark, path), 1))) if n else 1


def chunks(spark: SparkSession, path: str, dataset: Dataset, step: int | str, first: int = 0, stop: int | None = None) -> Iterator[DataFrame]:
    """A file's entries from ``first`` to before ``stop``, ``step`` at a time, a number or a size (see ``entries_in``); for what has to go chunk by chunk, as Spark itself splits its input."""
    end, step = entries_of(spark, path) if stop is None else stop, entries_in(spark, path, step)
    for at in range(first, end, step):
        yield read(spark, path, dataset, at, min(at + step, end))


def keyed(rows: DataFrame, dataset: Dataset, file_id: int | Column = 0, layout: KeyLayout | None = None) -> DataFrame:
    """``rows`` with event_id: packed, or taken from the dataset's own column, which allows no file id."""
    if dataset.id_column:
        if not isinstance(file_id, int) or file_id:
            raise ValueError("a dataset with its own ids takes no file id")
        return rows.withColumn("event_id", F.col(dataset.id_column).cast("long"))
    return rows.withColumn("event_id", (layout or KeyLayout()).pack(file_id, F.col("entry")))


def events_table(rows: DataFrame, dataset: Dataset) -> DataFrame:
    """One row per event. A flag whose column is absent is null, never false."""
    by = {c.name: c for c in dataset.collections}
    flags = [(F.col(src) if src in rows.columns else F.lit(None)).cast("boolean").alias(dest) for dest, src in dataset.flags.items()]
    counts = [F.size(by[c].count).alias(dest) for dest, c in dataset.counts.items()]
    constants = [F.lit(v).alias(k) for k, v in dataset.constants.items()]
    return rows.select("event_id", *[F.col(s).alias(d) for d, s in dataset.scalars.items()], *flags, *counts, *constants)


def objects_table(rows: DataFrame, collection: Jagged | Wide) -> DataFrame:
    """One row per object: event_id, <collection's singular>_index, fields. Empty events give none."""
    index = collection.name.rstrip("s") + "_index"
    if isinstance(collection, Jagged):
        zipped = F.arrays_zip(*[F.col(s).alias(d) for d, s in collection.fields.items()])
        each = rows.select("event_id", F.posexplode(zipped).alias(index, "o"))
        return each.select("event_id", index, *[F.col(f"o.`{s}`").alias(d) for d, s in zip(collection.fields, _zip_names(each), strict=True)])
    slots = F.array(*[F.struct(F.lit(n).alias(index), *[F.col(f"{s}{i}").alias(d) for d, s in collection.fields.items()]) for n, i in enumerate(collection.slots)])
    return rows.select("event_id", F.explode(slots).alias("o")).select("event_id", "o.*")


def _zip_names(each: DataFrame) -> list[str]:
    return each.schema["o"].dataType.fieldNames()


def tables(rows: DataFrame, dataset: Dataset) -> dict[str, DataFrame]:
    return {"events": events_table(rows, dataset)} | {c.name: objects_table(rows, c) for c in dataset.collections}


def _draw(seed: int, *of) -> Column:
    """A number from 0 to below 1 that follows from ``seed`` and ``of`` alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 52)).cast("double") / float(1 << 52)


def _numbers(count: Column) -> Column:
    return F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))


def synthetic_events(spark: SparkSession, n: int, avg_jets: float = 6.0, seed: int = 0, parts: int | None = None) -> DataFrame:
    """Nested events for learning: a Poisson number of jets each, and a MET that their sum and spread say, with noise.

    Made on the executors; an event follows from the seed and its id alone.
    """
    draw = lambda *of: _draw(seed, *of)
    key = F.col("event_id")
    # a Poisson number by inversion: how many of the first cumulative chances are below a draw
    chances, term = [], math.exp(-avg_jets)
    for k in range(int(avg_jets + 10 * math.sqrt(avg_jets) + 10)):
        chances.append((chances[-1] if chances else 0.0) + term)
        term *= avg_jets / (k + 1)
    count = F.size(F.filter(F.array(*map(F.lit, chances)), lambda c: c < draw(key, F.lit("n"))))

    def jet(i):
        u = lambda name: draw(key, i, F.lit(name))
        return F.struct(
            (20.0 - 30.0 * F.log(1 - u("pt"))).alias("pt"), (u("eta") * 5 - 2.5).alias("eta"), (u("phi") * 2 * F.pi() - F.pi()).alias("phi"), (u("mass") * 15 + 5).alias("mass"),
        )

    made = spark.range(0, n, 1, parts).select(F.col("id").alias("event_id")).withColumn("jets", F.transform(_numbers(count), jet))
    total = lambda of: F.aggregate("jets", F.lit(0.0), lambda s, j: s + of(j))
    noise = F.sqrt(-2 * F.log(1 - draw(key, F.lit("a")))) * F.cos(2 * F.pi() * draw(key, F.lit("b")))
    met = 0.2 * total(lambda j: j["pt"]) + 3.0 * total(lambda j: j["eta"] * j["eta"]) + 2.0 * noise
    return made.withColumns({"met_pt": F.abs(met), "met_phi": draw(key, F.lit("phi")) * 2 * F.pi() - F.pi()})


def sample_rows(spark: SparkSession, n: int, seed: int = 1, triggers: bool = True, parts: int | None = None) -> DataFrame:
    """Invented events in the nanoaod layout: 0 to 7 jets, 0 to 4 muons, and triggers that ask for a muon of 24 or 27.

    Made on the executors. Every number follows from the seed, the event, the object and the field alone,
    so it is the same however rows are dealt, and with and without triggers.
    """
    key, turn = F.col("event"), 2 * math.pi
    even = lambda low, high, *of: low + (high - low) * _draw(seed, key, *of)
    decay = lambda least, mean, *of: least - mean * F.log(1 - _draw(seed, key, *of))
    whole = lambda low, high, name: F.floor(even(low, high, F.lit(name))).cast("int")
    each = lambda count, f: F.transform(_numbers(F.col(count)), f)
    kinds = {
        "Jet_pt": ("jets", lambda i: decay(15, 40, i, F.lit("Jet_pt"))), "Jet_eta": ("jets", lambda i: even(-4, 4, i, F.lit("Jet_eta"))), "Jet_phi": ("jets", lambda i: even(-math.pi, turn / 2, i, F.lit("Jet_phi"))), "Jet_mass": ("jets", lambda i: even(2, 25, i, F.lit("Jet_mass"))),
        "Muon_pt": ("muons", lambda i: decay(5, 20, i, F.lit("Muon_pt"))), "Muon_eta": ("muons", lambda i: even(-2.5, 2.5, i, F.lit("Muon_eta"))), "Muon_phi": ("muons", lambda i: even(-math.pi, turn / 2, i, F.lit("Muon_phi"))), "Muon_mass": ("muons", lambda i: F.lit(0.10566)),
        "Muon_charge": ("muons", lambda i: F.when(even(0, 1, i, F.lit("Muon_charge")) < 0.5, -1).otherwise(1)),
    }
    rows = spark.range(0, n, 1, parts).select(
        F.lit(1).alias("run"), F.col("id").alias("event"),
    ).withColumns({"luminosityBlock": whole(1, 2000, "luminosityBlock"), "MET_pt": decay(0, 30, F.lit("MET_pt")), "MET_phi": even(-math.pi, turn / 2, F.lit("MET_phi")), "jets": whole(0, 8, "jets"), "muons": whole(0, 5, "muons")})
    rows = rows.withColumns({name: each(count, f) for name, (count, f) in kinds.items()})
    names = ["run", "luminosityBlock", "event", "MET_pt", "MET_phi", *kinds]
    if triggers:
        lead, fired = F.coalesce(F.array_max("Muon_pt"), F.lit(0.0)), even(0, 1, F.lit("fired")) < 0.9
        rows = rows.withColumns({f"HLT_IsoMu{t}": (lead > t) & fired for t in (24, 27)})
        names += ["HLT_IsoMu24", "HLT_IsoMu27"]
    return rows.select(names)
