"""Trees of ROOT files as a Spark source and sink, by the Python Data Source API: format ``root``.

Reading: each file's tree is cut into ranges of entries at the ends of baskets, a task each, which reads
the baskets of the columns of the schema and no others. Besides branches, a schema may have ``entry``, a
row's place in its tree, and ``path``, its file. Writing: a file for each task, or several, each made in
memory up to ``bytes`` of columns; files get their names when all tasks have ended.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import LongType, StringType, StructField, StructType

from nestfold.sources.datasets import Dataset, Jagged
from nestfold.sources.root_format import File, Tree, Writer

ENTRIES, CLUSTER, BYTES = 200_000, 10_000, 256 << 20
SPARK_TYPES = {pa.int8(): "tinyint", pa.int16(): "smallint", pa.int32(): "int", pa.int64(): "long", pa.float32(): "float", pa.float64(): "double", pa.bool_(): "boolean"}


def located(path: str):
    """(file system, name) of a path of any scheme that pyarrow knows."""
    from pyarrow import fs

    if re.match(r"[a-z][a-z0-9+.-]+:", path) and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), re.sub("^file:/*", "/", unquote(path) if path.startswith("file:") else path)


def files_of(path: str) -> list[str]:
    """A file, or the files of a folder whose names end in .root and begin with no _ or dot, in order."""
    from pyarrow import fs

    system, name = located(path)
    info = system.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"{path} is not there")
    if info.is_file:
        return [path]
    inside = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(name)) if f.is_file and f.base_name.endswith(".root") and f.base_name[0] not in "_.")
    return [f"{path.rstrip('/')}/{n}" for n in inside]


class Opened:
    """A file and its tree, as a context."""

    def __init__(self, path: str, tree: str | None):
        system, name = located(path)
        self.stream = system.open_input_file(name)
        self.file = File(self.stream)
        self.tree: Tree = self.file.tree(tree)

    def __enter__(self) -> Opened:
        return self

    def __exit__(self, *_) -> None:
        self.stream.close()


def described(tree: Tree) -> str:
    """What Spark calls the branches that can be read, and ``entry``."""
    kinds = [(n, b.arrow) for n, b in tree.branches.items()]
    told = [f"`{n}` " + (f"array<{SPARK_TYPES[k.value_type]}>" if pa.types.is_list(k) else SPARK_TYPES[k]) for n, k in kinds]
    return ", ".join([*told, "entry long"])


def schema_of(tree: Tree) -> StructType:
    return StructType.fromDDL(described(tree))


@dataclass
class Range(InputPartition):
    path: str
    first: int
    stop: int


class RootReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.paths = options.get("paths", "").split("\n") if options.get("paths") else [options["path"]]
        self.tree, self.entries, self.columns = options.get("tree"), int(options.get("entries", ENTRIES)), schema.names

    def partitions(self) -> list[Range]:
        """Ranges of about ``entries``, that end where baskets of the first asked branch do."""
        out = []
        for path in (f for p in self.paths for f in files_of(p)):
            with Opened(path, self.tree) as o:
                asked = [o.tree.branches[c] for c in self.columns if c in o.tree.branches]
                ends = asked[0].entries.tolist() if asked else [0, *range(self.entries, o.tree.entries, self.entries), o.tree.entries]
                first = 0
                for end in ends[1:]:
                    if end - first >= self.entries or end == ends[-1]:
                        out += [Range(path, first, end)] if end > first else []
                        first = end
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        with Opened(partition.path, self.tree) as o:
            missing = [c for c in self.columns if c not in (*o.tree.branches, "entry", "path")]
            if missing:
                raise ValueError(f"missing columns {missing} in {partition.path}; there are {sorted(o.tree.branches)}")
            for first in range(partition.first, partition.stop, CLUSTER):
                stop = min(first + CLUSTER, partition.stop)
                made = {"entry": lambda a=first, b=stop: pa.array(range(a, b), pa.int64()), "path": lambda n=stop - first: pa.array([partition.path] * n)}
                yield pa.RecordBatch.from_arrays([made[c]() if c in made else o.file.read(o.tree, c, first, stop) for c in self.columns], self.columns)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class RootWriter(DataSourceArrowWriter):
    """Files are written under a name that no reader takes, and renamed once all are there."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.tree, self.overwrite = options["path"], options.get("tree", "Events"), overwrite
        self.cluster, self.bytes = int(options.get("cluster", CLUSTER)), int(options.get("bytes", BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = located(self.path)
        system.create_dir(folder, recursive=True)
        names, made, held = [], None, 0

        def end() -> None:
            name = f"part-{uuid.uuid4().hex}.root"
            with system.open_output_stream(f"{folder}/_{name}") as f:
                f.write(made.done())
            names.append(name)

        for batch in iterator:
            for at in range(0, len(batch), self.cluster):
                made, held = made or Writer(batch.schema, self.tree), held + batch.slice(at, self.cluster).nbytes
                made.add(batch.slice(at, self.cluster))
            if held > self.bytes:
                end()
                made, held = None, 0
        if made:
            end()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = located(self.path)
        old = files_of(self.path) if self.overwrite else []
        for name in (n for m in messages if m for n in m.names):
            system.move(f"{folder}/_{name}", f"{folder}/{name}")
        for path in old:
            system.delete_file(located(path)[1])

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = located(self.path)
        for name in (n for m in messages if m for n in m.names):
            if system.get_file_info(f"{folder}/_{name}").is_file:
                system.delete_file(f"{folder}/_{name}")


class RootSource(DataSource):
    """Options: path (or paths, a line each), tree (the first one by default), entries of a task; of a writer cluster and bytes."""

    @classmethod
    def name(cls) -> str:
        return "root"

    def schema(self) -> StructType:
        first = (self.options.get("paths") or self.options["path"]).split("\n")[0]
        with Opened(files_of(first)[0], self.options.get("tree")) as o:
            return schema_of(o.tree)

    def reader(self, schema: StructType) -> RootReader:
        return RootReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> RootWriter:
        return RootWriter(dict(self.options), overwrite)


def read_root(spark: SparkSession, paths: str | list[str], dataset: Dataset | None = None, columns: list[str] | None = None, tree: str | None = None, entries: int = ENTRIES) -> DataFrame:
    """Rows of one or more ROOT files with ``entry`` and ``path``: of the columns that a dataset has or that are told, else all.

    A column that the dataset must have and the first file lacks is an error; flags may be missing.
    """
    spark.dataSource.register(RootSource)
    paths, tree = [paths] if isinstance(paths, str) else list(paths), tree or (dataset.tree if dataset else None)
    with Opened(files_of(paths[0])[0], tree) as o:
        there = schema_of(o.tree)
    if dataset:
        missing = [c for c in dataset.required() if c not in there.names]
        if missing:
            raise ValueError(f"missing columns {missing}; there are {there.names}")
        columns = [c for c in there.names if c in {*dataset.required(), *dataset.flags.values(), *[c.count for c in dataset.collections if isinstance(c, Jagged)]}]
    asked = [f for f in there if columns is None or f.name in columns]
    schema = StructType([f for f in asked if f.name != "entry"] + [StructField("entry", LongType()), StructField("path", StringType())])
    reader = spark.read.format("root").schema(schema).option("paths", "\n".join(paths)).option("entries", entries)
    return (reader.option("tree", tree) if tree else reader).load()


def write_root(rows: DataFrame, path: str, tree: str = "Events", mode: str = "append", **options) -> None:
    """Write rows without nulls as trees, a file for each partition; in the folder ``path``."""
    rows.sparkSession.dataSource.register(RootSource)
    writer = rows.write.format("root").mode(mode).option("tree", tree)
    for k, v in options.items():
        writer = writer.option(k, v)
    writer.save(path)


def to_bytes(rows: pa.Table, tree: str = "Events", cluster: int = CLUSTER) -> bytes:
    """A small table as one file."""
    made = Writer(rows.schema, tree)
    for batch in rows.combine_chunks().to_batches(cluster):
        made.add(batch)
    return made.done()

