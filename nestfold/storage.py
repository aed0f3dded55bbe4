"""Where intermediate tables go: one shared folder that all executors and the driver see."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

CONF = "spark.checkpoint.dir"
_written: list[tuple[object, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as the session's ``spark.checkpoint.dir`` names it.

    Only where that setting is absent and all is on one machine (tests) a temporary folder is made and
    set. On a cluster its absence is an error, as each executor would write to its own disk.
    """
    found = spark.conf.get(CONF, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CONF} must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="nestfold-")
        spark.conf.set(CONF, found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder; what is written there is removed when the driver ends."""
    path = f"{shared_dir(spark)}/nestfold/{label}-{uuid.uuid4().hex[:12]}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation, and every later
    use sees the same rows.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _system(spark, path)
    return system.exists(target)


def make_folder(spark: SparkSession, path: str) -> None:
    system, target = _system(spark, path)
    system.mkdirs(target)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Rename; the folder that ``to`` is in must be there."""
    system, target = _system(spark, path)
    if not system.rename(target, spark._jvm.org.apache.hadoop.fs.Path(to)):
        raise OSError(f"could not move {path} to {to}")


def move_new(spark: SparkSession, path: str, to: str) -> bool:
    """Rename to a name that nothing has, in one step; false, with nothing changed, if something has it."""
    jvm, kinds = spark._jvm, spark.sparkContext._gateway
    source, target = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(to)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
    none = kinds.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    if system.exists(target):
        return False
    try:
        context.rename(system.makeQualified(source), system.makeQualified(target), none)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def put_text(spark: SparkSession, path: str, text: str) -> None:
    system, target = _system(spark, path)
    out = system.create(target, True)
    out.write(text.encode())
    out.close()


def get_text(spark: SparkSession, path: str) -> str:
    system, target = _system(spark, path)
    stream = system.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if it is not there."""
    system, target = _system(spark, path)
    if not system.exists(target):
        return []
    found = spark._jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(system.listStatus(target))
    told = spark._jvm.org.apache.commons.lang3.ArrayUtils.toString(found)[1:-1]  # one call for all names
    start = system.makeQualified(target).toString().rstrip("/") + "/"
    return sorted(told.removeprefix(start).split(f",{start}")) if told else []


def modified(spark: SparkSession, path: str) -> float:
    """When a folder was last changed, in seconds since 1970."""
    system, target = _system(spark, path)
    return system.getFileStatus(target).getModificationTime() / 1000


def total_bytes(spark: SparkSession, path: str) -> int:
    """The bytes of a file, or of all files in a folder."""
    system, target = _system(spark, path)
    return system.getContentSummary(target).getLength()


def qualified(spark: SparkSession, path: str) -> str:
    """The full name of a path, with its scheme, as Spark's file systems write it."""
    system, target = _system(spark, path)
    return system.makeQualified(target).toString()


def qualified_all(spark: SparkSession, paths: list[str]) -> list[str]:
    """``qualified`` of many paths, with one call for each folder that they are in."""
    homes: dict[str, str] = {}
    out = []
    for path in paths:
        home, _, name = path.rstrip("/").rpartition("/")
        if not home.strip("/") or home.rstrip("/").endswith(":") or name in (".", ".."):
            out.append(qualified(spark, path))
            continue
        if home not in homes:
            homes[home] = qualified(spark, home).rstrip("/")
        out.append(f"{homes[home]}/{name}")
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file systems."""
    system, target = _system(spark, path)
    system.delete(target, True)


def drop(df: DataFrame) -> None:
    """Delete a table that ``written`` made, once nothing reads it any more."""
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        remove(df.sparkSession, file)


def _clean() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone already
            return
