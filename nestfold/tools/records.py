"""What the tools keep between runs, as Spark tables in a folder: scored answers, and reference answers."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestfold.storage import exists, remove

CHECKS = "task string, agreed boolean, detail string, route string, statement string, note string, at timestamp"


class Checks:
    """Scored answers. Without a folder they are kept in memory, for this run alone."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder, self.here = spark, folder, []

    def rows(self) -> DataFrame:
        if self.folder and exists(self.spark, self.folder):
            return self.spark.read.schema(CHECKS).parquet(self.folder)
        return self.spark.createDataFrame(self.here, CHECKS)

    def attempts(self, task: str) -> int:
        return self.rows().where(F.col("task") == task).count()

    def add(self, task: str, agreed: bool, detail: str, route: str, statement: str | None, note: str) -> None:
        row = (task, agreed, detail, route, statement, note, datetime.now(UTC).replace(tzinfo=None))
        if self.folder:
            self.spark.createDataFrame([row], CHECKS).coalesce(1).write.mode("append").parquet(self.folder)
        else:
            self.here.append(row)


class References:
    """Reference answers, made once for each state of the data: a table for each task and digest of the rows asked about."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @staticmethod
    def digest(rows: DataFrame) -> str:
        """Of all rows and columns, whatever their order."""
        each = F.xxhash64(F.to_json(F.struct(*rows.columns)))
        n, mixed, total = rows.select(each.alias("h")).agg(F.count("*"), F.bit_xor("h"), F.sum(F.shiftright("h", 20))).first()
        return f"{n}-{(mixed or 0) & (1 << 64) - 1:016x}-{(total or 0) & (1 << 64) - 1:016x}"

    def get(self, task: str, rows: DataFrame, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.folder}/{task.lower()}/{self.digest(rows)}"
        if not exists(self.spark, f"{path}/_SUCCESS"):
            remove(self.spark, path)
            make().write.parquet(path)
        return self.spark.read.schema("value double").parquet(path)
