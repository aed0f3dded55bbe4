"""Resumable ingest: a file stream that takes what is new and stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestfold.functions.keys import Manifest
from nestfold.operators.record import BROADCAST_FILES, row_path
from nestfold.operators.tables import load
from nestfold.sources.datasets import Dataset, tables
from nestfold.storage import qualified_all


def ingest_new(spark: SparkSession, folder: str, manifest: Manifest, dataset: Dataset, root: str, checkpoint: str) -> None:
    """Load the files of ``folder`` that no run with this checkpoint has loaded; each replaces only its own rows.

    Every file must be in the manifest, which gives its id; one that is not ends the run with an
    error before anything of its batch is loaded.
    """
    schema = spark.read.parquet(folder).schema
    named = qualified_all(spark, [f["path"] for f in manifest.files])
    known = spark.createDataFrame(list(zip(named, [f["file_id"] for f in manifest.files], strict=True)), "_path string, _file long")
    known = F.broadcast(known) if len(manifest.files) <= BROADCAST_FILES else known

    def batch(rows: DataFrame, _: int) -> None:
        met = rows.join(known, "_path", "left")
        lost = met.where("_file IS NULL").select("_path").distinct().limit(5).collect()
        if lost:
            raise ValueError(f"not in the manifest: {', '.join(r[0] for r in lost)}")
        keyed = met.withColumn("event_id", manifest.layout.pack(F.col("_file"), F.col("_entry")))
        load(tables(keyed.drop("_path", "_file", "_entry"), dataset), root, manifest.layout)

    rows = spark.readStream.schema(schema).parquet(folder)
    rows = rows.select("*", row_path().alias("_path"), F.col("_metadata.row_index").alias("_entry"))
    rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
