"""Ingestion of a folder that files arrive in, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.ingest import Ingestor
from brindle.sources.files import SUPPORTED


def watch(spark: SparkSession, folder: str, ingestor: Ingestor, checkpoint_dir: str, once: bool = False):
    """Ingests every batch of new files as one snapshot. Files seen again are duplicates by their bytes, so a batch that is
    repeated after a failure changes nothing."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    named = files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "content").filter(F.col("filename").rlike(SUPPORTED))

    def take(batch: DataFrame, _: int) -> None:
        ingestor.ingest(batch).count()

    writer = named.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint_dir)
    return (writer.trigger(availableNow=True) if once else writer).start()
