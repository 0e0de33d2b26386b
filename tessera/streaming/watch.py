"""Folder watching and stimulus draining with Structured Streaming; only logical ticks move time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.arrow import decoded_text
from tessera.operators.tables import chunks_of


def watch_folder(spark: SparkSession, folder: str, chunk_table: str, provenance_table: str, checkpoint: str, *, interval: str = "5 seconds", once: bool = False) -> StreamingQuery:
    """Ingest what arrives in a folder, file by file: new chunks once, provenance for each. A batch is one commit of either
    table, keyed by its number, so a batch that is run again writes the same rows."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1000).load(folder)

    def ingest(batch: DataFrame, number: int) -> None:
        texts = batch.select(F.col("path").alias("source"), decoded_text("content").alias("text")).where("text is not null")
        cut = chunks_of(texts)
        new = cut.dropDuplicates(["chunk_id"]).select("chunk_id", "text", F.lit(number).alias("batch"))
        try:
            new = new.join(batch.sparkSession.read.parquet(chunk_table).where(F.col("batch") < number).select("chunk_id"), "chunk_id", "left_anti")
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new.drop("batch").write.mode("overwrite").parquet(f"{chunk_table}/batch={number}")
        cut.select("chunk_id", "source").distinct().write.mode("overwrite").parquet(f"{provenance_table}/batch={number}")

    writer = files.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def drain(spark: SparkSession, folder: str, apply: Callable[[DataFrame, int], None], checkpoint: str, *, most_files: int = 256, interval: str = "3 seconds", once: bool = False) -> StreamingQuery:
    """Hand queued stimuli (id, strength; JSON files) to ``apply`` tick by tick; a batch's number is its tick."""
    queue = spark.readStream.schema("id string, strength double").option("maxFilesPerTrigger", most_files).json(folder)
    writer = queue.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
