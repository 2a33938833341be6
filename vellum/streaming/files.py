"""Word files read as they arrive: a folder is watched, and each new file's blocks are added to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellum.operators import blocks

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, pattern: str = "*.docx", files_each: int = 1_000) -> StreamingQuery:
    """A query that reads the files that the folder has now or got since the last run, files_each at a time, and ends. A batch
    writes one partition of `out` (batch=n) and replaces it if it runs again after a failure, so no file counts twice."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_each).load(folder)

    def add(batch: DataFrame, n: int) -> None:
        own = batch.select(F.col("path").alias("doc_id"), "content")
        blocks.from_docx(own).drop("source").write.mode("overwrite").parquet(f"{out}/batch={n}")

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
