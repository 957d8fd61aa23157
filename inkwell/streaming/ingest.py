"""Scripts that arrive as files, parsed batch by batch.

The parser's windows run over the lines of one script, not over time, so they can't run on a stream as such; each
micro-batch holds whole scripts and is parsed as a table. A batch that is run again after a failure replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkwell.plans.script import Corpus


def ingest(spark: SparkSession, source: str, elements_path: str, checkpoint: str, parser: str = "fast", files_per_batch: int = 1000) -> StreamingQuery:
    """Parse the files that are or come below source; their elements go to elements_path, a folder per batch.

    It works off what is there and ends; started again with the same checkpoint, it goes on with what is new."""
    files = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_per_batch).schema("value string").load(source)
    scripts = files.select(F.xxhash64("_metadata.file_path").alias("script_id"), F.col("_metadata.file_name").alias("filename"), F.col("value").alias("text"))

    def write(batch: DataFrame, number: int) -> None:
        Corpus(batch, parser).elements.write.mode("overwrite").parquet(f"{elements_path}/batch={number}")

    return scripts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
