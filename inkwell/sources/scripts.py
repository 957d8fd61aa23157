"""Scripts in and out: one row per document, (script_id, filename, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_scripts(spark: SparkSession, path: str | list[str], ignore_missing: bool = False) -> DataFrame:
    """UTF-8 files, each whole. The id is a hash of the full path, so it is the same in every run.

    A missing path raises, unless ignore_missing; then files that vanish while being read are skipped."""
    reader = spark.read.option("ignoreMissingFiles", str(ignore_missing).lower())
    files = reader.text(path, wholetext=True)
    return files.select(F.xxhash64("_metadata.file_path").alias("script_id"), F.col("_metadata.file_name").alias("filename"), F.col("value").alias("text"))


def scripts_from(df: DataFrame, script_id: str | Column, text: str | Column) -> DataFrame:
    """Scripts from columns of any table; they have no file name."""
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(as_column(script_id).cast("long").alias("script_id"), F.lit(None).cast("string").alias("filename"), as_column(text).alias("text"))


def scripts_from_strings(spark: SparkSession, texts: list[str | None]) -> DataFrame:
    return spark.createDataFrame([(i, None, t) for i, t in enumerate(texts)], "script_id long, filename string, text string")


def write_documents(documents: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """documents (script_id, text) as UTF-8 text files below path, any Hadoop file system URI; the job commits as a whole."""
    documents.select("text").write.mode(mode).option("lineSep", "\n").text(path)


def write_script_files(documents: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """As write_documents, each script in a folder of its own named by its id."""
    documents.select("script_id", "text").write.mode(mode).partitionBy("script_id").text(path)
