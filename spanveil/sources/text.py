"""Text files as a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_FILES = r"(?i)\.(?:txt|md|csv|log)\z"


def read_text_corpus(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """One row per text file under ``path``: path, filename, source, text.

    Names are checked on the file listing, so other files are never read.  A file is one
    text; split very large logs upstream if they must be processed in parallel.
    """
    files = (
        spark.read.text(path, wholetext=True, recursiveFileLookup=recursive)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_name").alias("filename"),
            F.lit("file").alias("source"),
            F.col("value").alias("text"),
        )
    )
    return files.where(F.col("filename").rlike(TEXT_FILES))
