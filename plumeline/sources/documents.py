"""Reader for policy documents: one JSON text per file."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, path: str | list[str], missing_ok: bool = False) -> DataFrame:
    """Rows `(doc, text)`, the file name and its whole content, for a file, a folder or a pattern.

    With `missing_ok`, a path that does not exist gives no rows instead of an error.
    """
    try:
        files = spark.read.text(path, wholetext=True)
    except AnalysisException:
        if not missing_ok:
            raise
        return spark.createDataFrame([], "doc string, text string")
    return files.select(F.col("_metadata.file_name").alias("doc"), F.col("value").alias("text"))
