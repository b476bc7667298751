"""Incremental output: only keys that the target lacks are computed and appended."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame


def not_yet_written(df: DataFrame, written: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose keys ``written`` lacks; a row with a null key is never written yet."""
    return df.join(written.select(*keys).distinct(), keys, "left_anti")


def append_missing(df: DataFrame, path: str, keys: list[str], partition_by: list[str] = ()) -> DataFrame:
    """Append the rows whose keys the Parquet table at ``path`` lacks, and return the table."""
    spark = df.sparkSession
    try:
        df = not_yet_written(df, spark.read.parquet(path), keys)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    df.write.mode("append").partitionBy(*partition_by).parquet(path)
    return spark.read.parquet(path)
