"""Registration of queries, and the tables that stand in for cohort data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a directory, read when they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def grid(self) -> DataFrame:
        """``embeddings`` as slides of 10 x 10 cells: (slide, r, c, vec_id, label, embedding)."""
        v = F.col("vec_id")
        return self.embeddings.select(
            F.floor(v / 100).cast("int").alias("slide"),
            F.floor((v % 100) / 10).cast("int").alias("r"),
            (v % 10).cast("int").alias("c"),
            "vec_id",
            "label",
            "embedding",
        )


#: The same as a common table expression.
GRID = (
    "grid AS (SELECT (vec_id // 100)::INTEGER AS slide, ((vec_id % 100) // 10)::INTEGER AS r, "
    "(vec_id % 10)::INTEGER AS c, vec_id, label, embedding::DOUBLE[] AS embedding FROM embeddings)"
)


def query(sql: str | None = None):
    """Register a function of ``Tables`` as a query, with its DuckDB SQL if there is one."""

    def keep(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep
