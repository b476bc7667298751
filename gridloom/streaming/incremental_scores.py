"""Scores of new slides as they arrive: a file stream and an idempotent batch function."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import vectors
from gridloom.sources.incremental import append_missing

CELLS = "slide string, r int, c int, label int, embedding array<double>"


def heterogeneity(cells: DataFrame) -> DataFrame:
    """(slide, score): medoids of each label, their pair distances, and their weighted mean."""
    medoids = vectors.medoids(cells.withColumn("id", F.struct("r", "c")), ["slide", "label"], "id", "embedding")
    pairs = vectors.pairs_within(medoids, ["slide"], "label", "vector")
    return vectors.group_scores(pairs, ["slide"], F.col("dist"))


def run(spark: SparkSession, source: str, target: str, state: str) -> None:
    """Score the slides of files in ``source`` that earlier calls haven't seen, and append them to ``target``.

    A slide's cells must come in one batch. A batch that is run again after a failure
    writes nothing twice, as slides that ``target`` has are left out.
    """
    def batch(cells: DataFrame, _: int) -> None:
        append_missing(heterogeneity(cells), target, ["slide"])

    stream = spark.readStream.schema(CELLS).parquet(source)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
