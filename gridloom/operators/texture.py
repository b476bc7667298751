"""Texture of labelled objects: co-occurrence counts of neighbouring pixels' levels, and their thirteen measures, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["slide", "label"]

#: Offsets (rows, columns) of the four directions; a pair counts both ways, so the other four are in them.
OFFSETS = ((0, 1), (1, 1), (1, 0), (1, -1))
#: Names of the measures, in their usual order.
MEASURES = (
    "second_moment", "contrast", "correlation", "variance", "inverse_difference", "sum_average", "sum_variance",
    "sum_entropy", "entropy", "difference_variance", "difference_entropy", "information_1", "information_2",
)


def grey_level(value: Column, low: float, high: float, levels: int = 256) -> Column:
    """Levels 0 to ``levels`` - 1 of values from ``low`` to ``high``; what lies beyond is cut to the ends; null for null."""
    share = (value - F.lit(float(low))) / F.lit(float(high - low))
    return F.when(value.isNotNull(), F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * (levels - 1)).cast("int"))


def cooccurrence(pixels: DataFrame) -> DataFrame:
    """(slide, label, direction, i, j, n): how often levels ``i`` and ``j`` are next to each other inside an object, by direction.

    ``pixels`` has (slide, label, r, c, level). Each pixel asks for four neighbours by their place, an equi-join whose keys are single pixels.
    Level 0 stands for no tissue and is left out, as are nulls; a repeated pixel counts once, with its highest level.
    """
    known = pixels.where("slide IS NOT NULL AND label IS NOT NULL AND r IS NOT NULL AND c IS NOT NULL AND level > 0")
    one = known.groupBy(*KEYS, "r", "c").agg(F.max("level").alias("j"))
    steps = F.array(*[F.struct(F.lit(d).alias("direction"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for d, (dr, dc) in enumerate(OFFSETS)])
    asks = one.select(*KEYS, "r", "c", F.col("j").alias("i"), F.explode(steps).alias("s"))
    asks = asks.select(*KEYS, "s.direction", (F.col("r") + F.col("s.dr")).alias("r"), (F.col("c") + F.col("s.dc")).alias("c"), "i")
    pairs = asks.join(one, [*KEYS, "r", "c"]).groupBy(*KEYS, "direction", "i", "j").agg(F.count("*").alias("n"))
    ways = F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    both = pairs.select(*KEYS, "direction", "n", ways.alias("w"))
    return both.groupBy(*KEYS, "direction", "w.i", "w.j").agg(F.sum("n").alias("n"))


def texture(pixels: DataFrame) -> DataFrame:
    """(slide, label, MEASURES): means over the four directions, for every object with a pixel.

    Logarithms are binary. ``difference_variance`` is the variance of the differences' shares over the levels 0 to the object's highest.
    ``correlation`` is 1 where all levels are one. An object that has no pair in some direction has zeros everywhere.
    """
    by = [*KEYS, "direction"]
    i, j, p = F.col("i"), F.col("j"), F.col("p")
    shared = lambda *of: F.sum("p").over(Window.partitionBy(*by, *of))
    # at most levels x levels rows a direction, dealt once: all windows and the sums by direction keep to it
    counts = cooccurrence(pixels).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))
    rows = counts.withColumns({"level": shared("i"), "plus": shared(i + j), "minus": shared(F.abs(i - j))})
    bits = lambda q: -F.sum(p * F.log2(q))  # noqa: E731  # of shares that rows have in common, each counts by its rows' own
    sums = rows.groupBy(*by).agg(
        F.sum(p * p).alias("second_moment"), F.sum((i - j) * (i - j) * p).alias("contrast"), F.sum(i * j * p).alias("product"),
        F.sum(i * p).alias("mean"), F.sum(i * i * p).alias("square"), F.sum(p / (1 + (i - j) * (i - j))).alias("inverse_difference"),
        F.sum((i + j) * p).alias("sum_average"), F.sum((i + j) * (i + j) * p).alias("sum_square"), F.sum(p * F.col("minus")).alias("minus_square"),
        bits("p").alias("entropy"), bits("level").alias("h"), bits("plus").alias("sum_entropy"), bits("minus").alias("difference_entropy"),
    )
    objects = pixels.where("slide IS NOT NULL AND label IS NOT NULL").groupBy(*KEYS).agg(F.coalesce(F.max("level"), F.lit(0)).alias("top"))
    size, h, v = (F.col("top") + 1).cast("double"), F.col("h"), F.col("variance")
    spread = F.col("square") - F.col("mean") * F.col("mean")
    measured = sums.join(objects, KEYS).withColumn("variance", F.when(spread > 1e-12, spread).otherwise(0.0)).select(
        *by, "second_moment", "contrast",
        F.when(v == 0, F.lit(1.0)).otherwise(F.try_divide(F.col("product") - F.col("mean") * F.col("mean"), v)).alias("correlation"),
        "variance", "inverse_difference", "sum_average",
        F.greatest(F.col("sum_square") - F.col("sum_average") * F.col("sum_average"), F.lit(0.0)).alias("sum_variance"), "sum_entropy", "entropy",
        F.greatest(F.col("minus_square") / size - 1 / (size * size), F.lit(0.0)).alias("difference_variance"), "difference_entropy",
        F.when(h > 0, (F.col("entropy") - 2 * h) / h).otherwise(0.0).alias("information_1"),
        F.sqrt(F.greatest(1 - F.exp(-2 * (2 * h - F.col("entropy"))), F.lit(0.0))).alias("information_2"),
    )
    found = measured.groupBy(*KEYS).agg(F.count("*").alias("_n"), *[F.avg(m).alias(m) for m in MEASURES])
    full = found.where(F.col("_n") == len(OFFSETS)).drop("_n")
    return objects.select(*KEYS).join(full, KEYS, "left").select(*KEYS, *[F.coalesce(m, F.lit(0.0)).alias(m) for m in MEASURES])
