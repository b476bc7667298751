"""Features of labelled objects from their member pixels (slide, label, r, c, act), in one aggregation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["slide", "label"]


def location_size(pixels: DataFrame) -> DataFrame:
    """Ends (exclusive), centroid, area, area of the box and diameter of a circle of that area."""
    out = pixels.groupBy(*KEYS).agg(
        F.min("r").alias("r_start"), (F.max("r") + 1).alias("r_end"), F.min("c").alias("c_start"), (F.max("c") + 1).alias("c_end"),
        F.avg("r").alias("r_mean"), F.avg("c").alias("c_mean"), F.count("*").alias("area"),
    )
    box = (F.col("r_end") - F.col("r_start")) * (F.col("c_end") - F.col("c_start"))
    return out.withColumns({"box_area": box.cast("long"), "diameter": F.sqrt(4 * F.col("area") / math.pi)})


def moments(pixels: DataFrame) -> DataFrame:
    """Axes, eccentricity and orientation from second central moments; a pixel adds 1/12 to each variance."""
    out = pixels.groupBy(*KEYS).agg(
        (F.var_pop("r") + 1 / 12).alias("a"), F.covar_pop("r", "c").alias("b"), (F.var_pop("c") + 1 / 12).alias("d")
    )
    half, root = (F.col("a") + F.col("d")) / 2, F.sqrt(F.pow((F.col("a") - F.col("d")) / 2, F.lit(2.0)) + F.col("b") * F.col("b"))
    big, small = half + root, F.greatest(half - root, F.lit(0.0))
    return out.select(
        *KEYS,
        (4 * F.sqrt(big)).alias("major"),
        (4 * F.sqrt(small)).alias("minor"),
        F.sqrt(F.greatest(1 - small / big, F.lit(0.0))).alias("eccentricity"),
        (F.atan2(2 * F.col("b"), F.col("a") - F.col("d")) / 2).alias("angle"),
    )


def orientation(pixels: DataFrame) -> DataFrame:
    """(slide, label, y_proj, x_proj, atan, orientation): the direction of the main axis, from exact whole-number moments.

    The projections are 2 cov(r, c) and var(r) - var(c), over their length if that isn't 0; ``atan`` is their quotient's arc tangent, 0 if both are 0.
    With equal variances the orientation is a quarter of pi, negative where the covariance is positive.
    """
    whole = lambda c: F.sum(c).cast("decimal(18,0)")
    r, c = F.col("r").cast("long"), F.col("c").cast("long")
    out = pixels.groupBy(*KEYS).agg(
        whole(F.lit(1)).alias("n"), whole(r).alias("r"), whole(c).alias("c"), whole(r * r).alias("rr"), whole(c * c).alias("cc"), whole(r * c).alias("rc")
    )
    n = F.col("n")
    square = F.pow(n.cast("double"), F.lit(2.0))
    y = (2 * (n * F.col("rc") - F.col("r") * F.col("c"))).cast("double") / square
    x = (n * F.col("rr") - F.col("r") * F.col("r") - n * F.col("cc") + F.col("c") * F.col("c")).cast("double") / square
    out = out.select(*KEYS, y.alias("y"), x.alias("x")).withColumn("length", F.sqrt(F.col("y") * F.col("y") + F.col("x") * F.col("x")))
    y, x = F.col("y"), F.col("x")
    steep = F.when(y == 0, 0.0).otherwise(F.signum(y) * (math.pi / 2))
    equal = F.when(y > 0, -math.pi / 4).otherwise(math.pi / 4)
    return out.select(
        *KEYS,
        F.when(F.col("length") > 0, y / F.col("length")).otherwise(0.0).alias("y_proj"),
        F.when(F.col("length") > 0, x / F.col("length")).otherwise(0.0).alias("x_proj"),
        F.when(x == 0, steep).otherwise(F.atan(F.try_divide(y, x))).alias("atan"),
        F.when(x == 0, equal).otherwise(F.atan2(y, x) / 2).alias("orientation"),
    )


def mask_overlap(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """(slide, label, overlap): the share of an object's pixels that are in ``mask`` (slide, r, c), whose repeated rows count once."""
    places = mask.select("slide", "r", "c").distinct().withColumn("_in", F.lit(1.0))
    return pixels.join(places, ["slide", "r", "c"], "left").groupBy(*KEYS).agg(F.avg(F.coalesce("_in", F.lit(0.0))).alias("overlap"))


def activation(pixels: DataFrame, act: str, cuts: list[float]) -> DataFrame:
    """Mean activation and the share of pixels above each cut, named over_0, over_1, ..."""
    shares: list[Column] = [F.avg((F.col(act) > x).cast("double")).alias(f"over_{i}") for i, x in enumerate(cuts)]
    return pixels.groupBy(*KEYS).agg(F.avg(act).alias("mean"), *shares)


def majority(pixels: DataFrame, value: str) -> DataFrame:
    """The most frequent value of each object, the smallest on ties."""
    return pixels.groupBy(*KEYS).agg(F.mode(F.col(value), deterministic=True).alias("majority"))


def hull(pixels: DataFrame) -> DataFrame:
    """(slide, label, hull_area, solidity): area of the convex hull of the pixels' squares, and the object's share of it.

    Only the first and last pixel of each row can be corners, so a task holds an object's outline.
    """
    import pandas as pd

    rows = pixels.groupBy(*KEYS, "r").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        points = sorted({(r + dr, c + dc) for r, lo, hi in zip(pdf["r"], pdf["lo"], pdf["hi"], strict=True) for c in (lo, hi) for dr in (0, 1) for dc in (0, 1)})
        turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
        chain: list = []
        for part in (points, points[::-1]):
            side: list = []
            for p in part:
                while len(side) > 1 and turn(side[-2], side[-1], p) <= 0:
                    side.pop()
                side.append(p)
            chain += side[:-1]
        area = abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(chain, chain[1:] + chain[:1], strict=True))) / 2
        return pdf[KEYS].head(1).assign(hull_area=float(area), solidity=float(pdf["n"].sum() / area))

    return rows.groupBy(*KEYS).applyInPandas(one, "slide int, label int, hull_area double, solidity double")
