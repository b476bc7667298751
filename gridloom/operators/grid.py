"""Operators on cells (slide, r, c, ...) of rasters in sparse form: a cell that is absent is outside."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = ["slide", "r", "c"]


def _box_counts(cells: DataFrame, radius: int) -> DataFrame:
    """(slide, r, c, n): how many cells the square of ``radius`` around each place holds, where it holds any.

    Along each axis a cell opens a stretch and closes it again, and running sums give
    the counts between: rows grow with the places found, not with the square's area.
    """
    held = cells.select(*CELL, F.lit(1).cast("long").alias("n"))
    for axis, other in (("c", "r"), ("r", "c")):
        edge = lambda by, sign: held.select("slide", other, (F.col(axis) + by).alias(axis), (sign * F.col("n")).alias("n"))  # noqa: B023, E731
        edges = edge(-radius, 1).unionByName(edge(radius + 1, -1)).groupBy("slide", other, axis).agg(F.sum("n").alias("n"))
        line = Window.partitionBy("slide", other).orderBy(axis)  # one row or column of a raster
        runs = edges.select("slide", other, axis, F.lead(axis).over(line).alias("next"), F.sum("n").over(line).alias("n")).where("n > 0")
        held = runs.select("slide", other, F.explode(F.sequence(F.col(axis), F.col("next") - 1)).alias(axis), "n")
    return held.select(*CELL, "n")


def dilate(cells: DataFrame, radius: int) -> DataFrame:
    """Places within ``radius`` rows and columns of a cell; radius 0 changes nothing."""
    return _box_counts(cells, radius).select(*CELL)


def erode(cells: DataFrame, radius: int, frame: DataFrame) -> DataFrame:
    """Cells whose whole square is filled, where only places of ``frame`` count: those outside don't erode."""
    empty = frame.select(*CELL).join(cells.select(*CELL), CELL, "left_anti")
    return cells.select(*CELL).join(dilate(empty, radius), CELL, "left_anti")


def border_band(labels: DataFrame, radius: int = 2, loss: int = 2, band: int = 3) -> DataFrame:
    """(slide, r, c, label): cells near the border between ``loss`` and the other labels become ``band``."""
    lost = labels.where(F.col("label") == loss)
    kept = labels.where(F.col("label") != loss)
    near = dilate(lost, radius).join(kept.select(*CELL), CELL, "left_semi").unionByName(
        dilate(kept, radius).join(lost.select(*CELL), CELL, "left_semi")
    )
    marked = labels.join(near.withColumn("_near", F.lit(True)), CELL, "left")
    return marked.select(*CELL, F.when(F.col("_near"), band).otherwise(F.col("label")).cast("int").alias("label"))


def components(cells: DataFrame, diagonal: bool = True, out: str = "component") -> DataFrame:
    """Add ``component``: connected cells of one label on a slide, named by their first cell r * 2**32 + c.

    A task holds one slide's cells: a slide's size is bounded by its image.
    """
    steps = [(0, 1), (1, 0)] + [(1, 1), (1, -1)] * diagonal

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf["r"].to_numpy(np.int64) << 32 | pdf["c"].to_numpy(np.int64)
        order = np.argsort(key)
        key, kind = key[order], pdf["label"].to_numpy()[order]
        links = []
        for dr, dc in steps:
            want = key + (dr << 32) + dc
            at = np.minimum(np.searchsorted(key, want), len(key) - 1)
            hit = np.flatnonzero((key[at] == want) & (kind[at] == kind))
            links.append(np.column_stack([hit, at[hit]]))
        links = np.concatenate(links)
        root = np.arange(len(key))
        while True:  # least neighbour, then jumps to the root's root, until nothing moves
            before = root.copy()
            np.minimum.at(root, links[:, 0], before[links[:, 1]])
            np.minimum.at(root, links[:, 1], before[links[:, 0]])
            np.minimum.at(root, before, root)
            root = root[root]
            if (root == before).all():
                break
        named = np.empty(len(key), np.int64)
        named[order] = key[root]
        return pdf.assign(**{out: named})

    kept = [c for c in cells.columns if c != out]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema if f.name in kept)
    return cells.select(*kept).groupBy("slide").applyInPandas(label, f"{schema}, `{out}` long")


def without_small(labelled: DataFrame, least: int) -> DataFrame:
    """Cells of components with at least ``least`` cells."""
    keys = ["slide", "component"]
    big = labelled.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return labelled.join(big.select(*keys), keys, "left_semi")


def split_control(labelled: DataFrame, angles: int) -> DataFrame:
    """(slide, component, r, c, angle, side): each component cut by lines through its centre.

    Angle i of n is the whole number of degrees 360 / n, times i + 1. Cells above the
    line are on side 1, others on 2, and the sides change places from 180 degrees on.
    """
    centre = labelled.groupBy("slide", "component").agg(F.avg("r").alias("cr"), F.avg("c").alias("cc"))
    degrees = F.explode(F.array(*[F.lit(360 // angles * (i + 1)) for i in range(angles)]))
    rows = labelled.join(centre, ["slide", "component"]).withColumn("angle", degrees)
    above = F.col("r") < F.round(F.tan(F.radians("angle")), 9) * (F.col("c") - F.col("cc")) + F.col("cr")
    side = F.when((F.col("angle") >= 180) == above, 2).otherwise(1)
    return rows.select("slide", "component", "r", "c", "angle", side.cast("int").alias("side"))


def contiguity_control(cells: DataFrame, sizes: DataFrame, runs: int, seed: int = 1) -> DataFrame:
    """(slide, run, r, c, side): random contiguous regions of given sizes.

    ``sizes`` is (slide, area). In each run the areas, largest first, each take a random
    free cell and the free cells nearest to it (side 2); the rest is side 1. Areas of
    one cell are left out. Slides and runs are independent tasks; inside one the areas
    depend on each other.
    """
    areas = sizes.where("area > 1").groupBy("slide").agg(F.sort_array(F.collect_list("area"), False).alias("areas"))
    rows = cells.select(*CELL).join(areas, "slide", "left").withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))

    def claim(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["r", "c"], ignore_index=True)
        rng = np.random.default_rng([seed, int(pdf["slide"][0]), int(pdf["run"][0])])
        at, free = pdf[["r", "c"]].to_numpy(float), np.ones(len(pdf), bool)
        areas = pdf["areas"][0]
        for area in areas if areas is not None else ():
            open_ = np.flatnonzero(free)
            if not len(open_):
                break
            far = ((at[open_] - at[rng.choice(open_)]) ** 2).sum(axis=1)
            free[open_[np.argsort(far, kind="stable")[: int(area)]]] = False
        return pdf[["slide", "run", "r", "c"]].assign(side=np.where(free, 1, 2))

    return rows.groupBy("slide", "run").applyInPandas(claim, "slide int, run int, r int, c int, side int")


def rasterise(regions: DataFrame) -> DataFrame:
    """(slide, r, c, label): cells whose centres lie in a region; of several the one with the largest ``region_ix``.

    ``regions`` is (slide, region_ix, label, xs, ys) with the corners of a ring in order, and may have ``sign``. The rows of one
    ``region_ix`` are rings of one region, by the even-odd rule: a ring inside another is a hole. Regions whose sign is "-"
    come after all others and leave no label where they are; a null sign is "+". Rings with a null or under two corners have no cells.

    Regions of a slide with the same rings, labels and signs have the same cells, so only the one with the largest ``region_ix`` is drawn.
    Each edge gives its crossing of every row of centres that it spans, and a row's sorted crossings bound the spans of cells between the
    first and second, third and fourth; so work grows with outlines and cells inside, not with bounding boxes.
    """
    turned = lambda a: F.concat(F.slice(a, 2, F.size(a) - 1), F.slice(a, 1, 1))
    edges = F.arrays_zip(F.col("xs").alias("x1"), F.col("ys").alias("y1"), turned(F.col("xs")).alias("x2"), turned(F.col("ys")).alias("y2"))
    sign = F.coalesce(F.col("sign"), F.lit("+")) if "sign" in regions.columns else F.lit("+")
    key = ["slide", "region_ix"]
    rings = regions.where((F.size("xs") > 1) & (F.size("xs") == F.size("ys"))).select(*key, F.struct("xs", "ys", "label", sign.alias("sign")).alias("ring"))
    whole = rings.groupBy(*key).agg(F.sort_array(F.collect_list("ring")).alias("rings"))
    drawn = whole.groupBy("slide", "rings").agg(F.max("region_ix").alias("region_ix"))
    rows = drawn.select(*key, F.explode("rings").alias("ring")).select(*key, "ring.*").select(*key, "label", "sign", F.explode(edges).alias("e")).select(*key, "label", "sign", "e.*")
    first = lambda v: F.ceil(v - 0.5).cast("int")  # noqa: E731  # the first whole number whose centre is v or more
    low, high = first(F.least("y1", "y2")), first(F.greatest("y1", "y2")) - 1
    rows = rows.where(low <= high).withColumn("r", F.explode(F.sequence(low, high)))
    meets = (F.col("x2") - F.col("x1")) * (F.col("r") + 0.5 - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    lines = rows.groupBy(*key, "r").agg(F.array_sort(F.collect_list(meets)).alias("m"), F.max("label").alias("label"), F.min("sign").alias("sign"))
    span = F.explode(F.transform(F.sequence(F.lit(0), F.size("m") - 2, F.lit(2)), lambda i: F.struct(first(F.get("m", i)).alias("a"), (first(F.get("m", i + 1)) - 1).alias("b"))))
    spans = lines.where(F.size("m") > 1).select(*key, "r", "label", "sign", span.alias("s")).where("s.a <= s.b")
    cells = spans.select(*key, "r", F.explode(F.sequence("s.a", "s.b")).alias("c"), "label", "sign")
    one = cells.groupBy("slide", "r", "c").agg(F.max_by("label", "region_ix").alias("label"), F.bool_or(F.col("sign") == "-").alias("gone"))
    return one.where("NOT gone").drop("gone")


def smoothed_argmax(cells: DataFrame, scores: str, kernel: list[float], only: int | None = None) -> DataFrame:
    """(slide, r, c, class): each class score averaged with ``kernel`` by rows and columns, then the first largest.

    ``kernel`` has odd length; places outside the slide count as absent, and weights are
    renormalised. With ``only``, that class alone is averaged, the others stay as they are.
    """
    half = len(kernel) // 2
    weigh = F.array(*[F.struct(F.lit(i - half).alias("d"), F.lit(float(w)).alias("w")) for i, w in enumerate(kernel)])
    long = cells.select(*CELL, F.posexplode(scores).alias("class", "v"))
    still = long.where(F.col("class") != only) if only is not None else None
    if only is not None:
        long = long.where(F.col("class") == only)
    for axis in ("r", "c"):
        moved = long.withColumn("k", F.explode(weigh)).withColumn(axis, F.col(axis) + F.col("k.d"))
        long = moved.groupBy(*CELL, "class").agg((F.sum(F.col("v") * F.col("k.w")) / F.sum("k.w")).alias("v"))
        long = long.join(cells.select(*CELL), CELL, "left_semi")
    if still is not None:
        long = long.unionByName(still)
    best = Window.partitionBy(*CELL).orderBy(F.desc("v"), "class")
    return long.withColumn("i", F.row_number().over(best)).where("i = 1").select(*CELL, "class")


def overlap(truth: DataFrame, control: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side, overlap): share of each true side's cells that the control puts on that side.

    ``truth`` is (slide, r, c, side), ``control`` has the same columns and ``keys``.
    """
    rows = control.select(*keys, *CELL, F.col("side").alias("claimed")).join(truth, CELL)
    return rows.groupBy(*keys, "side").agg(F.avg((F.col("claimed") == F.col("side")).cast("double")).alias("overlap"))


def coverage(cells: DataFrame, height: int, width: int, size: int, least: float) -> DataFrame:
    """(slide, r, c, filled): places whose square of odd side ``size`` is filled to more than ``least``, off the border."""
    half = size // 2
    filled = _box_counts(cells, half)
    inside = F.col("r").between(half, height - 1 - half) & F.col("c").between(half, width - 1 - half)
    share = F.col("n") / float(size * size)
    return filled.where(inside & (share > least)).select(*CELL, share.alias("filled"))


def resized_nearest(cells: DataFrame, shape: tuple[int, int], to: tuple[int, int], keys: list[str]) -> DataFrame:
    """``cells`` (keys, r, c, ..) of rasters of ``shape`` at the size ``to``: each new cell is the one under its middle."""
    spark = cells.sparkSession
    place = lambda name, k: spark.range(to[k]).select(
        F.col("id").cast("int").alias(f"_{name}"), F.least(F.floor((F.col("id") + 0.5) * shape[k] / to[k]), F.lit(shape[k] - 1)).cast("int").alias(name)
    )
    rows = cells.join(F.broadcast(place("r", 0)), "r").join(F.broadcast(place("c", 1)), "c")  # as many rows as the new raster has
    rest = [c for c in cells.columns if c not in (*keys, "r", "c")]
    return rows.select(*keys, F.col("_r").alias("r"), F.col("_c").alias("c"), *rest)


def pair_mask(cells: DataFrame, label: str, first, second) -> DataFrame:
    """``cells`` with ``side``: 1 where ``label`` is the first, 2 where it is the second, 0 elsewhere and where it is null."""
    return cells.withColumn("side", F.when(F.col(label) == first, 1).when(F.col(label) == second, 2).otherwise(0))


def without_markers(cells: DataFrame, markers: DataFrame, classes: list[int]) -> DataFrame:
    """``cells`` whose place isn't marked with one of ``classes`` in ``markers`` (slide, r, c, label); a null mark marks nothing."""
    marked = markers.where(F.col("label").isin(classes)).select(*CELL)
    return cells.join(marked, CELL, "left_anti")
