"""Tiling plans, padding, windows and merging, as generated rows and index arithmetic."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MODES = ("constant", "drop", "irregular", "reflect", "edge", "wrap")

#: Tiles that one row of a plan stands for while they are dealt to tasks.
RUN = 1 << 14

#: Coefficients of cosine-sum windows.
COSINE_SUMS = {
    "hann": (0.5, 0.5),
    "hamming": (0.54, 0.46),
    "blackman": (0.42, 0.5, 0.08),
    "nuttall": (0.3635819, 0.4891775, 0.1365995, 0.0106411),
    "blackmanharris": (0.35875, 0.48829, 0.14128, 0.01168),
    "flattop": (0.21557895, 0.41663158, 0.277263158, 0.083578947, 0.006947368),
}


def step_sizes(tile: tuple[int, ...], overlap: int | float | tuple[int, ...]) -> tuple[int, ...]:
    """How far tiles are apart on each axis: an overlap is a number of cells, a share of the tile, or one for each axis."""
    if isinstance(overlap, float):
        if not 0 <= overlap < 1:
            raise ValueError("an overlap that is a share must be from 0 to less than 1")
        overlap = tuple(math.ceil(overlap * t) for t in tile)
    elif isinstance(overlap, int) and not isinstance(overlap, bool):
        overlap = (overlap,) * len(tile)
    elif not isinstance(overlap, tuple):
        raise ValueError("an overlap is an int, a float or a tuple")
    if len(overlap) != len(tile) or any(not 0 <= o < t for o, t in zip(overlap, tile, strict=True)):
        raise ValueError("an overlap must be less than the tile on each axis")
    return tuple(t - o for t, o in zip(tile, overlap, strict=True))


def tile_plan(
    spark: SparkSession,
    shape: tuple[int, ...],
    tile: tuple[int, ...],
    overlap=0,
    mode: str = "constant",
    batch: int = 0,
    channel: int | None = None,
    drop_last: bool = False,
) -> DataFrame:
    """(tile_id, p0.., s0.., e0.., pad0.., batch): each tile's place in the mosaic, its box and its padding.

    Tiles are numbered row by row. ``drop`` leaves out those that would stand out,
    ``irregular`` cuts them, the other modes pad them. ``batch`` is null for 0; ``drop_last``
    leaves out the tiles of a batch that isn't full. ``channel`` is an axis that every tile
    has whole: its entry in ``tile`` must be that of ``shape``, and the overlap leaves it out.
    """
    if channel is not None:
        if not -len(shape) <= channel < len(shape) or len(shape) != len(tile) or tile[channel] != shape[channel]:
            raise ValueError("the channel must be an axis of the data, which tiles have whole")
        channel %= len(shape)
        if isinstance(overlap, tuple):
            overlap = (*overlap[:channel], 0, *overlap[channel:]) if len(overlap) == len(shape) - 1 else overlap
        else:
            rest = step_sizes(tile[:channel] + tile[channel + 1 :], overlap)
            overlap = tuple(t - x for t, x in zip(tile, (*rest[:channel], tile[channel], *rest[channel:]), strict=True))
    if len(shape) != len(tile) or not shape or any(x <= 0 for x in (*shape, *tile)) or mode not in MODES or batch < 0:
        raise ValueError("shapes must be positive and of one rank, the mode known, the batch not negative")
    step = step_sizes(tile, overlap)
    counts = []
    for n, t, s in zip(shape, tile, step, strict=True):
        whole, rest = divmod(max(n - (t - s), 0), s)
        counts.append(whole if mode == "drop" else whole + bool(rest) if n > t - s else 1)
    total = math.prod(counts)
    rows = spark.range(total).withColumnRenamed("id", "tile_id")
    below, cols = total, []
    for i, (n, t, s, k) in enumerate(zip(shape, tile, step, counts, strict=True)):
        below //= max(k, 1)
        place = (F.floor(F.col("tile_id") / max(below, 1)) % max(k, 1)).cast("int")
        end = place * s + t
        cols += [
            place.alias(f"p{i}"),
            (place * s).alias(f"s{i}"),
            (F.least(end, F.lit(n)) if mode == "irregular" else end).cast("int").alias(f"e{i}"),
            (F.lit(0) if mode == "irregular" else F.greatest(end - n, F.lit(0))).cast("int").alias(f"pad{i}"),
        ]
    batches = F.floor(F.col("tile_id") / batch) if batch else F.lit(None).cast("long")
    if batch and drop_last:
        rows = rows.where(F.col("tile_id") < total // batch * batch)
    return rows.select("tile_id", *cols, batches.alias("batch"))


def slide_tiles(slides: DataFrame, keys: list[str], shape: tuple[str, ...], tile: tuple[int, ...], overlap=0, batch: int = 0, drop_last: bool = False) -> DataFrame:
    """(keys, tile_id, p0.., s0.., e0.., pad0.., batch): ``tile_plan`` with padding, for each of ``slides``, whose columns ``shape`` are its sizes.

    Slides with a null or no size have no tiles. ``batch`` numbers a slide's full batches; ``drop_last`` leaves out the tiles of one that isn't.
    A slide's tiles are dealt to tasks in runs of RUN, so neither a task nor an array holds a whole slide's.
    """
    if len(shape) != len(tile) or not shape or any(t <= 0 for t in tile) or batch < 0:
        raise ValueError("a tile must be positive and have the slides' axes, the batch not be negative")
    step = step_sizes(tile, overlap)
    counts = {f"_n{i}": F.greatest(F.ceil((F.col(n) - (t - s)) / s), F.lit(1)).cast("long") for i, (n, t, s) in enumerate(zip(shape, tile, step, strict=True))}
    rows = slides.where(reduce(Column.__and__, [F.col(n) > 0 for n in shape])).withColumns(counts)
    total = reduce(Column.__mul__, [F.col(n) for n in counts])
    last = F.floor(total / batch) * batch if batch and drop_last else total
    runs = rows.where(last > 0).withColumn("_last", last - 1).withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_last") / RUN))))
    runs = runs.repartition(4 * slides.sparkSession.sparkContext.defaultParallelism, *keys, "_run")
    begin = F.col("_run") * RUN
    rows = runs.withColumn("tile_id", F.explode(F.sequence(begin, F.least(begin + (RUN - 1), F.col("_last")))))
    cols, below = [], F.lit(1).cast("long")
    for i in reversed(range(len(shape))):
        place = F.pmod(F.call_function("div", F.col("tile_id"), below), F.col(f"_n{i}")).cast("int")
        end = place * step[i] + tile[i]
        cols[:0] = [place.alias(f"p{i}"), (place * step[i]).alias(f"s{i}"), end.alias(f"e{i}"), F.greatest(end - F.col(shape[i]), F.lit(0)).cast("int").alias(f"pad{i}")]
        below = below * F.col(f"_n{i}")
    return rows.select(*keys, "tile_id", *cols, (F.call_function("div", F.col("tile_id"), F.lit(batch)) if batch else F.lit(None)).cast("long").alias("batch"))


def source_index(i: Column, n: int, mode: str) -> Column:
    """Which cell of 0 to n - 1 stands at place ``i``; null where a constant does."""
    if mode == "edge":
        return F.least(F.greatest(i, F.lit(0)), F.lit(n - 1))
    if mode == "wrap":
        return F.pmod(i, F.lit(n))
    if mode == "reflect":
        period = max(2 * n - 2, 1)
        j = F.pmod(i, F.lit(period))
        return F.least(j, period - j)
    return F.when((i >= 0) & (i < n), i)


def cut(data: DataFrame, n: int, tile: int, overlap=0, mode: str = "constant", fill: float = 0.0) -> DataFrame:
    """(tile_id, i, v): the cells of each tile of a row of values (i, v), ``i`` within the tile."""
    plan = tile_plan(data.sparkSession, (n,), (tile,), overlap, mode)
    cells = plan.withColumn("at", F.explode(F.sequence("s0", F.col("e0") - 1)))
    cells = cells.select("tile_id", (F.col("at") - F.col("s0")).alias("i"), source_index(F.col("at"), n, mode).alias("j"))
    rows = cells.join(data.select(F.col("i").alias("j"), "v"), "j", "left")
    return rows.select("tile_id", F.col("i").cast("int").alias("i"), F.when(F.col("j").isNull(), F.lit(fill)).otherwise(F.col("v")).alias("v"))


def merge(tiles: DataFrame, n: int, tile: int, overlap=0, weight: Column | None = None) -> DataFrame:
    """(i, total, weights, visits, mean): tiles (tile_id, i, v) laid over each other, without padding.

    ``total`` is the weighted sum, ``mean`` that divided by the weights (null where they are 0).
    """
    step = step_sizes((tile,), overlap)[0]
    w = F.lit(1.0) if weight is None else weight
    at = (F.col("tile_id") * step + F.col("i")).cast("int")
    rows = tiles.withColumn("w", w).withColumn("i", at).where(F.col("i") < n)
    out = rows.groupBy("i").agg(
        F.sum(F.col("v") * F.col("w")).alias("total"), F.sum("w").alias("weights"), F.count("*").alias("visits")
    )
    return out.withColumn("mean", F.try_divide("total", "weights"))


def cut_nd(
    data: DataFrame, shape: tuple[int, ...], tile: tuple[int, ...], overlap=0, mode: str = "constant", fill: float = 0.0, keys: tuple[str, ...] = ()
) -> DataFrame:
    """(keys, tile_id, i0.., v): the cells of each tile of images (keys, i0.., v), places within the tile.

    Each image, a value of ``keys``, has the ``shape``; ``v`` is a number, or an array of one for each class.
    A cell that the data lacks, and the padding of the mode constant, has ``fill`` (in every class). ``drop`` and
    ``irregular`` have no padding.
    """
    axes = range(len(shape))
    plan = tile_plan(data.sparkSession, shape, tile, overlap, mode)
    for k in axes:
        plan = plan.withColumn(f"at{k}", F.explode(F.sequence(f"s{k}", F.col(f"e{k}") - 1)))
    places = [(F.col(f"at{k}") - F.col(f"s{k}")).cast("int").alias(f"i{k}") for k in axes]
    cells = plan.select("tile_id", *places, *[source_index(F.col(f"at{k}"), shape[k], mode).cast("int").alias(f"j{k}") for k in axes])
    if keys:
        cells = data.select(*keys).distinct().crossJoin(cells)  # an image has all tiles
    source = data.select(*keys, *[F.col(f"i{k}").cast("int").alias(f"j{k}") for k in axes], "v")
    rows = cells.join(source, [*keys, *[f"j{k}" for k in axes]], "left")
    many = str(data.schema["v"].dataType.typeName()) == "array"
    if many:
        rows = rows.join(F.broadcast(data.agg(F.max(F.size("v")).alias("_size"))))  # one row
    blank = F.array_repeat(F.lit(fill), F.col("_size")) if many else F.lit(fill)
    return rows.select(*keys, "tile_id", *[f"i{k}" for k in axes], F.coalesce("v", blank).alias("v"))


def merge_nd(
    tiles: DataFrame, shape: tuple[int, ...], tile: tuple[int, ...], overlap=0, windows: tuple[str, ...] | str = "boxcar", keys: tuple[str, ...] = ()
) -> DataFrame:
    """(keys, i0.., [class,] total, weights, visits, mean): tiles (keys, tile_id, i0.., v) laid over each other, without padding.

    A cell's weight is the product of one window's values on each axis. Where ``v`` is an array, one of logits, each
    class is merged by itself. ``mean`` is null where the weights are 0.
    """
    steps, axes = step_sizes(tile, overlap if isinstance(overlap, (float, tuple)) else (overlap,) * len(tile)), range(len(shape))
    windows = (windows,) * len(shape) if isinstance(windows, str) else windows
    plan = tile_plan(tiles.sparkSession, shape, tile, overlap)
    placed = tiles.join(plan.select("tile_id", *[F.col(f"p{k}") for k in axes]), "tile_id")
    weight = F.lit(1.0)
    for k in axes:
        weight = weight * window(windows[k], F.col(f"i{k}"), tile[k], tile[k] - steps[k])
    at = [(F.col(f"p{k}") * steps[k] + F.col(f"i{k}")).cast("int").alias(f"i{k}") for k in axes]
    many = str(tiles.schema["v"].dataType.typeName()) == "array"
    values = [F.posexplode("v").alias("class", "v")] if many else ["v"]
    rows = placed.select(*keys, *at, weight.alias("w"), *values)
    for k in axes:
        rows = rows.where(F.col(f"i{k}") < shape[k])
    out = rows.groupBy(*keys, *[f"i{k}" for k in axes], *(["class"] if many else [])).agg(
        F.sum(F.col("v") * F.col("w")).alias("total"), F.sum("w").alias("weights"), F.count("*").alias("visits")
    )
    return out.withColumn("mean", F.try_divide("total", "weights"))


def merged_classes(merged: DataFrame, places: tuple[str, ...]) -> DataFrame:
    """(places, class, mean): the class with the largest merged logit at each place, the smaller of equal ones."""
    best = F.max_by(F.struct("class", "mean"), F.struct("mean", (-F.col("class")).alias("c")))
    return merged.groupBy(*places).agg(best.alias("b")).select(*places, "b.class", "b.mean")


def window(name: str, i: Column, m: int, overlap: int = 0) -> Column:
    """Value ``i`` of 0 to m - 1 of a symmetric window; 1 for m of 1 or 0. A negative length is an error."""
    if m < 0:
        raise ValueError("a window has no negative length")
    if m <= 1 or name == "boxcar":
        return F.lit(1.0)
    last = m - 1.0
    x = 2.0 * i / last - 1.0  # -1 to 1
    if name == "overlap-tile":
        return F.when((i >= overlap // 2) & (i < m - overlap // 2), 1.0).otherwise(0.0)
    if name in COSINE_SUMS:
        angle = 2 * math.pi * i / last
        return sum((F.lit((-1) ** k * a) * F.cos(angle * k) for k, a in enumerate(COSINE_SUMS[name])), F.lit(0.0))
    if name == "bartlett":
        return 1.0 - F.abs(x)
    if name == "triang":
        return 1.0 - F.abs(i - last / 2) * 2 / (m + 1 if m % 2 else m)
    if name == "parzen":
        d = F.abs(i - last / 2) / (m / 2)
        return F.when(F.abs(i - last / 2) <= (m - 1) / 4, 1 - 6 * d * d + 6 * d * d * d).otherwise(2 * F.pow(1 - d, F.lit(3.0)))
    if name == "bohman":
        d = F.abs(x)
        return F.when((i == 0) | (i == m - 1), 0.0).otherwise((1 - d) * F.cos(math.pi * d) + F.sin(math.pi * d) / math.pi)
    if name == "barthann":
        d = F.abs(i / last - 0.5)
        return 0.62 - 0.48 * d + 0.38 * F.cos(2 * math.pi * d)
    raise ValueError(f"no window {name!r}")


WINDOWS = ("boxcar", "triang", "parzen", "bohman", "bartlett", "barthann", *COSINE_SUMS)


def reassembled(patches: DataFrame, rows: int, side: int) -> DataFrame:
    """``patches`` (box, i) with (r, c): boxes are numbered down the columns of a grid of ``rows``, patches row by row."""
    r = F.pmod("box", F.lit(rows)) * side + F.floor(F.col("i") / side)
    c = F.floor(F.col("box") / rows) * side + F.pmod("i", F.lit(side))
    return patches.withColumns({"r": r.cast("int"), "c": c.cast("int")})


def cropped(cells: DataFrame, height: int, width: int, patch: int, step: int) -> DataFrame:
    """Cells whose patch begins inside a slide of that size."""
    ends = [-(-(n - patch) // step) + 1 for n in (height, width)]
    return cells.where((F.col("r") < ends[0]) & (F.col("c") < ends[1]))


def box_plan(slides: DataFrame, side: int, patch: int, stride: int, factor: float = 1.0) -> DataFrame:
    """(slide, box, x, y, size): boxes of side x side patches that cover slides (slide, width, height).

    Boxes are numbered down the columns; ``size`` is a box's side in pixels, before ``factor``.
    """
    step = int(side * stride * factor)
    along = lambda n: F.greatest(F.ceil(F.col(n) / step), F.lit(1)).cast("int")
    rows = slides.select("slide", along("height").alias("rows"), along("width").alias("cols"))
    rows = rows.withColumn("box", F.explode(F.sequence(F.lit(0), F.col("rows") * F.col("cols") - 1)))
    return rows.select(
        "slide", "box", (F.floor(F.col("box") / F.col("rows")) * step).cast("int").alias("x"), (F.pmod("box", "rows") * step).cast("int").alias("y"),
        F.lit(side * stride + patch - stride).alias("size"),
    )
