"""Slides as tables of blocks, read lazily, and models run over their patches as one plan."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from importlib import import_module
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from gridloom.operators.ranking import sample_without
from gridloom.sources.hooks import predict

BLOCK_SCHEMA = "slide string, box int, x int, y int, height int, width int, channels int, rows int, cols int, pixels binary"


class ArraySlide:
    """The default decoder: a NumPy file (height, width, channels) of bytes, of which only what is asked for is read."""

    def __init__(self, path: str):
        self.pixels = np.load(path, mmap_mode="r", allow_pickle=False)
        self.size = self.pixels.shape[:2]
        self.channels = self.pixels.shape[2] if self.pixels.ndim == 3 else 1

    def read(self, y: int, x: int, height: int, width: int) -> np.ndarray:
        return np.asarray(self.pixels[y : y + height, x : x + width], np.uint8)


@dataclass
class Block(InputPartition):
    path: str
    slide: str
    box: int
    y: int
    x: int
    rows: int
    cols: int


class SlideReader(DataSourceReader):
    """A partition a block; filters on ``slide`` and ``box`` choose blocks before any is read."""

    def __init__(self, options: dict):
        self.paths = [p for p in options["paths"].split("\n") if p]
        self.step, self.size = int(options["step"]), int(options["size"])
        module, _, name = options["decoder"].partition(":")
        self.open = getattr(import_module(module), name)
        self.only: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or f.attribute not in (("slide",), ("box",)):
                yield f
            else:
                self.only[f.attribute[0]] = self.only.get(f.attribute[0], values) & values

    def partitions(self) -> list[Block]:
        out = []
        for path in self.paths:
            slide = PurePosixPath(path).name.split(".")[0]
            if slide not in self.only.get("slide", {slide}):
                continue
            height, width = self.open(path).size  # of the header
            rows, cols = max(1, math.ceil(height / self.step)), max(1, math.ceil(width / self.step))
            boxes = self.only.get("box", range(rows * cols))
            out += [Block(path, slide, b, b % rows * self.step, b // rows * self.step, rows, cols) for b in sorted(boxes) if 0 <= b < rows * cols]
        return out or [Block("", "", 0, 0, 0, 0, 0)]

    def read(self, block: Block) -> Iterator[tuple]:
        if not block.path:
            return
        slide = self.open(block.path)
        height, width = slide.size
        h, w = max(0, min(self.size, height - block.y)), max(0, min(self.size, width - block.x))
        pixels = np.ascontiguousarray(slide.read(block.y, block.x, h, w), np.uint8)
        yield block.slide, block.box, block.x, block.y, h, w, slide.channels, block.rows, block.cols, pixels.tobytes()


class SlideBlocks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gridloom_slides"

    def schema(self) -> str:
        return BLOCK_SCHEMA

    def reader(self, schema) -> SlideReader:
        return SlideReader(self.options)


def blocks(spark: SparkSession, paths: list[str], step: int, size: int | None = None, decoder: str = "gridloom.sources.slides:ArraySlide") -> DataFrame:
    """Blocks of slides, BLOCK_SCHEMA: ``size`` pixels a side (``step`` by default), every ``step``, numbered down the columns; edges are cut.

    A block is a partition and is decoded when its task runs. ``decoder`` is "module:name" of what opens a path: it has ``size``
    (height, width), ``channels`` and ``read(y, x, height, width)`` to bytes. Filters on slide and box choose partitions.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SlideBlocks)
    options = {"paths": "\n".join(paths), "step": str(step), "size": str(size or step), "decoder": decoder}
    return spark.read.format("gridloom_slides").options(**options).load()


def pixels(blocks_: DataFrame) -> DataFrame:
    """(slide, y, x, v): every pixel of blocks that don't overlap, ``v`` its channels."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for b in frame.itertuples():
                m = np.frombuffer(b.pixels, np.uint8).reshape(b.height, b.width, b.channels)
                for i in range(b.height):  # a row of pixels at a time
                    yield pd.DataFrame({"slide": b.slide, "y": b.y + i, "x": b.x + np.arange(b.width), "v": list(m[i].astype(np.int32))})

    return blocks_.mapInPandas(run, "slide string, y int, x int, v array<int>")


def tissue_pixels(blocks_: DataFrame, n: int, seed: int = 0, least: float = 230) -> DataFrame:
    """(slide, y, x, v) of ``n`` pixels of each slide that aren't near-white, drawn by hash; a slide with fewer gives all."""
    tissue = pixels(blocks_).where(F.aggregate("v", F.lit(0), lambda a, x: a + x) / F.size("v") <= least)
    place = tissue.withColumn("id", F.concat_ws(",", "slide", "y", "x"))
    return sample_without(place, ["slide"], "id", n, seed).drop("id")


def tessellated_slides(
    spark: SparkSession,
    paths: list[str],
    make_predict: Callable[[], Callable[[np.ndarray], np.ndarray]],
    side: int = 24,
    patch: int = 224,
    stride: int = 100,
    decoder: str = "gridloom.sources.slides:ArraySlide",
    fill: int = 255,
    batch: int = 16,
) -> DataFrame:
    """(slide, r, c, profile): a model over every patch of slides, in one lazy frame.

    A block holds ``side`` x ``side`` patches and is read, cut, predicted and placed by one task; cells whose patch begins outside the
    slide are cropped, and patches that reach over its edge are filled. ``make_predict`` makes a function of (n, patch, patch, channels).
    """
    held = blocks(spark, paths, side * stride, side * stride + patch - stride, decoder)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_predict()
        for frame in frames:
            for b in frame.itertuples():
                m = np.frombuffer(b.pixels, np.uint8).reshape(b.height, b.width, b.channels)
                full = side * stride + patch - stride
                m = np.pad(m, ((0, full - b.height), (0, full - b.width), (0, 0)), constant_values=fill)
                rows = range(_patches(b.height, full, side, patch, stride, b.y == 0))
                cols = range(_patches(b.width, full, side, patch, stride, b.x == 0))
                places = [(i, j) for i in rows for j in cols]
                for at in range(0, len(places), batch):
                    part = places[at : at + batch]
                    got = np.asarray(model(np.stack([m[i * stride : i * stride + patch, j * stride : j * stride + patch] for i, j in part])), np.float32)
                    r, c = b.box % b.rows * side, b.box // b.rows * side
                    yield pd.DataFrame({"slide": b.slide, "r": [r + i for i, _ in part], "c": [c + j for _, j in part], "profile": list(got)})

    return held.mapInPandas(run, "slide string, r int, c int, profile array<float>")


def _patches(length: int, full: int, side: int, patch: int, stride: int, first: bool) -> int:
    """How many of a block's patches are the slide's, which has as many as reach its end, and one at least.

    A block that isn't ``full`` is as long as the slide from there on.
    """
    return side if length == full else max(int(first), math.ceil((length - patch) / stride) + 1)


def tessellated_pixels(
    pixels_: DataFrame,
    slides: DataFrame,
    patch: int,
    stride: int,
    make_predict: Callable[[], Callable[[np.ndarray], np.ndarray]],
    fill: float = 0.0,
    batch: int = 16,
) -> DataFrame:
    """(slide, r, c, profile): a model over every patch of slides (slide, height, width) whose pixels (slide, y, x, v) are a table.

    The plan of patches, the pixels of each, the prediction and the crop are one lazy frame. A patch is its numbers row by
    row, ``fill`` where there is no pixel; patches without any pixel have no row. Pixels that are repeated count by their largest value.
    """

    def covering(at: str, length: str):
        last = F.greatest(F.ceil((F.col(length) - patch) / stride), F.lit(0))
        first = F.greatest(F.ceil((F.col(at) - patch + 1) / stride), F.lit(0))
        return first.cast("int"), F.least(F.floor(F.col(at) / stride), last).cast("int")

    (r0, r1), (c0, c1) = covering("y", "height"), covering("x", "width")
    inside = pixels_.join(slides, "slide").where((F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") < F.col("height")) & (F.col("x") < F.col("width")))
    placed = inside.where((r0 <= r1) & (c0 <= c1)).withColumn("r", F.explode(F.sequence(r0, r1))).withColumn("c", F.explode(F.sequence(c0, c1)))
    place = ((F.col("y") - F.col("r") * stride) * patch + F.col("x") - F.col("c") * stride).cast("int").alias("i")
    cells = placed.groupBy("slide", "r", "c", place).agg(F.max("v").cast("double").alias("v")).groupBy("slide", "r", "c")
    held = cells.agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("m"))
    numbers = F.transform(F.sequence(F.lit(0), F.lit(patch * patch - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(float(fill))))
    return predict(held.select("slide", "r", "c", numbers.alias("patch")), "patch", make_predict, "profile", batch)
