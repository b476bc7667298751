"""Block-wise slides, inference over their patches, slides that arrive in parts, regions with holes, patch centres."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import grid, sampling, tiling
from gridloom.sources import slides
from gridloom.streaming import arriving_slides, incremental_scores


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    where, rng = tmp_path_factory.mktemp("slides"), np.random.default_rng(1)
    made = {"a": rng.integers(0, 256, (57, 83, 3)), "b": rng.integers(200, 256, (20, 31, 3)), "tiny": rng.integers(0, 256, (5, 4, 3))}
    for name, m in made.items():
        np.save(where / f"{name}.npy", m.astype(np.uint8))
    return [str(where / f"{n}.npy") for n in made], made


def test_blocks_are_partitions_and_filters_choose_them(spark, files):
    paths, made = files
    df = slides.blocks(spark, paths, 20)
    rows = df.collect()
    assert df.rdd.getNumPartitions() == len(rows) == 3 * 5 + 1 * 2 + 1
    for r in rows:
        m = made[r["slide"]][r["y"] : r["y"] + 20, r["x"] : r["x"] + 20]
        assert np.array_equal(np.frombuffer(r["pixels"], np.uint8).reshape(r["height"], r["width"], r["channels"]), m)
        assert (r["y"], r["x"]) == (r["box"] % r["rows"] * 20, r["box"] // r["rows"] * 20)
    one = df.where("slide = 'a' AND box IN (3, 4, 99)")
    assert one.rdd.getNumPartitions() == 2 and sorted(r["box"] for r in one.collect()) == [3, 4]
    assert df.where("slide = 'nobody'").count() == 0
    assert df.where("height < 10").count() == sum(r["height"] < 10 for r in rows)


def test_tissue_pixels(spark, files):
    paths, made = files
    got = slides.tissue_pixels(slides.blocks(spark, paths, 16), 50, seed=3).collect()
    for name, m in made.items():
        mine = [r for r in got if r["slide"] == name]
        assert len(mine) == len({(r["y"], r["x"]) for r in mine}) == min(50, int((m.mean(axis=2) <= 230).sum()))
        assert all(list(m[r["y"], r["x"]]) == r["v"] and np.mean(r["v"]) <= 230 for r in mine)
    again = slides.tissue_pixels(slides.blocks(spark, paths, 40), 50, seed=3).collect()
    assert {tuple(r)[:3] for r in again} == {tuple(r)[:3] for r in got}, "blocks change nothing"


def plain_patches(m, patch, stride, fill):
    rows, cols = (max(0, -(-(n - patch) // stride)) + 1 for n in m.shape[:2])
    out = {}
    for r in range(rows):
        for c in range(cols):
            p = np.full((patch, patch, m.shape[2]), fill, float)
            part = m[r * stride : r * stride + patch, c * stride : c * stride + patch]
            p[: part.shape[0], : part.shape[1]] = part
            out[r, c] = (p.mean(), p.max(axis=(0, 1))[0])
    return out


@pytest.mark.parametrize("side,patch,stride", [(3, 8, 4), (2, 9, 5), (4, 6, 6)])
def test_inference_over_slides(spark, files, side, patch, stride):
    paths, made = files
    model = lambda: lambda m: np.column_stack([m.mean(axis=(1, 2, 3)), m[..., 0].max(axis=(1, 2))])
    got = slides.tessellated_slides(spark, paths, model, side, patch, stride, fill=7, batch=5).collect()
    for name, m in made.items():
        want = plain_patches(m, patch, stride, 7)
        mine = {(r["r"], r["c"]): r["profile"] for r in got if r["slide"] == name}
        assert set(mine) == set(want)
        assert all(mine[k] == pytest.approx(want[k], rel=1e-5) for k in want)


def test_slides_in_three_batches_and_a_restart(spark, tmp_path):
    rng = np.random.default_rng(2)
    cells = {s: [(s, r, c, int(rng.integers(0, 3)), rng.normal(size=4).tolist(), 30) for r in range(5) for c in range(6)] for s in ("x", "y")}
    source, target, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    put = lambda rows: spark.createDataFrame(rows, arriving_slides.PARTS).coalesce(1).write.mode("append").parquet(source)
    run = lambda wait=3_600_000: arriving_slides.run(spark, source, target, state, wait, files=1)
    put(cells["x"][:10])
    put(cells["x"][5:20] + cells["y"][:12])  # cells that arrive again count once
    run()
    assert spark.read.parquet(target).count() == 0
    put(cells["x"][20:])
    put([(None, 1, 1, 1, [0.0] * 4, 1), ("y", None, 1, 1, [0.0] * 4, 30)])
    run(1)  # a new query, from the checkpoint
    want = {r["slide"]: r["score"] for r in incremental_scores.heterogeneity(spark.createDataFrame(cells["x"], arriving_slides.PARTS)).collect()}
    got = spark.read.parquet(target).collect()
    assert [(r["slide"], r["complete"]) for r in got] == [("x", True)] and got[0]["score"] == pytest.approx(want["x"])
    put(cells["y"][12:14])
    run(1)
    time.sleep(1)
    put(cells["x"][:1])
    run(1)  # y has waited too long
    got = {r["slide"]: r for r in spark.read.parquet(target).collect()}
    assert set(got) == {"x", "y"} and not got["y"]["complete"]
    part = incremental_scores.heterogeneity(spark.createDataFrame(cells["y"][:14], arriving_slides.PARTS)).first()["score"]
    assert got["y"]["score"] == pytest.approx(part)


def test_regions_with_holes_and_negatives(spark):
    square = lambda a, b: ([a, b, b, a], [a, a, b, b])
    rings = [(0, 1, 5, "+", *square(0.0, 10.0)), (0, 1, 5, "+", *square(3.0, 6.0)), (0, 2, 6, "+", *square(4.0, 5.0)), (0, 0, 9, "-", *square(8.0, 20.0))]
    rings += [(0, 3, 7, None, *square(30.0, 31.0)), (0, 4, 7, "+", None, None), (0, 5, 7, "+", [1.0], [1.0]), (0, 6, 7, "+", [0.0, 50.0], [3.0, 3.0])]
    df = spark.createDataFrame(rings, "slide int, region_ix int, label int, sign string, xs array<double>, ys array<double>")
    got = {(r["r"], r["c"]): r["label"] for r in grid.rasterise(df).collect()}
    want = {(r, c): 5 for r in range(10) for c in range(10) if not (3 <= r < 6 and 3 <= c < 6) and not (r >= 8 and c >= 8)}
    assert got == want | {(4, 4): 6, (30, 30): 7}
    assert grid.rasterise(df.limit(0)).count() == 0


def test_patch_centres_stay_in_their_region(spark):
    rows = [("big", r, c) for r in range(40) for c in range(30)] + [("small", 1, 1), (None, 1, 1), ("big", None, 2), ("big", 3, 3)]
    cells = spark.createDataFrame(rows, "region string, r int, c int")
    got = sampling.patch_centres(cells, ["region"], 4, 100, 0.2, scale=10, seed=5).collect()
    assert len(got) == min(100, int(1200 * 1.2 / 16)) == 90
    assert {r["region"] for r in got} == {"big"} and sorted(r["pick"] for r in got) == list(range(90))
    assert all(-5 <= r["y"] <= 390 and -5 <= r["x"] <= 290 for r in got) and len({(r["y"], r["x"]) for r in got}) > 60
    assert len(sampling.patch_centres(cells, ["region"], 4, 7, 0.2).collect()) == 7
    inner = sampling.inner_cells(cells, 40, 30, 4)
    assert {r["r"] for r in inner.collect()} == set(range(2, 38))


def test_slide_tiles_match_the_plan_of_one_shape(spark):
    sizes = spark.createDataFrame([("a", 25, 30), ("b", 3, 100), ("none", 0, 5), ("null", None, 5)], "slide string, h int, w int")
    got = tiling.slide_tiles(sizes, ["slide"], ("h", "w"), (8, 12), (2, 3), batch=5)
    for slide, shape in (("a", (25, 30)), ("b", (3, 100))):
        want = sorted(map(tuple, tiling.tile_plan(spark, shape, (8, 12), (2, 3), mode="reflect", batch=5).collect()))
        assert sorted(tuple(r)[1:] for r in got.where(F.col("slide") == slide).collect()) == want
    assert {r["slide"] for r in got.collect()} == {"a", "b"}
    few = tiling.slide_tiles(sizes, ["slide"], ("h", "w"), (8, 12), (2, 3), batch=5, drop_last=True)
    assert few.groupBy("slide", "batch").count().where("count <> 5").count() == 0


def test_tiles_of_a_large_slide_are_dealt_in_runs(spark, monkeypatch):
    monkeypatch.setattr(tiling, "RUN", 7)
    sizes = spark.createDataFrame([("a", 250, 300)], "slide string, h int, w int")
    for last in (False, True):
        got = tiling.slide_tiles(sizes, ["slide"], ("h", "w"), (8, 12), (2, 3), batch=10, drop_last=last)
        want = tiling.tile_plan(spark, (250, 300), (8, 12), (2, 3), mode="reflect", batch=10, drop_last=last)
        assert sorted(tuple(r)[1:] for r in got.collect()) == sorted(map(tuple, want.collect()))
    tasks = {r["p"] for r in got.select(F.spark_partition_id().alias("p")).distinct().collect()}
    assert len(tasks) > 4


def test_equal_regions_are_drawn_once(spark):
    square = ([0.0, 3.0, 3.0, 0.0], [0.0, 0.0, 3.0, 3.0])
    rings = [(0, i, 5, "+", *square) for i in range(200)] + [(0, 300, 6, "+", [1.0, 2.0, 2.0, 1.0], [1.0, 1.0, 2.0, 2.0]), (0, 250, 7, "+", *square), (1, 3, 5, "-", *square)]
    out = grid.rasterise(spark.createDataFrame(rings, "slide int, region_ix int, label int, sign string, xs array<double>, ys array<double>"))
    assert {(r["r"], r["c"]): r["label"] for r in out.collect()} == {(r, c): 6 if r == c == 1 else 7 for r in range(3) for c in range(3)}
    assert "rings" in out._jdf.queryExecution().optimizedPlan().toString()
