"""Operators against NumPy, invariants and edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import scalars
from gridloom.functions.vectors import cosine_distance
from gridloom.operators import grid, objects, ranking, relational, spatial, stats, tiling, vectors
from gridloom.sources import incremental, readers


def test_nearest_against_numpy_over_many_cells(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(120, 6))
    m[7] = m[3]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)] + [(900, None), (901, [0.0] * 6)], "vec_id long, embedding array<double>")
    got = {(r["query"], r["rank"]): r["neighbour"] for r in vectors.nearest(df, 4, rows=25).collect()}
    u = m / np.linalg.norm(m, axis=1)[:, None]
    for i in range(120):
        d = np.round(1 - u @ u[i], 12)
        d[i] = np.inf
        assert [got[i, r] for r in (1, 2, 3, 4)] == np.argsort(d, kind="stable")[:4].tolist()


def test_medoid_is_a_member_and_distance_is_symmetric(spark):
    df = spark.createDataFrame([(1, 1, [0.0, 0.0]), (1, 2, [1.0, 0.0]), (1, 3, [9.0, 0.0]), (2, 4, [5.0, 5.0])], "g int, id int, v array<double>")
    got = {r["g"]: (r["medoid"], r["n"]) for r in vectors.medoids(df, ["g"], "id", "v").collect()}
    assert got == {1: (2, 3), 2: (4, 1)}
    a, b = F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(-1.0))
    zero = F.array(F.lit(0.0), F.lit(0.0))
    row = spark.range(1).select(cosine_distance(a, b), cosine_distance(b, a), cosine_distance(a, zero)).first()
    assert row[0] == row[1] and row[2] is None


def test_group_scores_stay_between_the_extremes(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 3.0), ("c", 5.0), ("c", 5.0)], "g string, x double")
    got = {r["g"]: r["score"] for r in vectors.group_scores(df, ["g"], F.col("x")).collect()}
    w = np.exp((np.array([1, 2, 4]) - 1) / 3)
    assert got["a"] == pytest.approx((w * [1, 2, 4]).sum() / w.sum()) and got["b"] == 3.0 and got["c"] == 5.0


def test_midranks_with_ties_over_partitions(spark):
    x = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5]
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    got = sorted((r["v"], r["midrank"]) for r in stats.with_midranks(df, "v").collect())
    s = sorted(x)
    assert got == [(float(v), np.mean([i + 1 for i, w in enumerate(s) if w == v])) for v in s]


def test_nearest_value_over_partitions(spark):
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=80), 2)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)] + [(500, None)], "id long, v double")
    for r in relational.nearest_value(df, "id", "v").collect():
        gap = np.abs(v - v[r["id"]])
        gap[r["id"]] = np.inf
        assert r["gap"] == pytest.approx(gap.min()) and gap[r["nearest"]] == pytest.approx(gap.min())
    assert relational.nearest_value(df.limit(0), "id", "v").count() == 0


@pytest.mark.parametrize(("tile", "overlap"), [(10, 0), (12, 0), (10, 5), (10, 0.5)])
def test_cut_and_merge_gives_the_input_back(spark, tile, overlap):
    data = spark.createDataFrame([(i, float(i * i)) for i in range(100)], "i int, v double")
    out = tiling.merge(tiling.cut(data, 100, tile, overlap), 100, tile, overlap).orderBy("i").collect()
    assert [r["mean"] for r in out] == pytest.approx([float(i * i) for i in range(100)])
    if overlap:
        assert {r["visits"] for r in out} == {1, 2}


def test_tile_plans(spark):
    plan = lambda *a, **k: tiling.tile_plan(spark, *a, **k)
    assert plan((100,), (10,), 5).count() == plan((100,), (10,), 0.5).count() == 19
    assert plan((1, 63), (1, 64), mode="drop").count() == 0 and plan((1, 63), (1, 64)).count() == 1
    assert [r["pad0"] for r in plan((100,), (15,)).orderBy("tile_id").collect()][-1] == 5
    assert plan((100,), (15,), mode="irregular").agg(F.max("e0")).first()[0] == 100
    for bad in (((-1,), (2,)), ((10,), (2, 2)), ((0,), (1,))):
        with pytest.raises(ValueError):
            plan(*bad)
    for overlap in (10, 1337.0, "x", (1, 2)):
        with pytest.raises(ValueError):
            plan((100,), (10,), overlap)
    with pytest.raises(ValueError):
        plan((10,), (2,), mode="mirror")


def test_tile_channels_and_batches(spark):
    plan = lambda *a, **k: tiling.tile_plan(spark, *a, **k)
    last = plan((3, 100), (3, 10), channel=0).orderBy("tile_id").collect()[-1]
    assert (last["p1"], last["s1"], last["e1"], last["s0"], last["e0"]) == (9, 90, 100, 0, 3)
    assert plan((3, 100), (3, 4), 2, channel=0).count() == 49
    assert plan((100,), (10,), batch=9).count() == 10 and plan((100,), (10,), batch=9, drop_last=True).count() == 9
    for bad in ({"channel": 10}, {"channel": 1}, {"batch": -1}):
        with pytest.raises(ValueError):
            plan((3, 100), (3, 10), **bad)
    with pytest.raises(ValueError):
        tiling.window("hann", F.lit(0), -1)


def test_cut_and_merge_in_two_axes(spark):
    rng = np.random.default_rng(4)
    m = rng.random((7, 9))
    data = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(7) for j in range(9)], "i0 int, i1 int, v double")
    for mode in ("constant", "reflect", "edge", "wrap"):
        tiles = tiling.cut_nd(data, (7, 9), (4, 4), (1, 2), mode, fill=-1.0)
        wide = np.pad(m, ((0, 3), (0, 1)), mode if mode != "constant" else "constant", **({"constant_values": -1.0} if mode == "constant" else {}))
        for r in tiles.collect():
            a, b = divmod(r["tile_id"], 4)
            assert r["v"] == wide[a * 3 + r["i0"], b * 2 + r["i1"]]
        out = tiling.merge_nd(tiles, (7, 9), (4, 4), (1, 2), "triang").collect()
        assert len(out) == 63 and all(r["mean"] == pytest.approx(m[r["i0"], r["i1"]]) for r in out)


def test_reflect_edge_wrap(spark):
    i = F.col("id").cast("int")
    at = lambda mode: [r[0] for r in spark.range(8).select(tiling.source_index(i, 5, mode)).collect()]
    assert at("reflect") == [0, 1, 2, 3, 4, 3, 2, 1]
    assert at("edge") == [0, 1, 2, 3, 4, 4, 4, 4]
    assert at("wrap") == [0, 1, 2, 3, 4, 0, 1, 2]
    assert at("constant") == [0, 1, 2, 3, 4, None, None, None]


@pytest.mark.parametrize("name", tiling.WINDOWS)
@pytest.mark.parametrize("m", [1, 6, 7])
def test_windows_are_symmetric(spark, name, m):
    i = F.col("id").cast("int")
    w = [r[0] for r in spark.range(m).select(tiling.window(name, i, m)).collect()]
    assert w == pytest.approx(w[::-1], abs=1e-9) and max(w) <= 1 + 1e-8
    if m == 1:
        assert w == [1.0]


def test_triangle_and_overlap_windows(spark):
    i = F.col("id").cast("int")
    w = lambda *a: [r[0] for r in spark.range(a[1]).select(tiling.window(a[0], i, *a[1:])).collect()]
    assert w("triang", 6) == pytest.approx([1 / 6, 3 / 6, 5 / 6, 5 / 6, 3 / 6, 1 / 6])
    assert w("overlap-tile", 10, 5) == [0, 0, 1, 1, 1, 1, 1, 1, 0, 0]
    with pytest.raises(ValueError):
        w("none", 5)


def test_reassembly_is_column_major(spark):
    rows = spark.createDataFrame([(1, 0), (3, 5)], "box long, i long")
    assert [(r["r"], r["c"]) for r in tiling.reassembled(rows, 3, 4).collect()] == [(4, 0), (1, 5)]


def flood(cells, diagonal):
    out, left = {}, dict(cells)
    while left:
        start = min(left)
        kind, todo = left.pop(start), [start]
        while todo:
            r, c = todo.pop()
            out[r, c] = start
            for d in ((0, 1), (1, 0), (0, -1), (-1, 0)) + ((1, 1), (1, -1), (-1, 1), (-1, -1)) * diagonal:
                n = (r + d[0], c + d[1])
                if left.get(n) == kind:
                    del left[n]
                    todo.append(n)
    return out


@pytest.mark.parametrize("diagonal", [True, False])
def test_components_against_flood_fill(spark, diagonal):
    rng = np.random.default_rng(2)
    cells = {(r, c): int(rng.integers(0, 2)) for r in range(15) for c in range(15) if rng.random() < 0.8}
    df = spark.createDataFrame([(0, r, c, v) for (r, c), v in cells.items()], "slide int, r int, c int, label int")
    want = flood(cells, diagonal)
    for x in grid.components(df, diagonal).collect():
        assert x["component"] == want[x["r"], x["c"]][0] * 2**32 + want[x["r"], x["c"]][1]


def test_split_control_swaps_sides_half_a_turn_on(spark):
    df = spark.createDataFrame([(0, 1, r, c) for r in range(4) for c in range(5)], "slide int, component int, r int, c int")
    got = {(x["angle"], x["r"], x["c"]): x["side"] for x in grid.split_control(df, 8).collect()}
    for r in range(4):
        for c in range(5):
            if (r - 1.5) != 0 and (c - 2) != 0:
                assert got[45, r, c] != got[225, r, c]


def test_contiguity_control_claims_the_areas(spark):
    cells = spark.createDataFrame([(0, r, c) for r in range(6) for c in range(6)], "slide int, r int, c int")
    sizes = spark.createDataFrame([(0, 7), (0, 3)], "slide int, area int")
    got = grid.contiguity_control(cells, sizes, 2)
    assert {(r["run"], r["n"]) for r in got.where("side = 2").groupBy("run").agg(F.count("*").alias("n")).collect()} == {(0, 10), (1, 10)}


def test_ward_clusters_are_connected_and_numbered(spark):
    rows = [(0, r, c, [float(c >= 3) * 9, r * 0.01]) for r in range(5) for c in range(6)]
    df = spark.createDataFrame(rows, "slide int, r int, c int, embedding array<double>")
    got = spatial.constrained_clusters(df, [2, 4], least=30).where("k = 2").collect()
    assert {(x["c"] >= 3, x["cluster"]) for x in got} == {(False, 1), (True, 2)}


def test_rasterised_square(spark):
    df = spark.createDataFrame([(0, 1, 5, [1.0, 4.0, 4.0, 1.0], [1.0, 1.0, 3.0, 3.0]), (0, 2, 6, [2.0, 3.0, 3.0, 2.0], [1.0, 1.0, 2.0, 2.0])], "slide int, region_ix int, label int, xs array<double>, ys array<double>")
    got = {(x["r"], x["c"]): x["label"] for x in grid.rasterise(df).collect()}
    assert got == {(1, 1): 5, (1, 2): 6, (1, 3): 5, (2, 1): 5, (2, 2): 5, (2, 3): 5}


def test_hull_of_a_rectangle(spark):
    df = spark.createDataFrame([(0, 1, r, c) for r in range(3) for c in range(4)], "slide int, label int, r int, c int")
    assert tuple(objects.hull(df).first())[2:] == (12.0, 1.0)


def test_box_counts_against_numpy(spark):
    rng = np.random.default_rng(4)
    places = sorted({(int(s), int(r), int(c)) for s, r, c in zip(rng.integers(0, 2, 60), rng.integers(0, 12, 60), rng.integers(0, 12, 60), strict=True)})
    cells = spark.createDataFrame(places, "slide int, r int, c int")
    for radius in (0, 1, 3):
        want = {}
        for s, r, c in places:
            for i in range(-radius, radius + 1):
                for j in range(-radius, radius + 1):
                    want[s, r + i, c + j] = want.get((s, r + i, c + j), 0) + 1
        got = {(x.slide, x.r, x.c): x.n for x in grid._box_counts(cells, radius).collect()}
        assert got == want
    assert grid.dilate(cells.limit(0), 2).count() == 0


def test_smoothing_of_one_class_leaves_the_others(spark):
    cells = spark.createDataFrame([(0, 0, c, [0.4, 1.0 if c == 1 else 0.0]) for c in range(4)], "slide int, r int, c int, s array<double>")
    got = {x.c: x["class"] for x in grid.smoothed_argmax(cells, "s", [0.25, 0.5, 0.25], only=1).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 0}
    kept = {x.c: x["class"] for x in grid.smoothed_argmax(cells, "s", [1.0], only=1).collect()}
    assert kept == {0: 0, 1: 1, 2: 0, 3: 0}


def test_areas_of_one_cell_claim_nothing(spark):
    cells = spark.createDataFrame([(s, r, 0) for s in (0, 1) for r in range(5)], "slide int, r int, c int")
    sizes = spark.createDataFrame([(0, 1), (1, 1), (1, 3)], "slide int, area long")
    got = grid.contiguity_control(cells, sizes, 2).where("side = 2").groupBy("slide", "run").count().collect()
    assert sorted((x.slide, x.run, x["count"]) for x in got) == [(1, 0, 3), (1, 1, 3)]


def test_p_values_against_closed_forms(spark):
    rows = [(3, n, f) for n in (5, 30, 2000) for f in (0.0, 0.3, 2.5, 9.0)]
    got = stats.f_p(spark.createDataFrame([*rows, (3, 9, None)], "groups long, n long, f double")).collect()
    for x in got:
        if x.f is None:
            assert x.p is None
        else:  # two degrees of freedom have a closed form
            assert x.p == pytest.approx((1 + 2 * x.f / (x.n - 3)) ** (-(x.n - 3) / 2), rel=1e-9)
    one = stats.f_p(spark.createDataFrame([(2, 3, 1.0)], "groups long, n long, f double")).collect()[0]
    assert one.p == pytest.approx(0.5, rel=1e-12)  # Cauchy's upper and lower quarters
    chi = stats.chi2_p(spark.createDataFrame([(3.841458820694124,), (0.0,), (None,)], "chi2 double")).collect()
    assert [x.p if x.p is None else round(x.p, 9) for x in chi] == [0.05, 1.0, None]


def test_region_names_and_loops(spark):
    architecture, grade = scalars.region_class(F.col("s"))
    rows = spark.createDataFrame([("+solid-b-3",), ("+null",), ("+solid",), ("+a-x",), (None,)], "s string").select(architecture, grade).collect()
    assert [tuple(x) for x in rows] == [("solid-b", 3), (None, None), (None, None), ("a", None), (None, None)]
    loops = [([0.0, 1.0, 1.0, 0.0], [0.0, 0.0, 1.0, 0.0]), ([0.0, 4.0, 4.0, 0.0], [0.0, 0.0, 4.0, 4.0]), ([], []), (None, None)]
    loops.append(([0.0, 1.0, 0.0, 0.0, 3.0, 3.0, 0.0], [0.0, 0.0, 0.0, 5.0, 5.0, 8.0, 5.0]))
    rows = spark.createDataFrame(loops, "xs array<double>, ys array<double>").select(scalars.largest_loop(F.col("xs"), F.col("ys")).alias("l"))
    got = rows.select("l.*").collect()
    assert (got[-1].xs, got[-1].ys) == ([0.0, 3.0, 3.0, 0.0], [5.0, 5.0, 8.0, 5.0])
    assert [(g.xs, g.ys) for g in got[:-1]] == [([0.0, 1.0, 1.0, 0.0], [0.0, 0.0, 1.0, 0.0]), ([0.0, 4.0, 4.0, 0.0], [0.0, 0.0, 4.0, 4.0]), ([], []), (None, None)]


def test_fisher_against_known_values(spark):
    df = spark.createDataFrame([(8, 2, 1, 5), (3, 3, 3, 3)], "a long, b long, c long, d long")
    one, two = stats.fisher_exact(df).collect()
    assert one["p_two"] == pytest.approx(0.03496503, abs=1e-6) and one["p_greater"] == pytest.approx(0.02447552, abs=1e-6) and one["odds"] == 20.0
    assert two["p_two"] == pytest.approx(1.0)


def test_fisher_of_any_size(spark):
    rng = np.random.default_rng(8)
    small = [tuple(int(v) for v in rng.integers(0, 30, 4)) for _ in range(60)] + [(0, 0, 0, 0), (5, 0, 0, 0), (0, 7, 9, 0), (900, 1100, 1050, 950)]
    rows = [*small, (10**11 + 400_000, 10**11, 10**11, 10**11 + 300_000), (10**9, 10**9, 10**9, 10**9), (10**12, 0, 0, 10**12), (None, 1, 2, 3)]
    got = stats.fisher_exact(spark.createDataFrame(rows, "a long, b long, c long, d long").coalesce(1)).collect()
    for r in got[: len(small)]:
        a, b, c, d = (r[k] for k in "abcd")
        row, col, n = a + b, a + c, a + b + c + d
        ways = {k: math.comb(col, k) * math.comb(n - col, row - k) for k in range(max(0, row + col - n), min(row, col) + 1)}
        total = sum(ways.values())
        assert r["p_two"] == pytest.approx(sum(v for v in ways.values() if v - ways[a] <= ways[a] // 10**7) / total)
        assert r["p_greater"] == pytest.approx(sum(v for k, v in ways.items() if k >= a) / total)
    large, even, far, none = got[len(small) :]
    z = math.log(large["odds"]) / math.sqrt(sum(1 / large[k] for k in "abcd"))
    assert large["p_greater"] == pytest.approx(math.erfc(z / math.sqrt(2)) / 2, rel=1e-3)
    assert even["p_two"] == pytest.approx(1.0) and 0.5 < even["p_greater"] < 0.50002
    assert far["p_two"] == 0.0 and none["p_two"] is None and none["odds"] is None


def test_kaplan_meier_and_concordance(spark):
    df = spark.createDataFrame([(1, True, 3), (2, False, 2), (3, True, 2), (3, True, 1), (5, True, 1)], "t int, e boolean, g int")
    one = stats.kaplan_meier(df.withColumn("k", F.lit(0)), "t", "e", "k").orderBy("t").collect()
    assert [r["survival"] for r in one] == pytest.approx([0.8, 0.8 / 3, 0.0])
    rows, good = df.collect(), [0.0, 0]
    for a in rows:
        for b in rows:
            if a["e"] and b["t"] > a["t"]:
                good[1] += 1
                good[0] += 1.0 if a["g"] > b["g"] else 0.5 * (a["g"] == b["g"])
    c = stats.concordance(df, "t", "e", "g").first()
    assert c["pairs"] == good[1] and c["c_index"] == pytest.approx(good[0] / good[1])


def test_mantel_finds_equal_and_unrelated_distances(spark):
    rng = np.random.default_rng(3)
    x = rng.random((9, 9)).tolist()
    rows = [(0, i, j, x[i][j], x[i][j] * 2 + 1) for i in range(9) for j in range(i + 1, 9)]
    got = stats.mantel(spark.createDataFrame(rows, "s int, a int, b int, x double, y double"), "s", 99).first()
    assert got["r"] == pytest.approx(1.0) and got["p"] == pytest.approx(0.01)


def test_samples_and_folds(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(30)], "g int, id int")
    assert ranking.sample_without(df, ["g"], "id", 4, 1).groupBy("g").count().where("count = 4").count() == 3
    assert ranking.sample_with(df, ["g"], "id", 50, 1).groupBy("g").count().where("count = 50").count() == 3
    halves = ranking.half_split(df, ["g"], "id", 1).groupBy("g").agg(F.count_if("train").alias("n"))
    assert {r["n"] for r in halves.collect()} == {5}
    folds = ranking.group_folds(df.select(F.col("id").alias("s")).where("id < 8"), "s", 3)
    assert [r["fold"] for r in folds.orderBy("s").collect()] == [0, 0, 0, 1, 1, 1, 2, 2]


def test_scalar_functions(spark):
    row = spark.range(1).select(
        scalars.without_suffix(F.lit("svs.svs"), ".svs"), scalars.hex_colour(F.lit(300), F.lit(-4), F.lit(16.9)), scalars.stars(F.lit(0.02)),
        scalars.grade(F.lit("G3")), scalars.grade(F.lit("GX")), scalars.status_number(F.lit("1:PROGRESSION")), scalars.status_number(F.lit("x")),
        scalars.first_preferred(F.array(F.lit("a"), F.lit("b_X2")), "_X2"), scalars.key_prefix(F.lit("a-b-c-d"), 3), scalars.optical_density(F.lit(0)),
    ).first()
    assert tuple(row[:9]) == ("svs", "#ff0010", "*", 3, None, 1, None, 1, "a-b-c") and row[9] == pytest.approx(math.log(255))


def test_append_missing_writes_each_key_once(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert incremental.append_missing(df, path, ["k"]).count() == 2
    more = spark.createDataFrame([(2, "x"), (3, "c")], "k int, v string")
    assert sorted(map(tuple, incremental.append_missing(more, path, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "c")]


def test_readers(spark, tmp_path):
    (tmp_path / "grid.tsv").write_text("\n".join(["# head"] * 6 + ["s1\t10\t20\t5\t6\ttrue", "s2\t1\t2\t3\t4\tfalse"]) + "\n")
    rows = readers.punch_grid(spark, str(tmp_path / "grid.tsv")).orderBy("name").collect()
    assert [(r["name"], r["x"], r["keep"]) for r in rows] == [("s1", 10, True), ("s2", 1, False)]
    (tmp_path / "m.csv").write_text(",p,q\np,0,2\nq,2,0\n")
    assert {(r["a"], r["b"], r["d"]) for r in readers.square_matrix(spark, str(tmp_path / "m.csv")).collect()} == {("p", "p", 0.0), ("p", "q", 2.0), ("q", "p", 2.0), ("q", "q", 0.0)}
    np.save(tmp_path / "a.npy", np.arange(6.0).reshape(1, 2, 3))
    got = readers.dense_grids(spark, str(tmp_path / "*.npy")).orderBy("r", "c").collect()
    assert [(r["slide"], r["r"], r["c"], r["profile"]) for r in got] == [("a", 0, 0, [0.0, 1.0, 2.0]), ("a", 0, 1, [3.0, 4.0, 5.0])]
    (tmp_path / "x.xml").write_text('<Annotations><Annotation><Regions><Region Id="7" Text="+A" NegativeROA="0" Length="4" Area="1" Type="0"><Vertices><Vertex X="1.9" Y="2"/><Vertex X="5" Y="2"/><Vertex X="5" Y="6"/></Vertices></Region><Region Id="8" NegativeROA="1"><Vertices><Vertex X="0" Y="0"/></Vertices></Region></Regions></Annotation></Annotations>')
    r = readers.annotations(spark, str(tmp_path / "x.xml")).orderBy("id").collect()
    assert (r[0]["name"], r[0]["sign"], r[0]["xs"], r[0]["bbox"]) == ("+A", "+", [1, 5, 5], [1, 2, 5, 6]) and r[1]["sign"] == "-"
    (tmp_path / "q.txt").write_text("Tumour [1.0, 2.0, 3.0, 4.0, 5.0, 0.0]\n")
    q = readers.point_lists(spark, str(tmp_path / "q.txt")).first()
    assert (q["name"], q["sign"], q["xs"], q["ys"], q["area"]) == ("Tumour", "+", [1.0, 3.0, 5.0], [2.0, 4.0, 0.0], 16.0)


def test_stream_scores_each_slide_once(spark, tmp_path):
    from gridloom.streaming import incremental_scores

    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rng = np.random.default_rng(4)
    cells = [(f"s{k}", r, c, int(c // 2), rng.normal(size=3).tolist()) for k in range(2) for r in range(4) for c in range(6)]
    df = spark.createDataFrame(cells, "slide string, r int, c int, label int, embedding array<double>")
    for part in ("s0", "s1"):
        df.where(F.col("slide") == part).coalesce(1).write.mode("append").parquet(source)
        incremental_scores.run(spark, source, out, state)
    assert spark.read.parquet(out).groupBy("slide").count().where("count = 1").count() == 2


def test_cox_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, (150, 2)).astype(float)
    t, e = np.ceil(rng.exponential(10 / np.exp(0.5 * x[:, 0]))), rng.random(150) < 0.8
    beta = np.zeros(2)
    for _ in range(30):
        g, h, r = np.zeros(2), np.zeros((2, 2)), np.exp(x @ beta)
        for i in np.flatnonzero(e):
            at = t >= t[i]
            m = (r[at, None] * x[at]).sum(0) / r[at].sum()
            g += x[i] - m
            h += (r[at, None, None] * x[at, :, None] * x[at, None]).sum(0) / r[at].sum() - np.outer(m, m)
        beta += np.linalg.solve(h, g)
    df = spark.createDataFrame([(float(a), bool(b), float(c), float(d)) for a, b, (c, d) in zip(t, e, x)], "k double, d boolean, x double, y double")
    assert list(stats.cox_fit(df, "k", "d", ["x", "y"]).values()) == pytest.approx(beta.tolist(), abs=1e-6)


def test_stains_and_back(spark):
    from gridloom.functions import colour

    r, g, b = F.lit(120.0), F.lit(60.0), F.lit(200.0)
    hed = spark.range(1).select(*colour.rgb_to_hed(r, g, b)).first()
    back = spark.range(1).select(*colour.hed_to_rgb(*map(F.lit, colour.STAINS[0]))).first()
    assert all(v >= 0 for v in hed) and all(0 <= v <= 255 for v in back)
    pure = spark.range(1).select(*colour.hed_to_rgb(F.lit(0.0), F.lit(0.3), F.lit(0.0))).first()
    again = spark.range(1).select(*colour.rgb_to_hed(*map(F.lit, pure))).first()
    assert tuple(again) == pytest.approx((0.0, 0.3, 0.0), abs=1e-6)


def test_predict_hook_and_box_plan(spark):
    from gridloom.sources import hooks

    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)] + [(99, None)], "id int, v array<double>")
    got = hooks.predict(df, "v", lambda: lambda m: m * 2).collect()
    assert {r["id"]: r["profile"] for r in got} == {i: [2.0 * i, 2.0] for i in range(40)} | {99: None}
    slides = spark.createDataFrame([("s", 900, 500)], "slide string, width int, height int")
    plan = tiling.box_plan(slides, 4, 224, 100).orderBy("box").collect()
    assert [(r["box"], r["x"], r["y"], r["size"]) for r in plan[:3]] == [(0, 0, 0, 524), (1, 0, 400, 524), (2, 400, 0, 524)] and len(plan) == 6


def test_merged_logits_only_where_cells_are(spark, tmp_path):
    import __spark_entry__

    rows = [(i, [float(i % k) for k in range(2, 8)], i % 10) for i in range(130)]  # the second slide has 30 of 100 cells
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = __spark_entry__.queries()["tile_merge_logits"](spark, str(tmp_path)).collect()
    assert len(got) == 130 and len({(r["slide"], r["i0"], r["i1"]) for r in got}) == 130


def test_loops_are_folded_without_python(spark):
    rows = spark.createDataFrame([([0.0, 2.0, 2.0, 0.0, 9.0, 9.0, 9.0], [0.0, 0.0, 2.0, 0.0, 1.0, 8.0, 3.0]), (None, [1.0])], "xs array<double>, ys array<double>")
    out = rows.select(scalars.largest_loop(F.col("xs"), F.col("ys")).alias("l"))
    assert [tuple(r.l) for r in out.collect()] == [([0.0, 2.0, 2.0, 0.0], [0.0, 0.0, 2.0, 0.0]), (None, None)]
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
