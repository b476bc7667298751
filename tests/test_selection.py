"""Partners by selection mode, on a small grid against brute force."""

import math

import numpy as np

from gridloom.operators.ranking import sample_with
from gridloom.operators.selection import far_pairs, selection_study
from gridloom.registry import QUERIES


def _cells(spark, n=5):
    rows = [(0, i // n, i % n, i, [float(i % 3 + 1), float(i % 7), 1.0], float((i * 7) % 11)) for i in range(n * n)]
    return spark.createDataFrame([*rows, (1, 0, 0, 100, [1.0, 0.0, 1.0], 1.0)], "slide int, r int, c int, id long, v array<double>, f double")


def test_far_pairs_are_found_without_a_lucky_draw(spark):
    # only opposite corners are that far apart, so that one draw of 1,250 or so meets them
    got = far_pairs(_cells(spark), "id", 20, 5.6, 1, 3).collect()
    assert len(got) == 20 and {(r.a, r.b) for r in got} <= {(0, 24), (24, 0), (4, 20), (20, 4)}
    assert {r.slide for r in got} == {0}  # a slide of one cell has no pair


def test_selection_study_against_brute_force(spark):
    cells = _cells(spark)
    drawn = {r.pair: (r.a, r.b) for r in far_pairs(cells, "id", 6, 2, 16, 41).collect()}
    got = selection_study(cells, "id", "v", ["f"], pairs=6, least=2, reference=9).collect()
    by = {(r.pair, r.mode, r.metric): r.percent for r in got}
    assert len(by) == len(got) == 6 * 3 * 2 and all(0 <= p <= 100 for p in by.values())
    values = {r.id: r for r in cells.where("slide = 0").collect()}
    gap = lambda a, b: abs(values[a].f - values[b].f)
    for pair, (a, b) in drawn.items():
        nearest = min((i for i in values if i != a), key=lambda i: (gap(a, i), i))
        # a partner that is no farther has no larger share
        assert (by[pair, "f", "f"] <= by[pair, "random", "f"]) and (gap(a, nearest) <= gap(a, b))
    assert selection_study(cells.limit(0), "id", "v", ["f"]).count() == 0


def test_a_cell_without_a_feature_is_no_partner_by_it(spark):
    rows = [(0, 0, 0, 1, [1.0, 0.0], 1.0), (0, 4, 4, 2, [1.0, 1.0], None), (0, 8, 8, 3, None, 3.0)]
    cells = spark.createDataFrame(rows, "slide int, r int, c int, id long, v array<double>, f double")
    got = selection_study(cells, "id", "v", ["f"], pairs=4, least=2, reference=20).collect()
    assert {r.mode for r in got} <= {"random", "vector", "f"} and any(r.percent is None for r in got)


def test_nearest_off_both_axes_computes_a_pair_once(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(0, 260, 3)]
    rows[5] = (15, rows[9][1])  # equal vectors, whose tie goes to the smaller id
    rows += [(0, [1.0, 2.0, 3.0, 4.0]), (44, None), (144, [0.0] * 4), (146, [1.0, None, 2.0, 0.5]), (None, [1.0] * 4), (188, [2.0, 1.0])]
    cells = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int")
    cells.write.parquet(f"{tmp_path}/embeddings.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = QUERIES["nearest_off_both_axes"](spark, str(tmp_path))
        got = {r.vec_id: r.other for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    best = {}
    for i, v in rows:
        for j, w in rows:
            if i is None or j is None or i // 100 != j // 100:
                continue
            dr, dc = i % 100 // 10 - j % 100 // 10, i % 10 - j % 10
            if not dr or not dc or dr * dr + dc * dc <= 9:
                continue
            d = None
            if v is not None and w is not None:
                v32, w32 = ([None if x is None else float(np.float32(x)) for x in u] for u in (v, w))
                dot = lambda a, b: sum(x * y for x, y in zip(a, b) if x is not None and y is not None)  # noqa: E731, B905
                size = math.sqrt(dot(v32, v32)) * math.sqrt(dot(w32, w32))
                d = round(1 - dot(v32, w32) / size, 12) if size else None
            best.setdefault(i, []).append((d is not None, d or 0.0, j))  # a pair without a distance comes first
    assert got == {i: min(x)[2] for i, x in best.items()}
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") == 1  # one side is shuffled for both
    assert not any("zip_with" in line for line in plan.splitlines() if "Aggregate" in line)  # vectors end before pairs are sorted


def test_selection_study_sums_one_product_of_vectors_a_pair(spark):
    rng = np.random.default_rng(4)
    rows = [(s, i // 4, i % 4, 100 * s + i, rng.normal(size=3).tolist(), float(rng.integers(5))) for s in (0, 1) for i in range(16)]
    rows += [(0, 1, 1, 5, [0.5, 1.0, 2.0], 9.0), (0, 5, 5, 50, None, 1.0), (0, 6, 6, 51, [0.0] * 3, None), (0, 7, 7, None, [1.0] * 3, 2.0), (None, 0, 0, 7, [1.0] * 3, 2.0)]
    cells = spark.createDataFrame(rows, "slide int, r int, c int, id long, v array<double>, f double")
    out = selection_study(cells, "id", "v", ["f"], pairs=5, least=2, reference=40)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))

    def gaps(x, o):
        size = math.sqrt(dot(x[4], x[4])) * math.sqrt(dot(o[4], o[4])) if x[4] and o[4] else 0
        return abs(round(1 - dot(x[4], o[4]) / size, 9)) if size else None, abs(round(x[5] - o[5], 6)) if None not in (x[5], o[5]) else None

    of = {}
    for row in rows:
        of.setdefault((row[0], row[3]), []).append(row)  # an id may be that of several rows
    drawn = [(d.slide, d.draw, row) for d in sample_with(cells, ["slide"], "id", 40, 43).collect() if d.id is not None and d.slide is not None for row in of[d.slide, d.id]]
    base = {s: [gaps(x, o) for t, d, x in drawn for u, e, o in drawn if s == t == u and d < e] for s in (0, 1)}
    want = {}
    for p in far_pairs(cells, "id", 5, 2, 16, 41).where("slide IS NOT NULL AND a IS NOT NULL").collect():
        met = [(o, gaps(x, o), x) for x in of[p.slide, p.a] for k, some in of.items() if k[0] == p.slide and k[1] not in (None, p.a) for o in some]
        modes = {"random": [((0.0, o[3], *map(_first, g)), g) for o, g, _ in met if o[3] == p.b]}
        apart = lambda x, o: x[1] != o[1] and x[2] != o[2] and (x[1] - o[1]) ** 2 + (x[2] - o[2]) ** 2 > 4
        modes["vector"] = [((g[0], o[3], *map(_first, g)), g) for o, g, x in met if g[0] is not None and apart(x, o)]
        modes["f"] = [((g[1], o[3], *map(_first, g)), g) for o, g, _ in met if g[1] is not None]
        for mode, found in modes.items():
            for k, metric in enumerate(("vector", "f") if found else ()):
                v, all_ = min(found)[1][k], [b[k] for b in base[p.slide] if b[k] is not None]
                want[p.slide, p.pair, mode, metric] = None if v is None else round(100 * sum(b < v for b in all_) / len(all_), 9)
    assert want and {(r.slide, r.pair, r["mode"], r.metric): r.percent if r.percent is None else round(r.percent, 9) for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert max(line.count("zip_with") for line in plan) == 1  # lengths are summed for each cell, not for each pair


def _first(v):
    """A key by which null values come first."""
    return v is not None, v or 0.0
