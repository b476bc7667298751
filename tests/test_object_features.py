"""Texture, skeletons, orientation and overlap of objects, against plain loops over small shapes."""

import itertools
import math

import numpy as np
import pytest

from gridloom.operators import objects, skeleton, texture

SHAPE = "slide int, label int, r int, c int"


def near_of(cells):
    r, c = (np.array(v, dtype=np.int64) for v in zip(*sorted(cells), strict=True))
    return r, c, skeleton.neighbours(r, c)


def linked(cells):
    cells = set(cells)
    seen, todo = set(), [min(cells)]
    while todo:
        y, x = todo.pop()
        if (y, x) not in seen:
            seen.add((y, x))
            todo += [(y + dy, x + dx) for dy, dx in skeleton.AROUND if (y + dy, x + dx) in cells]
    return seen == cells


def diameter(cells):
    cells, most = sorted(cells), 0
    for start in cells:
        steps, level = {start: 0}, [start]
        while level:
            level = [q for y, x in level for q in {(y + dy, x + dx) for dy, dx in skeleton.AROUND} & set(cells) if steps.setdefault(q, steps[y, x] + 1) == steps[y, x] + 1]
            level = list(dict.fromkeys(level)) if len(steps) < len(cells) else []
        most = max(most, *steps.values())
    return most


def holes(cells):
    """Parts of the places around and between the cells that hang together by their sides, less the outer one."""
    ys, xs = zip(*cells, strict=True)
    free = set(itertools.product(range(min(ys) - 1, max(ys) + 2), range(min(xs) - 1, max(xs) + 2))) - set(cells)
    parts = 0
    while free:
        parts += 1
        todo = [free.pop()]
        while todo:
            y, x = todo.pop()
            for q in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if q in free:
                    free.remove(q)
                    todo.append(q)
    return parts - 1


BAR = {(r, c) for r in range(5) for c in range(30)}
CROSS = {(r, c) for r in range(31) for c in range(31) if abs(r - 15) < 3 or abs(c - 15) < 3}
RING = {(r, c) for r in range(31) for c in range(31) if 8 <= math.hypot(r - 15, c - 15) <= 13}
LINE = {(7, c) for c in range(12)}
DOT = {(3, 3)}
BLOB = {(r, c) for r in range(20) for c in range(25) if math.hypot(r - 9, (c - 12) / 1.3) <= 8 or (r - 4) ** 2 + (c - 5) ** 2 < 30}
SQUARE = {(0, 0), (0, 1), (1, 0), (1, 1)}
SHAPES = [BAR, CROSS, RING, LINE, DOT, BLOB, SQUARE]


@pytest.mark.parametrize("cells", SHAPES)
def test_thinning_keeps_the_shape(cells):
    r, c, near = near_of(cells)
    for kept in (skeleton.thinned(near), skeleton.medial(near, skeleton.depth(near, c))):
        left = set(zip(r[kept].tolist(), c[kept].tolist(), strict=True))
        assert left and linked(left) and holes(left) == holes(cells)
        assert len(left) <= max(12, len(cells) / 3)


@pytest.mark.parametrize("cells", SHAPES)
def test_depth_is_the_nearest_place_outside(cells):
    r, c, near = near_of(cells)
    ring = [(y, x) for y in range(-3, 40) for x in range(-3, 40) if (y, x) not in cells]
    want = [min(math.hypot(y - a, x - b) for a, b in ring) for y, x in zip(r, c, strict=True)]
    assert skeleton.depth(near, c) == pytest.approx(want)


def test_depth_of_scattered_pixels():
    rng = np.random.default_rng(4)
    for _ in range(20):
        cells = {(int(y), int(x)) for y, x in rng.integers(0, 14, (rng.integers(1, 180), 2))}
        r, c, near = near_of(cells)
        ring = [(y, x) for y in range(-2, 17) for x in range(-2, 17) if (y, x) not in cells]
        assert skeleton.depth(near, c) == pytest.approx([min(math.hypot(y - a, x - b) for a, b in ring) for y, x in zip(r, c, strict=True)])


def test_extent_equals_all_searches():
    rng = np.random.default_rng(5)
    for k in range(30):
        cells = sorted({(int(y), int(x)) for y, x in rng.integers(0, 12, (rng.integers(1, 90), 2))} if k else RING)
        _, _, near = near_of(cells)
        links = [[q for q in row if q < len(cells)] for row in near.tolist()]
        assert skeleton.extent(links) == max(max(skeleton._steps(*skeleton._reach(links, p)).values()) for p in range(len(cells)))


def test_skeletons_of_shapes(spark):
    turn = [(5, 5 + i) for i in range(6)] + [(5 + i, 10) for i in range(1, 6)]
    shapes = [*SHAPES, set(turn)]
    rows = [(1, i, y, x) for i, cells in enumerate(shapes) for y, x in cells]
    rows += rows[:7] + [(1, None, 1, 1), (None, 1, 1, 1), (1, 9, None, 2)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SHAPE + ", extent string")  # a column of a clashing name
    got = {r["label"]: r for r in skeleton.skeletons(df).collect()}
    assert set(got) == set(range(len(shapes)))
    assert got[0]["max_depth"] == 3 and 24 <= got[0]["extent"] <= 29 and 24 <= got[0]["skeleton_length"] <= 30
    assert got[3]["extent"] == 11 and got[3]["skeleton_length"] == 12 and got[3]["curvature"] == 0 and got[3]["max_depth"] == 1 and got[3]["extent_by_depth"] == 11
    assert (got[4]["extent"], got[4]["skeleton_length"], got[4]["curvature"]) == (0, 1, 0)
    assert 24 <= got[2]["extent"] <= 40  # half way around the ring
    assert 1 / 20 < got[2]["curvature"] < 1 / 5  # a circle's is that of its radius, ten or so
    assert got[7]["curvature"] > 0.05
    assert got == {r["label"]: r for r in skeleton.skeletons(df.repartition(7)).collect()}
    assert skeleton.skeletons(df.limit(0)).count() == 0 and skeleton.skeletons(df).select("extent").count() == len(shapes)


def measures(levels):
    """The thirteen measures of a dict of places and levels, one direction after the other, by dense arrays."""
    levels = {p: v for p, v in levels.items() if v > 0}
    n, out = max(levels.values(), default=0) + 1, []
    for dr, dc in texture.OFFSETS:
        m = np.zeros((n, n))
        for (y, x), v in levels.items():
            if (w := levels.get((y + dr, x + dc))) is not None:
                m[v, w] += 1
                m[w, v] += 1
        if not m.sum():
            return np.zeros(13)
        p = m / m.sum()
        i, j = np.indices(p.shape)
        plus = np.bincount((i + j).ravel(), p.ravel())
        minus = np.bincount(abs(i - j).ravel(), p.ravel())
        edge, k, s = p.sum(0), np.arange(n), np.arange(len(plus))
        bits = lambda q: -(q[q > 0] * np.log2(q[q > 0])).sum()
        var = (edge * k * k).sum() - (edge @ k) ** 2
        both = np.outer(edge, edge)
        one = -(p[p > 0] * np.log2(both[p > 0])).sum()
        out.append([
            (p * p).sum(), ((i - j) ** 2 * p).sum(), 1.0 if var < 1e-12 else ((i * j * p).sum() - (edge @ k) ** 2) / var, var, (p / (1 + (i - j) ** 2)).sum(),
            plus @ s, plus @ s**2 - (plus @ s) ** 2, bits(plus), bits(p), minus.var(), bits(minus),
            (bits(p) - one) / bits(edge) if bits(edge) > 0 else 0, math.sqrt(max(0, 1 - math.exp(-2 * (bits(both) - bits(p))))),
        ])
    return np.mean(out, axis=0)


def test_texture_against_dense_arrays(spark):
    rng = np.random.default_rng(6)
    shapes = {1: {p: int(rng.integers(0, 7)) for p in BLOB}, 2: dict.fromkeys(BAR, 3), 3: dict.fromkeys(LINE, 2), 4: dict.fromkeys(DOT, 0), 5: {p: sum(p) % 5 + 1 for p in RING}}
    rows = [(1, k, *p, v) for k, cells in shapes.items() for p, v in cells.items()]
    rows += [rows[0][:4] + (0,), (1, 1, 2, None, 3), (1, 1, 0, 99, None), (None, 1, 1, 1, 4)]
    df = spark.createDataFrame(rows, SHAPE + ", level int")
    got = {r["label"]: [r[m] for m in texture.MEASURES] for r in texture.texture(df).collect()}
    assert set(got) == set(shapes)
    for k, cells in shapes.items():
        assert got[k] == pytest.approx(measures(cells), abs=1e-9), k
    assert texture.texture(df.limit(0)).count() == 0


def test_grey_levels(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (0.5,), (1.0,), (9.0,), (None,)], "x double")
    assert [r[0] for r in df.select(texture.grey_level(df["x"], 0, 1)).collect()] == [0, 0, 127, 255, 255, None]


def test_orientation_of_bars(spark):
    bars = {0: [(r, 0) for r in range(9)], 1: [(0, c) for c in range(9)], 2: [(i, i) for i in range(9)], 3: [(i, 8 - i) for i in range(9)], 4: [(0, 0)]}
    df = spark.createDataFrame([(1, k, 10**6 + r, 10**6 + c) for k, cells in bars.items() for r, c in cells], SHAPE)
    got = {r["label"]: tuple(r[c] for c in ("y_proj", "x_proj", "atan", "orientation")) for r in objects.orientation(df).collect()}
    half, quarter = math.pi / 2, math.pi / 4
    want = {0: (0, 1, 0, 0), 1: (0, -1, 0, half), 2: (1, 0, half, -quarter), 3: (-1, 0, -half, quarter), 4: (0, 0, 0, quarter)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())


def test_mask_overlap(spark):
    px = spark.createDataFrame([(1, 1, 0, 0), (1, 1, 0, 1), (1, 2, 5, 5), (2, 1, 0, 0)], SHAPE)
    mask = spark.createDataFrame([(1, 0, 0), (1, 0, 0), (1, 9, 9), (None, 0, 0)], "slide int, r int, c int")
    assert sorted(tuple(r) for r in objects.mask_overlap(px, mask).collect()) == [(1, 1, 0.5), (1, 2, 0.0), (2, 1, 0.0)]
