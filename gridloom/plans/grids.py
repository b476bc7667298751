"""Queries on grids: rasters, controls, tiles and objects."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.operators import grid, objects, ranking, relational, skeleton, spatial, texture, tiling
from gridloom.plans.base import GRID, query
from gridloom.plans.similarity import _DRAW
from gridloom.sources import slides

_SIDE = f"{GRID}, sides AS (SELECT slide, r, c, vec_id, CASE WHEN label < 5 THEN 2 ELSE 1 END AS label FROM grid)"


def sides(t):
    return t.grid().select("slide", "r", "c", "vec_id", F.when(F.col("label") < 5, 2).otherwise(1).alias("label"))


@query(
    f"""WITH {_SIDE} SELECT a.slide, a.r, a.c, max((abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1)::INTEGER) = 1 AS dilated,
  a.label = 2 AND NOT bool_or(b.label = 1 AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1) AS eroded
FROM sides a JOIN (SELECT * FROM sides) b ON a.slide = b.slide AND (b.label = 2 OR b.label = 1) GROUP BY a.slide, a.r, a.c, a.label
HAVING bool_or(b.label = 2 AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1)"""
)
def dilate_erode(t):
    cells = sides(t)
    two = cells.where("label = 2")
    grown = grid.dilate(two, 1).join(cells.select("slide", "r", "c"), ["slide", "r", "c"], "left_semi")
    left = grid.erode(two, 1, cells).withColumn("eroded", F.lit(True))
    rows = grown.join(left, ["slide", "r", "c"], "left")
    return rows.select("slide", "r", "c", F.lit(True).alias("dilated"), F.coalesce("eroded", F.lit(False)).alias("eroded"))


_BAND = f"""WITH {_SIDE}, band AS (
  SELECT a.slide, a.r, a.c, a.vec_id, CASE WHEN bool_or(b.label <> a.label) THEN 3 ELSE a.label END::INTEGER AS label
  FROM sides a JOIN sides b ON a.slide = b.slide AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY a.slide, a.r, a.c, a.vec_id, a.label)"""


@query(f"{_BAND} SELECT slide, r, c, label FROM band")
def dilate_erode_band(t):
    return grid.border_band(sides(t), radius=1)


@query(
    f"""{_BAND}, n AS (SELECT b.slide, g.label AS cluster, b.label AS status, count(*) AS n FROM band b JOIN grid g USING (vec_id) WHERE b.label <> 3 GROUP BY ALL)
SELECT slide, cluster, status, n, round(n / sum(n) OVER (PARTITION BY slide, cluster), 6) AS fraction FROM n"""
)
def contingency_row_fraction(t):
    band = grid.border_band(sides(t), radius=1).where("label <> 3").withColumnRenamed("label", "status")
    rows = t.grid().withColumnRenamed("label", "cluster").join(band, ["slide", "r", "c"])
    return relational.row_fractions(rows, ["slide", "cluster"], "status").withColumn("fraction", F.round("fraction", 6))


@query(
    f"""WITH {GRID}, n AS (SELECT slide, label AS cluster, (vec_id % 3)::INTEGER AS source, count(*) AS n FROM grid GROUP BY ALL),
f AS (SELECT slide, cluster, source, n / sum(n) OVER (PARTITION BY slide, cluster) AS f FROM n),
s AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY slide, source ORDER BY {_DRAW.format("'31|' || cluster")}, cluster) <= 8)
SELECT source, count(*) AS n, count(*) FILTER (f BETWEEN 0.2 AND 0.8) AS middle, round(100 * count(*) FILTER (f BETWEEN 0.2 AND 0.8)::DOUBLE / count(*), 6) AS pct FROM s GROUP BY source"""
)
def overlap_middle_share(t):
    g = t.grid().select("slide", F.col("label").alias("cluster"), (F.col("vec_id") % 3).cast("int").alias("source"))
    f = relational.row_fractions(g, ["slide", "cluster"], "source")
    s = ranking.sample_without(f, ["slide", "source"], "cluster", 8, 31)
    middle = F.count_if(F.col("fraction").between(0.2, 0.8))
    return s.groupBy("source").agg(F.count("*").alias("n"), middle.alias("middle"), F.round(100 * middle / F.count("*"), 6).alias("pct"))


_CONTROL = f"""WITH {GRID}, centre AS (SELECT slide, label AS component, avg(r) AS cr, avg(c) AS cc FROM grid GROUP BY ALL),
control AS (
  SELECT slide, component, r, c, angle::INTEGER AS angle,
    CASE WHEN (angle >= 180) = (r < round(tan(radians(angle)), 9) * (c - cc) + cr) THEN 2 ELSE 1 END::INTEGER AS side
  FROM grid g JOIN centre USING (slide), (VALUES (90), (180), (270), (360)) a(angle) WHERE g.label = component)"""


def _components(t):
    return t.grid().select("slide", F.col("label").alias("component"), "r", "c")


@query(f"{_CONTROL} SELECT slide, component, r, c, angle, side FROM control")
def split_control_masks(t):
    return grid.split_control(_components(t), 4)


@query(
    f"""{_CONTROL} SELECT angle, truth AS side, round(avg((side = truth)::INTEGER), 6) AS overlap
FROM control JOIN (SELECT slide, r, c, CASE WHEN label < 5 THEN 2 ELSE 1 END::INTEGER AS truth FROM grid) USING (slide, r, c) GROUP BY ALL"""
)
def control_overlap(t):
    truth = sides(t).select("slide", "r", "c", F.col("label").alias("side"))
    return grid.overlap(truth, grid.split_control(_components(t), 4), ["angle"]).withColumn("overlap", F.round("overlap", 6))


@query()
def contiguity_control_masks(t):
    lost = grid.components(sides(t)).where("label = 2")
    sizes = lost.groupBy("slide", "component").agg(F.count("*").alias("area")).select("slide", "area")
    return grid.contiguity_control(sides(t), sizes, 3)


_COMPONENTS = f"""WITH RECURSIVE {_SIDE}, reach AS (
  SELECT slide, r, c, label, r * 4294967296 + c AS component FROM sides
  UNION
  SELECT s.slide, s.r, s.c, s.label, least(p.component, s.r * 4294967296 + s.c) FROM reach p JOIN sides s
    ON s.slide = p.slide AND s.label = p.label AND abs(s.r - p.r) <= 1 AND abs(s.c - p.c) <= 1),
parts AS (SELECT slide, r, c, min(component)::BIGINT AS component FROM reach GROUP BY slide, r, c)"""


@query(
    f"""{_COMPONENTS}, a AS (SELECT p.slide, component, count(*) AS area FROM parts p JOIN sides s ON s.slide = p.slide AND s.r = p.r AND s.c = p.c WHERE label = 2 GROUP BY ALL)
SELECT slide, run::INTEGER AS run, count(*) AS cells, coalesce((SELECT sum(area) FROM a WHERE a.slide = s.slide AND area > 1), 0)::BIGINT AS taken FROM sides s, range(3) x(run) GROUP BY ALL"""
)
def contiguity_control_areas(t):
    return contiguity_control_masks(t).groupBy("slide", "run").agg(F.count("*").alias("cells"), F.count_if(F.col("side") == 2).alias("taken"))


@query(f"{_COMPONENTS} SELECT slide, r, c, component FROM parts")
def connected_components(t):
    return grid.components(sides(t)).select("slide", "r", "c", "component")


@query(
    f"""{_COMPONENTS} SELECT slide, r, c FROM parts QUALIFY count(*) OVER (PARTITION BY slide, component) >= 5"""
)
def remove_small_components(t):
    return grid.without_small(grid.components(sides(t)), 5).select("slide", "r", "c")


@query()
def constrained_ward_clusters(t):
    return spatial.constrained_clusters(t.grid(), [2, 3, 5, 10], least=100)  # these slides have 100 cells


@query(
    f"""WITH {GRID}, cells AS (SELECT slide, r, c FROM grid WHERE label % 2 = 0),
near AS (
  SELECT a.slide, a.r, a.c, b.r AS r2, b.c AS c2 FROM cells a JOIN cells b ON a.slide = b.slide AND (a.r, a.c) <> (b.r, b.c)
  QUALIFY row_number() OVER (PARTITION BY a.slide, a.r, a.c ORDER BY (a.r - b.r) ** 2 + (a.c - b.c) ** 2, b.r, b.c) <= 8)
SELECT DISTINCT slide, CASE WHEN (r, c) < (r2, c2) THEN r ELSE r2 END AS r, CASE WHEN (r, c) < (r2, c2) THEN c ELSE c2 END AS c,
  CASE WHEN (r, c) < (r2, c2) THEN r2 ELSE r END AS r2, CASE WHEN (r, c) < (r2, c2) THEN c2 ELSE c END AS c2 FROM near"""
)
def spatial_graph_links(t):
    return spatial.spatial_graph(t.grid().where("label % 2 = 0")).where("NOT forced").drop("forced")


_RINGS = """ring AS (SELECT p_partkey AS id, p_size::DOUBLE AS n, (p_partkey % 7)::INTEGER AS label FROM part),
edges AS (SELECT id, label, n, unnest([0.0, n, n + 2, 1.0]::DOUBLE[]) AS x1, unnest([0.0, 1.0, n / 2 + 3, n]::DOUBLE[]) AS y1,
  unnest([n, n + 2, 1.0, 0.0]::DOUBLE[]) AS x2, unnest([1.0, n / 2 + 3, n, 0.0]::DOUBLE[]) AS y2 FROM ring)"""


@query(
    f"""WITH {_RINGS}, cell AS (SELECT r::INTEGER AS r, c::INTEGER AS c FROM range(0, 60) a(r), range(0, 60) b(c)),
hit AS (SELECT id, label, r, c, count(*) FILTER ((y1 > r + 0.5) <> (y2 > r + 0.5) AND c + 0.5 < (x2 - x1) * (r + 0.5 - y1) / nullif(y2 - y1, 0) + x1) AS k
  FROM edges, cell GROUP BY ALL HAVING k % 2 = 1)
SELECT (id % 4)::INTEGER AS slide, r, c, arg_max(label, id) AS label FROM hit GROUP BY ALL"""
)
def rasterised_polygons(t):
    n = F.col("p_size").cast("double")
    rings = t.part.select(
        (F.col("p_partkey") % 4).cast("int").alias("slide"), F.col("p_partkey").alias("region_ix"), (F.col("p_partkey") % 7).cast("int").alias("label"),
        F.array(F.lit(0.0), n, n + 2, F.lit(1.0)).alias("xs"), F.array(F.lit(0.0), F.lit(1.0), n / 2 + 3, n).alias("ys"),
    )
    return grid.rasterise(rings)


@query(
    """WITH ring AS (SELECT p_partkey AS id, p_size::DOUBLE AS n, (p_partkey % 7)::INTEGER AS label, CASE WHEN p_partkey % 5 = 0 THEN '-' ELSE '+' END AS sign FROM part),
edges AS (SELECT id, label, sign, unnest([0.0, n, n + 2, 1.0]::DOUBLE[]) AS x1, unnest([0.0, 1.0, n / 2 + 3, n]::DOUBLE[]) AS y1,
    unnest([n, n + 2, 1.0, 0.0]::DOUBLE[]) AS x2, unnest([1.0, n / 2 + 3, n, 0.0]::DOUBLE[]) AS y2 FROM ring
  UNION ALL SELECT id, label, sign, unnest([2.0, n / 2, n / 2]::DOUBLE[]), unnest([2.0, 2.0, n / 2 + 1]::DOUBLE[]),
    unnest([n / 2, n / 2, 2.0]::DOUBLE[]), unnest([2.0, n / 2 + 1, 2.0]::DOUBLE[]) FROM ring WHERE n > 8),
cell AS (SELECT r::INTEGER AS r, c::INTEGER AS c FROM range(0, 60) a(r), range(0, 60) b(c)),
hit AS (SELECT id, label, sign, r, c, count(*) FILTER ((y1 > r + 0.5) <> (y2 > r + 0.5) AND c + 0.5 < (x2 - x1) * (r + 0.5 - y1) / nullif(y2 - y1, 0) + x1) AS k
  FROM edges, cell GROUP BY ALL HAVING k % 2 = 1)
SELECT (id % 40)::INTEGER AS slide, r, c, arg_max(label, id) AS label FROM hit GROUP BY 1, 2, 3 HAVING NOT bool_or(sign = '-')"""
)
def rasterised_signed_regions(t):
    n, k = F.col("p_size").cast("double"), F.col("p_partkey")
    named = [(k % 40).cast("int").alias("slide"), k.alias("region_ix"), (k % 7).cast("int").alias("label"), F.when(k % 5 == 0, "-").otherwise("+").alias("sign")]
    ring = lambda xs, ys: [F.array(*xs).alias("xs"), F.array(*ys).alias("ys")]
    outer = t.part.select(*named, *ring((F.lit(0.0), n, n + 2, F.lit(1.0)), (F.lit(0.0), F.lit(1.0), n / 2 + 3, n)))
    holes = t.part.where("p_size > 8").select(*named, *ring((F.lit(2.0), n / 2, n / 2), (F.lit(2.0), F.lit(2.0), n / 2 + 1)))
    return grid.rasterise(outer.unionByName(holes))


@query(
    f"""WITH {_SIDE}, n AS (SELECT a.slide, a.r, a.c, count(*) AS n FROM grid a JOIN sides b
  ON a.slide = b.slide AND b.label = 2 AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY ALL)
SELECT slide, r, c, round(n / 9.0::DOUBLE, 6) AS filled FROM n WHERE n / 9.0 > 0.5 AND r BETWEEN 1 AND 8 AND c BETWEEN 1 AND 8"""
)
def patch_centre_coverage(t):
    return grid.coverage(sides(t).where("label = 2"), 10, 10, 3, 0.5).withColumn("filled", F.round("filled", 6))


@query(
    f"""WITH {GRID}, k(d, w) AS (VALUES (-1, 0.25::DOUBLE), (0, 0.5::DOUBLE), (1, 0.25::DOUBLE)),
l AS (SELECT slide, r, c, i - 1 AS cls, embedding[i] AS v FROM grid, range(1, 5) s(i)),
a AS (SELECT x.slide, x.r, x.c, x.cls, sum(y.v * w) / sum(w) AS v FROM l x, k JOIN l y ON y.slide = x.slide AND y.cls = x.cls AND y.c = x.c AND y.r = x.r + d GROUP BY ALL),
b AS (SELECT x.slide, x.r, x.c, x.cls, sum(y.v * w) / sum(w) AS v FROM a x, k JOIN a y ON y.slide = x.slide AND y.cls = x.cls AND y.r = x.r AND y.c = x.c + d GROUP BY ALL)
SELECT slide, r, c, cls::INTEGER AS class FROM b QUALIFY row_number() OVER (PARTITION BY slide, r, c ORDER BY v DESC, cls) = 1"""
)
def smoothed_response_class(t):
    cells = t.grid().select("slide", "r", "c", F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")).alias("s"))
    return grid.smoothed_argmax(cells, "s", [0.25, 0.5, 0.25])


#: Slides whose sizes come from a table: a nation's customers and suppliers.
_SIZES = """sizes AS (SELECT c_nationkey AS slide, (20 + count(*))::INTEGER AS h, (15 + count(*) // 2)::INTEGER AS w FROM customer GROUP BY 1),
n AS (SELECT *, greatest(ceil((h - 2) / 6), 1)::BIGINT AS n0, greatest(ceil((w - 3) / 9), 1)::BIGINT AS n1 FROM sizes)"""


def _sizes(t):
    half = F.call_function("div", F.count("*"), F.lit(2))
    return t.customer.groupBy(F.col("c_nationkey").alias("slide")).agg((F.count("*") + 20).cast("int").alias("h"), (half + 15).cast("int").alias("w"))


@query(
    f"""WITH {_SIZES}, p AS (SELECT slide, h, w, n1, unnest(range(n0 * n1)) AS i FROM n)
SELECT slide, i AS tile_id, (i // n1)::INTEGER AS p0, (i // n1 * 6)::INTEGER AS s0, (i // n1 * 6 + 8)::INTEGER AS e0, greatest(i // n1 * 6 + 8 - h, 0)::INTEGER AS pad0,
  (i % n1)::INTEGER AS p1, (i % n1 * 9)::INTEGER AS s1, (i % n1 * 9 + 12)::INTEGER AS e1, greatest(i % n1 * 9 + 12 - w, 0)::INTEGER AS pad1, i // 5 AS batch FROM p"""
)
def tile_plan(t):
    return tiling.slide_tiles(_sizes(t), ["slide"], ("h", "w"), (8, 12), (2, 3), batch=5)


def _values(t):
    """A row of values as long as the table, and its length."""
    return t.part.select(F.col("p_partkey").cast("int").alias("i"), F.col("p_retailprice").alias("v")), t.part.count()


@query(
    """WITH d AS (SELECT p_partkey AS j, p_retailprice AS v, (SELECT count(*) FROM part) AS n FROM part),
t AS (SELECT unnest(range(0, (n + 14) // 15)) AS t, n FROM (SELECT count(*) AS n FROM part)),
p AS (SELECT m, t, i, n, t * 15 + i AS a FROM (VALUES ('reflect'), ('edge'), ('wrap'), ('constant')) m(m), t, range(15) c(i)),
s AS (SELECT m, t, i, CASE m WHEN 'edge' THEN least(a, n - 1) WHEN 'wrap' THEN a % n WHEN 'reflect' THEN CASE WHEN a < n THEN a ELSE 2 * n - 2 - a END ELSE CASE WHEN a < n THEN a END END AS j FROM p)
SELECT m AS mode, t::BIGINT AS tile_id, i::INTEGER AS i, CASE WHEN s.j IS NULL THEN -99.0 ELSE v END AS v FROM s LEFT JOIN d ON s.j = d.j"""
)
def tile_pad_modes(t):
    (values, n), out = _values(t), None
    for mode in ("reflect", "edge", "wrap", "constant"):
        rows = tiling.cut(values, n, 15, 0, mode, -99.0).withColumn("mode", F.lit(mode))
        out = rows if out is None else out.unionByName(rows)
    return out


_MERGE = """WITH d AS (SELECT p_partkey AS i, p_retailprice AS v, unnest([p_partkey // 5, p_partkey // 5 - 1]) AS t FROM part),
t AS (SELECT d.i, v, count(*) AS n, sum({w}) AS w FROM d WHERE t >= 0 AND d.i >= t * 5 AND t < ((SELECT count(*) FROM part) - 1) // 5 GROUP BY ALL)
SELECT i::INTEGER AS i, round(v * w, 6) AS total, round(w, 6) AS weights, n AS visits, round(v * w / w, 6) AS mean FROM t"""


@query(_MERGE.format(w="1.0::DOUBLE"))
def tile_merge_sum(t):
    values, n = _values(t)
    out = tiling.merge(tiling.cut(values, n, 10, 5), n, 10, 5)
    return out.withColumns({c: F.round(c, 6) for c in ("total", "weights", "mean")})


@query(_MERGE.format(w="0.54 - 0.46 * cos(2 * pi() * (d.i - t * 5) / 9)"))
def tile_merge_weighted(t):
    values, n = _values(t)
    out = tiling.merge(tiling.cut(values, n, 10, 5), n, 10, 5, tiling.window("hamming", F.col("i"), 10))
    return out.withColumns({c: F.round(c, 6) for c in ("total", "weights", "mean")})


@query(
    """WITH n AS (SELECT (count(*) + 49) // 50 AS rows FROM part), d AS (SELECT p_partkey // 50 AS i0, p_partkey % 50 AS i1, p_retailprice AS v FROM part),
t AS (SELECT i0, i1, v, unnest([i0 // 2, i0 // 2 - 1]) AS t0 FROM d), u AS (SELECT *, unnest([i1 // 5, i1 // 5 - 1]) AS t1 FROM t),
w AS (SELECT *, (0.54 - 0.46 * cos(2 * pi() * (i0 - 2 * t0) / 3)) * (0.54 - 0.46 * cos(2 * pi() * (i1 - 5 * t1) / 9)) AS w
  FROM u, n WHERE t0 >= 0 AND t1 >= 0 AND t0 < (rows - 2 + 1) // 2 AND t1 < 9)
SELECT i0::INTEGER AS i0, i1::INTEGER AS i1, round(sum(v * w), 6) AS total, round(sum(w), 6) AS weights, count(*) AS visits, round(sum(v * w) / sum(w), 6) AS mean
FROM w GROUP BY ALL"""
)
def tile_merge_2d(t):
    shape = (-(-t.part.count() // 50), 50)
    data = t.part.select(F.floor(F.col("p_partkey") / 50).cast("int").alias("i0"), (F.col("p_partkey") % 50).cast("int").alias("i1"), F.col("p_retailprice").alias("v"))
    out = tiling.merge_nd(tiling.cut_nd(data, shape, (4, 10), (2, 5)), shape, (4, 10), (2, 5), "hamming")
    return out.withColumns({c: F.round(c, 6) for c in ("total", "weights", "mean")})


@query(
    f"""WITH {GRID}, t AS (SELECT slide, r, c, embedding, unnest([r // 2, r // 2 - 1]) AS t0 FROM grid),
u AS (SELECT *, unnest([c // 2, c // 2 - 1]) AS t1 FROM t), k AS (SELECT *, unnest([0, 1, 2, 3]) AS cls FROM u WHERE t0 BETWEEN 0 AND 3 AND t1 BETWEEN 0 AND 3),
m AS (SELECT slide, r, c, cls, avg(embedding[cls + 1] + 0.01 * ((t0 * 4 + t1) % 3) * cls) AS m FROM k GROUP BY ALL)
SELECT slide, r AS i0, c AS i1, cls::INTEGER AS class, round(m, 6) AS mean FROM m QUALIFY row_number() OVER (PARTITION BY slide, r, c ORDER BY m DESC, cls) = 1"""
)
def tile_merge_logits(t):
    logits = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double"))
    data = t.grid().select("slide", F.col("r").alias("i0"), F.col("c").alias("i1"), logits.alias("v"))
    tiles = tiling.cut_nd(data, (10, 10), (4, 4), (2, 2), keys=("slide",))
    seen = F.transform("v", lambda x, k: x + 0.01 * (F.col("tile_id") % 3) * k)  # a model sees each tile by itself
    merged = tiling.merge_nd(tiles.withColumn("v", seen), (10, 10), (4, 4), (2, 2), keys=("slide",))
    best = tiling.merged_classes(merged, ("slide", "i0", "i1")).withColumn("mean", F.round("mean", 6))
    return best.join(data.select("slide", "i0", "i1"), ["slide", "i0", "i1"], "left_semi")  # the last slide need not be full


@query(
    f"""WITH {_SIZES}, p AS (SELECT slide, n1, unnest(range(n0 * n1 // 7 * 7)) AS i FROM n)
SELECT slide, i AS tile_id, (i // n1)::INTEGER AS p0, (i % n1)::INTEGER AS p1, i // 7 AS batch FROM p"""
)
def tile_batches(t):
    plan = tiling.slide_tiles(_sizes(t), ["slide"], ("h", "w"), (8, 12), (2, 3), batch=7, drop_last=True)
    return plan.select("slide", "tile_id", "p0", "p1", "batch")


def _cosines(*a: float) -> str:
    return " + ".join(f"{(-1) ** k * x} * cos({2 * k} * pi() * i / 36)" for k, x in enumerate(a))


_WINDOW_SQL = {
    "bartlett": "1 - abs(2 * i / 36.0 - 1)",
    "hann": _cosines(0.5, 0.5),
    "hamming": _cosines(0.54, 0.46),
    "blackman": _cosines(0.42, 0.5, 0.08),
    "nuttall": _cosines(0.3635819, 0.4891775, 0.1365995, 0.0106411),
    "blackmanharris": _cosines(0.35875, 0.48829, 0.14128, 0.01168),
    "triang": "1 - abs(i - 18) * 2 / 38.0",
    "barthann": "0.62 - 0.48 * abs(i / 36.0 - 0.5) + 0.38 * cos(2 * pi() * abs(i / 36.0 - 0.5))",
    "bohman": "CASE WHEN i IN (0, 36) THEN 0 ELSE (1 - abs(i / 18.0 - 1)) * cos(pi() * abs(i / 18.0 - 1)) + sin(pi() * abs(i / 18.0 - 1)) / pi() END",
    "parzen": "CASE WHEN abs(i - 18) <= 9 THEN 1 - 6 * (abs(i - 18) / 18.5) ** 2 + 6 * (abs(i - 18) / 18.5) ** 3 ELSE 2 * (1 - abs(i - 18) / 18.5) ** 3 END",
    "boxcar": "1",
}


@query(
    "WITH v AS (SELECT (p_partkey // 37)::INTEGER AS run, (p_partkey % 37)::INTEGER AS i, p_retailprice AS v FROM part) SELECT run, "
    + ", ".join(f"round(sum(v * ({e})), 4) AS {n}" for n, e in _WINDOW_SQL.items())
    + " FROM v GROUP BY run"
)
def window_values(t):
    i = (F.col("p_partkey") % 37).cast("int")
    rows = t.part.select(F.floor(F.col("p_partkey") / 37).cast("int").alias("run"), i.alias("i"), F.col("p_retailprice").alias("v"))
    return rows.groupBy("run").agg(*[F.round(F.sum(F.col("v") * tiling.window(n, F.col("i"), 37)), 4).alias(n) for n in _WINDOW_SQL])


@query(
    """WITH p AS (SELECT b, i, (b % 3) * 4 + i // 4 AS r, (b // 3) * 4 + i % 4 AS c FROM range(6) x(b), range(16) y(i))
SELECT b AS box, i, r::INTEGER AS r, c::INTEGER AS c FROM p WHERE r < 11 AND c < 7"""
)
def tessellation_reassembly(t):
    rows = t.spark.range(96).select(F.floor(F.col("id") / 16).alias("box"), (F.col("id") % 16).alias("i"))
    return tiling.cropped(tiling.reassembled(rows, 3, 4), 1224, 800, 224, 100)


@query(
    f"""WITH {GRID}, px AS (SELECT slide, unnest(range(greatest(ceil((r - 3) / 4.0), 0)::INTEGER, least(r // 4, 2) + 1)) AS pr, r, c, label FROM grid),
p AS (SELECT slide, pr, unnest(range(greatest(ceil((c - 3) / 4.0), 0)::INTEGER, least(c // 4, 2) + 1)) AS pc, label FROM px)
SELECT slide, pr::INTEGER AS r, pc::INTEGER AS c, round(sum(label) / 16.0::DOUBLE, 4) AS mean, max(label)::DOUBLE AS most FROM p GROUP BY ALL"""
)
def tessellated_inference(t):
    cells = t.grid().select("slide", F.col("r").alias("y"), F.col("c").alias("x"), F.col("label").alias("v"))
    sizes = cells.groupBy("slide").agg(F.lit(10).alias("height"), F.lit(10).alias("width"))
    model = lambda: lambda m: np.column_stack([m.mean(axis=1), m.max(axis=1)])
    out = slides.tessellated_pixels(cells, sizes, 4, 4, model)
    profile = F.transform("profile", lambda x: F.round(x.cast("double"), 4))
    return out.select("slide", "r", "c", profile[0].alias("mean"), profile[1].alias("most"))


_PIXELS = f"WITH {GRID}, px AS (SELECT slide, label, r, c, embedding[1] AS act, (vec_id % 3)::INTEGER AS kind FROM grid)"


def _pixels(t):
    return t.grid().select("slide", "label", "r", "c", F.col("embedding")[0].cast("double").alias("act"), (F.col("vec_id") % 3).cast("int").alias("kind"))


@query(
    f"""{_PIXELS} SELECT slide, label, min(r) AS r_start, max(r) + 1 AS r_end, min(c) AS c_start, max(c) + 1 AS c_end, round(avg(r), 6) AS r_mean, round(avg(c), 6) AS c_mean,
  count(*) AS area, ((max(r) + 1 - min(r)) * (max(c) + 1 - min(c)))::BIGINT AS box_area, round(sqrt(4 * count(*) / pi()), 6) AS diameter FROM px GROUP BY ALL"""
)
def object_location_size(t):
    out = objects.location_size(_pixels(t))
    return out.withColumns({c: F.round(c, 6) for c in ("r_mean", "c_mean", "diameter")})


@query(
    f"""{_PIXELS}, m AS (SELECT slide, label, var_pop(r) + 1.0::DOUBLE / 12 AS a, covar_pop(r, c) AS b, var_pop(c) + 1.0::DOUBLE / 12 AS d FROM px GROUP BY ALL),
e AS (SELECT slide, label, a, b, d, (a + d) / 2 + sqrt(((a - d) / 2) ** 2 + b * b) AS big, greatest((a + d) / 2 - sqrt(((a - d) / 2) ** 2 + b * b), 0) AS small FROM m)
SELECT slide, label, round(4 * sqrt(big), 5) AS major, round(4 * sqrt(small), 5) AS minor, round(sqrt(greatest(1 - small / big, 0)), 5) AS eccentricity FROM e"""
)
def object_moments(t):
    out = objects.moments(_pixels(t)).drop("angle")
    return out.withColumns({c: F.round(c, 5) for c in ("major", "minor", "eccentricity")})


@query(
    f"""{_PIXELS} SELECT slide, label, round(avg(act), 6) AS mean, round(avg((act > 0.0)::INTEGER), 6) AS over_0, round(avg((act > 0.1)::INTEGER), 6) AS over_1 FROM px GROUP BY ALL"""
)
def object_activation_bins(t):
    return objects.activation(_pixels(t), "act", [0.0, 0.1]).withColumns({c: F.round(c, 6) for c in ("mean", "over_0", "over_1")})


@query(
    f"""{_PIXELS}, n AS (SELECT slide, label, kind, count(*) AS n FROM px GROUP BY ALL)
SELECT slide, label, kind AS majority FROM n QUALIFY row_number() OVER (PARTITION BY slide, label ORDER BY n DESC, kind) = 1"""
)
def object_majority_label(t):
    return objects.majority(_pixels(t), "kind")


@query(
    f"""{_PIXELS}, m AS (SELECT slide, label, count(*)::HUGEINT AS n, sum(r)::HUGEINT AS r, sum(c)::HUGEINT AS c, sum(r * r)::HUGEINT AS rr, sum(c * c)::HUGEINT AS cc, sum(r * c)::HUGEINT AS rc FROM px GROUP BY ALL),
p AS (SELECT slide, label, (2 * (n * rc - r * c))::DOUBLE / n ** 2 AS y, (n * rr - r * r - n * cc + c * c)::DOUBLE / n ** 2 AS x FROM m)
SELECT slide, label, round(coalesce(y / nullif(sqrt(y * y + x * x), 0), 0), 6) AS y_proj, round(coalesce(x / nullif(sqrt(y * y + x * x), 0), 0), 6) AS x_proj,
  round(CASE WHEN x = 0 THEN sign(y) * pi() / 2 ELSE atan(y / x) END, 6) AS atan,
  round(CASE WHEN x <> 0 THEN atan2(y, x) / 2 WHEN y > 0 THEN -pi() / 4 ELSE pi() / 4 END, 6) AS orientation FROM p"""
)
def object_orientation(t):
    out = objects.orientation(_pixels(t))
    return out.withColumns({c: F.round(c, 6) for c in ("y_proj", "x_proj", "atan", "orientation")})


@query(f"{_PIXELS} SELECT slide, label, round(avg((act > 0 AND (r + c) % 2 = 0)::INTEGER), 6) AS overlap FROM px GROUP BY ALL")
def object_mask_overlap(t):
    mask = _pixels(t).where("act > 0 AND (r + c) % 2 = 0").select("slide", "r", "c")
    return objects.mask_overlap(_pixels(t), mask).withColumn("overlap", F.round("overlap", 6))


@query(
    f"""{_PIXELS} SELECT slide, label, {", ".join(f"round(avg((act > {x / 10 - 0.5:.1f}::DOUBLE)::INTEGER), 6) AS over_{x - 1}" for x in range(1, 10))}, round(avg(act), 6) AS mean FROM px GROUP BY ALL"""
)
def object_activation_nine_bins(t):
    out = objects.activation(_pixels(t), "act", [float(f"{x / 10 - 0.5:.1f}") for x in range(1, 10)])
    return out.withColumns({c: F.round(c, 6) for c in ("mean", *[f"over_{i}" for i in range(9)])})


_LEVELS = """, lv AS (SELECT slide, label, r, c, floor(least(greatest((act + 0.35::DOUBLE) / 0.7::DOUBLE, 0), 1) * 15)::INTEGER AS level
  FROM (SELECT slide, r, c, embedding[1] AS act, CASE WHEN label < 5 THEN 2 ELSE 1 END AS label FROM grid)),
pr AS (SELECT a.slide, a.label, d, unnest([{'i': a.level, 'j': b.level}, {'i': b.level, 'j': a.level}]) AS w
  FROM lv a, (VALUES (0, 0, 1), (1, 1, 1), (2, 1, 0), (3, 1, -1)) o(d, dr, dc) JOIN lv b ON b.slide = a.slide AND b.label = a.label AND b.r = a.r + dr AND b.c = a.c + dc
  WHERE a.level > 0 AND b.level > 0),
n AS (SELECT slide, label, d, w.i AS i, w.j AS j, count(*) AS n FROM pr GROUP BY ALL),
p AS (SELECT slide, label, d, i, j, n / sum(n) OVER (PARTITION BY slide, label, d) AS p FROM n),
e AS (SELECT slide, label, d, i, sum(p) AS q FROM p GROUP BY ALL),
m AS (SELECT slide, label, d, sum(i * q) AS mean, sum(i * i * q) - sum(i * q) ** 2 AS v, -sum(q * log2(q)) AS h FROM e GROUP BY ALL),
w AS (SELECT slide, label, d, sum(p * p) AS asm, sum((i - j) ** 2 * p) AS con, sum(i * j * p) AS prod, sum(p / (1 + (i - j) ** 2)) AS idm, -sum(p * log2(p)) AS ent FROM p GROUP BY ALL),
s AS (SELECT slide, label, d, sum(k * q) AS sa, sum(k * k * q) - sum(k * q) ** 2 AS sv, -sum(q * log2(q)) AS se FROM (SELECT slide, label, d, i + j AS k, sum(p) AS q FROM p GROUP BY ALL) GROUP BY ALL),
g AS (SELECT slide, label, d, sum(q * q) AS sq, -sum(q * log2(q)) AS de FROM (SELECT slide, label, d, abs(i - j) AS k, sum(p) AS q FROM p GROUP BY ALL) GROUP BY ALL),
ob AS (SELECT slide, label, max(level) + 1 AS size FROM lv GROUP BY ALL),
x AS (SELECT slide, label, d, asm, con, CASE WHEN v <= 1e-12 THEN 1 ELSE (prod - mean * mean) / v END AS cor, greatest(v, 0) AS v, idm, sa, greatest(sv, 0) AS sv, se, ent,
  greatest(sq / size - 1.0::DOUBLE / (size * size), 0) AS dv, de, CASE WHEN h > 0 THEN (ent - 2 * h) / h ELSE 0 END AS i1, sqrt(greatest(1 - exp(-2 * (2 * h - ent)), 0)) AS i2
  FROM w JOIN m USING (slide, label, d) JOIN s USING (slide, label, d) JOIN g USING (slide, label, d) JOIN ob USING (slide, label)),
f AS (SELECT slide, label, avg(asm) a0, avg(con) a1, avg(cor) a2, avg(v) a3, avg(idm) a4, avg(sa) a5, avg(sv) a6, avg(se) a7, avg(ent) a8, avg(dv) a9, avg(de) a10, avg(i1) a11, avg(i2) a12
  FROM x GROUP BY ALL HAVING count(*) = 4)"""


@query(
    f"""WITH {GRID}{_LEVELS} SELECT slide, label, {", ".join(f"round(coalesce(a{i}, 0), 5) AS {m}" for i, m in enumerate(texture.MEASURES))} FROM ob LEFT JOIN f USING (slide, label)"""
)
def object_texture(t):
    cells = t.grid().select("slide", "r", "c", F.when(F.col("label") < 5, 2).otherwise(1).alias("label"), F.col("embedding")[0].cast("double").alias("act"))
    out = texture.texture(cells.withColumn("level", texture.grey_level(F.col("act"), -0.35, 0.35, 16)))
    return out.withColumns({m: F.round(m, 5) for m in texture.MEASURES})


@query()
def object_skeletons(t):
    return skeleton.skeletons(sides(t), seed=43)


@query(
    f"""{_PIXELS}, pts AS (SELECT DISTINCT slide, label, r + i AS y, c + j AS x FROM px, range(2) a(i), range(2) b(j)),
e AS (SELECT slide, label, p.y AS y1, p.x AS x1, q.y AS y2, q.x AS x2 FROM pts p JOIN pts q USING (slide, label) WHERE p.y <> q.y OR p.x <> q.x),
s AS (SELECT e.*, (y2 - y1) * (o.x - x1) - (x2 - x1) * (o.y - y1) AS turn, (o.y - y1) * (o.y - y2) + (o.x - x1) * (o.x - x2) AS along FROM e JOIN pts o USING (slide, label)),
h AS (SELECT slide, label, y1, x1, y2, x2 FROM s GROUP BY ALL HAVING min(turn) >= 0 AND bool_and(turn > 0 OR along <= 0)),
a AS (SELECT slide, label, abs(sum(y1 * x2 - y2 * x1)) / 2 AS hull_area FROM h GROUP BY ALL), n AS (SELECT slide, label, count(*) AS n FROM px GROUP BY ALL)
SELECT slide, label, hull_area::DOUBLE AS hull_area, round(n / hull_area, 6) AS solidity FROM a JOIN n USING (slide, label)"""
)
def object_convexity(t):
    return objects.hull(_pixels(t)).withColumn("solidity", F.round("solidity", 6))


@query(
    f"""WITH {GRID} SELECT slide, label, count(*) AS n, (row_number() OVER (PARTITION BY slide ORDER BY count(*) DESC, label))::INTEGER AS rank FROM grid GROUP BY slide, label"""
)
def components_by_size(t):
    n = t.grid().groupBy("slide", "label").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("slide").orderBy(F.desc("n"), "label")))
