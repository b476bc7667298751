"""Smaller operators of tables and grids: filters, lookups, pairs, splits, reshapes, raster rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.functions import scalars
from gridloom.functions.vectors import cosine_distance, norm
from gridloom.operators import grid, ranking, relational
from gridloom.plans.base import GRID, query

_DRAW = "('0x' || substr(md5({}), 1, 8))::BIGINT"
#: An order of categories, and a dictionary of codes.
_STATUS_ORDER = {"P": 0, "O": 1, "F": 2}
_TYPE_CODES = {"view": 1, "click": 2, "signup": 3, "purchase": 4, "error": 9}


@query("SELECT o_orderkey FROM orders WHERE CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END = true")
def nullable_boolean_filter(t):
    flag = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    return t.orders.where(flag).select("o_orderkey")  # a null flag isn't true


@query("SELECT event_id, ln(value - 100) AS x FROM events WHERE value > 100")
def finite_only(t):
    rows = t.events.select("event_id", F.log(F.col("value") - 100).alias("x"))  # null from 100 down
    return rows.where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")))


@query("SELECT p_partkey FROM part WHERE NOT contains(p_name, 'widget')")
def substring_exclude(t):
    return t.part.where(~F.col("p_name").contains("widget")).select("p_partkey")


@query(
    f"""WITH m AS (SELECT * FROM (VALUES {', '.join(str(x) for x in _TYPE_CODES.items())}) m(event_type, code))
SELECT code::INTEGER AS code, count(*) AS n FROM events JOIN m USING (event_type) GROUP BY ALL"""
)
def strict_dictionary_map(t):
    return relational.mapped(t.events, "event_type", _TYPE_CODES, "code").groupBy("code").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey) AS place FROM orders QUALIFY place <= 50")
def categorical_order_top(t):
    order = F.create_map(*[F.lit(x) for pair in _STATUS_ORDER.items() for x in pair])[F.col("o_orderstatus")]
    top = t.orders.orderBy(order, F.desc("o_totalprice"), "o_orderkey").limit(50)
    ranked = Window.orderBy(order, F.desc("o_totalprice"), "o_orderkey")  # over the 50 rows of the report
    return top.select("o_orderkey", F.row_number().over(ranked).cast("long").alias("place"))


@query(
    f"""WITH k AS (SELECT c_mktsegment AS g, c_custkey AS id, {_DRAW.format("'31|' || c_custkey")} AS k, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
SELECT g, id, row_number() OVER (PARTITION BY g ORDER BY k, id) <= ceil(0.3 * n) AS test FROM k"""
)
def fraction_split(t):
    rows = t.customer.select(F.col("c_mktsegment").alias("g"), F.col("c_custkey").alias("id"))
    return ranking.fraction_split(rows, ["g"], "id", 0.3, 31, "test")


@query("SELECT label FROM (SELECT c_mktsegment AS label FROM customer UNION SELECT p_type FROM part UNION SELECT event_type FROM events)")
def label_union(t):
    names = [t.customer.select(F.col("c_mktsegment").alias("label")), t.part.select("p_type"), t.events.select("event_type")]
    return names[0].union(names[1]).union(names[2]).distinct()


_PAIRS = f"""{GRID}, m AS (SELECT label, list_transform(range(1, 5), lambda i: avg_all[i]) AS v FROM (
  SELECT label, [avg(embedding[1]), avg(embedding[2]), avg(embedding[3]), avg(embedding[4])] AS avg_all FROM grid GROUP BY label))"""


def _label_means(t):
    first = [F.avg(F.col("embedding")[i].cast("double")) for i in range(4)]
    return t.grid().groupBy("label").agg(F.array(*first).alias("v"))


@query(f"WITH {_PAIRS} SELECT a.label AS a, b.label AS b, round(list_cosine_distance(a.v, b.v), 6) AS d FROM m a JOIN m b ON a.label <> b.label")
def ordered_pairs_matrix(t):
    m = _label_means(t)
    # one row for each label, whose number is that of the classes
    pairs = m.toDF("a", "va").crossJoin(F.broadcast(m.toDF("b", "vb"))).where("a <> b")
    return pairs.select("a", "b", F.round(cosine_distance(F.col("va"), F.col("vb")), 6).alias("d"))


@query(
    f"""WITH {_PAIRS}, d AS (SELECT a.label AS a, b.label AS b, list_cosine_distance(a.v, b.v) AS d FROM m a JOIN m b ON a.label <> b.label),
k AS (SELECT * FROM (VALUES (3, 0), (1, 1), (7, 2), (99, 3)) k(label, i))
SELECT p.i::INTEGER AS i, q.i::INTEGER AS j, round(d, 6) AS d FROM k p CROSS JOIN k q LEFT JOIN d ON d.a = p.label AND d.b = q.label"""
)
def matrix_reindex(t):
    m = _label_means(t)
    d = m.toDF("a", "va").crossJoin(F.broadcast(m.toDF("b", "vb"))).where("a <> b").select("a", "b", cosine_distance(F.col("va"), F.col("vb")).alias("d"))
    return relational.reindexed(d, "a", "b", "d", [3, 1, 7, 99], [3, 1, 7, 99]).withColumn("d", F.round("d", 6))


@query(
    """WITH e AS (SELECT l_linenumber AS epoch, l_suppkey % 5 AS rank, avg(l_discount) AS m FROM lineitem GROUP BY ALL)
SELECT arg_max(epoch, round(m, 9))::INTEGER AS best, round(max(m), 6) AS m FROM e WHERE rank = (SELECT max(rank) FROM e)"""
)
def best_epoch(t):
    e = t.lineitem.groupBy(F.col("l_linenumber").alias("epoch"), (F.col("l_suppkey") % 5).alias("rank")).agg(F.avg("l_discount").alias("m"))
    last = e.groupBy("rank").agg(F.max_by("epoch", F.round("m", 9)).alias("best"), F.round(F.max("m"), 6).alias("m"))
    return last.agg(F.max_by(F.struct("best", "m"), "rank").alias("b")).select("b.*")


@query("SELECT p_type, round(avg(p_size * (p_size + 2.0) * 0.25 * 0.25 / 1e6), 9) AS mm2 FROM part GROUP BY ALL")
def mean_box_area_mm2(t):
    n = F.col("p_size").cast("double")
    return t.part.groupBy("p_type").agg(F.round(F.avg(n * (n + 2) * 0.25 * 0.25 / 1e6), 9).alias("mm2"))


@query(
    """WITH r AS (SELECT l_orderkey, l_quantity AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber) - 1 AS i FROM lineitem),
o AS (SELECT o_orderkey, (o_orderkey % 50 + 1)::DOUBLE AS x FROM orders)
SELECT o_orderkey, coalesce((SELECT min(i) FROM r WHERE r.l_orderkey = o.o_orderkey AND r.x = o.x), 0)::INTEGER AS rank FROM o"""
)
def first_equal_rank(t):
    arrays = t.lineitem.groupBy("l_orderkey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("l_extendedprice", "l_linenumber", "l_quantity"))), lambda s: s["l_quantity"]).alias("a")
    )
    x = (F.col("o_orderkey") % 50 + 1).cast("double")
    rows = t.orders.join(arrays, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select("o_orderkey", F.greatest(F.coalesce(F.array_position("a", x), F.lit(0)) - 1, F.lit(0)).cast("int").alias("rank"))  # 0 where absent


@query(
    """WITH w AS (SELECT n_regionkey AS r, count(*) AS n, sum(n_nationkey)::BIGINT AS k FROM nation GROUP BY ALL)
SELECT name, a[1] AS r0, a[2] AS r1, a[3] AS r2, a[4] AS r3, a[5] AS r4 FROM (SELECT 'n' AS name, list(n ORDER BY r) AS a FROM w UNION ALL SELECT 'k', list(k ORDER BY r) FROM w)"""
)
def transposed_frame(t):
    w = t.nation.groupBy("n_regionkey").agg(F.count("*").alias("n"), F.sum("n_nationkey").alias("k"))
    long = w.unpivot("n_regionkey", ["n", "k"], "name", "v")
    return long.groupBy("name").agg(*[F.max(F.when(F.col("n_regionkey") == i, F.col("v"))).alias(f"r{i}") for i in range(5)])


@query("SELECT p_partkey, floor(p_size * 37 - 4.0 * (224 + 1) / 2)::BIGINT AS corner, round(p_size * 0.25 * 0.25 / 1e6, 12) AS mm2 FROM part")
def corner_from_centre(t):
    return t.part.select(
        "p_partkey", F.floor(F.col("p_size") * 37 - 4.0 * (224 + 1) / 2).alias("corner"), F.round(F.col("p_size") * 0.25 * 0.25 / 1e6, 12).alias("mm2")
    )


@query(
    f"""WITH {GRID}, p AS (SELECT a::INTEGER AS r, b::INTEGER AS c FROM range(4) x(a), range(15) y(b))
SELECT slide, p.r, p.c, label FROM p JOIN grid g ON g.r = least(floor((p.r + 0.5) * 10 / 4), 9) AND g.c = least(floor((p.c + 0.5) * 10 / 15), 9)"""
)
def nearest_resize(t):
    cells = t.grid().select("slide", "r", "c", "label")
    return grid.resized_nearest(cells, (10, 10), (4, 15), ["slide"]).select("slide", "r", "c", "label")


@query(f"WITH {GRID} SELECT slide, r, c, CASE label WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS side FROM grid")
def pair_mask(t):
    return grid.pair_mask(t.grid(), "label", 3, 1).select("slide", "r", "c", "side")


@query(
    """WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN '+null' ELSE '+' || replace(p_type, ' ', '-') || '-' || (p_size % 4 + 1) END AS name FROM part)
SELECT p_partkey, CASE WHEN name <> '+null' THEN substr(regexp_extract(name, '^(.*)-([^-]*)$', 1), 2) END AS architecture,
  CASE WHEN name <> '+null' THEN regexp_extract(name, '^(.*)-([^-]*)$', 2)::INTEGER END AS grade FROM n"""
)
def region_name_parts(t):
    made = F.concat(F.lit("+"), F.replace("p_type", F.lit(" "), F.lit("-")), F.lit("-"), (F.col("p_size") % 4 + 1).cast("string"))
    named = t.part.select("p_partkey", F.when(F.col("p_partkey") % 9 == 0, "+null").otherwise(made).alias("name"))
    architecture, grade = scalars.region_class(F.col("name"))
    return named.select("p_partkey", architecture.alias("architecture"), grade.alias("grade"))


@query(f"WITH {GRID} SELECT slide, r, c FROM grid WHERE label <= 5 AND vec_id % 6 NOT IN (3, 4)")
def marker_exclusion(t):
    marks = t.grid().select("slide", "r", "c", (F.col("vec_id") % 6).cast("int").alias("label"))
    return grid.without_markers(t.grid().where("label <= 5").select("slide", "r", "c"), marks, [3, 4])


@query(
    """WITH p AS (SELECT p_partkey, p_size::DOUBLE AS n FROM part)
SELECT p_partkey, CASE WHEN n * n > 400 THEN [0.0, n, n, 0.0, 0.0] ELSE [1.0, 21.0, 21.0, 1.0, 1.0] END::DOUBLE[] AS xs,
  CASE WHEN n * n > 400 THEN [0.0, 0.0, n, n, 0.0] ELSE [2.0, 2.0, 22.0, 22.0, 2.0] END::DOUBLE[] AS ys FROM p"""
)
def largest_vertex_loop(t):
    n, f = F.col("p_size").cast("double"), lambda *v: [F.lit(float(x)) for x in v]
    xs = F.array(*f(1, 21, 21, 1, 1), *f(0), n, n, *f(0, 0), *f(5, 6))
    ys = F.array(*f(2, 2, 22, 22, 2), *f(0, 0), n, n, *f(0), *f(5, 5))
    rows = t.part.select("p_partkey", xs.alias("xs"), ys.alias("ys"))
    return rows.select("p_partkey", scalars.largest_loop(F.col("xs"), F.col("ys")).alias("loop")).select("p_partkey", "loop.xs", "loop.ys")


@query(
    f"""WITH {GRID}, d AS (SELECT a.vec_id AS q, b.vec_id AS other, round(list_cosine_distance(a.embedding, b.embedding), 12) AS dist
  FROM grid a JOIN grid b ON a.slide = b.slide AND a.r <> b.r AND a.c <> b.c AND sqrt((a.r - b.r) ** 2 + (a.c - b.c) ** 2) > 3)
SELECT q AS vec_id, arg_min(other, (dist, other)) AS other FROM d GROUP BY q"""
)
def nearest_off_both_axes(t):
    cells = t.grid().select("slide", "r", "c", "vec_id", "embedding", norm(F.col("embedding")).alias("norm"))
    x, y = (lambda name, side=side: F.col(f"{side}.{name}") for side in "xy")
    dr, dc = y("r") - x("r"), y("c") - x("c")
    # pairs inside a slide only, each once, as it is as far in both directions; the two sides are the same rows, so they are shuffled once
    off = (dr > 0) & (dc != 0) & (F.sqrt(dr * dr + dc * dc) > 3)
    pairs = cells.alias("x").join(cells.alias("y"), (x("slide") == y("slide")) & off)
    dist = F.round(cosine_distance(x("embedding"), y("embedding"), x("norm"), y("norm")), 12)
    pairs = pairs.select(x("vec_id").alias("a"), y("vec_id").alias("b"), dist.alias("dist"))
    both = F.explode(F.array(*[F.struct(F.col(q).alias("q"), F.col(other).alias("other")) for q, other in ("ab", "ba")])).alias("p")
    best = pairs.select("dist", both).groupBy("p.q").agg(F.min(F.struct("dist", "p.other")).alias("b"))
    return best.select(F.col("q").alias("vec_id"), F.col("b.other").alias("other"))
