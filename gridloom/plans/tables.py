"""Queries on tables: joins, filters, aggregations, reshapes, keys, samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.functions import scalars
from gridloom.operators import order, ranking, relational, sampling
from gridloom.plans.base import query
from gridloom.plans.similarity import _DRAW


@query("SELECT d.doc_id, source, lang FROM documents d ANTI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) USING (doc_id)")
def blacklist_anti_join(t):
    return relational.anti_blacklist(t.documents.select("doc_id", "source", "lang"), t.labels.where("toxic = 1"), "doc_id")


@query(
    "SELECT d.doc_id, coalesce(toxic, 0)::INTEGER AS toxic FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(toxic, 0) = 0"
)
def blacklist_fill_left_join(t):
    rows = t.documents.select("doc_id").join(t.labels.select("doc_id", "toxic"), "doc_id", "left")
    return rows.select("doc_id", F.coalesce("toxic", F.lit(0)).cast("int").alias("toxic")).where("toxic = 0")


@query("SELECT doc_id, source FROM documents SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1) USING (doc_id)")
def semi_join_membership(t):
    return t.documents.select("doc_id", "source").join(t.labels.where("quality = 1"), "doc_id", "left_semi")


@query(
    """WITH n AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL),
m AS (SELECT l_returnflag, l_linestatus, count(l_quantity) AS k FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 OR l_discount > 0.09 GROUP BY ALL)
SELECT l_returnflag, l_linestatus, n, round(100 * k::DOUBLE / n, 6) AS pct FROM n LEFT JOIN m USING (l_returnflag, l_linestatus)"""
)
def multi_key_left_join_percentage(t):
    keys = ["l_returnflag", "l_linestatus"]
    n = t.lineitem.groupBy(*keys).agg(F.count("*").alias("n"))
    some = t.lineitem.where(F.col("l_quantity").between(10, 20) | (F.col("l_discount") > 0.09))
    m = some.groupBy(*keys).agg(F.count("l_quantity").alias("k"))
    return n.join(m, keys, "left").select(*keys, "n", F.round(100 * F.col("k").cast("double") / F.col("n"), 6).alias("pct"))


@query(
    """WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem),
b AS (SELECT l_orderkey, l_linenumber + 1 AS l_linenumber, l_quantity AS before FROM lineitem)
SELECT l_orderkey, l_linenumber, round(sum(l_quantity - before), 6) AS step, count(*) AS n FROM a JOIN b USING (l_orderkey, l_linenumber) GROUP BY ALL"""
)
def positional_keys_as_join(t):
    a = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    b = t.lineitem.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_quantity").alias("before"))
    rows = a.join(b, ["l_orderkey", "l_linenumber"]).groupBy("l_orderkey", "l_linenumber")
    return rows.agg(F.round(F.sum(F.col("l_quantity") - F.col("before")), 6).alias("step"), F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 15)")
def group_size_filter_strict(t):
    return relational.group_size_filter(t.orders.select("o_orderkey", "o_custkey"), ["o_custkey"], 15, inclusive=False)


@query("SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM documents GROUP BY source HAVING count(*) >= 50)")
def group_size_filter_inclusive(t):
    return relational.group_size_filter(t.documents.select("doc_id", "source"), ["source"], 50, inclusive=True)


@query(
    """WITH p AS (SELECT quantile_cont(l_extendedprice, 0.05) AS lo, quantile_cont(l_extendedprice, 0.95) AS hi FROM lineitem)
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem, p WHERE l_extendedprice > lo AND l_extendedprice < hi"""
)
def percentile_band_filter(t):
    x = F.col("l_extendedprice")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", x)
    ends = order.quantiles(rows, x, {"lo": 0.05, "hi": 0.95}).drop("n")
    return rows.join(F.broadcast(ends)).where((x > F.col("lo")) & (x < F.col("hi"))).drop("lo", "hi")


@query(
    """SELECT o_custkey, o_orderkey, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1"""
)
def argmax_row_per_group(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    return relational.argmax_rows(rows, ["o_custkey"], "o_totalprice", "o_orderkey")


@query("SELECT event_type, event_id // 10 AS run, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def chunked_run_mean(t):
    run = F.floor(F.col("event_id") / 10).alias("run")
    return t.events.groupBy("event_type", run).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


_FLOW = """WITH flow AS (
  SELECT c.c_nationkey AS a, s.s_nationkey AS b, sum(l_quantity) AS v
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey JOIN supplier s ON l_suppkey = s_suppkey
  WHERE l_linenumber = 1 GROUP BY ALL)"""


def _flow(t):
    rows = t.lineitem.where("l_linenumber = 1").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b")).agg(F.sum("l_quantity").alias("v"))


@query(
    f"""{_FLOW} SELECT coalesce(x.a, y.b) AS a, coalesce(x.b, y.a) AS b, round(coalesce(x.v, y.v), 6) AS v
FROM flow x FULL JOIN flow y ON x.a = y.b AND x.b = y.a"""
)
def crosstab_sum_symmetrised(t):
    return relational.symmetrised(_flow(t), "a", "b", "v").withColumn("v", F.round("v", 6))


@query(
    f"""{_FLOW}, n AS (SELECT n_nationkey AS k FROM nation),
g AS (SELECT p.k AS a, q.k AS b FROM n p, n q)
SELECT a, b, round(nullif(CASE WHEN a < b THEN coalesce(u.v, 0) WHEN a > b THEN coalesce(l.v, 0) ELSE coalesce(u.v, 0) + coalesce(l.v, 0) END, 0), 6) AS v
FROM g LEFT JOIN flow u USING (a, b) LEFT JOIN flow l ON l.a = g.b AND l.b = g.a"""
)
def upper_lower_combine(t):
    flow, k = _flow(t), t.nation.select(F.col("n_nationkey").alias("a"))
    grid = k.crossJoin(F.broadcast(k.withColumnRenamed("a", "b")))  # 25 fixed nations
    back = flow.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("v").alias("w"))
    rows = grid.join(flow, ["a", "b"], "left").join(back, ["a", "b"], "left").fillna(0.0, ["v", "w"])
    v = F.when(F.col("a") < F.col("b"), F.col("v")).when(F.col("a") > F.col("b"), F.col("w")).otherwise(F.col("v") + F.col("w"))
    return rows.select("a", "b", F.round(F.nullif(v, F.lit(0.0)), 6).alias("v"))


@query(
    """WITH p AS (SELECT quantile_cont(l_discount, 0.95) FILTER (l_returnflag = 'N') AS a, quantile_cont(l_tax, 0.95) FILTER (l_returnflag = 'R') AS b FROM lineitem)
SELECT l_linestatus, CASE WHEN l_discount >= a AND l_tax >= b THEN 'full' WHEN l_discount >= a OR l_tax >= b THEN 'partial' ELSE 'none' END AS band, count(*) AS n
FROM lineitem, p GROUP BY ALL"""
)
def threshold_bands(t):
    rows = t.lineitem.select("l_linestatus", "l_returnflag", "l_discount", "l_tax")
    cut = lambda c, flag, name: order.quantiles(rows.where(F.col("l_returnflag") == flag), F.col(c), {name: 0.95}).drop("n")
    rows = rows.join(F.broadcast(cut("l_discount", "N", "a"))).join(F.broadcast(cut("l_tax", "R", "b")))
    x, y = F.col("l_discount") >= F.col("a"), F.col("l_tax") >= F.col("b")
    band = F.when(x & y, "full").when(x | y, "partial").otherwise("none")
    return rows.groupBy("l_linestatus", band.alias("band")).agg(F.count("*").alias("n"))


@query(
    """WITH p AS (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem)
SELECT l_orderkey, l_linenumber, round(least(greatest((l_extendedprice - lo) / (hi - lo), 0), 1), 6) AS scaled FROM lineitem, p"""
)
def robust_rescale_clip(t):
    rows = ranking.robust_rescale(t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice")
    return rows.select("l_orderkey", "l_linenumber", F.round("scaled", 6).alias("scaled"))


@query(
    """WITH p AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)
SELECT l_orderkey, l_linenumber, round(100 * (l_quantity - lo) / (hi - lo), 6) AS scaled FROM lineitem, p"""
)
def minmax_0_100(t):
    rows = ranking.minmax_100(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity")
    return rows.select("l_orderkey", "l_linenumber", F.round("scaled", 6).alias("scaled"))


@query("SELECT o_orderkey, o_totalprice >= (SELECT median(o_totalprice) FROM orders) AS high FROM orders")
def median_split_flag(t):
    middle = order.quantiles(t.orders, F.col("o_totalprice"), {"m": 0.5}).drop("n")
    rows = t.orders.select("o_orderkey", "o_totalprice").join(F.broadcast(middle))
    return rows.select("o_orderkey", (F.col("o_totalprice") >= F.col("m")).alias("high"))


@query("SELECT p_partkey, (dense_rank() OVER (ORDER BY p_brand) - 1)::INTEGER AS label FROM part")
def dense_label_ids(t):
    return ranking.dense_labels(t.part.select("p_partkey", "p_brand"), "p_brand", "label").select("p_partkey", "label")


@query(
    """WITH big AS (SELECT vec_id // 100 AS slide, label FROM embeddings GROUP BY ALL HAVING count(*) >= 9)
SELECT vec_id // 100 AS slide, vec_id, new FROM embeddings JOIN (
  SELECT slide, label, (dense_rank() OVER (PARTITION BY slide ORDER BY label))::INTEGER AS new FROM big) b
ON b.slide = vec_id // 100 AND b.label = embeddings.label"""
)
def dense_relabel(t):
    e = t.embeddings.select(F.floor(F.col("vec_id") / 100).alias("slide"), "vec_id", "label")
    big = e.groupBy("slide", "label").count().where("count >= 9")
    new = big.withColumn("new", F.dense_rank().over(Window.partitionBy("slide").orderBy("label"))).drop("count")
    return e.join(new, ["slide", "label"]).select("slide", "vec_id", "new")


@query(
    f"""SELECT label, vec_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY {_DRAW.format("'11|' || vec_id")}, vec_id) <= 5"""
)
def hash_sample_without_replacement(t):
    return ranking.sample_without(t.embeddings.select("label", "vec_id"), ["label"], "vec_id", 5, 11)


@query(
    f"""WITH r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS rank, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
SELECT label, j::INTEGER AS draw, vec_id FROM r, range(30) d(j) WHERE rank = {_DRAW.format("'13|' || j")} % n"""
)
def hash_sample_with_replacement(t):
    return ranking.sample_with(t.embeddings.select("label", "vec_id"), ["label"], "vec_id", 30, 13)


@query(
    f"""SELECT label, vec_id, 2 * row_number() OVER (PARTITION BY label ORDER BY {_DRAW.format("'17|' || vec_id")}, vec_id)
  <= count(*) OVER (PARTITION BY label) AS train FROM embeddings"""
)
def stratified_half_split(t):
    return ranking.half_split(t.embeddings.select("label", "vec_id"), ["label"], "vec_id", 17)


@query(
    """WITH g AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)),
h AS (SELECT *, n // 3 AS s, n % 3 AS x FROM g)
SELECT source, (CASE WHEN i < x * (s + 1) THEN i // (s + 1) ELSE x + (i - x * (s + 1)) // s END)::INTEGER AS fold FROM h"""
)
def group_kfold_assignment(t):
    return ranking.group_folds(t.documents, "source", 3)


@query("SELECT label, vec_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 4")
def first_n_of_group(t):
    return ranking.first_members(t.embeddings.select("label", "vec_id"), ["label"], "vec_id", 4)


@query(
    """WITH r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS rank, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
SELECT label, i::INTEGER AS slot, vec_id FROM r, range(7) s(i) WHERE rank = (i * (n - 1)) // 6"""
)
def evenly_spaced_members(t):
    return ranking.spaced_members(t.embeddings.select("label", "vec_id"), ["label"], "vec_id", 7)


@query(
    """SELECT least(a.o_orderpriority, b.o_orderpriority) || '-' || greatest(a.o_orderpriority, b.o_orderpriority) AS pair, count(*) AS n
FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey GROUP BY pair"""
)
def unordered_pair_label(t):
    o = t.orders.select("o_custkey", "o_orderkey", "o_orderpriority")
    pairs = o.join(o.toDF("o_custkey", "k", "p"), "o_custkey").where("o_orderkey < k")
    return pairs.groupBy(scalars.pair_label(F.col("o_orderpriority"), F.col("p")).alias("pair")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, (i - 1)::INTEGER AS i, w FROM (SELECT p_partkey, generate_subscripts(string_split(p_name, ' '), 1) AS i, unnest(string_split(p_name, ' ')) AS w FROM part)")
def explode_ragged(t):
    return t.part.select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("i", "w"))


@query(
    """SELECT l_returnflag, measure, round(avg(v), 6) AS mean FROM (
  UNPIVOT (SELECT l_returnflag, l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME measure VALUE v) GROUP BY ALL"""
)
def unpivot_measures(t):
    long = t.lineitem.select("l_returnflag", "l_quantity", "l_discount", "l_tax").unpivot("l_returnflag", ["l_quantity", "l_discount", "l_tax"], "measure", "v")
    return long.groupBy("l_returnflag", "measure").agg(F.round(F.avg("v"), 6).alias("mean"))


@query(
    """SELECT 'c' AS kind, c_nationkey AS nation, c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY ALL
UNION ALL SELECT 's', s_nationkey, NULL, count(*) FROM supplier GROUP BY ALL"""
)
def union_by_name(t):
    c = t.customer.select(F.lit("c").alias("kind"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    s = t.supplier.select(F.lit("s").alias("kind"), F.col("s_nationkey").alias("nation"))
    return c.unionByName(s, allowMissingColumns=True).groupBy("kind", "nation", "segment").agg(F.count("*").alias("n"))


@query(
    """SELECT c_custkey, split_part(c_name, '#', 1) AS kind, try_cast(split_part(c_name, '#', 2) AS BIGINT) AS number,
  c_name[:-2] AS short, upper(c_mktsegment) AS segment, replace(c_name, 'Customer', 'C') AS brief FROM customer"""
)
def string_key_parsing(t):
    n = F.col("c_name")
    return t.customer.select(
        "c_custkey",
        F.split_part(n, F.lit("#"), F.lit(1)).alias("kind"),
        F.split_part(n, F.lit("#"), F.lit(2)).try_cast("long").alias("number"),
        scalars.without_last(n).alias("short"),
        F.upper("c_mktsegment").alias("segment"),
        F.replace(n, F.lit("Customer"), F.lit("C")).alias("brief"),
    )


@query(
    """SELECT o_orderkey, try_cast(split_part(o_orderpriority, '-', 1) AS INTEGER) AS number,
  CASE WHEN regexp_full_match('G' || left(o_orderpriority, 1), 'G[1-4]') THEN left(o_orderpriority, 1)::INTEGER END AS grade FROM orders"""
)
def status_prefix_parse(t):
    p = F.col("o_orderpriority")
    return t.orders.select("o_orderkey", scalars.status_number(p, "-").alias("number"), scalars.grade(F.concat(F.lit("G"), F.left(p, F.lit(1)))).alias("grade"))


@query(
    """SELECT page_id, string_split(url, '/')[-1] AS base, split_part(string_split(url, '/')[-1], '.', 1) AS stem,
  regexp_extract(url, '(?s)^(.*)/([^/]*)$', 1) AS parent FROM pages"""
)
def path_basename(t):
    u = F.col("url")
    return t.pages.select("page_id", scalars.basename(u).alias("base"), scalars.stem(u).alias("stem"), scalars.split_right(u, "/")[0].alias("parent"))


@query("SELECT r_regionkey, r_name, CASE r_name WHEN 'ASIA' THEN 1 WHEN 'EUROPE' THEN 2 END AS code FROM region")
def value_map_nullable(t):
    return t.region.select("r_regionkey", "r_name", scalars.mapped(F.col("r_name"), {"ASIA": 1, "EUROPE": 2}).alias("code"))


@query(
    """WITH fix AS (SELECT * FROM (VALUES (1, 'SN-1'), (3, 'LN-2')) f(k, name))
SELECT n_nationkey, CASE WHEN contains(x, 'SN') THEN replace(x, 'SN', 'Small nest') ELSE replace(x, 'LN', 'Large nest') END AS name
FROM (SELECT n_nationkey, coalesce(name, n_name) AS x FROM nation LEFT JOIN fix ON n_nationkey = k)"""
)
def corrections_overlay(t):
    fix = t.spark.createDataFrame([(1, "SN-1"), (3, "LN-2")], "n_nationkey int, name string")
    x = F.coalesce("name", "n_name")
    name = F.when(x.contains("SN"), F.replace(x, F.lit("SN"), F.lit("Small nest"))).otherwise(F.replace(x, F.lit("LN"), F.lit("Large nest")))
    return t.nation.join(F.broadcast(fix), "n_nationkey", "left").select("n_nationkey", name.alias("name"))


@query(
    """WITH v AS (SELECT DISTINCT p_retailprice AS v FROM part),
n AS (SELECT v, lag(v) OVER (ORDER BY v) AS b, lead(v) OVER (ORDER BY v) AS a FROM v),
k AS (SELECT p_retailprice AS v, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1),
j AS (SELECT p.p_partkey, n.*, k.n AS same FROM part p JOIN n ON p.p_retailprice = n.v JOIN k ON k.v = n.v)
SELECT p_partkey AS id,
  CASE WHEN same > 1 THEN (SELECT min(q.p_partkey) FROM part q WHERE q.p_retailprice = j.v AND q.p_partkey <> j.p_partkey)
    WHEN b IS NOT NULL AND (a IS NULL OR v - b <= a - v) THEN (SELECT first FROM k WHERE k.v = b) ELSE (SELECT first FROM k WHERE k.v = a) END AS nearest,
  round(CASE WHEN same > 1 THEN 0 WHEN b IS NOT NULL AND (a IS NULL OR v - b <= a - v) THEN v - b ELSE a - v END, 6) AS gap FROM j"""
)
def nearest_value_excluding_self(t):
    return relational.nearest_value(t.part, "p_partkey", "p_retailprice").withColumn("gap", F.round("gap", 6))


@query(
    """WITH p AS (SELECT l_partkey % 1000 AS y, l_suppkey * 10 AS x, l_quantity AS area FROM lineitem),
r AS (SELECT unnest(range(0, (SELECT max(y) // 100 + 1 FROM p))) AS a), s AS (SELECT unnest(range(0, (SELECT max(x) // 100 + 1 FROM p))) AS b),
w AS (SELECT a::INTEGER AS wr, b::INTEGER AS wc FROM r, s)
SELECT wr, wc, count(*) AS n, round(median(area), 6) AS area FROM w JOIN p ON y BETWEEN wr * 100 AND wr * 100 + 224 AND x BETWEEN wc * 100 AND wc * 100 + 224
GROUP BY ALL"""
)
def window_containment_join(t):
    points = t.lineitem.select((F.col("l_partkey") % 1000).alias("y"), (F.col("l_suppkey") * 10).alias("x"), F.col("l_quantity").alias("area"))
    rows = relational.containing_windows(points, "y", "x", 224, 100)
    return rows.groupBy("wr", "wc").agg(F.count("*").alias("n"), F.round(F.median("area"), 6).alias("area"))


@query(
    """WITH c AS (SELECT event_id % 50 AS y, user_id % 40 AS x FROM events WHERE event_type = 'click'),
w AS (SELECT a::INTEGER AS wr, b::INTEGER AS wc FROM range(0, 5) r(a), range(0, 4) s(b))
SELECT wr, wc, round(count(DISTINCT (y, x)) / 169.0::DOUBLE, 6) AS density FROM w JOIN c ON y BETWEEN wr * 10 AND wr * 10 + 12 AND x BETWEEN wc * 10 AND wc * 10 + 12 GROUP BY ALL"""
)
def window_marker_density(t):
    cells = t.events.where("event_type = 'click'").select((F.col("event_id") % 50).alias("y"), (F.col("user_id") % 40).alias("x")).distinct()
    rows = relational.containing_windows(cells, "y", "x", 12, 10)
    return rows.groupBy("wr", "wc").agg(F.round(F.count("*") / 169.0, 6).alias("density"))


@query(
    """WITH ring AS (SELECT p_partkey, [0.0, p_size, p_size + 2.0, 1.0]::DOUBLE[] AS xs, [0.0, 1.0, p_size / 2.0, p_size]::DOUBLE[] AS ys FROM part)
SELECT p_partkey, round(abs(xs[1] * ys[2] + xs[2] * ys[3] + xs[3] * ys[4] + xs[4] * ys[1] - ys[1] * xs[2] - ys[2] * xs[3] - ys[3] * xs[4] - ys[4] * xs[1]) / 2, 6) AS area,
  list_max(xs) - list_min(xs) AS width FROM ring"""
)
def polygon_area_shoelace(t):
    n = F.col("p_size").cast("double")
    ring = t.part.select("p_partkey", F.array(F.lit(0.0), n, n + 2, F.lit(1.0)).alias("xs"), F.array(F.lit(0.0), F.lit(1.0), n / 2, n).alias("ys"))
    area = scalars.polygon_area(F.col("xs"), F.col("ys"))
    return ring.select("p_partkey", F.round(area, 6).alias("area"), (F.array_max("xs") - F.array_min("xs")).alias("width"))


@query(
    """WITH f AS (SELECT p_partkey, p_size / 5.0::DOUBLE AS f FROM part), l AS (SELECT * FROM (VALUES (0, 1.0::DOUBLE), (1, 4.0), (2, 8.0)) l(i, d))
SELECT p_partkey, coalesce((SELECT i FROM l WHERE abs(d - f) < 0.025 ORDER BY abs(d - f) LIMIT 1), (SELECT max(i) FROM l WHERE d < f), 0)::INTEGER AS level,
  NOT EXISTS (SELECT 1 FROM l WHERE abs(d - f) < 0.025) AS resize FROM f"""
)
def pyramid_level_choice(t):
    found = scalars.pyramid_level(F.array(F.lit(1.0), F.lit(4.0), F.lit(8.0)), F.col("p_size") / 5.0)
    return t.part.select("p_partkey", found.alias("l")).select("p_partkey", "l.level", "l.resize")


@query("SELECT p_partkey, round_even(0.5 / ((p_size * 0.01 + p_size * 0.03) / 2), 0)::INTEGER AS factor FROM part WHERE p_size > 0")
def resolution_factor(t):
    n = F.col("p_size").cast("double")
    props = F.create_map(F.lit("x.MPP"), n * 0.01, F.lit("y.mpp"), n * 0.03, F.lit("width"), n)
    return t.part.where("p_size > 0").select("p_partkey", scalars.resolution_factor(props).alias("factor"))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def incremental_skip_existing(t):
    from gridloom.sources.incremental import not_yet_written

    return not_yet_written(t.documents.select("doc_id", "source"), t.labels, ["doc_id"])


@query(
    f"""WITH n AS (SELECT label, count(*) AS n, row_number() OVER (ORDER BY label) - 1 AS i, count(*) OVER () AS k FROM embeddings GROUP BY label),
m AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r FROM embeddings),
s AS (SELECT b, s, {_DRAW.format("'37|' || b || '|' || s || '|label'")} AS l, {_DRAW.format("'37|' || b || '|' || s || '|a'")} AS a, {_DRAW.format("'37|' || b || '|' || s || '|b'")} AS q
  FROM range(4) x(b), range(8) y(s))
SELECT s.b AS batch, s.s::INTEGER AS slot, n.label, x.vec_id AS a, y.vec_id AS b FROM s JOIN n ON n.i = s.l % n.k
JOIN m x ON x.label = n.label AND x.r = s.a % n.n JOIN m y ON y.label = n.label AND y.r = s.q % n.n"""
)
def paired_batch_sampler(t):
    return sampling.paired_batches(t.embeddings, "label", "vec_id", 4, 8, 37)


@query(
    f"""WITH g AS (SELECT vec_id // 100 AS slide, (vec_id % 100) // 10 AS r, vec_id % 10 AS c, vec_id, row_number() OVER (PARTITION BY vec_id // 100 ORDER BY vec_id) - 1 AS k,
  count(*) OVER (PARTITION BY vec_id // 100) AS n FROM embeddings),
t AS (SELECT a.slide, a.vec_id AS id, b.vec_id AS other, i FROM g a, range(6) x(i) JOIN g b ON b.slide = a.slide AND b.k = {_DRAW.format("'41|' || a.vec_id || '|' || i")} % a.n
  WHERE (a.r - b.r) ** 2 + (a.c - b.c) ** 2 >= 25),
m AS (SELECT slide, id, other, i FROM t QUALIFY row_number() OVER (PARTITION BY id ORDER BY i) = 1),
rest AS (SELECT a.slide, a.vec_id AS id, b.vec_id AS other FROM g a JOIN g b ON a.slide = b.slide
  WHERE (a.r - b.r) ** 2 + (a.c - b.c) ** 2 >= 25 AND a.vec_id NOT IN (SELECT id FROM m)
  QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DRAW.format("'41|' || a.vec_id || '|' || b.vec_id || '|rest'")}, b.vec_id) = 1)
SELECT slide::INTEGER AS slide, id, other, i::INTEGER AS attempt FROM m UNION ALL SELECT slide::INTEGER, id, other, NULL FROM rest"""
)
def distant_pair_draws(t):
    return sampling.distant_pairs(t.grid(), "vec_id", 5.0, 6, 41)


@query("SELECT vec_id, (vec_id % 3)::INTEGER AS shard FROM embeddings")
def sampler_shards(t):
    return t.embeddings.select("vec_id", sampling.shard(F.col("vec_id"), 3).alias("shard"))


@query(
    f"""WITH cells AS (SELECT (vec_id // 100)::INTEGER AS slide, label, ((vec_id % 100) // 10)::INTEGER AS r, (vec_id % 10)::INTEGER AS c FROM embeddings),
inner_ AS (SELECT * FROM cells WHERE r BETWEEN 1 AND 8 AND c BETWEEN 1 AND 8),
ranked AS (SELECT *, row_number() OVER (PARTITION BY slide, label ORDER BY r, c) - 1 AS k, count(*) OVER (PARTITION BY slide, label) AS n FROM inner_),
budget AS (SELECT slide, label, n, least(5, floor(n * 1.5 / 4))::INTEGER AS b FROM ranked GROUP BY ALL),
picks AS (SELECT slide, label, n, unnest(range(b)) AS pick FROM budget WHERE b > 0)
SELECT p.slide, p.label, pick::INTEGER AS pick, (r * 16 + {_DRAW.format("'47|' || p.slide || '|' || p.label || '|' || pick || '|y'")} % 8 - 8)::INTEGER AS y,
  (c * 16 + {_DRAW.format("'47|' || p.slide || '|' || p.label || '|' || pick || '|x'")} % 8 - 8)::INTEGER AS x
FROM picks p JOIN ranked ON ranked.slide = p.slide AND ranked.label = p.label AND ranked.k = {_DRAW.format("'47|' || p.slide || '|' || p.label || '|' || pick || '|cell'")} % p.n"""
)
def patch_centres(t):
    cells = sampling.inner_cells(t.grid().select("slide", "label", "r", "c"), 10, 10, 2)
    return sampling.patch_centres(cells, ["slide", "label"], 2, 5, 0.5, 16, 47)


@query("SELECT p_partkey, least(200, floor(p_retailprice * 100 * 1.5 / (224 * 224)))::INTEGER AS n FROM part")
def patch_budgets(t):
    return t.part.select("p_partkey", sampling.patch_budget(F.col("p_retailprice") * 100, 224, 200, 0.5).alias("n"))
