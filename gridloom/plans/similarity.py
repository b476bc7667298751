"""Queries on vectors: retrieval, medoids, heterogeneity, rank studies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.functions.vectors import argmax, as_doubles, cosine_distance
from gridloom.operators import order, ranking, relational, vectors
from gridloom.plans.base import GRID, query

_DRAW = "('0x' || substr(md5({}), 1, 8))::BIGINT"

KNN = """
d AS (
  SELECT a.vec_id AS query, b.vec_id AS neighbour, round(list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12) AS dist
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
nn AS (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY dist, neighbour) AS rank FROM d
  QUALIFY row_number() OVER (PARTITION BY query ORDER BY dist, neighbour) <= 10)"""


@query(
    f"""WITH {KNN} SELECT rank::INTEGER AS rank, count(*) AS n, round(avg((a.label = b.label)::INTEGER), 6) AS same_label
FROM nn JOIN embeddings a ON a.vec_id = query JOIN embeddings b ON b.vec_id = neighbour GROUP BY rank"""
)
def knn_label_precision_by_rank(t):
    found = vectors.nearest(t.embeddings, 10)
    out = vectors.label_precision(found, t.embeddings, "vec_id", ["label"])
    return out.withColumn("same_label", F.round("same_label", 6))


@query(
    f"""WITH {KNN} SELECT query, rank::INTEGER AS rank, neighbour, round(dist, 6) AS dist FROM nn"""
)
def knn_neighbours(t):
    return vectors.nearest(t.embeddings, 10).withColumn("dist", F.round("dist", 6))


@query(
    f"""WITH {KNN}, big AS (SELECT label FROM embeddings GROUP BY label HAVING count(*) >= 50)
SELECT rank::INTEGER AS rank, count(*) AS n, round(avg((a.label = b.label)::INTEGER), 6) AS same_label,
  round(avg((a.vec_id % 4 = b.vec_id % 4)::INTEGER), 6) AS same_site
FROM nn JOIN embeddings a ON a.vec_id = query JOIN embeddings b ON b.vec_id = neighbour
WHERE a.label IN (SELECT label FROM big) GROUP BY rank"""
)
def knn_dual_attribute_precision(t):
    e = t.embeddings.withColumn("site", F.col("vec_id") % 4)
    big = relational.group_size_filter(e, ["label"], 50, inclusive=True)
    found = vectors.nearest(t.embeddings, 10).join(big.select(F.col("vec_id").alias("query")), "query", "left_semi")
    out = vectors.label_precision(found, e, "vec_id", ["label", "site"])
    return out.withColumns({c: F.round(c, 6) for c in ("same_label", "same_site")})


@query(
    """SELECT label, (i - 1)::INTEGER AS dim, round(avg(x), 6) AS mean FROM (
  SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label, i"""
)
def group_centroid_long(t):
    return vectors.centroids(t.embeddings, ["label"], "embedding").withColumn("mean", F.round("mean", 6))


def _medoids(keys: str, source: str) -> str:
    return f"""
x AS (SELECT {keys}, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM {source}),
centre AS (SELECT {keys}, list(m ORDER BY i) AS centre FROM (SELECT {keys}, i, avg(v) AS m FROM x GROUP BY {keys}, i) GROUP BY {keys}),
far AS (
  SELECT {keys}, vec_id, embedding::DOUBLE[] AS embedding,
    round(list_sum([(p - q) * (p - q) for p, q in list_zip(embedding::DOUBLE[], centre)]), 12) AS d
  FROM {source} JOIN centre USING ({keys})),
medoid AS (
  SELECT {keys}, arg_min(vec_id, (d, vec_id)) AS medoid, count(*) AS n, arg_min(embedding, (d, vec_id)) AS vector
  FROM far GROUP BY {keys})""".replace(
        "list_sum([(p - q) * (p - q) for p, q in list_zip(embedding::DOUBLE[], centre)])",
        "list_sum(list_transform(list_zip(embedding::DOUBLE[], centre), lambda z: (z[1] - z[2]) * (z[1] - z[2])))",
    )


@query(f"WITH {_medoids('label', 'embeddings')} SELECT label, medoid, n FROM medoid")
def group_medoid(t):
    return vectors.medoids(t.embeddings, ["label"], "vec_id", "embedding").drop("vector")


@query(
    """WITH p AS (
  SELECT a.label, list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id),
m AS (SELECT label, median(d) AS m, count(*) AS n FROM p GROUP BY label)
SELECT label, n, round(m, 6) AS median_dist, m = (SELECT max(m) FROM m) AS widest, m = (SELECT min(m) FROM m) AS tightest FROM m"""
)
def within_group_median_distance(t):
    rows = vectors.pair_quantile(t.embeddings, ["label"], "vec_id", "embedding")
    rows = relational.with_scalars(rows, F.max("m").alias("hi"), F.min("m").alias("lo"))
    return rows.select(
        "label", "n", F.round("m", 6).alias("median_dist"), (F.col("m") == F.col("hi")).alias("widest"), (F.col("m") == F.col("lo")).alias("tightest")
    )


_SITES = f"WITH {GRID}, {_medoids('slide, label', 'grid')}"
_PAIRS = f"""{_SITES}, pairs AS (
  SELECT a.slide, a.label AS a, b.label AS b, list_cosine_distance(a.vector, b.vector) AS dist, a.n AS size_a, b.n AS size_b
  FROM medoid a JOIN medoid b ON a.slide = b.slide AND a.label < b.label)"""
_BAND = f"""{_PAIRS}, sizes AS (SELECT quantile_cont(n, 0.05) AS lo, quantile_cont(n, 0.95) AS hi FROM medoid),
kept AS (SELECT pairs.* FROM pairs, sizes WHERE size_a > lo AND size_a < hi AND size_b > lo AND size_b < hi),
ends AS (SELECT slide, min(dist) AS lo, max(dist) AS hi FROM kept GROUP BY slide),
weighed AS (SELECT kept.*, exp(coalesce((dist - lo) / nullif(hi - lo, 0), 0)) AS w FROM kept JOIN ends USING (slide))"""


def _site_pairs(t):
    medoids = vectors.medoids(t.grid(), ["slide", "label"], "vec_id", "embedding")
    pairs = vectors.pairs_within(medoids, ["slide"], "label", "vector")
    size = lambda x: medoids.select("slide", F.col("label").alias(x), F.col("n").alias(f"size_{x}"))
    return medoids, pairs.join(size("a"), ["slide", "a"]).join(size("b"), ["slide", "b"])


def _banded(t):
    medoids, pairs = _site_pairs(t)
    ends = order.quantiles(medoids, F.col("n"), {"lo": 0.05, "hi": 0.95}).drop("n")
    inside = lambda c: (F.col(c) > F.col("lo")) & (F.col(c) < F.col("hi"))
    return pairs.join(F.broadcast(ends)).where(inside("size_a") & inside("size_b")).drop("lo", "hi")


@query(f"{_PAIRS} SELECT slide, a, b, round(dist, 6) AS dist, size_a, size_b FROM pairs")
def medoid_pair_distance(t):
    return _site_pairs(t)[1].withColumn("dist", F.round("dist", 6)).select("slide", "a", "b", "dist", "size_a", "size_b")


@query(f"{_BAND} SELECT slide, round(sum(dist * w) / sum(w), 6) AS score FROM weighed GROUP BY slide")
def heterogeneity_score(t):
    return vectors.group_scores(_banded(t), ["slide"], F.col("dist")).withColumn("score", F.round("score", 6))


@query(
    f"""{_BAND} SELECT slide, a, b, round(dist, 6) AS dist FROM kept
QUALIFY row_number() OVER (PARTITION BY slide ORDER BY round(dist, 12) DESC, a, b) = 1"""
)
def heterogeneity_top_pair(t):
    best = Window.partitionBy("slide").orderBy(F.desc(F.round("dist", 12)), "a", "b")
    top = _banded(t).withColumn("i", F.row_number().over(best)).where("i = 1")
    return top.select("slide", "a", "b", F.round("dist", 6).alias("dist"))


@query(
    f"""WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings ORDER BY {_DRAW.format("'7|' || vec_id")}, vec_id LIMIT 100),
p AS (SELECT list_cosine_distance(a.e[1:32], b.e[1:32]) AS x, list_cosine_distance(a.e[33:64], b.e[33:64]) AS y
  FROM s a JOIN s b ON a.vec_id < b.vec_id)
SELECT count(*) AS n, round(corr(x, y), 6) AS r FROM p"""
)
def encoder_agreement_corr(t):
    half = lambda i: F.slice(as_doubles(F.col("embedding")), i, 32)
    drawn = t.embeddings.withColumn("k", ranking.draw_key(7, F.col("vec_id"))).orderBy("k", "vec_id").limit(100)
    s = drawn.select(F.lit(0).alias("g"), "vec_id", F.struct(half(1).alias("x"), half(33).alias("y")).alias("e"))
    both = lambda a, b: F.struct(cosine_distance(a["x"], b["x"]).alias("x"), cosine_distance(a["y"], b["y"]).alias("y"))
    pairs = vectors.pairs_in_blocks(s, ["g"], "vec_id", "e", both)
    return pairs.agg(F.count("*").alias("n"), F.round(F.corr("dist.x", "dist.y"), 6).alias("r"))


@query(
    f"""WITH ref AS (SELECT p_retailprice AS v FROM part ORDER BY {_DRAW.format("'5|' || p_partkey")}, p_partkey LIMIT 1000)
SELECT p_partkey, round((SELECT count(*) FROM ref WHERE v < p_retailprice)::DOUBLE / (SELECT count(*) FROM ref), 6) AS rank FROM part"""
)
def empirical_rank(t):
    ref = t.part.withColumn("k", ranking.draw_key(5, F.col("p_partkey"))).orderBy("k", "p_partkey").limit(1000)
    return ranking.empirical_rank(t.part, ref, "p_retailprice").select("p_partkey", F.round("rank", 6).alias("rank"))


@query(
    """WITH ref AS (
  SELECT round(list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS v FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id),
below AS (SELECT v, sum(count(*)) OVER (ORDER BY v) AS n FROM ref GROUP BY v),
p AS (SELECT a.label, a.vec_id, b.label = a.label AS same, b.vec_id % 4 = a.vec_id % 4 AS site,
    round(list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS d
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
m AS (SELECT vec_id, min(d) AS nearest, min(d) FILTER (same) AS same_label, min(d) FILTER (NOT same AND site) AS same_site,
    min(d) FILTER (NOT same AND NOT site) AS neither FROM p GROUP BY vec_id),
u AS (UNPIVOT m ON nearest, same_label, same_site, neither INTO NAME relation VALUE d)
SELECT vec_id, relation, round(coalesce(n, 0)::DOUBLE / (SELECT count(*) FROM ref), 6) AS rank FROM u ASOF LEFT JOIN below ON u.d > below.v"""
)
def rank_of_distance_by_relation(t):
    e = t.embeddings.withColumn("site", F.col("vec_id") % 4)
    least = vectors.nearest_by_relation(e, ["label", "site"]).select(F.col("query").alias("vec_id"), "relation", F.round("dist", 9).alias("d"))
    below = vectors.pairs_below(t.embeddings, least, "d", "vec_id", "embedding", 9)
    return least.join(below, "d").select("vec_id", "relation", F.round(F.col("below") / F.col("pairs"), 6).alias("rank"))


@query(
    """WITH s AS (SELECT vec_id, (embedding::DOUBLE[])[1:8] AS e FROM embeddings)
SELECT vec_id, (list_position(e, list_max(e)) - 1)::INTEGER AS class, list_position(e, list_max(e)) - 1 = 5 AS is_tumour FROM s"""
)
def score_argmax(t):
    scores = F.slice(as_doubles(F.col("embedding")), 1, 8)
    return t.embeddings.select("vec_id", argmax(scores).alias("class")).withColumn("is_tumour", F.col("class") == 5)


@query(
    f"""{_SITES}, pick AS (
  SELECT slide, bool_or(medoid % 3 = 0) AND bool_or(medoid % 3 = 1) AS sites_cover, count(*) AS s FROM medoid GROUP BY slide),
draws AS (SELECT slide, s, run, j, {_DRAW.format("'3|' || slide || '|' || run || '|' || j")} % 100 AS rank FROM pick, range(25) r(run), range(s) q(j)),
hit AS (SELECT d.slide, d.run, bool_or(vec_id % 3 = 0) AND bool_or(vec_id % 3 = 1) AS ok
  FROM draws d JOIN grid g ON g.slide = d.slide AND g.vec_id % 100 = d.rank GROUP BY d.slide, d.run)
SELECT slide, sites_cover, round(avg(ok::INTEGER), 6) AS random_share FROM pick JOIN hit USING (slide) GROUP BY slide, sites_cover"""
)
def site_sampling_success(t):
    covers = lambda c: F.bool_or(c % 3 == 0) & F.bool_or(c % 3 == 1)
    medoids = vectors.medoids(t.grid(), ["slide", "label"], "vec_id", "embedding")
    pick = medoids.groupBy("slide").agg(covers(F.col("medoid")).alias("sites_cover"), F.count("*").alias("s"))
    draws = pick.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(24)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("s").cast("int") - 1)))
    draws = draws.withColumn("rank", ranking.draw_key(3, F.col("slide"), F.col("run"), F.col("j")) % 100)
    cells = t.grid().select("slide", (F.col("vec_id") % 100).alias("rank"), "vec_id")
    hits = draws.join(cells, ["slide", "rank"]).groupBy("slide", "sites_cover", "run").agg(covers(F.col("vec_id")).alias("ok"))
    return hits.groupBy("slide", "sites_cover").agg(F.round(F.avg(F.col("ok").cast("int")), 6).alias("random_share"))


@query(
    f"""WITH {GRID}, q AS (SELECT * FROM grid),
d AS (SELECT q.slide, q.vec_id, g.vec_id AS other, round(list_cosine_distance(q.embedding, g.embedding), 12) AS dist,
    sqrt((q.r - g.r) ** 2 + (q.c - g.c) ** 2) AS gap
  FROM q JOIN grid g ON q.slide = g.slide AND q.vec_id <> g.vec_id),
far AS (SELECT * FROM d WHERE gap > 3)
SELECT slide, vec_id, other, round(dist, 6) AS dist, round(gap, 6) AS gap FROM far
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, other) = 1"""
)
def nearest_beyond_distance(t):
    g = t.grid()
    q = g.select("slide", F.col("vec_id").alias("q"), F.col("r").alias("qr"), F.col("c").alias("qc"), F.col("embedding").alias("qe"))
    gap = F.sqrt((F.col("r") - F.col("qr")) * (F.col("r") - F.col("qr")) + (F.col("c") - F.col("qc")) * (F.col("c") - F.col("qc")))
    rows = g.join(q, "slide").where("vec_id <> q").withColumn("gap", gap).where("gap > 3")
    rows = rows.withColumn("dist", F.round(cosine_distance(F.col("qe"), F.col("embedding")), 12))
    best = rows.groupBy("slide", "q").agg(F.min(F.struct("dist", "vec_id", "gap")).alias("b"))
    return best.select("slide", F.col("q").alias("vec_id"), F.col("b.vec_id").alias("other"), F.round("b.dist", 6).alias("dist"), F.round("b.gap", 6).alias("gap"))
