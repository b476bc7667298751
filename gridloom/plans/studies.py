"""Studies that put several operators together: partners by selection mode, distances of samples against an external matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import relational, selection, vectors
from gridloom.plans.base import GRID, query

_DRAW = "('0x' || substr(md5({}), 1, 8))::BIGINT"
_METRICS = ("vector", "p_size", "p_retailprice", "class")

#: Cells with stand-ins for three features; a slide of 10 x 10 cells has a cutoff of 3 cells and 100 reference draws.
_CELLS = f"""{GRID},
cell AS (SELECT slide, r, c, vec_id AS id, embedding AS e, p_size::DOUBLE AS p_size, p_retailprice::DOUBLE AS p_retailprice, label::DOUBLE AS class,
    row_number() OVER (PARTITION BY slide ORDER BY vec_id) - 1 AS k, count(*) OVER (PARTITION BY slide) AS n
  FROM grid JOIN part ON p_partkey = vec_id + 1)"""
_GAPS = "abs(round(list_cosine_distance(x.e, o.e), 9)) AS vector, " + ", ".join(
    f"abs(round(x.{f} - o.{f}, 6)) AS {f}" for f in _METRICS[1:]
)
_BY = " UNION ALL ".join(
    f"(SELECT *, '{m}' AS mode FROM d WHERE {'apart' if m == 'vector' else 'true'} QUALIFY row_number() OVER (PARTITION BY slide, pair ORDER BY {m}, other) = 1)"
    for m in _METRICS
)
_LONG = lambda columns, table: " UNION ALL ".join(f"SELECT {columns}, '{m}' AS metric, {m} AS v FROM {table}" for m in _METRICS)


@query(
    f"""WITH {_CELLS},
draws AS (SELECT slide, pair, attempt, {_DRAW.format("'41|' || slide || '|' || pair || '|' || attempt || '|a'")} % n AS ka,
    {_DRAW.format("'41|' || slide || '|' || pair || '|' || attempt || '|b'")} % n AS kb
  FROM (SELECT DISTINCT slide, n FROM cell), range(100) p(pair), range(16) t(attempt)),
q AS (SELECT t.slide, t.pair, a.id AS a, b.id AS b FROM draws t JOIN cell a ON a.slide = t.slide AND a.k = t.ka JOIN cell b ON b.slide = t.slide AND b.k = t.kb
  WHERE (a.r - b.r) ** 2 + (a.c - b.c) ** 2 >= 9 QUALIFY row_number() OVER (PARTITION BY t.slide, t.pair ORDER BY attempt) = 1),
d AS (SELECT q.slide, q.pair, o.id AS other, o.id = q.b AS drawn, {_GAPS}, x.r <> o.r AND x.c <> o.c AND (x.r - o.r) ** 2 + (x.c - o.c) ** 2 > 9 AS apart
  FROM q JOIN cell x ON x.id = q.a JOIN cell o ON o.slide = q.slide AND o.id <> q.a),
m AS ((SELECT *, 'random' AS mode FROM d WHERE drawn) UNION ALL {_BY}),
asked AS ({_LONG("slide, pair, mode", "m")}),
s AS (SELECT t.slide, j, c.* EXCLUDE (slide) FROM (SELECT slide, j, {_DRAW.format("'43|' || j")} % n AS k FROM (SELECT DISTINCT slide, n FROM cell), range(100) g(j)) t
  JOIN cell c ON c.slide = t.slide AND c.k = t.k),
two AS (SELECT x.slide, {_GAPS} FROM s x JOIN s o ON x.slide = o.slide AND x.j < o.j),
base AS ({_LONG("slide", "two")}),
value AS (SELECT slide, metric, list(v) AS vs FROM base GROUP BY ALL)
SELECT slide, pair::INTEGER AS pair, mode, metric, round(100.0 * len(list_filter(vs, lambda y: y < v)) / len(vs), 6) AS percent FROM asked JOIN value USING (slide, metric)"""
)
def selection_study_modes(t):
    part = t.part.select((F.col("p_partkey") - 1).alias("vec_id"), "p_size", "p_retailprice")
    cells = t.grid().withColumnRenamed("label", "class").join(part, "vec_id")
    study = selection.selection_study(cells, "vec_id", "embedding", list(_METRICS[1:]), pairs=100, least=3, reference=100)
    return study.withColumn("percent", F.round("percent", 6))


#: Parts stand for samples: their price gives the external distances of one slide's labels, their size a grade.
_SAMPLES = """sample AS (SELECT (p_partkey - 1) // 10 AS slide, (p_partkey - 1) % 10 AS id, p_retailprice AS price, p_size % 3 AS grade FROM part),
matrix AS (SELECT a.slide, a.id AS a, b.id AS b, abs(a.price - b.price) AS genetic,
  least(a.grade, b.grade) || '-' || greatest(a.grade, b.grade) AS transition FROM sample a JOIN sample b ON a.slide = b.slide AND a.id <> b.id)"""
_PAIRED = f"""{GRID}, {_SAMPLES},
parts AS (SELECT slide, label, i, avg(v) AS x FROM (SELECT slide, label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS v FROM grid) GROUP BY ALL),
mean AS (SELECT slide, label, list(x ORDER BY i) AS v FROM parts GROUP BY ALL),
paired AS (SELECT p.slide, p.label AS a, q.label AS b, list_cosine_distance(p.v, q.v) AS dist, genetic, transition
  FROM mean p JOIN mean q ON p.slide = q.slide AND p.label < q.label JOIN matrix m ON m.slide = p.slide AND m.a = p.label AND m.b = q.label)"""


def _paired(t):
    n = F.col("p_partkey") - 1
    sample = t.part.select(F.floor(n / 10).alias("slide"), (n % 10).alias("id"), F.col("p_retailprice").alias("price"), (F.col("p_size") % 3).alias("grade"))
    other = sample.toDF("slide", "b", "price_b", "grade_b")
    grades = F.concat_ws("-", F.least("grade", "grade_b"), F.greatest("grade", "grade_b"))
    matrix = sample.join(other, "slide").where("id <> b")  # ordered pairs, as the distance table holds them
    matrix = matrix.select("slide", F.col("id").alias("a"), "b", F.abs(F.col("price") - F.col("price_b")).alias("genetic"), grades.alias("transition"))
    means = vectors.centroid_vectors(t.grid(), ["slide", "label"], "embedding")
    return relational.with_matrix(vectors.pairs_within(means, ["slide"], "label", "centre"), matrix, ["slide"])


@query(f"WITH {_PAIRED} SELECT slide, a, b, round(dist, 6) AS dist, round(genetic, 4) AS genetic, transition FROM paired")
def sample_pairs_with_external_distance(t):
    return _paired(t).select("slide", "a", "b", F.round("dist", 6).alias("dist"), F.round("genetic", 4).alias("genetic"), "transition")


@query(f"WITH {_PAIRED} SELECT slide, count(*) AS n, round(corr(dist, genetic), 6) AS r FROM paired GROUP BY slide")
def external_distance_association(t):
    return _paired(t).groupBy("slide").agg(F.count("*").alias("n"), F.round(F.corr("dist", "genetic"), 6).alias("r"))
