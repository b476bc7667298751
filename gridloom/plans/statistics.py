"""Queries of statistics: rank tests, variance, contingency, survival, permutation."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.vectors import cosine_distance, squared_distance
from gridloom.operators import order, ranking, relational, stats, vectors
from gridloom.plans.base import query


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _fisher(t):
    high, done = F.col("o_totalprice") >= 150000, F.col("o_orderstatus") == "F"
    return t.orders.agg(
        F.count_if(high & done).alias("a"), F.count_if(high & ~done).alias("b"), F.count_if(~high & done).alias("c"), F.count_if(~high & ~done).alias("d")
    )


@query(
    """WITH f AS (SELECT o_totalprice >= 150000 AS h, o_orderstatus = 'F' AS e FROM orders)
SELECT count(*) FILTER (h AND e) AS a, count(*) FILTER (h AND NOT e) AS b, count(*) FILTER (NOT h AND e) AS c, count(*) FILTER (NOT h AND NOT e) AS d FROM f"""
)
def fisher_table(t):
    return _fisher(t)


@query(
    """WITH f AS (SELECT o_totalprice >= 150000 AS h, o_orderstatus = 'F' AS e FROM orders),
t AS (SELECT count(*) FILTER (h AND e) AS a, count(*) FILTER (h AND NOT e) AS b, count(*) FILTER (NOT h AND e) AS c, count(*) FILTER (NOT h AND NOT e) AS d FROM f),
m AS (SELECT *, a + b AS r, a + c AS s, a + b + c + d AS n FROM t), k AS (SELECT *, unnest(range(greatest(0, r + s - n), least(r, s) + 1)) AS k FROM m),
p AS (SELECT *, lgamma(s + 1) - CASE WHEN k = 0 THEN 0 ELSE lgamma(k + 1) END - lgamma(s - k + 1) + lgamma(n - s + 1) - lgamma(r - k + 1) - lgamma(n - s - r + k + 1)
  - lgamma(n + 1) + lgamma(r + 1) + lgamma(n - r + 1) AS lp FROM k),
o AS (SELECT *, max(lp) FILTER (k = a) OVER () AS own FROM p)
SELECT a, b, c, d, round(any_value(a::DOUBLE * d / (b * c)), 6) AS odds, round(least(1, sum(exp(lp)) FILTER (lp <= own + 1e-7)), 6) AS p_two, round(least(1, sum(exp(lp)) FILTER (k >= a)), 6) AS p_greater
FROM o GROUP BY a, b, c, d"""
)
def fisher_exact(t):
    return rounded(stats.fisher_exact(_fisher(t)), "odds", "p_two", "p_greater")


_U = """WITH v AS (SELECT l_quantity AS x, l_returnflag = 'R' AS g FROM lineitem WHERE l_returnflag IN ('R', 'A')),
r AS (SELECT g, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS m, count(*) OVER (PARTITION BY x) AS t FROM v)
SELECT count(*) FILTER (g) AS n1, count(*) FILTER (NOT g) AS n2,
  round(sum(m) FILTER (g) - count(*) FILTER (g) * (count(*) FILTER (g) + 1) / 2.0::DOUBLE, 6) AS u1, round(sum(t * t - 1)::DOUBLE, 6) AS tie_sum FROM r"""


def _mann_whitney(t):
    rows = t.lineitem.where(F.col("l_returnflag").isin("R", "A"))
    return stats.mann_whitney(rows, "l_quantity", F.col("l_returnflag") == "R")


@query(_U)
def mann_whitney_u(t):
    return rounded(_mann_whitney(t), "u1", "tie_sum")


@query()
def mann_whitney_p(t):
    return rounded(stats.normal_p(_mann_whitney(t)), "p").select("n1", "n2", "p")


@query(
    """WITH g AS (SELECT o_orderpriority AS k, count(*) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM orders GROUP BY 1),
s AS (SELECT count(*) AS groups, sum(n)::BIGINT AS n, sum(n * m) / sum(n) AS mean, sum(n * v) AS w, sum(n * m * m) AS q FROM g)
SELECT groups, n, round((q - n * mean * mean) / 1e9, 3) AS ss_between, round(w / 1e9, 3) AS ss_within,
  round((q - n * mean * mean) / (groups - 1) / (w / (n - groups)), 3) AS f FROM s"""
)
def anova_ss(t):
    out = stats.anova(t.orders, "o_orderpriority", "o_totalprice")
    return out.select(
        "groups", "n", F.round(F.col("ss_between") / 1e9, 3).alias("ss_between"), F.round(F.col("ss_within") / 1e9, 3).alias("ss_within"), F.round("f", 3).alias("f")
    )


@query()
def anova_p(t):
    out = stats.f_p(stats.anova(t.orders, "o_orderpriority", "o_totalprice"))
    return rounded(out, "f", "eta2", "p").select("groups", "n", "f", "eta2", "p")


_SURVIVAL = """s AS (
  SELECT date_diff('day', (SELECT min(o_orderdate) FROM orders), o_orderdate)::INTEGER AS t, o_orderstatus = 'F' AS e,
    o_totalprice >= (SELECT median(o_totalprice) FROM orders) AS high, left(o_orderpriority, 1)::INTEGER AS risk FROM orders)"""


def _survival(t):
    middle = order.quantiles(t.orders, F.col("o_totalprice"), {"m": 0.5}).drop("n")
    rows = relational.with_scalars(t.orders, F.min("o_orderdate").alias("t0")).join(F.broadcast(middle))
    return rows.select(
        F.datediff("o_orderdate", "t0").alias("t"), (F.col("o_orderstatus") == "F").alias("e"),
        (F.col("o_totalprice") >= F.col("m")).alias("high"), F.left("o_orderpriority", F.lit(1)).cast("int").alias("risk"),
    )


@query(
    f"""WITH {_SURVIVAL}, k AS (SELECT high, t, sum(e::INTEGER)::BIGINT AS d, count(*) AS k FROM s GROUP BY ALL),
n AS (SELECT high, t, d, (sum(k) OVER (PARTITION BY high ORDER BY t DESC))::BIGINT AS n FROM k)
SELECT high, t, d, n, round(CASE WHEN bool_or(d = n) OVER w THEN 0 ELSE exp(sum(CASE WHEN d < n THEN ln(1 - d / n) END) OVER w) END, 6) AS survival
FROM n WHERE d > 0 WINDOW w AS (PARTITION BY high ORDER BY t)"""
)
def kaplan_meier(t):
    return rounded(stats.kaplan_meier(_survival(t), "t", "e", "high"), "survival")


@query(
    f"""WITH {_SURVIVAL}, k AS (SELECT t, count(*) FILTER (e) AS d, count(*) FILTER (e AND high) AS d1, count(*) AS k, count(*) FILTER (high) AS k1 FROM s GROUP BY t),
n AS (SELECT *, sum(k) OVER (ORDER BY t DESC) AS n, sum(k1) OVER (ORDER BY t DESC) AS n1 FROM k),
o AS (SELECT sum(d1)::BIGINT AS observed, sum(d * n1 / n) AS expected,
    sum(coalesce(d * (n1 / n) * (1 - n1 / n) * (n - d) / nullif(n - 1, 0), 0)) AS variance FROM n WHERE d > 0)
SELECT observed, round(expected, 4) AS expected, round(variance, 4) AS variance, round((observed - expected) ** 2 / variance, 4) AS chi2 FROM o"""
)
def logrank_counts(t):
    out = stats.logrank(_survival(t), "t", "e", F.col("high"))
    return out.withColumns({c: F.round(c, 4) for c in ("expected", "variance", "chi2")})


@query()
def logrank_p(t):
    out = stats.chi2_p(stats.logrank(_survival(t), "t", "e", F.col("high")))
    return rounded(out, "chi2", "p").select("observed", "chi2", "p")


@query(
    f"""WITH {_SURVIVAL}, k AS (SELECT t, risk, count(*) AS k, count(*) FILTER (e) AS d FROM s GROUP BY ALL),
p AS (SELECT a.d * b.k AS n, a.risk > b.risk AS c, a.risk = b.risk AS q FROM k a JOIN k b ON b.t > a.t WHERE a.d > 0)
SELECT sum(n)::BIGINT AS pairs, (sum(n) FILTER (c))::BIGINT AS concordant, (sum(n) FILTER (q))::BIGINT AS tied,
  round((sum(n) FILTER (c) + sum(n) FILTER (q) / 2) / sum(n), 6) AS c_index FROM p"""
)
def concordance_index(t):
    return rounded(stats.concordance(_survival(t), "t", "e", "risk"), "c_index")


def _distances(t):
    g = t.grid().select("slide", "vec_id", F.struct("embedding").alias("e"))
    both = lambda a, b: F.struct(
        cosine_distance(a["embedding"], b["embedding"]).alias("x"), F.sqrt(squared_distance(a["embedding"], b["embedding"])).alias("y")
    )
    return vectors.pairs_within(g, ["slide"], "vec_id", "e", both).select("slide", "a", "b", "dist.x", "dist.y")


@query(
    """WITH g AS (SELECT vec_id // 100 AS s, vec_id, embedding::DOUBLE[] AS e FROM embeddings)
SELECT count(*) AS n, round(corr(list_cosine_distance(a.e, b.e), list_distance(a.e, b.e)), 6) AS r FROM g a JOIN g b ON a.s = b.s AND a.vec_id < b.vec_id"""
)
def mantel_observed_r(t):
    return _distances(t).agg(F.count("*").alias("n"), F.round(F.corr("x", "y"), 6).alias("r"))


@query()
def mantel_permutation_p(t):
    return rounded(stats.mantel(_distances(t), "slide", 999), "r", "p")


@query()
def separation_accuracy(t):
    cells = t.grid().withColumn("side", F.when(F.col("label") < 5, 1).otherwise(2))
    drawn = ranking.sample_without(cells, ["slide", "side"], "vec_id", 300, 19)
    halves = ranking.half_split(drawn, ["slide", "side"], "vec_id", 23)
    return rounded(stats.separation(halves, ["slide"]), "accuracy")


@query()
def cox_coefficients(t):
    rows = _survival(t).withColumn("high", F.col("high").cast("int"))
    fitted = stats.cox_fit(rows, "t", "e", ["risk", "high"])
    return rounded(t.spark.createDataFrame(list(fitted.items()), "covariate string, coefficient double"), "coefficient")
