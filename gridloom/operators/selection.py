"""How unlike a cell are the partners that several rules choose for it, as shares of its slide's distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.vectors import cosine_distance, norm
from gridloom.operators.ranking import draw_key, sample_with


def _gap2(a: str, b: str) -> Column:
    r, c = F.col(f"{a}.r") - F.col(f"{b}.r"), F.col(f"{a}.c") - F.col(f"{b}.c")
    return r * r + c * c


def far_pairs(cells: DataFrame, id_col: str, pairs: int, least: float, attempts: int, seed: int) -> DataFrame:
    """(slide, pair, a, b): ``pairs`` draws of two cells of each slide that are ``least`` or more apart.

    Both cells are drawn anew up to ``attempts`` times; a pair that this doesn't find is the one with the smallest
    key among all such pairs of its slide, so only a slide without any has no rows.
    """
    cell = F.struct(F.col(id_col).alias("id"), "r", "c")
    rank = (F.row_number().over(Window.partitionBy("slide").orderBy(id_col)) - 1).cast("long")
    ranked = cells.select("slide", rank.alias("k"), cell.alias("cell"))
    wanted = cells.groupBy("slide").agg(F.count("*").alias("n")).withColumn("pair", F.explode(F.sequence(F.lit(0), F.lit(pairs - 1))))
    tries = wanted.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))))
    for side in "ab":
        key = draw_key(seed, F.col("slide"), F.col("pair"), F.col("attempt"), F.lit(side))
        tries = tries.withColumn("k", F.pmod(key, F.col("n"))).join(ranked.withColumnRenamed("cell", side), ["slide", "k"]).drop("k")
    far = _gap2("a", "b") >= least * least
    met = tries.where(far).groupBy("slide", "pair").agg(F.min(F.struct("attempt", "a.id", F.col("b.id").alias("other"))).alias("m"))
    met = met.select("slide", "pair", F.col("m.id").alias("a"), F.col("m.other").alias("b"))
    unmet = wanted.join(met, ["slide", "pair"], "left_anti").select("slide", "pair")
    unmet = unmet.join(ranked.select("slide", F.col("cell").alias("a")), "slide").join(ranked.select("slide", F.col("cell").alias("b")), "slide")
    key = draw_key(seed, F.col("slide"), F.col("pair"), F.col("a.id"), F.col("b.id"))
    least_key = F.min(F.struct(key.alias("key"), F.col("a.id").alias("a"), F.col("b.id").alias("b"))).alias("m")
    rest = unmet.where(far).groupBy("slide", "pair").agg(least_key).select("slide", "pair", "m.a", "m.b")
    return met.unionByName(rest)


def selection_study(
    cells: DataFrame, id_col: str, vector_col: str, features: list[str], pairs: int = 100, least: float = 10, reference: int = 1000, attempts: int = 16, seed: int = 41
) -> DataFrame:
    """(slide, pair, mode, metric, percent) for cells (slide, r, c, id, vector, features).

    The first cell of each far pair gets a partner by each mode: ``random``, the second cell of the pair; ``vector``, the nearest
    by cosine distance among cells of another row and column that are more than ``least`` away; and each feature, the cell with the
    nearest value. Ties go to the smaller id. ``percent`` is the share of the distances between ``reference`` drawn cells of the
    slide that are smaller than the partner's, by the metrics ``vector`` (cosine distance) and each feature (absolute difference).
    Null features and vectors are near to nothing: they are no partner by that mode, and their metric's percent is null.
    """
    cell = [F.col(id_col).alias("id"), "r", "c", F.col(vector_col).alias("vector"), norm(F.col(vector_col)).alias("norm"), *features]
    of = cells.select("slide", F.struct(*cell).alias("o"))
    drawn = far_pairs(cells, id_col, pairs, least, attempts, seed)
    asked = drawn.join(of.select("slide", F.col("o.id").alias("a"), F.col("o").alias("x")), ["slide", "a"])
    metrics = {"vector": F.abs(F.round(cosine_distance(*map(F.col, ("x.vector", "o.vector", "x.norm", "o.norm"))), 9))}
    metrics |= {f: F.abs(F.round(F.col(f"x.{f}") - F.col(f"o.{f}"), 6)).cast("double") for f in features}
    names = list(metrics)

    met = asked.join(of, "slide").where(F.col("o.id") != F.col("a"))
    apart = (F.col("x.r") != F.col("o.r")) & (F.col("x.c") != F.col("o.c")) & (_gap2("x", "o") > least * least)
    met = met.select("slide", "pair", F.col("o.id").alias("id"), (F.col("o.id") == F.col("b")).alias("is_drawn"), apart.alias("apart"), *[v.alias(k) for k, v in metrics.items()])
    best = lambda by, allowed: F.min(F.when(allowed, F.struct(by.alias("by"), "id", *names)))
    modes = {"random": best(F.lit(0.0), F.col("is_drawn"))}
    modes |= {k: best(F.col(k), F.col(k).isNotNull() & (F.col("apart") if k == "vector" else F.lit(True))) for k in names}
    chosen = met.groupBy("slide", "pair").agg(*[v.alias(f"by_{k}") for k, v in modes.items()])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("mode"), F.col(f"by_{k}").alias("m")) for k in modes])).alias("e")
    chosen = chosen.select("slide", "pair", each).where("e.m IS NOT NULL")
    long_form = lambda at: F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(at(k)).alias("v")) for k in names])).alias("w")
    chosen = chosen.select("slide", "pair", "e.mode", long_form(lambda k: f"e.m.{k}")).select("slide", "pair", "mode", "w.metric", "w.v")

    # cells drawn several times meet once, with the number of their draws that meet; distances are as far in both directions
    times = sample_with(cells, ["slide"], id_col, reference, seed + 2).groupBy("slide", id_col).agg(F.count("*").alias("times"))
    some = cells.join(times, ["slide", id_col]).select("slide", "times", *cell)
    two = some.alias("x").join(some.alias("o"), (F.col("x.slide") == F.col("o.slide")) & (F.col("x.id") <= F.col("o.id")))
    n = F.col("x.times")
    draws = F.when(F.col("x.id") == F.col("o.id"), F.shiftright(n * (n - 1), 1)).otherwise(n * F.col("o.times"))
    two = two.where(draws > 0).select("x.slide", draws.alias("draws"), *[v.alias(k) for k, v in metrics.items()])
    two = two.select("slide", "draws", long_form(lambda k: k))
    base = two.select("slide", "w.metric", "w.v", F.col("draws").alias("base")).where("v IS NOT NULL")

    # asked values stand before equal ones of the distribution, so that only smaller ones count
    rows = chosen.withColumn("base", F.lit(0).cast("long")).unionByName(base, allowMissingColumns=True)
    all_of = Window.partitionBy("slide", "metric")
    before = all_of.orderBy("v", "base").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    percent = F.when(F.col("v").isNotNull(), 100.0 * F.sum("base").over(before) / F.sum("base").over(all_of))
    return rows.withColumn("percent", percent).where("base = 0").select("slide", "pair", "mode", "metric", "percent")
