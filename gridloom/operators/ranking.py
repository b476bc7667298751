"""Ranks, rescaling, deterministic samples and splits.

Random draws follow one rule that SQL can repeat: the key of a row is the first
eight hex digits of md5(seed | id), as an integer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.order import quantiles, running_sums
from gridloom.operators.relational import with_scalars


def draw_key(seed: int, *parts: Column) -> Column:
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def dense_labels(df: DataFrame, label: str, out: str) -> DataFrame:
    """0-based ranks of the sorted distinct labels; only those are gathered, not the rows."""
    names = df.select(label).where(F.col(label).isNotNull()).distinct()
    ids = names.withColumn(out, (F.dense_rank().over(Window.orderBy(label)) - 1).cast("int"))
    return df.join(ids, label)


def empirical_rank(probes: DataFrame, reference: DataFrame, value: str) -> DataFrame:
    """``probes`` with ``rank``: the share of the reference that is less than its ``value``.

    Distinct values of both are counted and put in order together, in ranges; no row carries the reference, which may be of any
    size. A null value, or an empty reference, has a null rank; null values of the reference are left out.
    """
    asked = probes.select(F.col(value).cast("double").alias("_v"), F.lit(0).alias("_k"))
    counts = asked.unionByName(reference.select(F.col(value).cast("double").alias("_v"), F.lit(1).alias("_k"))).where("_v IS NOT NULL")
    places = running_sums(counts.groupBy("_v").agg(F.sum("_k").alias("_k")), "_v", ["_k"])
    total = reference.agg(F.count(value).alias("_n"))  # one row
    placed = places.join(F.broadcast(total)).select("_v", F.try_divide("before__k", "_n").alias("rank"))
    return probes.join(placed, F.col(value).cast("double") == F.col("_v"), "left").drop("_v")


def robust_rescale(df: DataFrame, value: str, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Add ``scaled``: (x - low percentile) / (high - low), clipped to 0 and 1."""
    rows = df.join(F.broadcast(quantiles(df, F.col(value), {"_lo": lo, "_hi": hi}).drop("n")))
    scaled = F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return rows.withColumn("scaled", F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0))).drop("_lo", "_hi")


def minmax_100(df: DataFrame, value: str) -> DataFrame:
    rows = with_scalars(df, F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return rows.withColumn("scaled", 100 * F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo"))).drop("_lo", "_hi")


def sample_without(df: DataFrame, keys: list[str], id_col: str, n: int, seed: int) -> DataFrame:
    """``n`` rows of each group, those with the smallest keys."""
    w = Window.partitionBy(*keys).orderBy("_key", id_col)
    rows = df.withColumn("_key", draw_key(seed, F.col(id_col)))
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_key", "_rank")


def sample_with(df: DataFrame, keys: list[str], id_col: str, n: int, seed: int) -> DataFrame:
    """``n`` draws with replacement from each group: (keys, draw, id)."""
    w = Window.partitionBy(*keys).orderBy(id_col)
    ranked = df.select(*keys, id_col, (F.row_number().over(w) - 1).cast("long").alias("_rank"))
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    draws = sizes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    draws = draws.withColumn("_rank", F.pmod(draw_key(seed, F.col("draw")), F.col("_n")))
    return draws.join(ranked, [*keys, "_rank"]).select(*keys, "draw", id_col)


def half_split(df: DataFrame, keys: list[str], id_col: str, seed: int) -> DataFrame:
    """Add ``train``: the first half of each group by key, rounded down."""
    w = Window.partitionBy(*keys)
    rank = F.row_number().over(w.orderBy("_key", id_col))
    rows = df.withColumn("_key", draw_key(seed, F.col(id_col)))
    return rows.withColumn("train", rank * 2 <= F.count("*").over(w)).drop("_key")


def group_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """(group, fold): contiguous folds of the sorted groups; the first n mod folds have one more."""
    names = df.select(group).distinct()
    ranked = names.withColumn("i", F.row_number().over(Window.orderBy(group)) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))
    small, extra = F.floor(F.col("n") / folds), F.col("n") % folds
    edge = extra * (small + 1)
    fold = F.when(F.col("i") < edge, F.floor(F.col("i") / (small + 1))).otherwise(
        extra + F.floor(F.try_divide(F.col("i") - edge, small))
    )
    return ranked.select(group, fold.cast("int").alias("fold"))


def fold_parts(df: DataFrame, group: str, folds: int) -> DataFrame:
    """(fold, group, part): each group's part in each fold, train, test or validation; the last group of a fold's own is its validation.

    A row a group and fold, from the distinct groups only; a null group is one of its own, the first.
    """
    own = group_folds(df, group, folds)
    last = own.withColumn("_last", F.row_number().over(Window.partitionBy("fold").orderBy(F.desc(group))) == 1)
    every = last.withColumnRenamed("fold", "_own").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    part = F.when(F.col("_own") != F.col("fold"), "train").when(F.col("_last"), "validation").otherwise("test")
    return every.select("fold", group, part.alias("part"))


def fit_minmax(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the smallest and largest value of each column, for ``apply_minmax``."""
    return df.agg(*[f(c).cast("double").alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])


def apply_minmax(df: DataFrame, fitted: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``columns`` moved to 0 to 1 by the rows that were fitted; others may lie outside. A constant column only loses its value."""
    def scaled(c: str) -> Column:
        width = F.col(f"hi_{c}") - F.col(f"lo_{c}")
        return (F.col(c) - F.col(f"lo_{c}")) / F.when(width == 0, 1.0).otherwise(width)

    rows = df.join(F.broadcast(fitted))  # one row
    return rows.withColumns({c: scaled(c) for c in columns}).drop(*fitted.columns)


def size_histogram(df: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """(bin, low, high, n): how many groups have so many rows, in ``bins`` equal parts of the range of sizes; the last one holds its end.

    If all groups are of one size the range is half a row to both sides of it. Empty bins have a row, an empty table none.
    """
    sizes = df.groupBy(*keys).agg(F.count("*").cast("double").alias("_s")).groupBy("_s").agg(F.count("*").alias("_c"))
    ends = sizes.agg(F.min("_s").alias("a"), F.max("_s").alias("b")).where("a IS NOT NULL")
    half = F.when(F.col("a") == F.col("b"), 0.5).otherwise(0.0)
    ends = ends.select((F.col("a") - half).alias("a"), (F.col("b") + half).alias("b"))  # one row
    width = (F.col("b") - F.col("a")) / bins
    spot = F.least(F.floor((F.col("_s") - F.col("a")) / width), F.lit(bins - 1)).cast("int")
    counts = sizes.join(F.broadcast(ends)).groupBy(spot.alias("bin")).agg(F.sum("_c").alias("n"))
    every = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    edge = lambda k: F.col("a") + width * k
    out = every.join(counts, "bin", "left")
    return out.select("bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def first_members(df: DataFrame, keys: list[str], id_col: str, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(id_col)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def spaced_members(df: DataFrame, keys: list[str], id_col: str, n: int) -> DataFrame:
    """(keys, slot, id): ``n`` members of each group at even steps from the first to the last, repeated in small groups."""
    w = Window.partitionBy(*keys).orderBy(id_col)
    ranked = df.select(*keys, id_col, (F.row_number().over(w) - 1).cast("long").alias("_rank"))
    slots = df.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    slots = slots.withColumn("_rank", F.floor(F.col("slot") * (F.col("_n") - 1) / (n - 1)).cast("long"))
    return slots.join(ranked, [*keys, "_rank"]).select(*keys, "slot", id_col)


def fraction_split(df: DataFrame, keys: list[str], id_col: str, share: float, seed: int, out: str) -> DataFrame:
    """``df`` with ``out``: true for the ``share`` of each group, rounded up, that has the smallest keys."""
    rows = df.withColumn("_key", draw_key(seed, F.col(id_col)))
    rank, n = F.row_number().over(Window.partitionBy(*keys).orderBy("_key", id_col)), F.count("*").over(Window.partitionBy(*keys))
    return rows.withColumn(out, rank <= F.ceil(share * n)).drop("_key")
