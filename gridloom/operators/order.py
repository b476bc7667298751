"""Exact order statistics and running sums of a whole column, without sorting it in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: One part in so many of the rows is how far the sketch of a quantile may be off; twice that each side is looked at exactly.
ACCURACY = 20_000
#: Ranges of values of a running sum, at most.
RANGES = 256


def _joined(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the row of ``other`` for its keys, null keys too; without keys ``other`` is one row."""
    if not keys:
        return df.join(F.broadcast(other))
    renamed = other.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in other.columns if c not in keys])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return df.join(renamed, same).drop(*[f"_{k}" for k in keys])


def quantiles(df: DataFrame, value: Column, shares: dict[str, float], keys: list[str] | None = None) -> DataFrame:
    """(keys, n, a column for each of ``shares``): exact quantiles of ``value`` with linear interpolation, by group.

    A sketch gives a bracket around each share, all values under it are counted, and only the distinct values
    inside are put in order: about 4 / ACCURACY of the rows. Counts prove that the bracket holds the wanted places;
    where it doesn't, the whole group stands for it. Without keys there is one row, and nulls for an empty table;
    a group of nulls has n = 0 and nulls. Null values are left out; NaN is the largest value.
    """
    keys = keys or []
    names = list(shares)
    rows = df.select(*keys, value.cast("double").alias("_v"))
    ends = [min(1.0, max(0.0, shares[c] + s * 2 / ACCURACY)) for c in names for s in (-1, 1)]
    cut = F.percentile_approx("_v", F.array(*[F.lit(e) for e in ends]), ACCURACY)
    cuts = rows.groupBy(*keys).agg(cut.alias("_cut"), F.count("_v").alias("n"))
    at = lambda i: F.get("_cut", F.lit(i))
    placed = _joined(rows, cuts, keys)
    n = len(names)
    # (under, inside) of each bracket, and so whether it holds both places between which the quantile lies
    counts = placed.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.array(*[F.count_if(F.col("_v") < at(2 * i)) for i in range(n)]).alias("_under"),
        F.array(*[F.count_if((F.col("_v") >= at(2 * i)) & (F.col("_v") <= at(2 * i + 1))) for i in range(n)]).alias("_in"),
    )
    place = [F.lit(shares[c]) * (F.coalesce("n", F.lit(0)) - 1) for c in names]
    low, high = [F.floor(p).cast("long") for p in place], [F.ceil(p).cast("long") for p in place]
    held = [(F.col("_under")[i] <= low[i]) & (F.col("_under")[i] + F.col("_in")[i] > high[i]) for i in range(n)]
    plan = counts.select(
        *keys,
        F.array(
            *[F.struct(F.lit(i).alias("i"), held[i].alias("held"), F.when(held[i], F.col("_under")[i]).otherwise(0).cast("long").alias("under"), low[i].alias("low"), high[i].alias("high"), place[i].alias("place")) for i in range(n)]
        ).alias("_plan"),
    )
    inside = [F.when(~F.col("_plan")[i]["held"] | ((F.col("_v") >= at(2 * i)) & (F.col("_v") <= at(2 * i + 1))), F.col("_plan")[i]) for i in range(n)]
    band = _joined(placed.where("_v IS NOT NULL"), plan, keys).select(*keys, "_v", F.explode(F.filter(F.array(*inside), lambda x: x.isNotNull())).alias("p"))
    values = band.groupBy(*keys, "p", "_v").agg(F.count("*").alias("k"))
    up = F.sum("k").over(Window.partitionBy(*keys, "p").orderBy("_v")) + F.col("p.under")
    values = values.withColumn("up", up)
    holds = lambda c: F.when((F.col("up") > F.col(f"p.{c}")) & (F.col("up") - F.col("k") <= F.col(f"p.{c}")), F.col("_v"))
    two = values.groupBy(*keys, "p").agg(F.max(holds("low")).alias("a"), F.max(holds("high")).alias("b"))
    part = F.col("p.place") - F.col("p.low")
    found = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") * (1 - part) + F.col("b") * part)
    wide = two.groupBy(*keys).agg(*[F.max(F.when(F.col("p.i") == i, found)).alias(c) for i, c in enumerate(names)])
    if not keys:
        return counts.select(F.coalesce("n", F.lit(0)).alias("n")).join(F.broadcast(wide))
    renamed = wide.select(*[F.col(k).alias(f"_{k}") for k in keys], *names)
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return counts.select(*keys, "n").join(renamed, same, "left").select(*keys, "n", *names)


def _range_of(value: Column, cuts: str) -> Column:
    """How many of the sorted array ``cuts`` are ``value`` or less, by halving."""
    steps = F.sequence(F.lit(0), F.lit(RANGES.bit_length()))
    start = F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        low, high = F.struct(s["lo"].alias("lo"), mid.alias("hi")), F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))
        return F.when(s["lo"] >= s["hi"], s).when(F.get(cuts, mid) <= value, high).otherwise(low)

    return F.aggregate(steps, start, halve, lambda s: s["lo"])


def running_sums(df: DataFrame, by: str, sums: list[str], descending: bool = False) -> DataFrame:
    """``df`` with ``before_X`` for each X of ``sums``: the sum of X over the rows whose ``by`` is smaller (larger, if ``descending``).

    ``by`` is a number or a date. Values are dealt into at most RANGES ranges by a sketch of their quantiles; the ranges' totals are that
    many rows, and a window runs inside each range. Equal values don't count for each other. Rows whose
    ``by`` is null come out with nulls and count for nobody.
    """
    key = "_by"
    rows = df.withColumn(key, F.col(by).cast("double") if dict(df.dtypes)[by] != "date" else F.unix_date(by).cast("double"))
    shares = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    cuts = rows.agg(F.array_sort(F.array_distinct(F.coalesce(F.percentile_approx(key, shares, 10 * RANGES), F.array().cast("array<double>")))).alias("_cuts"))
    rows = rows.join(F.broadcast(cuts)).withColumn("_range", F.when(F.col(key).isNotNull(), _range_of(F.col(key), "_cuts"))).drop("_cuts")
    totals = rows.where("_range IS NOT NULL").groupBy("_range").agg(*[F.sum(c).alias(f"_t{i}") for i, c in enumerate(sums)])
    order = F.desc("_range") if descending else F.asc("_range")
    earlier = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows
    base = totals.select("_range", *[F.coalesce(F.sum(f"_t{i}").over(earlier), F.lit(0)).alias(f"_b{i}") for i in range(len(sums))])
    inside = Window.partitionBy("_range").orderBy(F.desc(key) if descending else F.asc(key))
    smaller = inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    equal = Window.partitionBy("_range", key)
    out = rows.join(F.broadcast(base), "_range", "left")
    # a range's running sum up to equal values, less theirs
    sum_ = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    own = {f"before_{c}": F.when(F.col("_range").isNotNull(), F.col(f"_b{i}") + sum_(c, smaller) - sum_(c, equal)) for i, c in enumerate(sums)}
    return out.withColumns(own).drop("_range", key, *[f"_b{i}" for i in range(len(sums))])
