"""Joins, filters, aggregations and reshapes as DataFrame transformations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.order import running_sums


def with_scalars(df: DataFrame, *aggregates: Column) -> DataFrame:
    """``df`` with global aggregates of itself as columns: a broadcast of one row."""
    return df.join(F.broadcast(df.agg(*aggregates)))


def anti_blacklist(df: DataFrame, blacklist: DataFrame, key: str) -> DataFrame:
    return df.join(blacklist.select(key).distinct(), key, "left_anti")


def group_size_filter(df: DataFrame, keys: list[str], least: int, inclusive: bool) -> DataFrame:
    """Rows of groups with more than ``least`` rows, or as many."""
    n = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return df.join(n.where(F.col("_n") >= least if inclusive else F.col("_n") > least).select(*keys), keys, "left_semi")


def argmax_rows(df: DataFrame, keys: list[str], measure: str, tie: str) -> DataFrame:
    """Each group's row with the largest ``measure``, ties to the smallest ``tie``."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.col(measure), -F.col(tie)))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def containing_windows(points: DataFrame, y: str, x: str, size: int, stride: int) -> DataFrame:
    """``points`` with (wr, wc) of each window of side ``size``, every ``stride``, that contains it, ends inclusive.

    Each point is exploded to the few windows that cover it, so that what follows is
    an equi-join or a grouping instead of a range join.
    """
    def covering(v: str) -> Column:
        first = F.greatest(F.ceil((F.col(v) - size) / stride), F.lit(0)).cast("int")
        return F.sequence(first, F.floor(F.col(v) / stride).cast("int"))

    return points.where((F.col(y) >= 0) & (F.col(x) >= 0)).withColumn("wr", F.explode(covering(y))).withColumn("wc", F.explode(covering(x)))


def window_shares(marks: DataFrame, windows: DataFrame, sizes: DataFrame, size: int, stride: int) -> DataFrame:
    """(slide, wr, wc, share): the share of marked places (slide, r, c) in each window, cut to its image; 0 where all places are alike.

    ``windows`` (slide, wr, wc) begin every ``stride`` places and have sides of ``size``; ``sizes`` has (slide, height, width). A wholly marked
    window has 0 as an empty one has: a share needs both kinds. Repeated marks count once; windows outside the image have null.
    """
    inside = containing_windows(marks.select("slide", "r", "c").distinct().join(sizes, "slide").where("r < height AND c < width"), "r", "c", size - 1, stride)
    counts = inside.groupBy("slide", "wr", "wc").agg(F.count("*").alias("_n"))
    along = lambda w, n: F.least(F.lit(size), F.col(n) - F.col(w) * stride)
    area = F.greatest(along("wr", "height"), F.lit(0)) * F.greatest(along("wc", "width"), F.lit(0))
    rows = windows.join(sizes, "slide").withColumn("_area", area).join(counts, ["slide", "wr", "wc"], "left")
    share = F.when(F.col("_n") < F.col("_area"), F.col("_n") / F.col("_area")).when(F.col("_area") > 0, 0.0)
    return rows.select("slide", "wr", "wc", share.alias("share"))


def share_bands(df: DataFrame, keys: list[str], value: str, low: float, high: float) -> DataFrame:
    """(keys, full, part, none): shares of rows with at least ``high``, from ``low`` up to it, and less than ``low``; nulls are in no band but count."""
    v = F.col(value)
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return df.groupBy(*keys).agg(share(v >= high).alias("full"), share((v >= low) & (v < high)).alias("part"), share(v < low).alias("none"))


def side_by_side(a: DataFrame, b: DataFrame, order_a: tuple[str, str], order_b: tuple[str, str]) -> DataFrame:
    """Columns of both tables in one row by their place (``place``, from 0) in their own order: by a number or date, and a second column on ties.

    The longer table's last rows have nulls for the other. Rows whose first order column is null have no place and are left out.
    Names must differ.
    """
    def placed(df: DataFrame, order: tuple[str, str]) -> DataFrame:
        rows = running_sums(df.where(F.col(order[0]).isNotNull()).withColumn("_one", F.lit(1)), order[0], ["_one"])
        tie = F.row_number().over(Window.partitionBy(order[0]).orderBy(order[1])) - 1
        return rows.withColumn("place", (F.col("before__one") + tie).cast("long")).drop("_one", "before__one")

    return placed(a, order_a).join(placed(b, order_b), "place", "full")


def nearest_value(df: DataFrame, id_col: str, value: str) -> DataFrame:
    """(id, nearest, gap): the other row with the nearest value, ties to the smaller value and then the smaller id.

    Only the values next to a row's own in sorted order can be nearest. Range
    partitioning sorts all rows; each part borrows the last and first value of its
    neighbours, so no task holds the whole column.
    """
    v = df.where(F.col(value).isNotNull()).select(F.col(id_col).alias("id"), F.col(value).alias("v"))
    # one row for each value: its two smallest ids, as a row's own value may be its nearest
    values = v.groupBy("v").agg(F.slice(F.array_sort(F.collect_set("id")), 1, 2).alias("ids"))
    parts = values.repartitionByRange("v").withColumn("p", F.spark_partition_id())
    inside = Window.partitionBy("p").orderBy("v")
    both = parts.select(
        "p", "v", "ids",
        F.lag(F.struct("v", "ids")).over(inside).alias("before"),
        F.lead(F.struct("v", "ids")).over(inside).alias("after"),
    )
    ends = parts.groupBy("p").agg(F.min(F.struct("v", "ids")).alias("lo"), F.max(F.struct("v", "ids")).alias("hi"))
    across = Window.orderBy("p")
    edge = ends.select("p", F.lag("hi").over(across).alias("eb"), F.lead("lo").over(across).alias("ea"))  # a row a part
    near = both.join(F.broadcast(edge), "p").select(
        "v", "ids", F.coalesce("before", "eb").alias("before"), F.coalesce("after", "ea").alias("after")
    )
    rows = v.join(near, "v")
    own = F.when(F.size("ids") > 1, F.when(F.col("ids")[0] == F.col("id"), F.col("ids")[1]).otherwise(F.col("ids")[0]))
    down, up = F.col("v") - F.col("before.v"), F.col("after.v") - F.col("v")
    left = F.col("before").isNotNull() & (F.col("after").isNull() | (down <= up))
    return rows.select(
        "id",
        F.when(own.isNotNull(), own).when(left, F.col("before.ids")[0]).otherwise(F.col("after.ids")[0]).alias("nearest"),
        F.when(own.isNotNull(), F.lit(0.0)).when(left, down).otherwise(up).alias("gap"),
    )


def symmetrised(pairs: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """(a, b, value) with both directions of each pair; a direction that is there keeps its own value."""
    back = pairs.select(F.col(b).alias(a), F.col(a).alias(b), F.col(value).alias("_back"))
    return pairs.join(back, [a, b], "full_outer").select(a, b, F.coalesce(value, "_back").alias(value))


def row_fractions(df: DataFrame, row: list[str], col: str) -> DataFrame:
    """(row, col, n, fraction): counts and their share of the row's rows."""
    counts = df.groupBy(*row, col).agg(F.count("*").alias("n"))
    return counts.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy(*row)))


def mapped(df: DataFrame, key: str, codes: dict, out: str) -> DataFrame:
    """``df`` with ``out``, the code of ``key``; a key without a code, or a null one, is an error."""
    known = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    missing = F.raise_error(F.concat(F.lit("no code for "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return df.withColumn(out, F.coalesce(F.try_element_at(known, F.col(key)), missing.cast("int")))


def reindexed(matrix: DataFrame, a: str, b: str, value: str, rows: list, columns: list) -> DataFrame:
    """(i, j, ``value``): a matrix (a, b, value) in the order of two lists of keys; null where it has no such pair."""
    spark = matrix.sparkSession
    kind = matrix.schema[a].dataType.simpleString()
    listed = lambda keys, key, place: F.broadcast(spark.createDataFrame([(k, i) for i, k in enumerate(keys)], f"{key} {kind}, {place} int"))
    wanted = listed(rows, "_a", "i").crossJoin(listed(columns, "_b", "j"))
    return wanted.join(matrix, (F.col(a) == F.col("_a")) & (F.col(b) == F.col("_b")), "left").select("i", "j", value)


def with_matrix(pairs: DataFrame, matrix: DataFrame, keys: list[str]) -> DataFrame:
    """``pairs`` (keys, a, b, ...), a < b, with what ``matrix`` (keys, a, b, ...) holds above its diagonal for each; pairs it lacks are left out."""
    return pairs.join(matrix.where("a < b"), [*keys, "a", "b"])
