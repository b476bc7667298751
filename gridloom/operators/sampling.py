"""Pair and batch sampling for training, and patch budgets, by the engine's rule of draws."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.ranking import draw_key


#: Parts in which the members of one label are numbered, so that no task holds a whole label.
SALTS = 64


def numbered(df: DataFrame, keys: list[str], id_col: str, seed: int) -> DataFrame:
    """(keys, id, _k): members of each group numbered from 0, in order of the part that a hash of the id deals them to and then of the id.

    Groups are cut into SALTS parts whose counts are added up, so a group may be of any size. Repeated rows are members of their own;
    rows with a null key or id take no part.
    """
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in (*keys, id_col)])
    dealt = df.where(known).select(*keys, id_col, F.pmod(draw_key(seed, F.col(id_col)), F.lit(SALTS)).alias("_part"))
    counts = dealt.groupBy(*keys, "_part").agg(F.count("*").alias("_c"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most SALTS rows
    base = counts.select(*keys, "_part", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_base"))
    place = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(id_col)) - 1
    return dealt.withColumn("_in", place).join(base, [*keys, "_part"]).select(*keys, id_col, (F.col("_base") + F.col("_in")).cast("long").alias("_k"))


def partners(df: DataFrame, label: str, id_col: str, seed: int) -> DataFrame:
    """(label, id, close, same): for every row a member of its label, drawn with replacement, and the row itself.

    Training on near patches reads ``close``, on two views of one patch ``same``, on both together both columns.
    """
    ranked = numbered(df, [label], id_col, seed)
    sizes = ranked.groupBy(label).agg(F.count("*").alias("_n"))  # a row a label
    asks = ranked.drop("_k").join(sizes, label).withColumn("_k", F.pmod(draw_key(seed, F.col(id_col), F.lit("partner")), F.col("_n")))
    return asks.drop("_n").join(ranked.withColumnRenamed(id_col, "close"), [label, "_k"]).select(label, id_col, "close", F.col(id_col).alias("same"))


def label_batches(df: DataFrame, label: str, id_col: str, batches: int, size: int, seed: int) -> DataFrame:
    """(batch, slot, label, id): in each batch ``size`` different labels, and one drawn member of each.

    Twice as many labels as needed are drawn with replacement, and the first different ones taken. Batches that have too few (there
    are hardly more labels than slots) put all labels in order by a key; fewer labels than ``size`` are in every batch.
    """
    ranked = numbered(df, [label], id_col, seed)
    sizes = ranked.groupBy(label).agg(F.count("*").alias("_n"))
    key = lambda *what: draw_key(seed, F.col("batch"), *what)
    kinds = numbered(sizes.withColumn("_all", F.lit(1)), ["_all"], label, seed).select(label, F.col("_k").alias("_i")).join(sizes, label)
    total = sizes.agg(F.count("*").alias("_m")).where("_m > 0")  # one row
    every = df.sparkSession.range(batches).withColumnRenamed("id", "batch").join(F.broadcast(total))
    tries = every.withColumn("_try", F.explode(F.sequence(F.lit(0), F.lit(2 * size - 1))))
    tries = tries.withColumn("_i", F.pmod(key(F.lit("label"), F.col("_try")), F.col("_m"))).groupBy("batch", "_i").agg(F.min("_try").alias("_try"))
    slot = (F.row_number().over(Window.partitionBy("batch").orderBy("_try", "_i")) - 1).alias("slot")
    drawn = tries.select("batch", "_i", slot).where(F.col("slot") < size)
    short = every.join(drawn.where(F.col("slot") == size - 1).select("batch"), "batch", "left_anti")
    listed = short.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1))).withColumn("_try", key(F.lit("order"), F.col("_i")))
    listed = listed.select("batch", "_i", slot).where(F.col("slot") < size)
    whole = drawn.join(short.select("batch"), "batch", "left_anti").unionByName(listed).join(kinds, "_i")
    picked = whole.withColumn("_k", F.pmod(key(F.lit("member"), F.col("slot")), F.col("_n")))
    return picked.join(ranked, [label, "_k"]).select("batch", "slot", label, id_col)


def padded_shards(df: DataFrame, ix: str, shards: int) -> DataFrame:
    """``df`` with (shard, place): row number ``ix`` (from 0, without gaps) goes to every so-manyth shard; the first rows come again at the end
    until all shards have as many, several times if there are fewer rows than shards."""
    rows = df.join(F.broadcast(df.agg(F.count(ix).alias("_n"))))
    last = F.ceil(F.col("_n") / shards) * shards - 1
    at = rows.where(F.col(ix).isNotNull()).withColumn("_at", F.explode(F.sequence(F.col(ix).cast("long"), last, F.col("_n"))))
    return at.withColumns({"shard": shard(F.col("_at"), shards), "place": F.floor(F.col("_at") / shards)}).drop("_at", "_n")


def paired_batches(df: DataFrame, label: str, id_col: str, batches: int, pairs: int, seed: int) -> DataFrame:
    """(batch, slot, label, a, b): in each slot two members, drawn with replacement, of one drawn label."""
    spark = df.sparkSession
    names = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("_n"))
    names = names.withColumns({"_i": F.row_number().over(Window.orderBy("label")) - 1, "_k": F.count("*").over(Window.partitionBy())})
    ranked = df.select(F.col(label).alias("label"), F.col(id_col).alias("_id")).withColumn(
        "_r", (F.row_number().over(Window.partitionBy("label").orderBy("_id")) - 1).cast("long")
    )
    slots = spark.range(batches).withColumnRenamed("id", "batch").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(pairs - 1))))
    key = lambda what: draw_key(seed, F.col("batch"), F.col("slot"), F.lit(what))
    kinds = names.select(F.first("_k").over(Window.partitionBy()).alias("_k")).limit(1)
    picked = slots.join(F.broadcast(kinds)).withColumn("_i", F.pmod(key("label"), F.col("_k"))).drop("_k").join(names.drop("_k"), "_i")
    picked = picked.withColumns({"_a": F.pmod(key("a"), F.col("_n")), "_b": F.pmod(key("b"), F.col("_n"))})
    a, b = ranked.toDF("label", "a", "_a"), ranked.toDF("label", "b", "_b")
    return picked.join(a, ["label", "_a"]).join(b, ["label", "_b"]).select("batch", "slot", "label", "a", "b")


def shard(ix: Column, shards: int) -> Column:
    """Which of ``shards`` takes the row with number ``ix``: every so-manyth row."""
    return F.pmod(ix, F.lit(shards)).cast("int")


def distant_pairs(cells: DataFrame, id_col: str, least: float, attempts: int, seed: int) -> DataFrame:
    """(slide, id, other, attempt): for each cell the first drawn cell of its slide that is far enough.

    After ``attempts`` draws it is the one with the smallest key among all that are (attempt is null), so only a cell
    without any has no row. Rows with a null id or place take no part.
    """
    cells = cells.where(F.col("slide").isNotNull() & F.col(id_col).isNotNull() & F.col("r").isNotNull() & F.col("c").isNotNull())
    ranked = cells.select(
        "slide", F.col(id_col).alias("other"), F.col("r").alias("r2"), F.col("c").alias("c2"),
        (F.row_number().over(Window.partitionBy("slide").orderBy(id_col)) - 1).cast("long").alias("_k"),
    )
    sizes = cells.groupBy("slide").agg(F.count("*").alias("_n"))
    tries = cells.join(sizes, "slide").withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))))
    tries = tries.withColumn("_k", F.pmod(draw_key(seed, F.col(id_col), F.col("attempt")), F.col("_n"))).join(ranked, ["slide", "_k"])
    far = (F.col("r") - F.col("r2")) * (F.col("r") - F.col("r2")) + (F.col("c") - F.col("c2")) * (F.col("c") - F.col("c2")) >= least * least
    best = tries.where(far).groupBy("slide", F.col(id_col).alias("id")).agg(F.min(F.struct("attempt", "other")).alias("b"))
    best = best.select("slide", "id", "b.other", "b.attempt")
    unmet = cells.join(best.select("slide", F.col("id").alias(id_col)), ["slide", id_col], "left_anti")
    all_ = unmet.select("slide", F.col(id_col), "r", "c").join(ranked.drop("_k"), "slide").where(far)  # pairs inside a slide, of what draws miss
    key = F.struct(draw_key(seed, F.col(id_col), F.col("other"), F.lit("rest")), "other")
    rest = all_.groupBy("slide", F.col(id_col).alias("id")).agg(F.min_by("other", key).alias("other"))
    return best.unionByName(rest.withColumn("attempt", F.lit(None).cast("int")))


def patch_centres(cells: DataFrame, keys: list[str], side: int, most: int, overlap: float, scale: int = 1, seed: int = 0) -> DataFrame:
    """(keys, pick, y, x): centres of patches of ``side`` cells in regions (keys, r, c), in pixels of ``scale`` a cell.

    A region gets ``patch_budget`` of its cells, each drawn with replacement: the draw's key is a rank among the region's cells by row and column.
    With a ``scale`` over 1 a centre is moved by up to half a cell. Rows that repeat a cell count once; regions too small for
    one patch have no rows, nor have rows with a null key or place.
    """
    known = [F.col(k).isNotNull() for k in (*keys, "r", "c")]
    cells = cells.where(reduce(Column.__and__, known)).select(*keys, "r", "c").distinct()
    ranked = cells.withColumn("_k", (F.row_number().over(Window.partitionBy(*keys).orderBy("r", "c")) - 1).cast("long"))
    budget = cells.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_b", patch_budget(F.col("_n"), side, most, overlap)).where("_b > 0")
    picks = budget.withColumn("pick", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    drawn = lambda *what: draw_key(seed, *[F.col(k) for k in keys], F.col("pick"), *[F.lit(w) for w in what])
    picks = picks.withColumn("_k", F.pmod(drawn("cell"), F.col("_n"))).join(ranked, [*keys, "_k"])
    half = round(scale / 2)
    at = lambda c, axis: F.col(c).cast("long") * scale + (F.pmod(drawn(axis), F.lit(half)) - half if scale > 1 else 0)
    return picks.select(*keys, "pick", at("r", "y").cast("int").alias("y"), at("c", "x").cast("int").alias("x"))


def inner_cells(cells: DataFrame, height: int, width: int, side: int) -> DataFrame:
    """``cells`` (.., r, c) whose patch of ``side`` cells stays inside a raster of that size."""
    half = side // 2
    return cells.where(F.col("r").between(half, height - 1 - half) & F.col("c").between(half, width - 1 - half))


def patch_budget(area: Column, size: int, most: int, overlap: float) -> Column:
    """How many patches of side ``size`` a region of ``area`` gets: at most ``most``, and what the overlap allows."""
    return F.least(F.lit(most), F.floor(area * (overlap + 1) / (size * size))).cast("int")
