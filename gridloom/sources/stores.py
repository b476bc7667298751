"""Parquet and CSV stores in place of array, dictionary, fold and patch files: sinks, and the sources that read them."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, index: str | None = None) -> None:
    """CSV with a header; ``index`` names the column to write first. Arrays, maps and structs become JSON."""
    nested = lambda f: f.dataType.typeName() in ("array", "map", "struct")
    order = [*([index] if index else []), *[c for c in df.columns if c != index]]
    flat = {f.name: F.to_json(F.col(f"`{f.name}`")) for f in df.schema if nested(f)}
    df.select(*[flat.get(c, F.col(f"`{c}`")).alias(c) for c in order]).write.csv(path, header=True)


def write_store(df: DataFrame, path: str, keys: list[str], properties: dict[str, str] | None = None) -> None:
    """Parquet in a folder for each value of ``keys`` (slide; fold and split), with ``properties`` as columns of text.

    Rows are dealt by the keys in balanced parts, so a folder has few files and a large one is split.
    """
    df = df.withColumns({k: F.lit(v) for k, v in (properties or {}).items()})
    df.hint("rebalance", *[F.col(k) for k in keys]).write.partitionBy(*keys).parquet(path)


def first_readable(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first of the Parquet stores that is there; an error if none is, or if one is there and can't be read."""
    for path in paths[:-1]:
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return spark.read.parquet(paths[-1])


def merged_profiles(spark: SparkSession, paths: list[str], keys: list[str]) -> DataFrame:
    """The rows of all stores; of rows with one key, those of the later store replace the others."""
    parts = [spark.read.parquet(p).withColumn("_file", F.lit(i)) for i, p in enumerate(paths)]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    last = rows.groupBy(*keys).agg(F.max("_file").alias("_last"))
    same = [rows[k].eqNullSafe(last[k]) for k in keys] + [rows["_file"] == last["_last"]]
    return rows.join(last, same, "left_semi").drop("_file")


def sparse_mask(cells: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """(keys, r, c, v) of every cell of masks whose cells that aren't 0 are the rows (keys, r, c, v)."""
    all_ = cells.select(*keys).distinct().withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
    all_ = all_.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    return all_.join(cells, [*keys, "r", "c"], "left").fillna(0, ["v"])


def patches(
    spark: SparkSession, paths: list[str], label: str = "label", classes: list[str] | None = None, scale: int | None = None, strict: bool = False
) -> DataFrame:
    """Patches of several stores with ``label_id``, the 0-based rank of the sorted labels, and ``sample``, the store's number.

    ``classes`` are the labels to keep (all that occur by default); rows of others are dropped, or an error if
    ``strict``. ``scale`` keeps one scale. Labels must be a bounded set; a null label is one of the others.
    """
    rows = None
    for i, path in enumerate(paths):
        part = spark.read.parquet(path).withColumn("sample", F.lit(i))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    if scale is not None:
        rows = rows.where(F.col("scale") == scale)
    if classes is None:
        names = rows.where(F.col(label).isNotNull()).select(F.col(label).alias("_name")).distinct()
        ids = names.withColumn("label_id", (F.row_number().over(Window.orderBy("_name")) - 1).cast("int"))  # distinct labels only
        return rows.join(ids, F.col(label) == F.col("_name")).drop("_name")
    known = F.array_position(F.lit(sorted(set(classes))), F.col(label))
    found: Column = F.when(known > 0, (known - 1).cast("int"))
    if strict:
        return rows.withColumn("label_id", F.coalesce(found, F.raise_error(F.lit("a label without a class")).cast("int")))
    return rows.withColumn("label_id", found).where("label_id IS NOT NULL")


def folds(spark: SparkSession, path: str, fold: int) -> dict[str, DataFrame]:
    """The splits (train, valid, test ..) of one fold of a store written by fold and split."""
    rows = spark.read.parquet(path).where(F.col("fold") == fold)
    names = sorted(r[0] for r in rows.select("split").distinct().collect())  # a few names
    return {n: rows.where(F.col("split") == n).drop("fold", "split") for n in names}


def sample_patches(patches_: DataFrame, samples: DataFrame, slide: str = "slide", punch: str = "label") -> DataFrame:
    """Patches with the metadata of their sample, where it was measured and isn't normal tissue; a null location isn't."""
    wanted = samples.where(F.col("rna_map_rate").isNotNull() & ~F.col("location").eqNullSafe("Normal"))
    return patches_.join(wanted, (patches_[slide] == wanted["patient_id"]) & (patches_[punch] == wanted["punch_id"]))


def layer_names(annotations: DataFrame) -> DataFrame:
    """(slide, region_ix, name) of the regions that have a name, from ``readers.annotations``."""
    return annotations.where("name IS NOT NULL").select("slide", "region_ix", "name")
