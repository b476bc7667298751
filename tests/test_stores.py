"""Sinks and the stores that are read back."""

import pytest
from pyspark.sql import functions as F

from gridloom.sources import stores


def test_csv_with_an_index_and_nested_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [1, 2]), (2, None, None)], "n int, name string, v array<int>")
    stores.write_csv(df, str(tmp_path / "x"), index="name")
    got = spark.read.csv(str(tmp_path / "x"), header=True)
    assert got.columns == ["name", "n", "v"]
    assert sorted(map(tuple, got.collect()), key=repr) == [("a", "1", "[1,2]"), (None, "2", None)]


def test_stores_by_key_with_properties_and_folds(spark, tmp_path):
    df = spark.range(40).select(F.col("id"), (F.col("id") % 2).cast("int").alias("fold"), F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("split"))
    stores.write_store(df, str(tmp_path / "f"), ["fold", "split"], {"mpp": "0.5"})
    assert {p.name for p in (tmp_path / "f").iterdir() if p.is_dir()} == {"fold=0", "fold=1"}
    got = stores.folds(spark, str(tmp_path / "f"), 1)
    assert sorted(got) == ["test", "train"] and got["test"].count() == 4 and got["train"].columns == ["id", "mpp"]
    assert stores.first_readable(spark, [str(tmp_path / "none"), str(tmp_path / "f")]).count() == 40
    with pytest.raises(Exception, match="none"):
        stores.first_readable(spark, [str(tmp_path / "none")])


def test_merged_profiles_take_the_later_store(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "slide string, v int")
    rows(("a", 1), ("b", 1), (None, 1)).write.parquet(str(tmp_path / "0"))
    rows(("b", 2), (None, 2)).write.parquet(str(tmp_path / "1"))
    got = stores.merged_profiles(spark, [str(tmp_path / "0"), str(tmp_path / "1")], ["slide"])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([("a", 1), ("b", 2), (None, 2)], key=repr)


def test_patches_have_label_ids_and_samples(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "label string, scale int, x int")
    rows(("t", 0, 1), ("n", 0, 2), ("t", 1, 3)).write.parquet(str(tmp_path / "0"))
    rows(("m", 0, 4), (None, 0, 5)).write.parquet(str(tmp_path / "1"))
    paths = [str(tmp_path / "0"), str(tmp_path / "1")]
    ids = lambda df: sorted((r["x"], r["label_id"], r["sample"]) for r in df.collect())
    assert ids(stores.patches(spark, paths)) == [(1, 2, 0), (2, 1, 0), (3, 2, 0), (4, 0, 1)]
    assert ids(stores.patches(spark, paths, classes=["t", "m"], scale=0)) == [(1, 1, 0), (4, 0, 1)]
    with pytest.raises(Exception, match="without a class"):
        stores.patches(spark, paths, classes=["t"], strict=True).collect()


def test_sparse_masks_become_dense(spark):
    cells = spark.createDataFrame([("s", 0, 1, 1), ("s", 1, 0, 1)], "slide string, r int, c int, v int")
    got = {(r["r"], r["c"]): r["v"] for r in stores.sparse_mask(cells, ["slide"], 2, 2).collect()}
    assert got == {(0, 0): 0, (0, 1): 1, (1, 0): 1, (1, 1): 0}
