"""Samplers, folds, scalers, histograms, window shares, tables side by side, parameter files and workbooks on small odd inputs."""

import json
import zipfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import scalars
from gridloom.operators import ranking, relational, sampling
from gridloom.registry import ORACLES, QUERIES
from gridloom.sources import readers


def test_members_are_numbered_without_gaps(spark):
    rows = [("hot", i) for i in range(3000)] + [("b", 1), ("b", 1), ("b", 2), (None, 5), ("b", None)]
    got = sampling.numbered(spark.createDataFrame(rows, "g string, id int").repartition(7), ["g"], "id", 1).collect()
    for g, n in (("hot", 3000), ("b", 3)):
        assert sorted(r["_k"] for r in got if r["g"] == g) == list(range(n))
    assert len(got) == 3003


def test_partners_are_drawn_from_the_own_label(spark):
    rows = [(i % 3, i) for i in range(900)] + [(9, 1000), (None, 5)]
    got = sampling.partners(spark.createDataFrame(rows, "g int, id int"), "g", "id", 2).collect()
    assert sorted(r["id"] for r in got) == [*range(900), 1000]
    assert all(r["same"] == r["id"] and (r["close"] % 3 == r["g"] or r["close"] == 1000 and r["g"] == 9) for r in got)
    drawn = Counter(r["close"] for r in got if r["g"] == 0)
    assert 150 < len(drawn) < 230 and max(drawn.values()) < 9  # of 300, 190 or so are drawn at least once


@pytest.mark.parametrize("labels", [4, 6, 40])
def test_batches_of_different_labels(spark, labels):
    df = spark.createDataFrame([(i % labels, i) for i in range(labels * 5)] + [(None, 1)], "g int, id int")
    got = sampling.label_batches(df, "g", "id", 300, 5, 3).collect()
    size = min(5, labels)
    batches: dict = {}
    for r in got:
        assert r["id"] % labels == r["g"]
        batches.setdefault(r["batch"], []).append((r["slot"], r["g"]))
    assert len(batches) == 300
    assert all(sorted(s for s, _ in b) == list(range(size)) and len({g for _, g in b}) == size for b in batches.values())
    share = Counter(r["g"] for r in got)
    assert len(share) == labels and max(share.values()) < 1.6 * 300 * size / labels
    assert sampling.label_batches(df.limit(0), "g", "id", 3, 5, 3).count() == 0


@pytest.mark.parametrize("n, shards", [(10, 4), (12, 4), (1, 5), (3, 7), (0, 3)])
def test_shards_are_filled_from_the_start(spark, n, shards):
    got = sampling.padded_shards(spark.range(n).withColumnRenamed("id", "ix"), "ix", shards).collect()
    filled = [i % n for i in range(-(-n // shards) * shards)] if n else []
    want = sorted((i % shards, i // shards, ix) for i, ix in enumerate(filled))
    assert sorted((r["shard"], r["place"], r["ix"]) for r in got) == want


def test_last_group_of_a_fold_is_its_validation(spark):
    df = spark.createDataFrame([(f"s{i:02}",) for i in range(11) for _ in range(3)], "slide string")
    got = {(r["fold"], r["slide"]): r["part"] for r in ranking.fold_parts(df, "slide", 3).collect()}
    assert len(got) == 33
    names = [f"s{i:02}" for i in range(11)]
    for fold, own in enumerate((names[:4], names[4:8], names[8:])):
        want = {n: "train" if n not in own else "validation" if n == own[-1] else "test" for n in names}
        assert {n: got[fold, n] for n in names} == want


def test_scaler_keeps_what_it_was_fitted_on(spark):
    df = spark.createDataFrame([(0.0, 5.0), (10.0, 5.0), (None, 5.0), (20.0, 7.0)], "x double, y double")
    fitted = ranking.fit_minmax(df.where("y = 5"), ["x", "y"])
    got = sorted(((r["x"], r["y"]) for r in ranking.apply_minmax(df, fitted, ["x", "y"]).collect()), key=str)
    assert got == sorted([(0.0, 0.0), (1.0, 0.0), (None, 0.0), (2.0, 2.0)], key=str)


@pytest.mark.parametrize("sizes", [[1, 2, 2, 11, 7, 4], [3, 3], [1], []])
def test_histogram_of_group_sizes(spark, sizes):
    df = spark.createDataFrame([(g,) for g, n in enumerate(sizes) for _ in range(n)], "g int")
    got = sorted(ranking.size_histogram(df, ["g"]).collect())
    if not sizes:
        assert got == []
        return
    counts, edges = np.histogram(sizes)
    assert [r["n"] for r in got] == counts.tolist()
    assert [r["low"] for r in got] == pytest.approx(edges[:-1]) and got[-1]["high"] == pytest.approx(edges[-1])


def test_window_share_needs_both_kinds(spark):
    marks = spark.createDataFrame([(1, r, c) for r in range(3) for c in range(3)] + [(1, 0, 0), (1, 4, 4), (1, 50, 0), (2, 0, 0)], "slide int, r int, c int")
    windows = spark.createDataFrame([(1, a, b) for a in range(3) for b in range(2)] + [(1, 9, 0)], "slide int, wr int, wc int")
    sizes = spark.createDataFrame([(1, 5, 5), (2, 1, 1)], "slide int, height int, width int")
    got = {(r["wr"], r["wc"]): r["share"] for r in relational.window_shares(marks, windows, sizes, 3, 2).collect()}
    assert got == {(0, 0): 0.0, (0, 1): pytest.approx(3 / 9), (1, 0): pytest.approx(3 / 9), (1, 1): pytest.approx(2 / 9), (2, 0): 0.0, (2, 1): pytest.approx(1 / 3), (9, 0): None}


def test_tables_side_by_side(spark):
    a = spark.createDataFrame([(3, "c"), (1, "a"), (3, "b"), (None, "x")], "x int, u string")
    b = spark.createDataFrame([(9.5, "p"), (0.5, "q")], "y double, v string")
    got = sorted(relational.side_by_side(a, b, ("x", "u"), ("y", "v")).select("place", "u", "v").collect())
    assert [tuple(r) for r in got] == [(0, "a", "q"), (1, "b", "p"), (2, "c", None)]
    assert relational.side_by_side(a.limit(0), b, ("x", "u"), ("y", "v")).count() == 2


def test_small_inverses(spark):
    df = spark.createDataFrame([({"a": 1, "b": 2, "c": 1, "d": None}, "né".encode(), 1.0), ({}, b"", 0.0), (None, None, None)], "m map<string,int>, b binary, d double")
    got = [tuple(r) for r in df.select(scalars.inverted(F.col("m")), scalars.text_of(F.col("b")), scalars.intensity(F.col("d"))).collect()]
    assert got == [({1: "c", 2: "b"}, "né", int(255 * np.exp(-1))), ({}, "", 254), (None, None, None)]


def test_parameter_files(tmp_path):
    want = {"paths": {"base": "/x", "n": [1, 2]}, "size": 224}
    (tmp_path / "p.json").write_text(json.dumps(want))
    assert readers.parameters(str(tmp_path / "p.json")) == want
    pytest.importorskip("yaml")
    (tmp_path / "p.yaml").write_text("paths:\n  base: /x\n  n: [1, 2]\nsize: 224\n")
    assert readers.parameters(str(tmp_path / "p.yaml")) == want


def test_workbooks(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f"""<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="3"><c r="B3"><v>2.5</v></c>
      <c r="AB3" t="inlineStr"><is><t>far</t></is></c></row><row r="4"><c r="A4"/></row></sheetData></worksheet>"""
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><r><t>gra</t></r><r><t>de</t></r></si></sst>")
    got = sorted(readers.workbook(spark, str(tmp_path / "*.xlsx")).select("row", "cells").collect())
    assert [tuple(r) for r in got] == [(1, ["name", None, "grade"]), (3, [None, "2.5", *[None] * 25, "far"])]
    assert readers.workbook(spark, str(tmp_path / "*.xlsx"), 2).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))  # those without SQL are counted elsewhere
def test_every_query_can_be_counted(spark, sf_dir, name):
    """A count needs no column, so all that can be pruned is."""
    assert QUERIES[name](spark, sf_dir).count() >= 0


@pytest.mark.parametrize("name", ["knn_neighbours", "object_texture", "object_skeletons", "tessellated_inference", "training_partners"])
def test_one_column_can_be_read(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    for c in df.columns[:3]:
        assert len(df.select(c).take(3)) == 3
