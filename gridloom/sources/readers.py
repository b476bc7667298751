"""Readers of the formats that cohort data comes in, as DataFrames with explicit schemas."""

from __future__ import annotations

import io
import json
import zipfile
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.scalars import stem

#: Column schemas of cohort and clinical tables.
SCHEMAS = {
    "cohort_focal": "name string, focal boolean, annotations boolean, mutation string",
    "cohort_samples": "name string, annotations boolean, sequencing boolean",
    "cohort_small": "name string, annotations boolean",
    "cohort_names": "name string",
    "blacklist": "friendly_name string, reason string",
    "punch_meta": "row_id int, svs string, corner_x int, corner_y int, punch_size int, grade int, blacklisted boolean, in_training boolean",
    "clinical": "patient string, pfs_months double, pfs_status string, ajcc_pathologic_m string, tumor_grade string",
    "sample_meta": "patient_id string, sample_id string, punch_id string, image_flip string, location string, rna_map_rate double, "
    "grade_punch double, pattern_uniformity_2 string",
}


def csv_table(spark: SparkSession, path: str, schema: str, tab: bool = False) -> DataFrame:
    """A CSV file with a header; ``schema`` is DDL or a key of SCHEMAS. Ids stay strings, blanks are nulls."""
    return spark.read.schema(SCHEMAS.get(schema, schema)).csv(path, header=True, sep="\t" if tab else ",")


def parameters(path: str) -> dict:
    """Nested parameters of a JSON file, or of a YAML file where a YAML reader is installed; a file of settings, read where the job starts."""
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            return json.load(f)
        try:
            import yaml
        except ImportError as e:
            raise ImportError(f"{path}: no YAML reader is installed; write the parameters as JSON") from e
        return yaml.safe_load(f)


#: Fixed value: the namespace of cells in workbook files.
_CELLS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def workbook(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """(path, row, cells) of the sheet with this number of ``.xlsx`` files: a row's cells as strings by column, null where blank; rows count from 1.

    Files are read where Spark deals them, a row at a time; the first row is the header where there is one. Blank rows have none. Dates are numbers of days, as
    stored. A file without the sheet has no rows.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def column(ref: str) -> int:
        n = 0
        for ch in ref.rstrip("0123456789"):
            n = n * 26 + ord(ch) - 64
        return n - 1

    def rows_of(content: bytes):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names, shared = set(z.namelist()), []
            if "xl/sharedStrings.xml" in names:
                shared = ["".join(t.text or "" for t in s.iter(f"{_CELLS}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_CELLS}si")]
            if f"xl/worksheets/sheet{sheet}.xml" not in names:
                return
            with z.open(f"xl/worksheets/sheet{sheet}.xml") as f:
                for at, (_, row) in enumerate(((e, x) for e, x in ElementTree.iterparse(f) if x.tag == f"{_CELLS}row"), 1):
                    found: dict[int, str] = {}
                    for i, cell in enumerate(row.iter(f"{_CELLS}c")):
                        value = cell.find(f"{_CELLS}v")
                        kind, ref = cell.get("t"), cell.get("r")
                        text = "".join(t.text or "" for t in cell.iter(f"{_CELLS}t")) if kind == "inlineStr" else None if value is None else value.text
                        if text is not None:
                            found[column(ref) if ref else i] = shared[int(text)] if kind == "s" else text
                    if found:
                        yield int(row.get("r") or at), [found.get(k) for k in range(max(found) + 1)]
                    row.clear()

    def read(batches):
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                part: list = []
                for r, cells in rows_of(content):
                    part.append((p, r, cells))
                    if len(part) == 1000:
                        yield pd.DataFrame(part, columns=["path", "row", "cells"])
                        part = []
                if part:
                    yield pd.DataFrame(part, columns=["path", "row", "cells"])

    return files.mapInPandas(read, "path string, row int, cells array<string>")


def square_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, d) of a CSV file whose header and first column name the rows and columns of a matrix."""
    wide = spark.read.csv(path, header=True)
    index, *names = wide.columns
    return wide.withColumnRenamed(index, "a").unpivot("a", names, "b", "d").withColumn("d", F.col("d").try_cast("double"))


def punch_grid(spark: SparkSession, path: str, skip: int = 6) -> DataFrame:
    """(name, x, y, w, h, keep) of tab-separated files without a header, after ``skip`` lines."""
    lines = spark.read.text(path, wholetext=True).select(F.split("value", "\r?\n").alias("l"))
    rows = lines.select(F.explode(F.slice("l", skip + 1, 1 << 30)).alias("l")).where(F.trim("l") != "")
    part = lambda i, kind: F.try_element_at(F.split("l", "\t"), F.lit(i + 1)).try_cast(kind)
    kinds = {"name": "string", "x": "int", "y": "int", "w": "int", "h": "int", "keep": "boolean"}
    return rows.select(*[part(i, kind).alias(c) for i, (c, kind) in enumerate(kinds.items())])


def dense_grids(spark: SparkSession, path: str) -> DataFrame:
    """(slide, r, c, profile) of ``.npy`` files of H x W x C numbers; objects are never unpickled. A file is one task's work."""
    files = spark.read.format("binaryFile").load(path).select(stem(F.col("path")).alias("slide"), "content")

    def cells(batches):
        for b in batches:
            for slide, content in zip(b["slide"], b["content"], strict=True):
                m = np.load(io.BytesIO(content), allow_pickle=False)
                for r in range(m.shape[0]):  # a row of cells at a time
                    yield pd.DataFrame({"slide": slide, "r": r, "c": np.arange(m.shape[1]), "profile": list(m[r].astype(np.float32))})

    return files.mapInPandas(cells, "slide string, r int, c int, profile array<float>")


def images(spark: SparkSession, path: str, decode) -> DataFrame:
    """Rows of ``decode(bytes)``, a pandas frame (r, c, label) of each file: the hook for image formats."""
    files = spark.read.format("binaryFile").load(path).select(stem(F.col("path")).alias("slide"), "content")

    def run(batches):
        for b in batches:
            for slide, content in zip(b["slide"], b["content"], strict=True):
                yield decode(content).assign(slide=slide)[["slide", "r", "c", "label"]]

    return files.mapInPandas(run, "slide string, r int, c int, label int")


def listing(spark: SparkSession, path: str, priorities: list[str] = ()) -> DataFrame:
    """(name, path): of files with one name the one whose path has the first of ``priorities``."""
    files = spark.read.format("binaryFile").load(path).select("path", stem(F.col("path")).alias("name"))
    rank: Column = F.lit(len(priorities))
    for i, p in reversed(list(enumerate(priorities))):
        rank = F.when(F.col("path").contains(p), i).otherwise(rank)
    return files.groupBy("name").agg(F.min_by("path", F.struct(rank, F.col("path"))).alias("path"))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """(slide, region_ix, id, name, sign, xs, ys, length, area, bbox) of annotation XML; corners are cut to whole numbers."""
    vertex = "array<struct<_X:double,_Y:double>>"
    region = f"struct<_Id:string,_Text:string,_NegativeROA:string,_Length:double,_Area:double,Vertices:struct<Vertex:{vertex}>>"
    schema = f"struct<Annotation:array<struct<Regions:struct<Region:array<{region}>>>>>"
    files = spark.read.text(path, wholetext=True).select(
        stem(F.col("_metadata.file_path")).alias("slide"), F.from_xml("value", F.lit(schema)).alias("x")
    )
    layers = files.select("slide", F.explode("x.Annotation").alias("a"))
    rows = layers.select("slide", F.posexplode("a.Regions.Region").alias("region_ix", "g")).select("slide", "region_ix", "g.*")
    whole = lambda f: F.transform("Vertices.Vertex", lambda v: v[f].cast("int"))
    xs, ys = whole("_X"), whole("_Y")
    return rows.select(
        "slide", "region_ix", F.col("_Id").alias("id"), F.col("_Text").alias("name"),
        F.when(F.col("_NegativeROA") == "1", "-").otherwise("+").alias("sign"), xs.alias("xs"), ys.alias("ys"),
        F.col("_Length").alias("length"), F.col("_Area").alias("area"),
        F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)).alias("bbox"),
    )


def point_lists(spark: SparkSession, path: str) -> DataFrame:
    """(slide, name, sign, xs, ys, area) of lines ``name [x, y, x, y, ...]``; area is that of the bounding box."""
    lines = spark.read.text(path).select(stem(F.col("_metadata.file_path")).alias("slide"), "value").where(F.col("value").contains("["))
    label = F.trim(F.split_part("value", F.lit("["), F.lit(1)))
    numbers = F.transform(F.split(F.regexp_replace(F.split_part("value", F.lit("["), F.lit(2)), r"[\]\s]", ""), ","), lambda x: x.try_cast("double"))
    rows = lines.select("slide", label.alias("label"), F.filter(numbers, lambda x: x.isNotNull()).alias("p"))
    xs, ys = F.filter("p", lambda _, i: i % 2 == 0), F.filter("p", lambda _, i: i % 2 == 1)
    sign = F.when(F.col("label").rlike(r"^[+-]"), F.left("label", F.lit(1))).otherwise("+")
    rows = rows.select("slide", F.regexp_replace("label", r"^[+-]\s*", "").alias("name"), sign.alias("sign"), xs.alias("xs"), ys.alias("ys"))
    return rows.withColumn("area", (F.array_max("xs") - F.array_min("xs")) * (F.array_max("ys") - F.array_min("ys")))


def label_ids(df: DataFrame, label: str, names: list[str]) -> DataFrame:
    """Add ``label_id``, the 0-based rank of the sorted names; rows with other labels are dropped."""
    return df.withColumn("label_id", (F.array_position(F.lit(sorted(set(names))), F.col(label)) - 1).cast("int")).where("label_id >= 0")
