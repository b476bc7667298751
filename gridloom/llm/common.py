"""Helpers that the training-data operators share.

* ``map_text`` runs a per-document function in one narrow Arrow pass.
* ``staged`` cuts lineage by writing a table into the shared folder that the
  cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of text that one call of a per-document function sees at most, unless
#: one text alone is longer.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has at most ``limit`` bytes of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(size)
    if len(sizes) > start:
        yield batch.slice(start)


def map_text(
    df: DataFrame,
    make: Callable[[], Callable[[list], dict[str, Iterable]]],
    added: str,
    text_col: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """Add columns that depend on one text each, without a shuffle.

    ``make`` is called once a task and returns a function from a list of texts
    (None for null) to the columns of ``added``, a DDL schema. ``keep`` names the
    input columns to return (all by default); an input column with the name of an
    added one is replaced by it. An empty input gives an empty output.
    """
    new = T.StructType.fromDDL(added)
    names = {n.lower() for n in new.names}
    kept = [f for f in df.schema if f.name.lower() not in names and (keep is None or f.name in keep)]
    schema = T.StructType(kept + new.fields)
    arrow = to_arrow_schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in schema]))
    wanted = [f.name for f in kept]
    read = list(dict.fromkeys([*wanted, text_col]))
    at, n = read.index(text_col), len(wanted)
    new_names = new.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = None
        for batch in batches:
            for part in slices(batch, at):
                fn = fn or make()
                got = fn(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(i).cast(arrow.field(i).type) for i in range(n)]
                    + [
                        x if isinstance(x := got[c], pa.Array) else pa.array(x, arrow.field(n + i).type)
                        for i, c in enumerate(new_names)
                    ],
                    schema=arrow,
                )

    return df.select(*read).mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one where that is unset (a local session)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


#: Settings while a table is staged: its shuffle files go when it is written, and workers get batches of bounded bytes.
STAGING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/gridloom-{uuid.uuid4().hex}"
    with settings(spark, STAGING):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gridloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a ``staged`` table that no later step reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._gridloom_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Stages:
    """Staged tables of one operator; what it returns is staged last, and the others are deleted then.

    The returned table stays in the shared folder, as its reader decides how long it is needed.
    """

    def __init__(self):
        self.tables: list[DataFrame] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        self.tables.append(staged(df))
        return self.tables[-1]

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self.tables = [x for x in self.tables if x is not t]
            discard(t)

    def last(self, df: DataFrame) -> DataFrame:
        out = staged(df)
        self.drop(*self.tables)
        return out
