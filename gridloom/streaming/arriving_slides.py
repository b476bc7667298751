"""Scores of slides that arrive in parts: a stateful stream holds a slide's cells until all are there or it has waited too long."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridloom.sources.incremental import append_missing
from gridloom.streaming.incremental_scores import heterogeneity

#: ``total`` is the number of cells that the slide has.
PARTS = "slide string, r int, c int, label int, embedding array<double>, total int"
_STATE = "r array<int>, c array<int>, label array<int>, v array<double>, total int"
_CELLS = "slide string, r int, c int, label int, embedding array<double>, complete boolean"


def whole_slides(parts: DataFrame, wait_ms: int) -> DataFrame:
    """(slide, r, c, label, embedding, complete): a slide's cells, once ``total`` of them have arrived in any number of batches.

    A slide that gets no cell for ``wait_ms`` comes out as it is, ``complete`` false. Cells that arrive again count
    once, the first of them; rows with a null slide, place, label or vector are left out. The state of a slide is its cells, and it ends with its output.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        r, c, label, v, total = state.get if state.exists else ([], [], [], [], None)
        r, c, label, v = list(r), list(c), list(label), list(v)
        if not state.hasTimedOut:
            seen = set(zip(r, c, strict=True))
            for frame in frames:
                for row in frame.itertuples():
                    if (row.r, row.c) not in seen:
                        seen.add((row.r, row.c))
                        r.append(int(row.r))
                        c.append(int(row.c))
                        label.append(int(row.label))
                        v += [float(x) for x in row.embedding]
                    if row.total is not None and row.total == row.total:
                        total = max(int(row.total), total or 0)
        whole = total is not None and len(r) >= total
        if not (state.hasTimedOut or whole):
            state.update((r, c, label, v, total))
            state.setTimeoutDuration(wait_ms)
            return
        if state.exists:
            state.remove()
        if r:
            yield pd.DataFrame({"slide": key[0], "r": r, "c": c, "label": label, "embedding": list(np.array(v).reshape(len(r), -1)), "complete": whole})

    known = " AND ".join(f"{x} IS NOT NULL" for x in ("slide", "r", "c", "label", "embedding"))
    return parts.where(known).groupBy("slide").applyInPandasWithState(step, _CELLS, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def run(spark: SparkSession, source: str, target: str, state: str, wait_ms: int = 3_600_000, files: int = 1000) -> None:
    """Append (slide, score, complete) of the slides of files in ``source`` that are whole now, or have waited too long, to ``target``.

    Calls go on where the last one ended, from the checkpoint in ``state``. A batch that is run again writes nothing
    twice, as slides that ``target`` has are left out. A batch takes at most ``files`` files; waiting slides
    end in a batch that has new ones.
    """

    def batch(cells: DataFrame, _: int) -> None:
        done = cells.select("slide", "complete").distinct()
        append_missing(heterogeneity(cells.drop("complete")).join(done, "slide").select("slide", "score", "complete"), target, ["slide"])

    # else waiting slides would keep a call running with empty batches; a call looks at them when it has new files
    empty = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(empty)
    spark.conf.set(empty, "false")
    parts = spark.readStream.schema(PARTS).option("maxFilesPerTrigger", files).parquet(source)
    stream = whole_slides(parts, wait_ms).writeStream.foreachBatch(batch).option("checkpointLocation", state)
    try:
        stream.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(empty, before)
