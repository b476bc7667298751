"""Hook for models: rows are scored in batches by a function that each task makes once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def predict(df: DataFrame, inputs: str, make_predict: Callable[[], Callable[[np.ndarray], np.ndarray]], out: str = "profile", batch: int = 16) -> DataFrame:
    """Add ``out``, an array of float: the prediction for the numbers in ``inputs``, ``batch`` rows at a time.

    ``make_predict`` loads the model and runs once a task. Rows keep their order and columns, but
    for ``inputs``; a null input gives a null.
    """
    kept = [f for f in df.schema if f.name not in (inputs, out)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", `{out}` array<float>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_predict()
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                there = np.flatnonzero(part[inputs].notna())
                result: list = [None] * len(part)
                if len(there):
                    got = model(np.stack([part[inputs].iloc[i] for i in there]))
                    for i, row in zip(there, np.asarray(got, np.float32), strict=True):
                        result[i] = row
                yield part[[f.name for f in kept]].assign(**{out: result})

    return df.mapInPandas(run, schema)
