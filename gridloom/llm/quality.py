"""Quality classifier: random Fourier features of document statistics, ridge, isotonic calibration.

Statistics of whole texts are standardised and mapped to cosines with random
frequencies, whose inner products approximate a Gaussian kernel. The normal
equations are summed in each partition and then by rows of the matrix, so only
sums move. Isotonic regression on other labelled rows turns scores into
probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages, map_text
from .textstats import measure

FEATURES = 128
GAMMA = 0.05
RIDGE = 1e-3
SEED = 17
#: Scores are put in so many equal steps before isotonic regression.
BINS = 1000
MIN_REPEAT = 8

STATS = ["words", "word_length", "upper", "symbol", "shout", "bar", "stop", "lines", "dup_lines", "repeat3", "repeat8"]


def statistics(texts: list) -> np.ndarray:
    """One row of STATS for each text; a null text counts as empty, with zeros."""
    m = measure(texts, MIN_REPEAT)
    texts = [t or "" for t in texts]
    words, chars = np.maximum(m["n_words"], 1), np.maximum(m["word_chars"], 1)
    count = lambda f: np.fromiter(map(f, texts), float, len(texts))
    letters_up = np.fromiter((sum(map(t.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) for t in texts), float, len(texts))
    lines = count(lambda t: t.count("\n") + 1)
    return np.column_stack(
        [
            np.log1p(m["n_words"]) / 4,
            np.log1p(m["word_chars"] / words),
            letters_up / chars,
            np.log1p(m["n_symbols"] / words),
            np.log1p(count(lambda t: t.count("!")) / words),
            np.log1p(count(lambda t: t.count("|")) / words),
            np.log1p(count(lambda t: t.count(".")) / words),
            np.log1p(words / lines) / 4,
            m["n_dup_lines"] / lines,
            m["n_repeat_words"] / words,
            m["repeated"] / words,
        ]
    )


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    frequency: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    steps: np.ndarray  # scores from which on a probability holds
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.mean) / self.scale, self.frequency, self.phase)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.steps):
            return np.full(len(x), 0.5)
        return self.levels[np.clip(np.searchsorted(self.steps, self.raw(x), "right") - 1, 0, None)]


def fourier(x: np.ndarray, frequency: np.ndarray, phase: np.ndarray) -> np.ndarray:
    z = np.cos(x @ frequency + phase) * np.sqrt(2.0 / frequency.shape[1])
    return np.column_stack([z, np.ones(len(x))])


def isotonic(scores: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over sorted scores: where each block begins, and its mean."""
    blocks: list[list[float]] = []
    for s, m, w in zip(scores, mean, weight, strict=True):
        blocks.append([s, m, w])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            _, m2, w2 = blocks.pop()
            b = blocks[-1]
            b[1], b[2] = (b[1] * b[2] + m2 * w2) / (b[2] + w2), b[2] + w2
    return np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])


def stats_table(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``stats``, an array of STATS, to each row in one narrow pass."""
    return map_text(docs, lambda: lambda texts: {"stats": statistics(texts).tolist()}, "stats array<double>", text_col, keep)


def fit(learning: DataFrame, calibrating: DataFrame, label_col: str = "label") -> Model:
    """Fit on ``learning`` and calibrate on ``calibrating``, rows of ``stats`` and a 0/1 label.

    Rows with a null label are left out. Without learning rows each score is 0.5;
    without calibrating rows the learning rows calibrate.
    """
    spark = learning.sparkSession
    learning = learning.where(F.col(label_col).isNotNull()).select("stats", F.col(label_col).cast("double").alias("label"))
    calibrating = calibrating.where(F.col(label_col).isNotNull()).select("stats", F.col(label_col).cast("double").alias("label"))
    d = len(STATS)
    each = [f(F.col("stats")[i]).alias(f"{n}{i}") for i in range(d) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    got = learning.agg(F.count("*").alias("n"), *each).first()
    rng = np.random.default_rng(SEED)
    frequency = rng.normal(0, np.sqrt(2 * GAMMA), (d, FEATURES))
    phase = rng.uniform(0, 2 * np.pi, FEATURES)
    if not got["n"]:
        e = np.zeros(0)
        return Model(np.zeros(d), np.ones(d), frequency, phase, np.zeros(FEATURES + 1), e, e)
    mean = np.array([got[f"m{i}"] for i in range(d)])
    scale = np.array([max(got[f"s{i}"] or 0.0, 1e-3) for i in range(d)])

    def sums(batches):
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for b in batches:
            if len(b):
                z = fourier((np.stack(b["stats"]) - mean) / scale, frequency, phase)
                total += z.T @ np.column_stack([z, b["label"]])
        yield pd.DataFrame({"row": np.arange(len(total)), "sums": list(total)})

    def add(key, parts):
        return pd.DataFrame({"row": [key[0]], "sums": [np.sum(np.stack(parts["sums"]), axis=0)]})

    kind = "row int, sums array<double>"
    rows = learning.mapInPandas(sums, kind).groupBy("row").applyInPandas(add, kind).orderBy("row").collect()
    both = np.array([r["sums"] for r in rows])  # FEATURES + 1 rows, however many documents there are
    left, right = both[:, :-1], both[:, -1]
    weights = np.linalg.solve(left + RIDGE * got["n"] * np.eye(len(left)) / len(left), right)
    plain = Model(mean, scale, frequency, phase, weights, np.zeros(0), np.zeros(0))
    model = spark.sparkContext.broadcast(plain)

    def binned(batches):
        for b in batches:
            if len(b):
                bins = np.floor(np.clip(model.value.raw(np.stack(b["stats"])), -1, 2) * BINS).astype(int)
                yield pd.DataFrame({"bin": bins, "label": b["label"]}).groupby("bin", as_index=False).agg(
                    n=("label", "size"), good=("label", "sum")
                )

    for rows in (calibrating, learning):
        got = rows.mapInPandas(binned, "bin int, n long, good double").groupBy("bin").agg(F.sum("n"), F.sum("good")).collect()
        if got:
            break
    b, n, good = map(np.array, zip(*sorted(tuple(r) for r in got), strict=True))
    steps, levels = isotonic(b / BINS, (good + 0.0) / n, n)
    return Model(mean, scale, frequency, phase, weights, steps, levels)


def score(stats: DataFrame, model: Model, threshold: float = 0.7, keep: list[str] | None = None) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on) to rows of ``stats``."""
    shared = stats.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in (keep if keep is not None else stats.columns) if c not in ("score", "predicted", "stats")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema if f.name in keep)

    def run(batches):
        for b in batches:
            s = shared.value.score(np.stack(b["stats"])) if len(b) else np.zeros(0)
            yield b[keep].assign(score=s, predicted=(s >= threshold).astype("int32"))

    return stats.select(*keep, "stats").mapInPandas(run, f"{schema}, score double, predicted int")


def classify_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = 0.7,
) -> DataFrame:
    """Score every row of ``docs``; learn only from labels whose crc32(id as text) mod 4 is not 2.

    Remainders 0 and 1 fit the weights and 3 calibrates them. Returns ``id_col``,
    ``held_out``, ``score`` and ``predicted``, a row for each row of ``docs``:
    a null or empty text has zero statistics and a score like any other; a null id
    is scored and never learnt from. Of repeated labels of one id the smallest counts.
    """
    of = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4
    stage = Stages()
    rows = stage(stats_table(docs.select(id_col, text_col), text_col, [id_col]).withColumn("part", of.cast("int")))
    known = labels.where(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("label"))
    learn = stage(rows.where("part <> 2").join(known, id_col).select("part", "stats", "label"))
    model = fit(learn.where("part < 2"), learn.where("part = 3"))
    out = score(rows.select(id_col, (F.col("part") == 2).alias("held_out"), "stats"), model, threshold)
    return stage.last(out.select(id_col, "held_out", "score", "predicted"))
