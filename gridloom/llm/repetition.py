"""Quality rule: repetition found by a suffix array over each document's words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text
from .textstats import measure

#: Words of the shortest repeat that counts.
MIN_REPEAT = 8
#: A document is dropped if more of its words lie in repeats, or its longest repeat has more words.
MAX_COVERED = 0.4
MAX_REPEAT = 100

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repetition_stats(
    docs: DataFrame, min_repeat: int = MIN_REPEAT, text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """Add the counts, ``repeated_words`` and ``longest_repeat`` of each whole text.

    A null, empty or blank text has 0 in every count. Each row is measured by
    itself in one narrow pass; repeated rows give equal rows, and columns of the
    input that bear the name of an added one are replaced.
    """

    def make():
        def run(texts):
            m = measure(texts, min_repeat)
            return {c: m[c] for c in COUNTS} | {"repeated_words": m["repeated"], "longest_repeat": m["longest"]}

        return run

    added = ", ".join(f"{c} long" for c in [*COUNTS, "repeated_words", "longest_repeat"])
    return map_text(docs, make, added, text_col, keep)


def repetition_verdict(stats: DataFrame, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Add ``covered_fraction``, ``base_failed`` and ``kept`` to the result of ``repetition_stats``.

    The base fails texts of under 50 words, or with over half of their words in
    repeated three-word windows; the method also limits how much maximal repeats
    cover and how long the longest is. A text without words has the fraction 0.
    """
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fraction = F.coalesce(F.try_divide(F.col("repeated_words"), F.col("n_words")), F.lit(0.0))
    return stats.withColumns({"covered_fraction": fraction, "base_failed": base}).withColumn(
        "kept",
        ~F.col("base_failed") & (F.col("covered_fraction") <= max_covered) & (F.col("longest_repeat") <= max_repeat),
    )
