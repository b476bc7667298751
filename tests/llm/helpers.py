"""Small documents with all the odd cases, and a generator of invented prose."""

import numpy as np

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, ids string, spans string"


def prose(rng, words, vocabulary=400):
    return " ".join(f"w{rng.integers(0, vocabulary)}{'abcdefgh'[rng.integers(0, 8)]}" for _ in range(words))


def odd_rows():
    rng = np.random.default_rng(11)
    long_text = prose(rng, 30_000, 5000)
    texts = [None, "", " \n\t ", "one", "One two", "a b c d", "été ☃ naïve 🙂", long_text, "x" * 50_000, "same words here again", "same words here again"]
    rows = [(i, t, "en", f"src{i % 3}", 0, "s", "i", "p") for i, t in enumerate(texts)]
    return rows + [(None, "no id at all", None, None, None, None, None, None), rows[-1]]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
