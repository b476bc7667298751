"""Language identification by compression with per-language zstandard dictionaries.

Each language's dictionary is raw content: a bounded sample of its texts. A text
is cut into blocks, each block is compressed with each dictionary, and the
language with the smallest total wins. Blocks keep the margin between languages
alike for short and long texts, as a long text would else become its own
dictionary.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_text

#: Bounds of the fitted sample for each language: documents, characters of each, and bytes in all.
SAMPLE_DOCS = 128
SAMPLE_CHARS = 1024
DICT_BYTES = 48 << 10
#: Bytes of a text that are compressed at a time, zstandard's level and its shortest match.
BLOCK = 2 << 10
LEVEL = 6
MIN_MATCH = 3
#: A document is rejected where the margin over the runner-up, as a share of the best size, is less.
MIN_MARGIN = 0.01
#: A text of fewer bytes of letters can't show a margin and is not rejected for it.
MIN_EVIDENCE = 64
UNKNOWN = "und"

_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """What is compressed: the text in lower case, each run of other characters than letters as one space."""
    return _OTHER.sub(" ", text.lower()).encode("utf-8", "surrogatepass")


def remainder(id_col: str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % by


def fit_dictionaries(
    labelled: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    id_col: str = "doc_id",
    docs: int = SAMPLE_DOCS,
    chars: int = SAMPLE_CHARS,
    size: int = DICT_BYTES,
) -> dict[str, bytes]:
    """Raw-content dictionaries of ``labelled``'s languages, from at most ``docs`` rows of each.

    Rows without language or text are not used. Counting the rows of each
    language comes first, so that only the rows with the smallest hashes, about
    twice ``docs`` of each language, leave their partitions. Language values must
    be a bounded set. Without any row the result is empty.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, 2.0 * docs / n + 50.0 / n))])
    # of id and text, so that rows with one id, or without, don't go all or none; copies of one row count once
    key = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.lit("langid")), F.lit(1 << 40))
    few = (
        rows.select(F.col(lang_col).alias("lang"), F.substring(text_col, 1, chars).alias("text"), key.alias("key"))
        .where(F.col("key") < share[F.col("lang")] * float(1 << 40))
        .groupBy("lang", "key")
        .agg(F.min("text").alias("text"))
        .groupBy("lang")
        .agg(F.slice(F.array_sort(F.collect_list(F.struct("key", "text"))), 1, docs).alias("rows"))
    )
    out = {}
    for r in sorted(few.collect(), key=lambda r: (-counts[r["lang"]], r["lang"])):
        texts = [letters(x["text"]) for x in r["rows"]]
        each = max(1, size // max(1, len(texts)))
        out[r["lang"]] = b" ".join(t[:each] for t in texts)[:size]
    return out


class Classifier:
    """Compressors of all languages; made once a task and gone with it."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard as z

        params = z.ZstdCompressionParameters.from_level(
            LEVEL, min_match=MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        self.langs = list(dictionaries)
        self.by = []
        for lang in self.langs:
            d = z.ZstdCompressionDict(dictionaries[lang], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.by.append(z.ZstdCompressor(dict_data=d, compression_params=params).compress)

    def classify(self, text: str | None) -> tuple[str, float, int]:
        """The language, the margin (how much larger the runner-up is, as a share of the best size), and the bytes."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0
        data = letters(text)
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        sizes = [sum(len(c(b)) for b in blocks) for c in self.by]
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        rest = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best])
        return self.langs[best], (rest - sizes[best]) / sizes[best], len(data)


def classify(
    docs: DataFrame,
    dictionaries: dict[str, bytes],
    min_margin: float = MIN_MARGIN,
    text_col: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """Add ``lang_pred``, ``score`` (0 to 1, higher: surer), ``margin`` and ``lang_rejected``.

    A null text or one without a letter is ``und`` with score and margin 0 and is
    rejected; a text whose margin is under ``min_margin`` keeps its language but
    is rejected, if it has MIN_EVIDENCE bytes of letters. Ties go to the language
    that comes first, the most frequent one when ``fit_dictionaries`` made them. Whole
    texts are read, in one narrow pass; repeated rows give equal rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # bounded by DICT_BYTES each

    def make():
        c = Classifier(shared.value)

        def run(texts):
            got = pd.DataFrame([c.classify(t) for t in texts], columns=["lang", "margin", "bytes"])
            narrow = (got["margin"] < min_margin) & (got["bytes"] >= MIN_EVIDENCE)
            return {
                "lang_pred": got["lang"].tolist(),
                "score": (got["margin"] / (got["margin"] + 0.05)).tolist(),
                "margin": got["margin"].tolist(),
                "lang_rejected": ((got["lang"] == UNKNOWN) | narrow).tolist(),
            }

        return run

    added = "lang_pred string, score double, margin double, lang_rejected boolean"
    return map_text(docs, make, added, text_col, keep)
