"""Spelling variants of words by a symmetric-delete join.

Every word emits itself and what each single deletion leaves. Two words that
differ by one inserted, deleted or replaced code point share such a key, so an
equi-join finds all near pairs. A key carries the place of its deletion: a replaced
code point leaves one key at one place in both words, an inserted one leaves the
shorter word. The join asks for that, so that it makes near pairs only, and each once;
the exact distance is verified last. A key's words are bounded by the alphabet and the
length of a word, and a word is one row however often it occurs.

A word's form is its most frequent near word, if that is frequent enough. Roots
come from joining each form to its own form until nothing changes; frequencies
multiply along a chain, so it is short, and each round halves what is left of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stages
from .sharding import CRC_TABLE, crc_sql

RUN = "[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One (document, run) in so many loses a code point.
ONE_IN = 199


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _LOWER))


def without(c: Column, place: Column) -> Column:
    """``c`` without its code point at ``place``, from 0."""
    return F.concat(c.substr(F.lit(1), place), c.substr(place + 2, F.length(c)))


def damaged_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int = ONE_IN) -> DataFrame:
    """(word) of each run of letters; where ``one_in`` divides crc32 of "id:run", a code point of the run is left out.

    A null text has no runs; a null id counts as an empty one. A run of one code point may become empty.
    """
    runs = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(F.regexp_extract_all(text_col, F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.select("id", lower_ascii(F.col("run")).alias("run"))
    h = F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), "run").cast("binary"))
    rows = runs.select("run", h.alias("h"))
    place = F.pmod("h", F.length("run").cast("long")).cast("int")
    return rows.select(F.when(F.col("h") % one_in == 0, without(F.col("run"), place)).otherwise(F.col("run")).alias("word"))


def word_counts(words: DataFrame, min_length: int = 6, min_count: int = 5) -> DataFrame:
    """(word, n) of words that are long and frequent enough; tasks count before the shuffle."""
    counts = words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= min_count)


def near_pairs(counts: DataFrame) -> DataFrame:
    """(word, n, near, near_n): each ordered pair of words at distance one, once. ``counts`` is (word, n), words distinct and not null."""
    at = F.col("place")
    deletions = counts.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("place")).where(F.length("word") > 0)
    same = F.col("word").substr(at, F.lit(1)) == F.col("word").substr(at + 1, F.lit(1))
    # of the places of one deletion, the first stands for it where the other word is what it leaves
    deletions = deletions.select(without(F.col("word"), at).alias("key"), "place", ((at == 0) | ~same).alias("first"), "word", "n")
    keys = deletions.unionByName(counts.select(F.col("word").alias("key"), F.lit(-1).alias("place"), F.lit(False).alias("first"), "word", "n"))
    other = keys.toDF("key", "there", "other_first", "near", "near_n")
    replaced = (at == F.col("there")) & (at >= 0)
    longer, shorter = F.col("first") & (F.col("there") == -1), (at == -1) & F.col("other_first")
    pairs = keys.join(other, "key").where((replaced | longer | shorter) & (F.col("word") != F.col("near")))
    return pairs.where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n")


def roots(links: DataFrame, stage: Stages) -> DataFrame:
    """(word, root): where each word of ``links`` (word, form), one row a word and no cycle, ends when forms are followed."""
    now = stage(links.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = stage(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        stage.drop(now)
        if new.where("moved").isEmpty():
            return new.select("word", "root")
        now = new.select("word", "root")
        now._gridloom_path = new._gridloom_path
        stage.tables = [now if t is new else t for t in stage.tables]


def spelling_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = 6,
    min_count: int = 5,
    ratio: int = 5,
    one_in: int = ONE_IN,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of ``docs``.

    Words are maximal runs of letters, A-Z in lower case, after ``damaged_runs``, of at
    least ``min_length`` code points and ``min_count`` occurrences (n). n_near counts the words at
    distance one; form is the most frequent of them (ties: smallest by code points), null unless its
    n is at least ``ratio`` (over 1) times the word's; root is where forms lead, the word itself if it has none.
    Null and empty texts have no words; rows that repeat count each time; other columns are ignored;
    an empty table gives an empty result.
    """
    if ratio <= 1:
        raise ValueError("ratio must be over 1: forms must grow")
    stage = Stages()
    counts = stage(word_counts(damaged_runs(docs, id_col, text_col, one_in), min_length, min_count))
    near = near_pairs(counts).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    rows = counts.join(near, "word", "left")
    often = -F.col("best.less") >= ratio * F.col("n")
    rows = stage(
        rows.select(
            "word",
            F.when(often, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(often, -F.col("best.less")).alias("form_n"),
        )
    )
    ends = roots(rows.where("form IS NOT NULL"), stage)
    out = rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    return stage.last(out)


SPELLING_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
found AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '{RUN}')) AS raw FROM documents),
runs AS (SELECT id, translate(raw, '{_UPPER}', '{_LOWER}') AS run, count(*) AS n FROM found GROUP BY ALL),
hashed AS (SELECT run, n, {crc_sql("id || ':' || run")} AS h FROM runs, crc_table),
damaged AS (
  SELECT CASE WHEN h % {ONE_IN} = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n
  FROM hashed),
counts AS (SELECT word, sum(n)::BIGINT AS n FROM damaged WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
places AS (SELECT word, n, unnest(range(length(word))) AS place FROM counts),
deletions AS (SELECT word, n, place, left(word, place::INT) || substr(word, place::INT + 2) AS rest FROM places),
near AS (
  SELECT x.word, x.n, y.word AS near, y.n AS near_n FROM deletions x JOIN deletions y ON x.rest = y.rest AND x.place = y.place AND x.word <> y.word
  UNION SELECT x.word, x.n, y.word, y.n FROM deletions x JOIN counts y ON x.rest = y.word
  UNION SELECT y.word, y.n, x.word, x.n FROM deletions x JOIN counts y ON x.rest = y.word),
best AS (SELECT word, n, count(*) AS n_near, arg_min(near, {{'o': -near_n, 'w': near}}) AS form, max(near_n) AS form_n FROM near GROUP BY word, n),
forms AS (SELECT word, n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n FROM best),
walk AS (
  SELECT word, word AS ends_at, 0 AS step FROM counts
  UNION ALL SELECT walk.word, forms.form, step + 1 FROM walk JOIN forms ON forms.word = walk.ends_at WHERE forms.form IS NOT NULL),
ends AS (SELECT word, arg_max(ends_at, step) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, coalesce(n_near, 0)::BIGINT AS n_near, form_n::BIGINT AS form_n
FROM counts LEFT JOIN forms USING (word) JOIN ends USING (word)
"""
