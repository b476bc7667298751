"""Secret scan with corpus-wide ownership frequency.

Each text is scanned for candidates. The hashes of their values are counted over
the corpus by distinct owners and repositories: a value that many owners or very
many repositories have is a widely copied example, one that few have is specific
to them and looks live. Base kinds are always reported; broader candidates are
only where they look live.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Stages, map_text, slices

#: The base kinds in their order, and then the broader one.
KINDS = ["assign", "access", "hex", "opaque"]
_KEYWORD = re.compile(r"password|passwd|secret|token|api_?key", re.IGNORECASE | re.ASCII)
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")

#: An opaque value has this entropy at least, in bits a character, and both letters and digits.
MIN_ENTROPY = 3.5
#: A value that as many owners or repositories have, or more, is an example: an owner repeats its own in fewer repositories.
EXAMPLE_OWNERS = 5
EXAMPLE_REPOS = 100
#: The columns that a row is joined by: two 64-bit hashes of its id and text.
ROW_KEY = ("row_key1", "row_key2")


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def candidates(text: str | None) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, hash of the value) of each candidate, by start and then kind."""
    if not text:
        return []
    found = []
    if _KEYWORD.search(text):
        found += [(0, m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(2, m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    taken = sorted((s, e) for _, s, e, _ in found)
    at = 0
    for m in _OPAQUE.finditer(text):  # in order, as the taken spans are
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        near = takewhile(lambda x: x[0] < m.end(), (taken[i] for i in range(at, len(taken))))  # noqa: B023
        free = not any(e > m.start() for _, e in near)
        v = m[0]
        if free and any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and _entropy(v) >= MIN_ENTROPY:
            found.append((3, m.start(), m.end(), v))
    digest = lambda v: int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "big", signed=True)
    return sorted((k, s, e, digest(v)) for k, s, e, v in found)


def scan(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``candidates``: an array of (kind, start, end, hash), empty for a null or empty text."""

    def make():
        names = ("kind", "start", "end", "hash")
        return lambda texts: {
            "candidates": [[dict(zip(names, c, strict=True)) for c in candidates(t)] for t in texts]
        }

    return map_text(docs, make, "candidates array<struct<kind:int,start:int,end:int,hash:long>>", text_col, keep)


def ownership(scanned: DataFrame, owner_col: str, repo_col: str) -> DataFrame:
    """(hash, n_owners, n_repos) of each candidate value; a null owner or repository counts as one of its own.

    Rows are counted for each (hash, owner, repository), then (hash, owner), then
    hash, each time partly before the shuffle: a value that a third of all rows
    has never meets in one task as rows.
    """
    rows = scanned.select(
        F.col(owner_col).alias("owner"), F.col(repo_col).alias("repo"), F.explode("candidates.hash").alias("hash")
    )
    return (
        rows.groupBy("hash", "owner", "repo")
        .agg(F.lit(1).alias("one"))
        .groupBy("hash", "owner")
        .agg(F.count("*").alias("repos"))
        .groupBy("hash")
        .agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"))
    )


def row_key(id_col: str, text_col: str) -> dict:
    """ROW_KEY's columns; two rows with one id and one text have the same."""
    return {ROW_KEY[0]: F.xxhash64(id_col, text_col), ROW_KEY[1]: F.xxhash64(F.lit(1), id_col, text_col)}


def find_secrets(
    docs: DataFrame,
    owner_col: str = "source",
    repo_col: str = "doc_id",
    id_col: str = "doc_id",
    text_col: str = "text",
    example_owners: int = EXAMPLE_OWNERS,
    example_repos: int = EXAMPLE_REPOS,
) -> DataFrame:
    """Per row: ``id_col``, the columns of ROW_KEY, ``base`` and ``spans``.

    ``base`` and ``spans`` are arrays of (start, kind, end, live), by start and
    then kind; ``spans`` has the base ones and those opaque ones that look live.
    ``live`` is false for values of ``example_owners`` owners or ``example_repos``
    repositories, or more. A null or empty text has none. Repeated rows give equal
    rows; a null id or owner is a value of its own.
    """
    cols = {"_id": F.col(id_col), "_owner": F.col(owner_col), "_repo": F.col(repo_col), **row_key(id_col, text_col), "_text": F.col(text_col)}
    stage, key = Stages(), list(ROW_KEY)
    scanned = stage(scan(docs.select(*[c.alias(n) for n, c in cols.items()]), "_text", ["_id", "_owner", "_repo", *key]))
    owners = ownership(scanned, "_owner", "_repo")
    # the many places of a common value are spread over salts, and its one row of counts is repeated for each
    salts = 16
    places = (
        scanned.select(*key, F.explode(F.array_distinct("candidates")).alias("c"))
        .select(*key, "c.*", F.pmod(F.hash(*key), F.lit(salts)).alias("salt"))
        .distinct()
    )
    counted = owners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    live = (F.col("n_owners") < example_owners) & (F.col("n_repos") < example_repos)
    judged = (
        places.join(counted, ["hash", "salt"])
        .groupBy(*key)
        .agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", live.alias("live")))).alias("found"))
    )
    some = scanned.where(F.size("candidates") > 0).select("_id", *key).join(judged, key, "left")
    none = scanned.where(F.size("candidates") == 0).select("_id", *key, F.lit(None).cast(judged.schema["found"].dataType).alias("found"))
    rows = some.select("_id", *key, "found").unionByName(none)
    found = F.coalesce("found", F.array().cast(judged.schema["found"].dataType))
    out = rows.select(
        F.col("_id").alias(id_col),
        *key,
        F.filter(found, lambda x: x["kind"] < 3).alias("base"),
        F.filter(found, lambda x: (x["kind"] < 3) | x["live"]).alias("spans"),
    )
    return stage.last(out)


def _listed(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"], x["end"])), ",")


def span_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        id_col,
        *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda x: ~x["live"])).cast("long").alias("n_example"),
    )


def redacted(text: str, spans: list[dict]) -> str:
    """``text`` with each span replaced by [redacted kind], or [example kind] for a copied one.

    ``spans`` are in order; of those that overlap the first is named, and all are one.
    """
    out, at = [], 0
    for x in spans:
        if x["start"] >= at:
            out += [text[at : x["start"]], "[redacted " if x["live"] else "[example ", KINDS[x["kind"]], "]"]
        at = max(at, x["end"])
    return "".join([*out, text[at:]])


def redact(rows: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """``rows`` without ``spans_col``, and with the spans replaced in ``text_col``; a null text, or one without spans, stays."""
    names = [c for c in rows.columns if c != spans_col]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.select(*names).schema])
    arrow, n, at = to_arrow_schema(schema), len(names), names.index(text_col)

    def run(batches):
        for batch in batches:
            for part in slices(batch, at):
                texts, spans = part.column(at).to_pylist(), part.column(n).to_pylist()
                new = pa.array([redacted(t, s) if t and s else t for t, s in zip(texts, spans, strict=True)], arrow.field(at).type)
                yield pa.RecordBatch.from_arrays([new if i == at else part.column(i).cast(arrow.field(i).type) for i in range(n)], schema=arrow)

    return rows.select(*names, spans_col).mapInArrow(run, schema)
