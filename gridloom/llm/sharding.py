"""Sharding by a Feistel permutation with cycle walking, in DataFrame functions only.

Rows get global numbers 0 to n - 1 in the order of a digest of their id and text. A
keyed Feistel network over a x b, the tightest rectangle that holds n, permutes the
numbers; a number that leaves 0 to n - 1 walks on along its cycle until it is back.
Place p of the permutation is slot p // shards of shard p % shards, so shards
differ by one row at most, and either direction is arithmetic on (n, shards, seed):
``place_of`` finds a number's shard and slot, ``number_at`` the number of a slot.

Numbers come without a global sort: the digest's first digits deal rows into BUCKETS
ranges, whose totals (a table of that many rows, whatever the input) give offsets, and
a window numbers the rows of each. Rows that repeat as a whole are counted first, and
their count is numbered as one, so no copy makes a range larger.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stages

SHARDS = 8
SEED = 20
ROUNDS = 8
#: Hexadecimal digits of the digest that name a range of rows, and so the number of ranges.
DIGITS = 3
BUCKETS = 16**DIGITS
#: Copies of one row that one task writes at most.
CHUNK = 1 << 16
#: A prime; round functions are cubes modulo it, whose products a long holds.
PRIME = (1 << 31) - 1


def round_keys(seed: int) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"{seed}:{k}".encode()).digest()[:8], "big") % PRIME for k in range(ROUNDS)]


def sides(n: int) -> tuple[int, int]:
    """(a, b) with a * b - n from 0 to a - 1. Both stay under PRIME for any n under 2 ** 61."""
    a = math.isqrt(max(n, 1) - 1) + 1
    return a, max(1, -(-n // a))


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _cubed(half: Column, key: Column) -> Column:
    x = (half + key) % PRIME
    return x * x % PRIME * x % PRIME


def _halves(x: Column, b: int) -> tuple[Column, Column]:
    return F.call_function("div", x, _long(b)).cast("long"), x % _long(b)


def _pass(x: Column, n: int, seed: int, back: bool = False) -> Column:
    """One pass of the network, or of its inverse, over 0 to a * b - 1, as a fold over its rounds."""
    a, b = sides(n)
    rounds = list(enumerate(round_keys(seed)))
    keys = F.array(*[F.struct(F.lit(k % 2 == 0).alias("left"), _long(key).alias("key")) for k, key in (rounds[::-1] if back else rounds)])

    def step(s: Column, k: Column) -> Column:
        f = _cubed(F.when(k["left"], s["r"]).otherwise(s["l"]), k["key"]) * (-1 if back else 1)
        left = F.when(k["left"], F.pmod(s["l"] + f, _long(a))).otherwise(s["l"])
        right = F.when(k["left"], s["r"]).otherwise(F.pmod(s["r"] + f, _long(b)))
        return F.struct(left.alias("l"), right.alias("r"))

    left, right = _halves(x, b)
    return F.aggregate(keys, F.struct(left.alias("l"), right.alias("r")), step, lambda s: s["l"] * b + s["r"])


def _walked(y: Column, n: int, seed: int, back: bool = False) -> Column:
    """``y``, or where it is n or more, the first number under n that more passes reach.

    A cycle has at most a * b - n numbers outside, fewer than a; one of about a numbers is there, so walks cost a pass a row.
    """
    a, b = sides(n)
    if a * b == n or n == 0:
        return y
    on = F.aggregate(F.sequence(_long(1), _long(a * b - n)), y, lambda v, _: F.when(v < n, v).otherwise(_pass(v, n, seed, back)))
    return F.when(y < n, y).otherwise(on)


def place_of(number: Column, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[Column, Column]:
    """(shard, slot) of a row's global number, 0 to n - 1; null where it is null."""
    place = _walked(_pass(number.cast("long"), n, seed), n, seed)
    return _shard_slot(place, shards)


def number_at(shard: Column, slot: Column, n: int, shards: int = SHARDS, seed: int = SEED) -> Column:
    """The global number of the row at a shard's slot; null where the shard has no such slot."""
    place = slot.cast("long") * shards + shard
    there = (shard >= 0) & (shard < shards) & (slot >= 0) & (place < n)
    return F.when(there, _walked(_pass(place, n, seed, back=True), n, seed, back=True))


def _shard_slot(place: Column, shards: int) -> tuple[Column, Column]:
    return (place % shards).cast("int"), F.call_function("div", place, _long(shards)).cast("long")


def permuted(rows: DataFrame, n: int, seed: int = SEED, number: str = "number") -> DataFrame:
    """Add ``place``, where the permutation takes ``number``.

    A column a round keeps the first pass in generated code; only numbers that leave 0 to n - 1 walk.
    """
    a, b = sides(n)
    left, right = _halves(F.col(number), b)
    out = rows.withColumns({"__l": left, "__r": right})
    for k, key in enumerate(round_keys(seed)):
        moved, by, m = ("__l", "__r", a) if k % 2 == 0 else ("__r", "__l", b)
        out = out.withColumn(moved, F.pmod(F.col(moved) + _cubed(F.col(by), _long(key)), _long(m)))
    out = out.withColumn("place", F.col("__l") * b + F.col("__r"))
    return out.withColumn("place", _walked(F.col("place"), n, seed)).drop("__l", "__r")


def numbered(rows: DataFrame, by: list[str], stage: Stages) -> tuple[DataFrame, int]:
    """``rows`` with ``number``, 0 to n - 1 in the order of ``by``, and n.

    The first of ``by`` is a digest in hexadecimal digits. Rows that are equal in all columns are
    counted first; they get numbers in a row.
    """
    columns = rows.columns
    counted = stage(rows.groupBy(*columns).agg(F.count("*").alias("__copies")).withColumn("__bucket", F.conv(F.substring(by[0], 1, DIGITS), 16, 10).cast("int")))
    totals = counted.groupBy("__bucket").agg(F.sum("__copies").alias("__n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage(totals.select("__bucket", "__n", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset")))  # at most BUCKETS rows
    n = offsets.agg(F.sum("__n")).first()[0] or 0
    inside = Window.partitionBy("__bucket").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    start = (F.col("__offset") + F.coalesce(F.sum("__copies").over(inside), F.lit(0))).alias("__start")
    placed = counted.join(F.broadcast(offsets.select("__bucket", "__offset")), "__bucket").select(*columns, "__copies", start)
    numbers = F.explode(F.sequence(F.col("__start"), F.col("__start") + F.col("__copies") - 1)).alias("number")
    chunks = F.explode(F.sequence(_long(0), F.col("__copies") - 1, _long(CHUNK))).alias("__chunk")
    many = placed.where(F.col("__copies") > CHUNK).select(*columns, "__copies", "__start", chunks)
    many = many.select(*columns, F.least(F.col("__copies") - F.col("__chunk"), _long(CHUNK)).alias("__copies"), (F.col("__start") + F.col("__chunk")).alias("__start"))
    few = placed.where(F.col("__copies") <= CHUNK)
    if counted.where(F.col("__copies") > CHUNK).isEmpty():
        return few.select(*columns, numbers), n
    return few.unionByName(many.repartition("__start")).select(*columns, numbers), n


def shard_rows(
    df: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """(``id_col``, size, text_crc32, law, shard, slot, grown_shard) of each row, and the columns that ``keep`` names.

    The law is ``rows``: counts of shards differ by one at most, and slots have no gaps; where rows go depends on
    the ids and texts of all rows, on ``shards`` and ``seed`` only, not on partitions or order. size is the bytes of the text
    in UTF-8 plus 1; a null text has none, and its checksum is that of no bytes. A null id sorts as an empty one.
    Rows that repeat take places of their own, which of the equal rows is where makes no difference.
    grown_shard is null, as another number of shards deals all rows anew. An empty table gives no rows.
    Columns that aren't named are ignored; of those in ``keep``, one named as a result's column is left out, and
    all must be groupable.
    """
    stage = Stages()
    added = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    kept = {f"__kept{i}": c for i, c in enumerate(keep or []) if c.lower() not in {x.lower() for x in [id_col, *added]}}
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text).cast("binary"))
    size, crc = F.octet_length(text).cast("long") + 1, F.crc32(text.cast("binary"))
    rows = df.select(digest.alias("__digest"), F.col(id_col).alias("__id"), size.alias("size"), crc.alias("text_crc32"), *[F.col(c).alias(k) for k, c in kept.items()])
    rows, n = numbered(rows, ["__digest", "__id", *kept], stage)
    shard, slot = _shard_slot(F.col("place"), shards)
    out = permuted(rows, n, seed).select(
        F.col("__id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        shard.alias("shard"),
        slot.alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *[F.col(k).alias(c) for k, c in kept.items()],
    )
    return stage.last(out)


def write_shards(rows: DataFrame, path: str, rows_per_file: int = 1 << 20) -> None:
    """Write ``rows`` (shard, slot and others) as Parquet, a folder a shard, whose files hold runs of slots in order."""
    part = F.call_function("div", F.col("slot"), _long(rows_per_file))
    dealt = rows.repartition("shard", part).sortWithinPartitions("shard", "slot")
    dealt.write.partitionBy("shard").option("maxRecordsPerFile", rows_per_file).parquet(path)


#: DuckDB: the table of crc32 by its rule, and the checksum of a string's UTF-8 bytes with it.
CRC_TABLE = """crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS crcs)"""


def crc_sql(text: str) -> str:
    bytes_ = f"list_transform(regexp_extract_all(hex({text}), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"(4294967295 - list_reduce({bytes_}, lambda c, b: xor(c >> 8, crcs[xor(c & 255, b) + 1]), 4294967295))"


def _rounds_sql(x: str) -> str:
    """The place that one pass gives to the number ``x``; a and b are columns."""
    out = f"SELECT {x} // b AS l0, {x} % b AS r0"
    for k, key in enumerate(round_keys(SEED)):
        by = f"r{k}" if k % 2 == 0 else f"l{k}"
        m = f"(({by} + {key}) % {PRIME})"
        f = f"{m} * {m} % {PRIME} * {m} % {PRIME}"
        moved = f"(l{k} + {f}) % a AS l{k + 1}, r{k} AS r{k + 1}" if k % 2 == 0 else f"l{k} AS l{k + 1}, (r{k} + {f}) % b AS r{k + 1}"
        out = f"SELECT *, {moved} FROM ({out})"
    return f"(SELECT l{ROUNDS} * b + r{ROUNDS} FROM ({out}))"


SHARD_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
total AS (SELECT count(*) AS n, greatest(ceil(sqrt(count(*)))::BIGINT, 1) AS a FROM documents),
rect AS (SELECT n, a, greatest((n + a - 1) // a, 1) AS b FROM total),
rows_ AS (
  SELECT doc_id, coalesce(text, '') AS text,
    row_number() OVER (ORDER BY md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), doc_id) - 1 AS number
  FROM documents),
walk AS (
  SELECT number, {_rounds_sql("number")} AS place FROM rows_, rect
  UNION ALL
  SELECT number, {_rounds_sql("place")} FROM walk, rect WHERE place >= n)
SELECT doc_id, octet_length(encode(text)) + 1 AS size, {crc_sql("text")} AS text_crc32, 'rows' AS law,
  (place % {SHARDS})::INT AS shard, place // {SHARDS} AS slot, NULL::INT AS grown_shard
FROM rows_ JOIN walk USING (number), crc_table, rect WHERE place < n
"""
