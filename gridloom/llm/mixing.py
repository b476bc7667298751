"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate: its share of the target rows over its
rows. A document's number of copies is the inverse of that Poisson distribution
at a uniform number hashed from the seed and the document, so that it depends on
no other row and no random state. Copies are exploded and shuffled globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Sources whose rates may be broadcast at most; beyond that the join is shuffled and salted.
BROADCAST_SOURCES = 10_000
#: The largest mean rate whose distribution a double can hold from its lower end; larger ones are sums of draws.
MAX_RATE = 500.0
SALTS = 64
#: Copies of a row that are exploded at a time.
CHUNK = 1 << 16
SEED = 29
#: Without weights, a source's weight is its number of rows to this power.
POWER = 0.5


def uniform(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of md5 over the seed and the parts as text; nulls count as empty."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / float(1 << 52)


def source_rates(
    docs: DataFrame, source_col: str, weights: dict[str, float] | None = None, total: float | None = None, power: float = POWER
) -> DataFrame:
    """(source, n, rate) of each source.

    ``weights`` gives the target share of each source, in any unit; sources it
    does not name get the rate 0. Without it a source weighs its rows to
    ``power``. ``total`` is the number of rows to aim at, by default as many as
    there are. A null source is a source of its own, named by the key None.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(power))
    else:
        named = [x for k, w in weights.items() if k is not None for x in (F.lit(k), F.lit(float(w)))]
        known = F.create_map(*named)[F.col("source")] if named else F.lit(None).cast("double")
        weight = F.coalesce(F.when(F.col("source").isNull(), float(weights.get(None, 0.0))).otherwise(known), F.lit(0.0))
    weighed = counts.withColumn("weight", weight)
    sums = weighed.agg(F.sum("weight").alias("weight"), F.sum("n").alias("n")).first()
    rows = float(sums["n"] or 0) if total is None else float(total)
    rate = F.try_divide(F.lit(rows) * F.col("weight"), F.lit(sums["weight"] or 0.0) * F.col("n"))
    return weighed.select("source", "n", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def poisson_steps(rate: Column) -> Column:
    """Array whose element k is P(X <= k), up to where nothing is left in double precision."""
    most = (rate + 12 * F.sqrt(rate) + 25).cast("int")
    first = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("steps"))

    def step(acc, k):
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(acc["steps"], F.array(F.element_at(acc["steps"], -1) + p)).alias("steps"))

    return F.aggregate(F.sequence(F.lit(1), most), first, step, lambda acc: acc["steps"])


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    total: float | None = None,
    seed: int = SEED,
    source_col: str = "source",
    id_col: str = "doc_id",
    power: float = POWER,
) -> DataFrame:
    """The rows of ``docs``, each as often as drawn, with ``copy`` (from 1), in a globally shuffled order.

    Any column is kept; input columns named ``copy`` or ``shuffle_key`` are
    replaced. The draw is seeded by the id, so rows that repeat an id are drawn
    alike; a row with a null id is seeded by its other columns. Empty input gives no rows. A source
    may have any rate: one over MAX_RATE is drawn as the sum of equal parts, each
    with a number of its own, and copies come in runs of at most CHUNK, so any ``total`` can be aimed at.
    """
    rates = source_rates(docs, source_col, weights, total, power)
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / MAX_RATE)).cast("int")
    rates = rates.select(F.col("source").alias("__mix_source"), parts.alias("__mix_parts"), (F.col("rate") / parts).alias("__mix_rate"))
    rates = rates.withColumn("__mix_steps", poisson_steps(F.col("__mix_rate")))
    rates = staged(rates)  # a row a source
    docs = docs.drop("copy", "shuffle_key")
    content = F.concat(F.lit("row "), F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])), 256))
    own = F.when(F.col(id_col).isNull(), content).otherwise(F.col(id_col).cast("string"))
    few = rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    if few:
        joined = docs.join(F.broadcast(rates), docs[source_col].eqNullSafe(F.col("__mix_source")))
    else:
        salted = docs.withColumn("__mix_salt", F.pmod(F.xxhash64(own), F.lit(SALTS)).cast("int"))
        spread = rates.withColumn("__mix_salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(
            spread, salted[source_col].eqNullSafe(F.col("__mix_source")) & (F.col("__mix_salt") == F.col("__mix_salt2"))
        ).drop("__mix_salt", "__mix_salt2")
    draw = lambda u: F.size(F.filter("__mix_steps", lambda x: x < u))
    further = F.when(F.col("__mix_parts") > 1, F.sequence(F.lit(2), F.col("__mix_parts"))).otherwise(F.array().cast("array<int>"))
    n = F.aggregate(further, draw(uniform(seed, own)), lambda acc, k: acc + draw(uniform(seed, own, F.lit("part"), k)))
    drawn = joined.withColumn("__mix_n", n).drop("__mix_steps", "__mix_parts", "__mix_rate", "__mix_source")
    runs = F.explode(F.sequence(F.lit(1), F.col("__mix_n"), F.lit(CHUNK)))
    copies = drawn.where("__mix_n > 0").withColumn("__mix_run", runs)
    one = F.sequence(F.col("__mix_run"), F.least(F.col("__mix_n"), F.col("__mix_run") + (CHUNK - 1)))
    copies = copies.withColumn("copy", F.explode(one)).drop("__mix_n", "__mix_run")
    keyed = copies.withColumn("shuffle_key", uniform(seed + 1, own, F.col("copy")))
    # a hashed deal by a uniform key and a sort within each part: a global shuffle with one exchange
    return keyed.repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key")


#: DuckDB's form of ``mix`` with the default parameters.
MIX_SQL = f"""
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (
  SELECT source, sum(n) OVER () * sqrt(n) / (sum(sqrt(n)) OVER () * n) AS rate FROM counts),
steps AS (
  SELECT source, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS p
  FROM rates, range(0, 60) r(k)),
drawn AS (
  SELECT d.*, (('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496 AS u
  FROM documents d),
counted AS (
  SELECT d.doc_id, d.source, d.text, (SELECT count(*) FROM steps s WHERE s.source = d.source AND s.p < d.u)::INTEGER AS copies
  FROM drawn d)
SELECT doc_id, source, text, c::INTEGER AS copy,
  (('0x' || substr(md5('{SEED + 1}|' || doc_id || '|' || c), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496 AS shuffle_key
FROM counted, range(1, copies + 1) r(c)
"""
