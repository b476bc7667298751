"""Queries of training samples, scalers, histograms and tables side by side."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import colour, scalars
from gridloom.operators import ranking, relational, sampling
from gridloom.plans.base import GRID, query
from gridloom.plans.similarity import _DRAW


def _ranked(seed: int) -> str:
    """Members of each label, in the order in which samplers number them."""
    part = _DRAW.format(f"'{seed}|' || vec_id")
    return (
        f"r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY {part} % {sampling.SALTS}, vec_id) - 1 AS k, "
        "count(*) OVER (PARTITION BY label) AS n FROM embeddings)"
    )


@query(
    f"""WITH {_ranked(47)} SELECT a.label, a.vec_id, b.vec_id AS close, a.vec_id AS same FROM r a JOIN r b ON b.label = a.label
AND b.k = {_DRAW.format("'47|' || a.vec_id || '|partner'")} % a.n"""
)
def training_partners(t):
    return sampling.partners(t.embeddings, "label", "vec_id", 47)


@query(
    f"""WITH {_ranked(53)}, l AS (SELECT label, count(*) AS n FROM embeddings GROUP BY ALL),
i AS (SELECT label, n, row_number() OVER (ORDER BY {_DRAW.format("'53|' || label")} % {sampling.SALTS}, label) - 1 AS i, count(*) OVER () AS m FROM l),
d AS (SELECT b, {_DRAW.format("'53|' || b || '|label|' || y")} % (SELECT count(*) FROM l) AS i, y FROM range(30) x(b), range(10) z(y)),
f AS (SELECT b, i, row_number() OVER (PARTITION BY b ORDER BY y) - 1 AS slot FROM (SELECT b, i, min(y) AS y FROM d GROUP BY ALL)),
s AS (SELECT b FROM f GROUP BY b HAVING count(*) < 5),
a AS (SELECT b, i, slot FROM f WHERE slot < 5 AND b NOT IN (FROM s)
  UNION ALL SELECT b, i, row_number() OVER (PARTITION BY b ORDER BY {_DRAW.format("'53|' || b || '|order|' || i")}, i) - 1 FROM s, i QUALIFY row_number() OVER (PARTITION BY b ORDER BY {_DRAW.format("'53|' || b || '|order|' || i")}, i) <= 5)
SELECT a.b AS batch, a.slot::INTEGER AS slot, i.label, r.vec_id FROM a JOIN i USING (i) JOIN r ON r.label = i.label AND r.k = {_DRAW.format("'53|' || a.b || '|member|' || a.slot")} % i.n"""
)
def distinct_label_batches(t):
    return sampling.label_batches(t.embeddings, "label", "vec_id", 30, 5, 53)


@query(
    """WITH n AS (SELECT count(*) AS n, (count(*) + 6) // 7 * 7 AS total FROM documents), d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ix FROM documents)
SELECT doc_id, ix, (p % 7)::INTEGER AS shard, p // 7 AS place FROM (SELECT doc_id, ix, unnest(range(ix, total, n)) AS p FROM d, n)"""
)
def padded_sampler_shards(t):
    from gridloom.operators.order import running_sums

    rows = running_sums(t.documents.select("doc_id", F.lit(1).alias("one")), "doc_id", ["one"])
    return sampling.padded_shards(rows.select("doc_id", F.col("before_one").cast("long").alias("ix")), "ix", 7)


@query(
    """WITH g AS (SELECT slide, row_number() OVER (ORDER BY slide) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT l_suppkey AS slide FROM lineitem)),
h AS (SELECT *, n // 3 AS s, n % 3 AS x FROM g),
o AS (SELECT slide, (CASE WHEN i < x * (s + 1) THEN i // (s + 1) ELSE x + (i - x * (s + 1)) // s END)::INTEGER AS own FROM h)
SELECT f::INTEGER AS fold, slide, CASE WHEN own <> f THEN 'train' WHEN slide = max(slide) OVER (PARTITION BY own) THEN 'validation' ELSE 'test' END AS part FROM o, range(3) y(f)"""
)
def fold_train_test_validation(t):
    return ranking.fold_parts(t.lineitem.select(F.col("l_suppkey").alias("slide")), "slide", 3)


@query(
    """WITH f AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS d FROM lineitem WHERE l_returnflag = 'A')
SELECT l_orderkey, l_linenumber, round((l_quantity - a) / (b - a), 6) AS l_quantity, round((l_extendedprice - c) / (d - c), 6) AS l_extendedprice FROM lineitem, f"""
)
def minmax_fit_transform(t):
    columns = ["l_quantity", "l_extendedprice"]
    fitted = ranking.fit_minmax(t.lineitem.where("l_returnflag = 'A'"), columns)
    out = ranking.apply_minmax(t.lineitem.select("l_orderkey", "l_linenumber", *columns), fitted, columns)
    return out.withColumns({c: F.round(c, 6) for c in columns})


@query(
    """WITH s AS (SELECT count(*)::DOUBLE AS s FROM lineitem GROUP BY l_partkey), e AS (SELECT min(s) AS a, (max(s) - min(s)) / 10 AS w FROM s),
n AS (SELECT least(floor((s - a) / w), 9)::INTEGER AS bin, count(*) AS n FROM s, e GROUP BY ALL)
SELECT b::INTEGER AS bin, round(a + w * b, 6) AS low, round(a + w * (b + 1), 6) AS high, coalesce(n, 0) AS n FROM range(10) x(b) CROSS JOIN e LEFT JOIN n ON n.bin = b"""
)
def group_size_histogram(t):
    return ranking.size_histogram(t.lineitem, ["l_partkey"]).withColumns({c: F.round(c, 6) for c in ("low", "high")})


@query(
    """WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS place FROM customer),
b AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS place FROM part)
SELECT coalesce(a.place, b.place) AS place, c_custkey, p_partkey FROM a FULL JOIN b ON a.place = b.place"""
)
def tables_side_by_side(t):
    a, b = t.customer.select("c_custkey", "c_acctbal"), t.part.select("p_partkey", "p_retailprice")
    return relational.side_by_side(a, b, ("c_acctbal", "c_custkey"), ("p_retailprice", "p_partkey")).select("place", "c_custkey", "p_partkey")


@query(
    """SELECT l_suppkey, round(avg((l_quantity >= 40)::INTEGER), 6) AS full_, round(avg((l_quantity >= 10 AND l_quantity < 40)::INTEGER), 6) AS part, round(avg((l_quantity < 10)::INTEGER), 6) AS none
FROM lineitem GROUP BY ALL"""
)
def share_bands(t):
    out = relational.share_bands(t.lineitem, ["l_suppkey"], "l_quantity", 10, 40).withColumnRenamed("full", "full_")
    return out.withColumns({c: F.round(c, 6) for c in ("full_", "part", "none")})


@query(
    f"""WITH {GRID}, w AS (SELECT slide, a::INTEGER AS wr, b::INTEGER AS wc FROM (SELECT DISTINCT slide FROM grid), range(4) x(a), range(4) y(b)),
n AS (SELECT w.slide, wr, wc, count(g.vec_id) AS n, least(4, 10 - wr * 3) * least(4, 10 - wc * 3) AS area
  FROM w LEFT JOIN grid g ON g.slide = w.slide AND g.label < 5 AND g.r >= wr * 3 AND g.r < wr * 3 + 4 AND g.c >= wc * 3 AND g.c < wc * 3 + 4 GROUP BY ALL)
SELECT slide, wr, wc, round(CASE WHEN n < area THEN n / area ELSE 0 END, 6) AS share FROM n"""
)
def window_mark_share(t):
    slides = t.grid().select("slide").distinct()
    steps = F.sequence(F.lit(0), F.lit(3))
    windows = slides.select("slide", F.explode(steps).alias("wr")).withColumn("wc", F.explode(steps))
    sizes = slides.withColumns({"height": F.lit(10), "width": F.lit(10)})
    return relational.window_shares(t.grid().where("label < 5"), windows, sizes, 4, 3).withColumn("share", F.round("share", 6))


@query(
    """WITH p AS (SELECT p_partkey, p_name, p_size / 10.0::DOUBLE AS d, (p_size + p_partkey) % 4 AS a, p_partkey % 3 AS b FROM part)
SELECT p_partkey, floor(255 * exp(-d))::INTEGER AS intensity, p_name AS text, CASE WHEN a = b THEN 'y' ELSE 'x' END AS first, CASE WHEN a = b THEN 1 ELSE 2 END AS entries FROM p"""
)
def inverse_values(t):
    n, key = F.col("p_size"), F.col("p_partkey")
    p = t.part.select("p_partkey", "p_name", (n / 10.0).alias("d"), ((n + key) % 4).cast("long").alias("a"), (key % 3).cast("long").alias("b"))
    names = scalars.inverted(F.create_map(F.lit("x"), F.col("a"), F.lit("y"), F.col("b")))
    text = scalars.text_of(F.encode("p_name", "UTF-8"))
    return p.select("p_partkey", scalars.intensity(F.col("d")).alias("intensity"), text.alias("text"), names[F.col("a")].alias("first"), F.size(names).alias("entries"))


@query(
    """WITH p AS (SELECT p_partkey, p_type, p_size, p_name FROM part)
SELECT p_partkey, CASE WHEN ends_with(p_type, 'TIN') THEN left(p_type, length(p_type) - 3) ELSE p_type END AS stem, left(p_type, length(p_type) - 1) AS shorter,
  array_to_string(list_slice(string_split(p_type, ' '), 1, 2), ' ') AS prefix,
  CASE WHEN p_size < 1 THEN '***' WHEN p_size < 10 THEN '**' WHEN p_size < 50 THEN '*' ELSE 'n.s.' END AS stars,
  printf('#%02x%02x%02x', least(p_size * 6, 255)::INTEGER, p_size::INTEGER, 255 - p_size::INTEGER) AS colour,
  coalesce(list_position(list_transform(string_split(p_type, ' '), lambda x: contains(x, 'STEEL')), true), 1)::INTEGER - 1 AS first FROM p"""
)
def text_scalars(t):
    kind, n = F.col("p_type"), F.col("p_size")
    return t.part.select(
        "p_partkey", scalars.without_suffix(kind, "TIN").alias("stem"), scalars.without_last(kind).alias("shorter"), scalars.key_prefix(kind, 2, " ").alias("prefix"),
        scalars.stars(n / 1000.0).alias("stars"), scalars.hex_colour(n * 6, n, 255 - n).alias("colour"), scalars.first_preferred(F.split(kind, " "), "STEEL").alias("first"),
    )


def _stain_sql() -> str:
    """Amounts of three stains by Cramer's rule, from the columns r, g and b of ``px``."""
    (a, b, c), (d, e, f), (g, h, i) = colour.STAINS
    det = f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))::DOUBLE"
    x, y, z = (f"(ln(greatest({v} / 255.0::DOUBLE, 1e-6)) / ln(1e-6))" for v in "rgb")
    # the mixing matrix stands row by row, so its transpose is what Cramer's rule takes
    stains = {
        "haematoxylin": f"{x} * ({e} * {i} - {h} * {f}) - {d} * ({y} * {i} - {h} * {z}) + {g} * ({y} * {f} - {e} * {z})",
        "eosin": f"{a} * ({y} * {i} - {h} * {z}) - {x} * ({b} * {i} - {h} * {c}) + {g} * ({b} * {z} - {y} * {c})",
        "dab": f"{a} * ({e} * {z} - {y} * {f}) - {d} * ({b} * {z} - {y} * {c}) + {x} * ({b} * {f} - {e} * {c})",
    }
    return ", ".join(f"round(greatest(({v}) / {det}, 0), 6) AS {n}" for n, v in stains.items())


@query(
    f"WITH px AS (SELECT l_orderkey, l_linenumber, (l_partkey % 256)::INTEGER AS r, (l_suppkey * 7 % 256)::INTEGER AS g, (l_orderkey % 256)::INTEGER AS b FROM lineitem) SELECT l_orderkey, l_linenumber, {_stain_sql()} FROM px"
)
def stain_amounts(t):
    r, g, b = (x % 256 for x in (F.col("l_partkey"), F.col("l_suppkey") * 7, F.col("l_orderkey")))
    amounts = colour.rgb_to_hed(r, g, b)
    names = ("haematoxylin", "eosin", "dab")
    return t.lineitem.select("l_orderkey", "l_linenumber", *[F.round(v, 6).alias(n) for n, v in zip(names, amounts, strict=True)])
