"""Similarity operators: exact neighbours, centroids, medoids and pair distances."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.vectors import as_doubles, cosine_distance, squared_distance

#: Rows of a block, about, where a table has few.
CELL_ROWS = 4096
#: Blocks on each side of a larger table: what a row is copied to doesn't grow with the rows, until a block has MOST_ROWS.
SIDE, MOST_ROWS = 8, 1 << 18
#: Rows that stand for cells of a pruned search, at most.
PIVOTS = 512
#: Decimals at which distances count as equal.
DECIMALS = 12


def _unit(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a length over zero, and those rows at length 1."""
    m = np.stack(vectors.to_numpy()).astype(float)
    size = np.linalg.norm(m, axis=1)
    return size > 0, m[size > 0] / size[size > 0, None]


def _best_of_block(k: int):
    """The k nearest stored rows (id, v) of each asked one (q_id, q_v), both of one block."""

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query": [], "neighbour": [], "dist": []})
        if not len(left) or not len(right):
            return none
        left = left.sort_values("id", kind="stable")
        (known, m), (ask, q) = _unit(left["v"]), _unit(right["q_v"])
        ids, asks, out = left["id"].to_numpy()[known], right["q_id"].to_numpy()[ask], []
        for at in range(0, len(q) if len(m) else 0, 512):
            dist = np.round(1.0 - q[at : at + 512] @ m.T, DECIMALS)
            dist[asks[at : at + 512, None] == ids[None, :]] = np.inf
            n = min(k, dist.shape[1])
            edge = np.partition(dist, n - 1, axis=1)[:, n - 1]
            for i, row in enumerate(dist):
                near = np.flatnonzero((row <= edge[i]) & np.isfinite(row))
                near = near[np.argsort(row[near], kind="stable")][:n]
                out.append((np.full(len(near), asks[at + i]), ids[near], row[near]))
        return pd.DataFrame({c: np.concatenate(x) for c, x in zip(("query", "neighbour", "dist"), zip(*out), strict=True)}) if out else none

    return cell


_FOUND = "query long, neighbour long, dist double"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy("dist", "neighbour")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query", "rank", "neighbour", "dist")


def _moved(df: DataFrame, vector_col: str) -> tuple[Column, str]:
    """The vectors as tasks send them, and their type: floats stay floats, which doubles of them would only make longer."""
    kind = df.schema[vector_col].dataType.simpleString()
    return (F.col(vector_col), kind) if kind == "array<float>" else (as_doubles(F.col(vector_col)), "array<double>")


def _block_rows(n: int, rows: int) -> int:
    """Rows of a block, so that ``n`` rows make about SIDE blocks, or more of MOST_ROWS; ``rows`` at least."""
    return max(rows, min(-(-n // SIDE), MOST_ROWS))


def _vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    known = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()
    return df.where(known).select(F.col(id_col).cast("long").alias("id"), _moved(df, vector_col)[0].alias("v"))


def nearest(df: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", rows: int = CELL_ROWS) -> DataFrame:
    """(query, rank, neighbour, dist): the ``k`` nearest other rows by cosine distance, exactly.

    Up to ``rows`` rows are one block; more are searched by ``pruned_search``. Ties, at DECIMALS, go to the smaller
    id. Rows with a null id or vector, or a vector of length zero, take no part.
    """
    v = _vectors(df, id_col, vector_col)
    if v.count() > rows:
        return pruned_search(df, k, id_col, vector_col, rows)[0]
    stored, asked = v.withColumn("i", F.lit(0)), v.select(F.col("id").alias("q_id"), F.col("v").alias("q_v"), F.lit(0).alias("qi"))
    return _ranked(stored.groupBy("i").cogroup(asked.groupBy("qi")).applyInPandas(_best_of_block(k), _FOUND), k)


def pruned_search(
    df: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", rows: int = CELL_ROWS, pivots: int = PIVOTS
) -> tuple[DataFrame, DataFrame]:
    """``nearest``'s rows, and the pairs of blocks (asking, block) that met for them.

    At most ``pivots`` rows, drawn by hash, stand for cells; a row belongs to its nearest pivot's cell, and large cells are dealt to
    blocks of about ``rows``, or of an eighth of the table if that is more, so a row goes to at most some forty blocks. A query first asks its own cell. On unit vectors the triangle inequality then bounds
    what another cell can hold: a cell whose pivot is further than its radius and the query's k-th distance together has
    nothing nearer, and its blocks never meet the query. Clustered rows leave most blocks unmet; rows without
    clusters meet all of them, as an exact search must. The driver sees the pivots, and a row for each cell.
    """
    v = _vectors(df, id_col, vector_col)
    n, kind = v.count(), _moved(df, vector_col)[1]
    rows = _block_rows(n, rows)
    wanted = max(1, min(pivots, -(-4 * n // rows)))  # more cells than blocks: small radii prune more
    drawn = v.where(F.exists("v", lambda x: x != 0)).orderBy(F.xxhash64("id", F.lit(3)), "id").limit(wanted).toPandas()  # at most ``pivots`` rows
    if not len(drawn):
        empty = v.sparkSession.createDataFrame([], _FOUND)
        return _ranked(empty, k), v.sparkSession.createDataFrame([], "asking long, block long")
    centre = _unit(drawn["v"])[1]

    def assign(batches):
        for pdf in batches:
            known, m = _unit(pdf["v"])
            gap = np.sqrt(np.maximum(2 - 2 * m @ centre.T, 0))
            cell = gap.argmin(axis=1)
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[known], "v": pdf["v"].to_numpy()[known], "cell": cell.astype(np.int32), "gap": gap[np.arange(len(m)), cell]})

    placed = v.mapInPandas(assign, f"id long, v {kind}, cell int, gap double")
    cells = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("r")).collect()}  # at most ``pivots``
    parts = [-(-cells[c]["n"] // rows) if c in cells else 0 for c in range(len(centre))]
    sizes = np.array([cells[c]["n"] if c in cells else 0 for c in range(len(centre))])
    radius = np.array([cells[c]["r"] if c in cells else -np.inf for c in range(len(centre))])
    of_cell = lambda c: F.get(F.array(*[F.lit(p) for p in parts]), c)
    block = lambda c, part: F.shiftleft(c.cast("long"), 32) + part
    own = block(F.col("cell"), F.pmod(F.xxhash64("id"), of_cell(F.col("cell")).cast("long")))
    stored = placed.select("id", "v", "cell", own.alias("block"))
    asked = stored.select(F.col("id").alias("q_id"), F.col("v").alias("q_v"), F.col("cell").alias("to"), F.col("block").alias("asking"))

    def meet(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What queries find in the blocks of the cells ``to``, and the blocks that meet."""
        parts_of = F.explode(F.sequence(F.lit(0), of_cell(F.col("to")) - 1)).alias("part")
        asked = asked.select("q_id", "q_v", "asking", "to", parts_of).select("q_id", "q_v", "asking", block(F.col("to"), F.col("part")).alias("asked"))
        met = asked.select("asking", F.col("asked").alias("block")).distinct()
        held = stored.join(met, "block").select("id", "v", F.col("asking").alias("by"), "block")
        return held.groupBy("by", "block").cogroup(asked.groupBy("asking", "asked")).applyInPandas(_best_of_block(k), _FOUND), met

    first, met = meet(asked)
    reach = first.groupBy("query").agg(F.slice(F.array_sort(F.collect_list("dist")), 1, k).alias("d"))
    reach = reach.select(F.col("query").alias("q_id"), F.when(F.size("d") == k, F.element_at("d", -1)).alias("reach"))

    def others(batches):
        for pdf in batches:
            m = _unit(pdf["q_v"])[1]
            gap = np.sqrt(np.maximum(2 - 2 * m @ centre.T, 0))
            far = np.sqrt(2 * np.maximum(pdf["reach"].fillna(2.0).to_numpy(), 0))  # 2 is the largest distance
            # cells whose furthest rows are near enough to hold k others bound the k-th distance too
            most = gap + radius[None]
            by = most.argsort(axis=1)
            enough = sizes[by].cumsum(axis=1) > k
            bound = np.take_along_axis(most, np.take_along_axis(by, enough.argmax(axis=1)[:, None], axis=1), axis=1)[:, 0]
            far = np.minimum(far, np.where(enough[:, -1], bound, np.inf)) + 1e-6
            open_ = gap - radius[None] <= far[:, None]
            open_[np.arange(len(m)), pdf["to"].to_numpy()] = False
            yield pdf[["q_id", "q_v", "asking"]].assign(to=[np.flatnonzero(x).astype(np.int32) for x in open_])

    more = asked.join(reach, "q_id", "left").mapInPandas(others, f"q_id long, q_v {kind}, asking long, to array<int>")
    second, also = meet(more.withColumn("to", F.explode("to")))
    return _ranked(first.unionByName(second), k), met.unionByName(also)


def nearest_by_relation(
    df: DataFrame, classes: list[str], id_col: str = "vec_id", vector_col: str = "embedding", rows: int = CELL_ROWS
) -> DataFrame:
    """(query, relation, dist): cosine distance from each row to the nearest other row, at all and of each relation.

    A pair's relation is ``same_`` and the first of the integer columns ``classes`` in which both rows agree, or
    ``neither``; ``nearest`` is over all. Rows and queries meet in cells as in ``nearest``, and only a cell's minima
    leave it. Rows with a null id, class or vector, or a vector of length zero, take no part.
    """
    known = [F.col(c).isNotNull() for c in (id_col, vector_col, *classes)]
    v = df.where(reduce(Column.__and__, known)).select(
        F.col(id_col).cast("long").alias("id"), _moved(df, vector_col)[0].alias("v"), F.array(*[F.col(c).cast("long") for c in classes]).alias("k")
    )
    n = v.count()
    side = max(1, -(-n // _block_rows(n, rows)))
    deal = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(side)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    stored = v.select(deal(1).alias("i"), every.alias("j"), "id", "v", "k")
    # names of its own, so that neither side's columns are taken for the other's
    asked = v.select(every.alias("qi"), deal(2).alias("qj"), F.col("id").alias("q_id"), F.col("v").alias("q_v"), F.col("k").alias("q_k"))
    names = ["nearest", *[f"same_{c}" for c in classes], "neither"]

    def unit(pdf: pd.DataFrame, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m = np.stack(pdf[f"{side}v"].to_numpy()).astype(float)
        size = np.linalg.norm(m, axis=1)
        return pdf[f"{side}id"].to_numpy()[size > 0], m[size > 0] / size[size > 0, None], np.stack(pdf[f"{side}k"].to_numpy())[size > 0]

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(left) and len(right):
            (ids, m, kinds), (asks, q, own) = unit(left, ""), unit(right, "q_")
            for at in range(0, len(q) if len(m) else 0, 512):
                part = slice(at, at + 512)
                dist = 1.0 - q[part] @ m.T
                dist[asks[part, None] == ids[None, :]] = np.inf
                open_, least = np.ones(dist.shape, bool), [dist.min(axis=1)]
                for c in range(len(classes)):
                    same = open_ & (own[part, None, c] == kinds[None, :, c])
                    least.append(np.where(same, dist, np.inf).min(axis=1))
                    open_ &= ~same
                least.append(np.where(open_, dist, np.inf).min(axis=1))
                parts += [pd.DataFrame({"query": asks[part], "relation": r, "dist": x}) for r, x in zip(names, least, strict=True)]
        out = pd.concat(parts) if parts else pd.DataFrame({"query": [], "relation": [], "dist": []})
        return out[np.isfinite(out["dist"].astype(float))]

    found = stored.groupBy("i", "j").cogroup(asked.groupBy("qi", "qj")).applyInPandas(cell, "query long, relation string, dist double")
    return found.groupBy("query", "relation").agg(F.min("dist").alias("dist"))


def label_precision(neighbours: DataFrame, labels: DataFrame, id_col: str, names: list[str]) -> DataFrame:
    """(rank, n, share of each name): how often a neighbour has its query's value of the columns ``names``."""
    q = labels.select(F.col(id_col).alias("query"), *[F.col(c).alias(f"q_{c}") for c in names])
    x = labels.select(F.col(id_col).alias("neighbour"), *[F.col(c).alias(f"x_{c}") for c in names])
    rows = neighbours.join(q, "query").join(x, "neighbour")
    shares = [F.avg((F.col(f"q_{c}") == F.col(f"x_{c}")).cast("double")).alias(f"same_{c}") for c in names]
    return rows.groupBy("rank").agg(F.count("*").alias("n"), *shares)


def centroids(df: DataFrame, keys: list[str], vector_col: str) -> DataFrame:
    """(keys, dim, mean): the mean vector of each group, one row for each dimension."""
    return (
        df.select(*keys, F.posexplode(vector_col).alias("dim", "x"))
        .groupBy(*keys, "dim")
        .agg(F.avg(F.col("x").cast("double")).alias("mean"))
    )


def centroid_vectors(df: DataFrame, keys: list[str], vector_col: str) -> DataFrame:
    """(keys, centre): the mean vector of each group as one array."""
    centre = F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"])
    return centroids(df, keys, vector_col).groupBy(*keys).agg(centre.alias("centre"))


def medoids(df: DataFrame, keys: list[str], id_col: str, vector_col: str) -> DataFrame:
    """(keys, medoid, n, vector): the member nearest to its group's mean, ties to the smaller id."""
    mean = centroid_vectors(df, keys, vector_col)
    far = F.round(squared_distance(F.col(vector_col), F.col("centre")), DECIMALS)
    best = F.min_by(F.struct(F.col(id_col).alias("id"), F.col(vector_col).alias("v")), F.struct(far, F.col(id_col)))
    rows = df.join(mean, keys).groupBy(*keys).agg(best.alias("b"), F.count("*").alias("n"))
    return rows.select(*keys, F.col("b.id").alias("medoid"), "n", F.col("b.v").alias("vector"))


def pairs_within(df: DataFrame, keys: list[str], id_col: str, vector_col: str, distance=cosine_distance) -> DataFrame:
    """(keys, a, b, dist) of unordered pairs a < b inside each group, whose size must be bounded."""
    a = df.select(*keys, F.col(id_col).alias("a"), F.col(vector_col).alias("va"))
    b = df.select(*keys, F.col(id_col).alias("b"), F.col(vector_col).alias("vb"))
    return a.join(b, keys).where("a < b").select(*keys, "a", "b", distance(F.col("va"), F.col("vb")).alias("dist"))


def pairs_in_blocks(df: DataFrame, keys: list[str], id_col: str, vector_col: str, distance=cosine_distance, blocks: int = 8) -> DataFrame:
    """The rows of ``pairs_within``, for large groups: a group's rows are dealt to ``blocks`` blocks, and each two blocks are a task's key.

    Rows are copied ``blocks`` times; a key has the pairs of about 1 / blocks ** 2 of its group, so a hot group is split.
    """
    own = F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    a = df.select(*keys, F.col(id_col).alias("a"), F.col(vector_col).alias("va"), own.alias("_i"), every.alias("_j"))
    b = df.select(*keys, F.col(id_col).alias("b"), F.col(vector_col).alias("vb"), every.alias("_i"), own.alias("_j"))
    return a.join(b, [*keys, "_i", "_j"]).where("a < b").select(*keys, "a", "b", distance(F.col("va"), F.col("vb")).alias("dist"))


#: Equal parts of the distances 0 to 2 in which pairs are counted; greater distances and NaN have one more.
PARTS = 1 << 13
#: Product sums of another order of addition are no further off than this.
SLACK = 1e-9
#: A distance that is nearer to an edge of rounding is summed again.
NEAR = 1e-12
#: Values that a task holds its pairs against.
VALUES = 1 << 21


def _dealt(rows: DataFrame, blocks: int) -> DataFrame:
    """``rows`` with block ``_own``, copied for each two blocks ``_low`` and ``_high`` of which it is one."""
    rows = rows.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return rows.withColumns({"_low": F.least("_own", "_j"), "_high": F.greatest("_own", "_j")}).drop("_j")


def _blocks_of(pdf: pd.DataFrame):
    """Some rows of a block, some of the other, their distances by matrix products, and which of them are pairs."""
    m = np.stack(pdf["_v"].to_numpy()).astype(float)
    squares = np.zeros(len(m))
    for x in m.T:
        squares += x * x
    size, ids, own = np.sqrt(squares), pdf["_id"].to_numpy(), pdf["_own"].to_numpy()
    left, right = (np.flatnonzero((own == pdf[c].iloc[0]) & ~(size == 0)) for c in ("_low", "_high"))
    same = pdf["_low"].iloc[0] == pdf["_high"].iloc[0]
    with np.errstate(all="ignore"):
        unit = m / size[:, None]
        for i in range(0, len(left), 256):
            for j in range(0, len(right), 2048):
                a, b = left[i : i + 256], right[j : j + 2048]
                if same and ids[a].min() > ids[b].max():
                    continue
                dist = 1.0 - unit[a] @ unit[b].T
                yield m, size, a, b, np.where(np.isnan(dist), np.inf, dist), ids[a][:, None] < ids[b] if same else ids[a][:, None] != ids[b]


def pair_quantile(df: DataFrame, keys: list[str], id_col: str, vector_col: str, share: float = 0.5, blocks: int | None = None) -> DataFrame:
    """(keys, n, m): how many pairs a < b each group has, and the exact quantile of their cosine distances, with linear interpolation.

    Rows are copied ``blocks`` times (one for each CELL_ROWS rows of the table, 16 at most, by default), and each two blocks of a group are one key, for which matrix products give the
    distances; no pair leaves its task. First pairs are counted in PARTS; the parts that hold the wanted places
    make a narrow band, and a second pass counts the pairs under it and gives those inside by distinct distance, summed in the order of
    ``cosine_distance``. Rows with a null key, id or vector, or a vector of length zero, have no pairs; NaN is the largest distance.
    """
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in (*keys, id_col, vector_col)])
    vector, _ = _moved(df, vector_col)
    blocks = blocks or max(1, min(16, -(-df.count() // CELL_ROWS)))
    rows = df.where(known).select(*keys, F.col(id_col).cast("long").alias("_id"), vector.alias("_v"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("_own"))
    types = ", ".join(f"`{k}` {dict(df.dtypes)[k]}" for k in keys)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(PARTS + 1, np.int64)
        for *_, dist, pair in _blocks_of(pdf):
            part = np.clip(dist * (PARTS / 2), 0, PARTS).astype(np.int64)
            n += np.bincount(part.ravel() if pair.all() else part[pair], minlength=PARTS + 1)
        part = np.flatnonzero(n)
        return pd.DataFrame({k: [pdf[k].iloc[0]] * len(part) for k in keys} | {"part": part, "k": n[part]})

    counts = _dealt(rows, blocks).groupBy(*keys, "_low", "_high").applyInPandas(count, f"{types}, part long, k long").groupBy(*keys, "part").agg(F.sum("k").alias("k"))
    up = counts.withColumns({"up": F.sum("k").over(Window.partitionBy(*keys).orderBy("part")), "n": F.sum("k").over(Window.partitionBy(*keys))})
    place = F.lit(share) * (F.col("n") - 1)
    holds = lambda p: (F.col("up") > p) & (F.col("up") - F.col("k") <= p)
    edges = up.where(holds(F.floor(place)) | holds(F.ceil(place))).groupBy(*keys).agg(F.max("n").alias("n"), F.min("part").alias("a"), F.max("part").alias("b"))
    low = F.when(F.col("a") == 0, float("-inf")).otherwise(F.col("a") * (2 / PARTS) - SLACK)
    high = F.when(F.col("b") == PARTS, float("inf")).otherwise((F.col("b") + 1) * (2 / PARTS) + SLACK)
    bands = edges.select(*keys, "n", low.alias("_from"), high.alias("_to"))

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high, under, found = pdf["_from"].iloc[0], pdf["_to"].iloc[0], 0, []
        for m, size, a, b, dist, pair in _blocks_of(pdf):
            under += int(np.count_nonzero((dist < low) & pair))
            x, y = np.nonzero((dist >= low) & (dist <= high) & pair)
            x, y, total = a[x], b[y], np.zeros(len(x))
            with np.errstate(all="ignore"):
                for c in m.T:
                    total += c[x] * c[y]
                found.append(1.0 - total / (size[x] * size[y]))
        v, k = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0), np.zeros(0, np.int64))
        v, k = np.r_[v, -np.inf], np.r_[k, under]  # what is under the band stands before all of it
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(v) for key in keys} | {"v": v, "k": k})

    values = _dealt(rows.join(bands.drop("n"), keys), blocks).groupBy(*keys, "_low", "_high").applyInPandas(inside, f"{types}, v double, k long")
    values = values.groupBy(*keys, "v").agg(F.sum("k").alias("k")).join(bands.select(*keys, "n"), keys)
    values = values.withColumn("up", F.sum("k").over(Window.partitionBy(*keys).orderBy("v")))
    at = lambda p: F.max(F.when(holds(p), F.col("v")))
    two = values.groupBy(*keys).agg(F.max("n").alias("n"), at(F.floor(place)).alias("a"), at(F.ceil(place)).alias("b"), F.max(place - F.floor(place)).alias("part"))
    return two.select(*keys, "n", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") * (1 - F.col("part")) + F.col("b") * F.col("part")).alias("m"))


def pairs_below(
    df: DataFrame, values: DataFrame, value: str, id_col: str, vector_col: str, decimals: int, blocks: int | None = None, most: int = VALUES
) -> DataFrame:
    """(``value``, below, pairs) of each distinct ``value`` of ``values``: how many pairs a < b of ``df`` have a smaller cosine distance, of how many.

    Distances and values count as rounded to ``decimals``. Rows are dealt to blocks as in ``pair_quantile`` (by default those of ``nearest``); each two blocks
    meet ``most`` of the values at once, and only counts leave a task. A distance next to where rounding decides is summed again, dimension
    by dimension. All pairs of different ids count in ``pairs``; one whose distance is null or NaN, as of a
    vector of length zero, is below nothing. Rows with a null id and null values take no part.
    """
    n = df.count()
    blocks = blocks or max(1, -(-n // _block_rows(n, CELL_ROWS)))
    rows = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("_id"), _moved(df, vector_col)[0].alias("_v"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("_own"))
    asked = values.select(F.col(value).cast("double").alias("t")).where("t IS NOT NULL").distinct()
    chunks = asked.agg(F.greatest(F.ceil(F.count("*") / most), F.lit(1)).cast("int").alias("_chunks"))  # one row
    held = asked.join(F.broadcast(chunks)).groupBy(F.pmod(F.xxhash64("t"), F.col("_chunks").cast("long")).cast("int").alias("c")).agg(F.array_sort(F.collect_list("t")).alias("t"))
    held = held.withColumn("low", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    held = held.withColumn("high", F.explode(F.sequence(F.col("low"), F.lit(blocks - 1))))
    dealt = _dealt(rows, blocks).join(F.broadcast(chunks)).withColumn("_c", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).drop("_chunks")
    scale = 10.0**decimals

    def count(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"t": [], "k": []})
        t = np.asarray(right["t"].iloc[0], float)
        whole = np.rint(t * scale)
        edge = (whole - 0.5) / scale  # what is less rounds to less
        # parts of the distances without an edge are counted at once
        known = np.searchsorted(edge, np.arange(PARTS + 1) * (2 / PARTS), side="right")
        near = np.clip(np.r_[edge - SLACK, edge + SLACK] * (PARTS / 2), 0, PARTS).astype(np.int64)
        busy, n, below = np.zeros(PARTS + 1, bool), np.zeros(PARTS + 1, np.int64), np.zeros(len(t) + 1, np.int64)
        busy[near] = True
        for m, size, a, b, dist, pair in _blocks_of(left):
            pair &= dist < edge[-1] + SLACK
            i, j = np.nonzero(pair)
            x = dist[i, j]
            part = np.clip(x * (PARTS / 2), 0, PARTS).astype(np.int64)
            n += np.bincount(part, minlength=PARTS + 1)
            open_ = np.flatnonzero(busy[part])
            i, j, x = i[open_], j[open_], x[open_]
            at, to = np.searchsorted(edge, x - NEAR, side="right"), np.searchsorted(edge, x + NEAR, side="right")
            again = np.flatnonzero(at != to)
            if len(again):
                p, q, total = a[i[again]], b[j[again]], np.zeros(len(again))
                for c in m.T:
                    total += c[p] * c[q]
                exact = 1.0 - np.clip(total / np.sqrt(size[p] ** 2 * size[q] ** 2), -1, 1)
                at[again] = np.searchsorted(whole, np.floor(exact * scale + 0.5), side="right")
            below += np.bincount(at, minlength=len(t) + 1)
        calm = np.flatnonzero(~busy)
        np.add.at(below, known[calm], n[calm])
        return pd.DataFrame({"t": t, "k": below.cumsum()[:-1]})

    found = dealt.groupBy("_low", "_high", "_c").cogroup(held.groupBy("low", "high", "c")).applyInPandas(count, "t double, k long")
    found = found.groupBy("t").agg(F.sum("k").alias("k"))
    times = df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("_k"))
    total = times.agg(F.coalesce(F.sum("_k"), F.lit(0)).alias("_n"), F.coalesce(F.sum(F.col("_k") * F.col("_k")), F.lit(0)).alias("_s"))  # one row
    total = total.select(F.expr("(_n * _n - _s) div 2").alias("pairs"))
    return asked.join(found, "t", "left").join(F.broadcast(total)).select(F.col("t").alias(value), F.coalesce("k", F.lit(0)).alias("below"), "pairs")


def group_scores(pairs: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """(keys, score): mean of ``value`` weighted by e to the power of its place between the group's extremes.

    Where all values of a group are equal the score is their mean.
    """
    rows = pairs.select(*keys, value.alias("x"))
    ends = rows.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    place = F.coalesce(F.try_divide(F.col("x") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    weighed = rows.join(ends, keys).withColumn("w", F.exp(place))
    return weighed.groupBy(*keys).agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("score"))
