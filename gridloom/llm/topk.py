"""Exact top-k inner products over an impact-ordered index, score at a time.

Vectors hold integers. The index of a block of vectors has a posting segment (ids and
values) for each dimension and quantised impact (a power of two of the absolute value),
in descending order of impact, and for each impact the norm of what later segments hold
of each vector. A query adds segment after segment to the accumulators of the vectors
in it; it stops when the norms prove that no vector outside its possible members can
reach its k best, and the possible members are scored again exactly.

Blocks of vectors and of queries are dealt to the cells of a grid, so that a task holds
a bounded number of each, and each query's k best of a cell meet in a window. Each pair
of a query and a vector is bounded or scored in one cell; rows are copied once for each
block of the other side, so larger blocks move less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors and queries of a cell at most, about, and vectors of a cell at least where there are more tasks than full cells.
CELL_VECTORS = 1 << 16
CELL_QUERIES = 1 << 14
#: Bytes of a cell's vectors, and of its queries, at most, about: wide vectors make smaller cells.
CELL_BYTES = 1 << 25
LEAST_VECTORS = 1 << 12
#: Queries that are scored together.
BLOCK = 64
#: A proof is tried once the median norm of what is left is this share of the whole norm, or less.
PROMISING = 0.5
LONG = np.iinfo(np.int64)


class Index:
    """Posting segments of ``vectors`` (a row each, whole numbers), by descending impact."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        size = np.abs(vectors.astype(np.float64))
        impact = np.frexp(size)[1]  # 0 for zero, else the power of two above the value
        self.levels: list[tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray]] = []
        self.norm = float(np.median(np.sqrt((size**2).sum(axis=1)))) if len(size) else 0.0
        for level in np.unique(impact[size > 0])[::-1]:
            held = (impact == level) & (size > 0)
            segments = []
            for d in np.flatnonzero(held.any(axis=0)):
                ids = np.flatnonzero(held[:, d])
                segments.append((int(d), ids, vectors[ids, d]))
            lower = (impact < level) & (size > 0)
            rest = np.where(lower, size**2, 0.0).sum(axis=1)
            self.levels.append((segments, np.sqrt(rest) * (1 + 1e-9)))


def search(index: Index, queries: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(query, members, scores, levels read) of each query: the k best vectors by score, then by place.

    ``own`` is a matrix of queries by vectors: true where a vector is the query itself. ``vectors`` and
    ``queries`` are of a type that no score can leave.
    """
    n = len(index.vectors)
    norms = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)
    acc = np.zeros((n, len(queries)), index.vectors.dtype)
    open_ = np.arange(len(queries))
    for level, (segments, rest) in enumerate(index.levels):
        q = queries[open_]
        whole = len(open_) == len(queries)
        for d, ids, values in segments:
            added = values[:, None] * q[:, d][None, :]
            if whole:
                acc[ids] += added
            else:
                acc[np.ix_(ids, open_)] += added
        last = level == len(index.levels) - 1
        if not last and np.median(rest) > PROMISING * index.norm:
            continue  # too much is left for a proof
        sums = np.ascontiguousarray(acc[:, open_].T).astype(np.float64)
        slack = norms[open_, None] * rest[None, :] + (1 + np.abs(sums) * 1e-15)
        low = np.where(own[open_], -np.inf, sums - slack)
        kth = np.partition(low, max(0, n - k), axis=1)[:, max(0, n - k)]
        possible = (sums + slack >= kth[:, None]) & ~own[open_]
        # proof: no vector that isn't a possible member can be among the k best
        done = (possible.sum(axis=1) <= 4 * k + n // 64) | last
        for i, members in zip(open_[done], possible[done], strict=True):
            yield (int(i), *_best(index.vectors, queries[i], np.flatnonzero(members), k), level + 1)
        open_ = open_[~done]
        if not len(open_):
            return
    for i in open_:  # every vector is zero
        yield (int(i), *_best(index.vectors, queries[i], np.flatnonzero(~own[i]), k), 0)


def _best(vectors: np.ndarray, query: np.ndarray, members: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    score = (vectors[members] * query[None, :]).sum(axis=1)
    best = np.argsort(-score, kind="stable")[:k]
    return members[best], score[best]


def matrix(rows: list, dims: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled up with zeros."""
    out = np.zeros((len(rows), dims), np.int64)
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def whole_numbers(*parts: np.ndarray) -> list[np.ndarray]:
    """The parts in the smallest type that no inner product can leave: int32, int64 or Python's whole numbers."""
    most = [max(1.0, float(np.abs(x.astype(np.float64)).max(initial=0))) for x in parts]
    bound = np.prod(most) * max(1, parts[0].shape[1])
    return [x.astype(np.int32 if bound < 2.0**30 else np.int64 if bound < 2.0**62 else object) for x in parts]


def quantised(df: DataFrame, vector_col: str, factor: float) -> DataFrame:
    """Rows with finite vectors only, the vector as integers floor(factor * x)."""
    whole = F.transform(vector_col, lambda x: x.cast("double"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return df.where(F.col(vector_col).isNotNull() & ~F.exists(whole, bad)).withColumn(
        vector_col, F.transform(whole, lambda x: F.floor(x * factor))
    )


def top_k(
    df: DataFrame, is_query, k: int, id_col: str = "vec_id", vector_col: str = "embedding", factor: float = 64.0
) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best other rows.

    ``is_query`` is a Column over the rows. Vectors that are null or hold a null
    or non-finite component take no part, nor do null ids; shorter vectors count as
    filled up with zeros. Rows that repeat an id are candidates of their own, but a
    query's own id is none; a repeated query id is one query for each different
    vector. No query or no vector gives no rows. Scores are whole numbers; a component
    or a score beyond 64 bits is the nearest number that a long holds.
    """
    rows = quantised(df.where(F.col(id_col).isNotNull()), vector_col, factor).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), is_query.alias("is_query")
    )
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("is_query").alias("q"), F.max(F.size("v")).alias("d")).first()
    n, nq, dims = sizes["n"] or 0, sizes["q"] or 0, sizes["d"] or 0
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = max(1, CELL_BYTES // (8 * max(1, dims)))
    height = max(1, -(-n // min(CELL_VECTORS, held)), min(tasks, -(-n // LEAST_VECTORS)))
    width = max(1, -(-nq // min(CELL_QUERIES, held)))
    row, col = F.pmod(F.xxhash64("id", "v", F.lit(1)), F.lit(height)), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(width))
    each = lambda x: F.explode(F.sequence(F.lit(0), F.lit(x - 1)))
    of_vectors = rows.select(row.cast("int").alias("r"), each(width).alias("c"), "id", "v")
    asked = rows.where("is_query").distinct().select(F.col("id").alias("q_id"), F.col("v").alias("q_v"), col.cast("int").alias("qc"))
    of_queries = asked.select("qc", each(height).alias("qr"), "q_id", "q_v")  # names of its own

    def cell(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        vectors = vectors.sort_values("id", kind="stable", ignore_index=True)
        queries = queries.reset_index(drop=True)
        ids, qids, found = vectors["id"].to_numpy(), queries["q_id"].to_numpy(), []
        if len(ids) and len(qids):
            m = matrix(queries["q_v"], dims)
            which = pd.util.hash_array(np.array([x.tobytes() for x in m], dtype=object)).astype(np.int64)
            v, q = whole_numbers(matrix(vectors["v"], dims), m)
            index = Index(v)
            for at in range(0, len(q), BLOCK):
                own = ids[None, :] == qids[at : at + BLOCK, None]
                for i, members, scores, _ in search(index, q[at : at + BLOCK], own, k):
                    score = np.clip(scores, LONG.min, LONG.max).astype(np.int64)
                    found.append((np.full(len(members), at + i), members, score))
        i, j, s = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        return pd.DataFrame({"query_id": qids[i], "vec_id": ids[j], "score": s, "qv": which[i] if found else s})

    found = (
        of_vectors.groupBy("r", "c")
        .cogroup(of_queries.groupBy("qr", "qc"))
        .applyInPandas(cell, "query_id long, vec_id long, score long, qv long")
    )
    best = Window.partitionBy("query_id", "qv").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e
  FROM embeddings WHERE embedding IS NOT NULL),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
