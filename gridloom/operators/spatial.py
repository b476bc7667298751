"""Spatial graph of a slide's cells, and Ward's clustering that only merges neighbours in it.

A slide is one task; its cells are bounded by its image. Nothing in the task grows with the
square of the cells: neighbours come from a lookup of the places around each cell, nearest first, and
clusters keep lists of neighbours, means and sizes.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: How far around a cell places are looked up one by one; cells that need more are held against all, in blocks.
RING = 16
BLOCK = 256


class Places:
    """Distinct cells, sorted by (row, column), and a lookup of a cell by place."""

    def __init__(self, at: np.ndarray):
        self.at = at.astype(np.int64)
        self.low = self.at.min(axis=0)
        self.width = int(np.ptp(self.at[:, 1])) + 2 * RING + 1
        self.codes = (self.at - self.low) @ np.array([self.width, 1]) + RING
        d = np.arange(-RING, RING + 1)
        steps = np.array([(r * r + c * c, r, c) for r in d for c in d if 0 < r * r + c * c <= RING * RING])
        self.steps = steps[np.lexsort(steps.T[::-1])]

    def step(self, cells: np.ndarray, dr: int, dc: int) -> tuple[np.ndarray, np.ndarray]:
        """Those of ``cells`` that have a cell at this distance, and it."""
        wanted = self.codes[cells] + dr * self.width + dc
        at = np.minimum(np.searchsorted(self.codes, wanted), len(self.codes) - 1)
        hit = self.codes[at] == wanted
        return cells[hit], at[hit]

    def far(self, cells: np.ndarray):
        """(block of cells, their squared distances to all cells), a block at a time."""
        for i in range(0, len(cells), BLOCK):
            block = cells[i : i + BLOCK]
            gap = self.at[block, None] - self.at[None]
            yield block, (gap * gap).sum(axis=2)


def nearest_cells(places: Places, k: int) -> np.ndarray:
    """The k nearest other cells of each, a row each, -1 where there are fewer; ties by row and then column."""
    n = len(places.at)
    out, found, live = np.full((n, k), -1), np.zeros(n, np.int64), np.arange(n)
    for _, dr, dc in places.steps.tolist():
        if not len(live):
            break
        cells, met = places.step(live, dr, dc)
        out[cells, found[cells]] = met
        found[cells] += 1
        live = live[found[live] < k]
    for block, gap in places.far(live):
        gap[np.arange(len(block)), block] = np.iinfo(np.int64).max
        most = min(k, n - 1)
        out[block, :most] = np.argsort(gap, axis=1, kind="stable")[:, :most]
    return out


def _components(n: int, edges: np.ndarray) -> np.ndarray:
    """The smallest cell of each cell's component."""
    group = np.arange(n)
    while True:
        least = np.minimum(group[edges[:, 0]], group[edges[:, 1]])
        new = group.copy()
        np.minimum.at(new, edges[:, 0], least)
        np.minimum.at(new, edges[:, 1], least)
        np.minimum.at(new, group, new.copy())  # what a cell learns, its group learns
        new = new[new]
        if (new == group).all():
            return group
        group = new


def joining_links(places: Places, group: np.ndarray) -> np.ndarray:
    """(a, b) of the links that join components: a minimum spanning tree of them, ties by the smaller cells.

    In a round every component but the largest takes its closest cell outside.
    """
    out, group = [], group.copy()
    while True:
        names, sizes = np.unique(group, return_counts=True)
        if len(names) == 1:
            return np.array(out, np.int64).reshape(-1, 2)
        best: dict[int, tuple[int, int, int]] = {}
        live = np.flatnonzero(group != names[sizes.argmax()])
        level = 0

        def offer(d2: int, a: np.ndarray, b: np.ndarray, best: dict = best, group: np.ndarray = group):
            low, high = np.minimum(a, b), np.maximum(a, b)
            for g, x, y in sorted(zip(group[a].tolist(), low.tolist(), high.tolist(), strict=True)):
                best[g] = min(best.get(g, (d2, x, y)), (d2, x, y))

        for d2, dr, dc in places.steps.tolist():
            if d2 != level:  # all cells of the last distance are seen
                live = live[~np.isin(group[live], list(best))] if best else live
                level = d2
            if not len(live):
                break
            cells, met = places.step(live, dr, dc)
            apart = group[cells] != group[met]
            offer(d2, cells[apart], met[apart])
        live = live[~np.isin(group[live], list(best))] if best else live
        for block, gap in places.far(live):
            gap[group[block][:, None] == group[None]] = np.iinfo(np.int64).max
            least = gap.min(axis=1)
            for i, cell in enumerate(block.tolist()):
                for other in np.flatnonzero(gap[i] == least[i]).tolist():
                    offer(int(least[i]), np.array([cell]), np.array([other]))
        links = sorted(set(best.values()))
        for _, a, b in links:
            if group[a] != group[b]:
                group[group == group[b]] = group[a]
                out.append((a, b))


def graph_links(at: np.ndarray, k: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(near, forced): links a < b of cells sorted by row and column; each cell's k nearest, and what joins the rest."""
    places = Places(at)
    near = nearest_cells(places, k)
    a = np.repeat(np.arange(len(at)), k)
    b = near.ravel()
    a, b = a[b >= 0], b[b >= 0]
    edges = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    forced = joining_links(places, _components(len(at), edges))
    return edges, np.sort(forced, axis=1)


def ward_merges(x: np.ndarray, links: np.ndarray) -> list[tuple[int, int, float]]:
    """(a, b, growth of the squared error) of each merge, smallest first among neighbours; merge i makes cluster n + i.

    Ties go to the smaller numbers.
    """
    n, dims = x.shape
    size, mean, alive = np.ones(2 * n), np.zeros((2 * n, dims)), np.zeros(2 * n, bool)
    mean[:n], alive[:n] = x, True
    near = [set() for _ in range(2 * n)]
    for a, b in links.tolist():
        near[a].add(b)
        near[b].add(a)

    def costs(a: int | np.ndarray, b: np.ndarray) -> np.ndarray:
        gap = mean[a] - mean[b]
        return size[a] * size[b] / (size[a] + size[b]) * (gap * gap).sum(axis=1)

    heap = list(zip(costs(links[:, 0], links[:, 1]).tolist(), links[:, 0].tolist(), links[:, 1].tolist(), strict=True)) if len(links) else []
    heapq.heapify(heap)
    out, new = [], n
    while heap:
        grown, a, b = heapq.heappop(heap)
        if not (alive[a] and alive[b]):
            continue
        out.append((a, b, grown))
        size[new] = size[a] + size[b]
        mean[new] = (mean[a] * size[a] + mean[b] * size[b]) / size[new]
        alive[[a, b]], alive[new] = False, True
        small, large = sorted((near[a], near[b]), key=len)
        large |= small
        large -= {a, b}
        near[new], near[a], near[b] = large, None, None
        if large:
            others = np.fromiter(large, np.int64, len(large))
            for other, cost in zip(others.tolist(), costs(new, others).tolist(), strict=True):
                near[other] -= {a, b}
                near[other].add(new)
                heapq.heappush(heap, (cost, other, new))
        new += 1
    return out


def cut(n: int, merges: list[tuple[int, int, float]], ks: list[int]) -> dict[int, np.ndarray]:
    """The cluster of each item, from 1 by their first items, where ``k`` clusters are left; for each k that occurs."""
    parent, out = np.arange(2 * n), {}
    for i in range(len(merges) + 1):
        if n - i in ks:
            top = parent.copy()
            while (top != top[top]).any():
                top = top[top]
            _, first, which = np.unique(top[:n], return_index=True, return_inverse=True)
            names = np.empty(len(first), np.int64)
            names[np.argsort(first)] = np.arange(1, len(first) + 1)
            out[n - i] = names[which]
        if i < len(merges):
            parent[list(merges[i][:2])] = n + i
    return out


def principal(x: np.ndarray, dims: int) -> np.ndarray:
    """Coordinates along the ``dims`` axes of largest variance."""
    x = x - x.mean(axis=0)
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    return x @ axes[:, :dims]


def spatial_graph(cells: DataFrame, k: int = 8) -> DataFrame:
    """(slide, r, c, r2, c2, forced): links of each cell and its ``k`` nearest, and the closest pairs that join what is apart.

    ``cells`` is (slide, r, c); a link is there once, from the cell that is first by row and column. Rows that repeat a cell count
    once; rows with a null place are left out.
    """

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        at = np.unique(pdf[["r", "c"]].to_numpy(), axis=0)
        near, forced = graph_links(at, k)
        both = np.vstack([near, forced])
        out = pd.DataFrame(np.column_stack([at[both[:, 0]], at[both[:, 1]]]), columns=["r", "c", "r2", "c2"])
        return out.assign(slide=pdf["slide"].iloc[0], forced=np.arange(len(both)) >= len(near))[["slide", "r", "c", "r2", "c2", "forced"]]

    rows = cells.where("slide IS NOT NULL AND r IS NOT NULL AND c IS NOT NULL").select("slide", "r", "c")
    return rows.groupBy("slide").applyInPandas(links, f"slide {dict(cells.dtypes)['slide']}, r int, c int, r2 int, c2 int, forced boolean")


def constrained_clusters(cells: DataFrame, ks: list[int], dims: int = 10, k: int = 8, least: int = 101) -> DataFrame:
    """(slide, k, r, c, cluster): Ward's clustering along the links of ``spatial_graph``, cut at each of ``ks``.

    Vectors are reduced to ``dims`` principal components. Clusters are numbered from 1 by their first cell. Slides with
    fewer than ``least`` cells have no rows, nor has a cut with more clusters than cells. Of rows that repeat a cell one
    counts; rows with a null place or embedding are left out.
    """

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["r", "c"], kind="stable").drop_duplicates(["r", "c"], ignore_index=True)
        names = ["slide", "k", "r", "c", "cluster"]
        if len(pdf) < least:
            return pd.DataFrame(columns=names)
        x = principal(np.stack(pdf["embedding"].to_numpy()).astype(float), dims)
        merges = ward_merges(x, np.vstack(graph_links(pdf[["r", "c"]].to_numpy(), k)))
        parts = [pdf[["slide", "r", "c"]].assign(k=n, cluster=v) for n, v in cut(len(pdf), merges, ks).items()]
        return pd.concat(parts, ignore_index=True)[names] if parts else pd.DataFrame(columns=names)

    known = " AND ".join(f"{c} IS NOT NULL" for c in ("slide", "r", "c", "embedding"))
    rows = cells.where(known).select("slide", "r", "c", "embedding")
    return rows.groupBy("slide").applyInPandas(cluster, f"slide {dict(cells.dtypes)['slide']}, k int, r int, c int, cluster int")
