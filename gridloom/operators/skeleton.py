"""Skeleton features of labelled objects: thinning, depth, extent and curvature. An object, part of one image, is one task's work, over its own pixels only."""

from __future__ import annotations

import hashlib
import heapq
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

KEYS = ["slide", "label"]
#: The eight neighbours (rows, columns), clockwise from the one above.
AROUND = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def neighbours(r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """(n, 8) indices of the pixels around each of the sorted pixels (r, c); n where there is none."""
    width = int(c.max() - c.min()) + 3
    code = (r - r.min()).astype(np.int64) * width + (c - c.min()) + 1
    out = np.full((len(code), 8), len(code))
    for k, (dr, dc) in enumerate(AROUND):
        want = code + dr * width + dc
        at = np.minimum(np.searchsorted(code, want), len(code) - 1)
        out[:, k] = np.where(code[at] == want, at, len(code))
    return out


def thinned(near: np.ndarray) -> np.ndarray:
    """Which pixels are left by two-step parallel thinning: those go that have 2 to 6 neighbours in one run around them, from the south-east
    in the first step and from the north-west in the second, until none goes. A pixel stays if all around it go and come after it: so a piece never vanishes."""
    index = np.arange(len(near))[:, None]
    alive = np.append(np.ones(len(near), bool), False)
    gone = True
    while gone:
        gone = False
        for second in (False, True):
            ring = alive[near]
            count = ring.sum(axis=1)
            runs = (~ring & np.roll(ring, -1, axis=1)).sum(axis=1)
            north, east, south, west = ring[:, 0], ring[:, 2], ring[:, 4], ring[:, 6]
            if second:
                side = ~(north & east & west) & ~(north & south & west)
            else:
                side = ~(north & east & south) & ~(east & south & west)
            drop = alive[:-1] & (count >= 2) & (count <= 6) & (runs == 1) & side
            going = np.append(drop, False)[near]
            drop &= ~((going == ring) & ((near > index) | ~ring)).all(axis=1)
            if drop.any():
                alive[:-1][drop] = False
                gone = True
    return alive[:-1]


def depth(near: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Euclidean distance of each pixel to the nearest place outside the object: by row first, then over the rows above and below."""
    n = len(near)
    run = np.zeros(n + 1, np.int64)
    west, east = near[:, 6], near[:, 2]
    place = np.arange(n)
    first = np.maximum.accumulate(np.where(west == n, place, -1))
    last = np.minimum.accumulate(np.where(east == n, place, n)[::-1])[::-1]
    run[:n] = np.minimum(c - c[first], c[last] - c) + 1
    best = run[:n] ** 2
    for way in (0, 4):
        step = np.append(near[:, way], n)
        at, k = step[:n], 1
        while k * k < best.max(initial=0):
            best = np.minimum(best, k * k + run[at] ** 2)
            at, k = step[at], k + 1
    return np.sqrt(best)


@cache
def _removable(ring: int) -> bool:
    """Whether a pixel with this ring of neighbours (a bit each) can go: at least two are there, they hang together without it, and no hole is left."""
    on = {AROUND[k] for k in range(8) if ring >> k & 1}
    if len(on) < 2 or on >= {AROUND[k] for k in (0, 2, 4, 6)}:
        return False
    seen, todo = set(), [next(iter(on))]
    while todo:
        p = todo.pop()
        if p not in seen:
            seen.add(p)
            todo += [q for q in on if max(abs(p[0] - q[0]), abs(p[1] - q[1])) == 1]
    return seen == on


def medial(near: np.ndarray, deep: np.ndarray) -> np.ndarray:
    """Which pixels are left when all are looked at by depth, those with fewer neighbours later, and each goes that can; ties by row and column."""
    n = len(near)
    alive = [True] * n + [False]
    corner = 8 - (near < n).sum(axis=1)
    rings = near.tolist()
    for p in np.lexsort((np.arange(n), corner, deep)).tolist():
        if _removable(sum(1 << k for k, q in enumerate(rings[p]) if alive[q])):
            alive[p] = False
    return np.array(alive[:-1])


def _reach(links: list[list[int]], start: int, most: int | None = None) -> tuple[list[int], dict[int, int]]:
    """Nodes in order of their steps from ``start``, up to ``most`` steps, and the node before each."""
    before, order, level = {start: -1}, [start], [start]
    while level and (most is None or most > 0):
        after = []
        for p in level:
            for q in links[p]:
                if q not in before:
                    before[q] = p
                    after.append(q)
        order += after
        level = after
        most = None if most is None else most - 1
    return order, before


def _steps(order: list[int], before: dict[int, int]) -> dict[int, int]:
    steps: dict[int, int] = {}
    for p in order:
        steps[p] = steps[before[p]] + 1 if before[p] >= 0 else 0
    return steps


def extent(links: list[list[int]]) -> int:
    """The largest number of steps between two nodes of one part of the graph: exact, from few searches.

    From the middle of a long path, nodes are searched from the farthest inwards; once twice the steps that are left can't beat
    the best, no other pair can.
    """
    best, seen = 0, set()
    for p in range(len(links)):
        if p in seen:
            continue
        part, _ = _reach(links, p)
        seen.update(part)
        far, before = _reach(links, part[-1])
        steps = _steps(far, before)
        best = max(best, steps[far[-1]])
        middle = far[-1]
        for _ in range(steps[far[-1]] // 2):
            middle = before[middle]
        order, before = _reach(links, middle)
        steps = _steps(order, before)
        for q in reversed(order):
            if 2 * steps[q] <= best:
                break
            ends, back = _reach(links, q)
            best = max(best, _steps(ends, back)[ends[-1]])
    return best


def curvature(r: np.ndarray, c: np.ndarray, links: list[list[int]], least: int, most: int, draws: int, seed: str) -> float:
    """Mean of 4 area / product of the sides of the triangles of both ends and the middle of shortest paths of ``least`` to ``most`` nodes.

    Of all such pairs of ends ``draws`` are taken, those with the smallest md5 keys of seed and places. 0 where there are none.
    """
    if len(links) < least:
        return 0.0

    def paths():
        for a in range(len(links)):
            order, before = _reach(links, a, most - 1)
            steps = _steps(order, before)
            for b in order:
                if b > a and least <= steps[b] + 1 <= most:
                    mid = b
                    for _ in range(steps[b] - (steps[b] + 1) // 2):
                        mid = before[mid]
                    yield hashlib.md5(f"{seed}|{r[a]}|{c[a]}|{r[b]}|{c[b]}".encode()).digest(), a, mid, b

    picked = heapq.nsmallest(draws, paths())
    bends = []
    for _, *three in picked:
        (y0, y1, y2), (x0, x1, x2) = r[three].astype(float), c[three].astype(float)
        area = abs(y0 * (x1 - x2) + y1 * (x2 - x0) + y2 * (x0 - x1)) / 2
        bends.append(4 * area / (np.hypot(y0 - y1, x0 - x1) * np.hypot(y1 - y2, x1 - x2) * np.hypot(y0 - y2, x0 - x2)))
    return float(np.mean(bends)) if bends else 0.0


def skeletons(pixels: DataFrame, least: int = 8, most: int = 10, draws: int = 50, seed: int = 0) -> DataFrame:
    """(slide, label, curvature, extent, max_depth, extent_by_depth, skeleton_length) of objects from their pixels (slide, label, r, c).

    ``skeleton_length`` counts the pixels that thinning leaves. ``extent`` (most steps between two pixels) and ``curvature`` are those of the
    medial axis, ``max_depth`` is the largest distance to a place outside the object. An object in pieces has the largest extent of a piece.
    Repeated pixels count once; rows with a null in these four columns take no part.
    """
    known = pixels.where("slide IS NOT NULL AND label IS NOT NULL AND r IS NOT NULL AND c IS NOT NULL").select(*KEYS, "r", "c").distinct()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["r", "c"])
        r, c = pdf["r"].to_numpy(np.int64), pdf["c"].to_numpy(np.int64)
        near = neighbours(r, c)
        deep = depth(near, c)
        kept = medial(near, deep)
        y, x = r[kept], c[kept]
        links = [[q for q in row if q < len(y)] for row in neighbours(y, x).tolist()]
        key = f"{seed}|{pdf['slide'].iloc[0]}|{pdf['label'].iloc[0]}"
        far = extent(links)
        row = (curvature(y, x, links, least, most, draws, key), far, deep.max(), far / deep.max(), int(thinned(near).sum()))
        names = ["curvature", "extent", "max_depth", "extent_by_depth", "skeleton_length"]
        return pdf[KEYS].head(1).assign(**dict(zip(names, row, strict=True)))

    kinds = {f.name: f.dataType.simpleString() for f in known.schema}
    schema = f"slide {kinds['slide']}, label {kinds['label']}, curvature double, extent int, max_depth double, extent_by_depth double, skeleton_length int"
    return known.groupBy(*KEYS).applyInPandas(one, schema)
