"""Exact order statistics, ranks, spatial graphs, constrained clusters and the linear machine, against plain NumPy."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import order, ranking, spatial, stats, vectors
from gridloom.registry import QUERIES


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("sketch", ["good", "useless"])
def test_quantiles_by_group(spark, monkeypatch, sketch):
    rng = np.random.default_rng(1)
    rows = [(g, float(x) if rng.random() < 0.9 else None) for g in ("a", "b", None) for x in np.round(rng.normal(size=301), 1)]
    rows += [("one", 4.0), ("none", None), ("same", 2.0), ("same", 2.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    if sketch == "useless":  # brackets that hold nothing: counts must tell
        monkeypatch.setattr(order.F, "percentile_approx", lambda *_: F.array(*[F.lit(1e9)] * 8))
    shares = {"lo": 0.05, "mid": 0.5, "hi": 0.975, "top": 1.0}
    got = {r["g"]: r for r in order.quantiles(df, F.col("x"), shares, ["g"]).collect()}
    assert set(got) == {"a", "b", None, "one", "none", "same"}
    for g, r in got.items():
        x = np.array([v for k, v in rows if k == g and v is not None])
        assert r["n"] == len(x)
        assert [r[c] for c in shares] == (pytest.approx([np.quantile(x, s) for s in shares.values()]) if len(x) else [None] * 4)
    x = np.array([v for _, v in rows if v is not None])
    one = order.quantiles(df, F.col("x"), {"q": 0.31}).collect()
    assert len(one) == 1 and one[0]["n"] == len(x) and one[0]["q"] == pytest.approx(np.quantile(x, 0.31))
    empty = order.quantiles(df.limit(0), F.col("x"), {"q": 0.5}).collect()
    assert [tuple(r) for r in empty] == [(0, None)]
    assert order.quantiles(df.limit(0), F.col("x"), {"q": 0.5}, ["g"]).count() == 0


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums(spark, descending):
    rng = np.random.default_rng(2)
    rows = [(int(x), int(w)) for x, w in zip(rng.integers(-400, 400, 3000), rng.integers(0, 9, 3000), strict=True)] + [(None, 100)]
    got = order.running_sums(spark.createDataFrame(rows, "x int, w long").repartition(5), "x", ["w"], descending).collect()
    assert len(got) == len(rows)
    for r in got[:200] + [r for r in got if r["x"] is None]:
        sign = -1 if descending else 1
        want = sum(w for x, w in rows if x is not None and sign * x < sign * r["x"]) if r["x"] is not None else None
        assert r["before_w"] == want


def test_ranks_against_a_reference_of_any_size(spark):
    rng = np.random.default_rng(3)
    ref, asked = np.round(rng.normal(size=5000), 2), np.round(rng.normal(size=400), 2)
    probes = spark.createDataFrame([(i, float(x)) for i, x in enumerate(asked)] + [(-1, None), (-2, 1e9), (-3, -1e9)], "i int, x double")
    reference = spark.createDataFrame([(float(x),) for x in ref] + [(None,)], "x double")
    got = {r["i"]: r["rank"] for r in ranking.empirical_rank(probes, reference, "x").collect()}
    assert got == {i: (ref < x).mean() for i, x in enumerate(asked)} | {-1: None, -2: 1.0, -3: 0.0}
    assert "collect_list" not in plan(ranking.empirical_rank(probes, reference, "x"))
    assert {r["rank"] for r in ranking.empirical_rank(probes, reference.limit(0), "x").collect()} == {None}


def test_pairs_in_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [(g, i, rng.normal(size=3).tolist()) for g in (0, 1) for i in range(40)]
    df = spark.createDataFrame(rows, "g int, i int, v array<double>")
    show = lambda x: sorted((r["g"], r["a"], r["b"], round(r["dist"], 9)) for r in x.collect())
    assert show(vectors.pairs_in_blocks(df, ["g"], "i", "v")) == show(vectors.pairs_within(df, ["g"], "i", "v"))


def test_neighbours_can_be_counted_and_projected(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, i % 3, rng.normal(size=4).tolist()) for i in range(50)], "vec_id long, k int, embedding array<double>")
    found = vectors.nearest_by_relation(df, ["k"], rows=20)
    assert found.count() == 150 == len(found.select("query").collect())
    assert found.groupBy("relation").count().count() == 3
    near = vectors.nearest(df, 4, rows=20)
    assert near.count() == 200 == len(near.select("rank").collect())


def plain_graph(at, k):
    gap = ((at[:, None] - at[None]) ** 2).sum(axis=2)
    links = set()
    for i in range(len(at)):
        others = sorted((int(gap[i, j]), j) for j in range(len(at)) if j != i)
        links |= {(min(i, j), max(i, j)) for _, j in others[:k]}
    group = list(range(len(at)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in links:
        group[top(a)] = top(b)
    forced = set()
    for _, a, b in sorted((int(gap[a, b]), a, b) for a in range(len(at)) for b in range(a + 1, len(at))):
        if top(a) != top(b):
            group[top(a)] = top(b)
            forced.add((a, b))
    return links, forced


@pytest.mark.parametrize("seed,k", list(itertools.product(range(4), (2, 8))))
def test_graph_links(seed, k):
    rng = np.random.default_rng(seed)
    spots = [rng.integers(0, 7, (25, 2)) + at for at in ([0, 0], [3, 30], [90, 5], [200, 400])]
    at = np.unique(np.vstack([*spots, [[60, 60], [61, 60]]]), axis=0)
    near, forced = spatial.graph_links(at, k)
    want = plain_graph(at, k)
    assert set(map(tuple, near.tolist())) == want[0]
    assert set(map(tuple, forced.tolist())) == want[1]
    assert len(forced) >= (3 if k == 2 else 0)


def plain_merges(x, links):
    """Ward's merges by trying all adjacent clusters each time."""
    clusters, out, n = {i: [i] for i in range(len(x))}, [], len(x)
    touch = {frozenset(e) for e in links.tolist()}
    sse = lambda rows: ((x[rows] - x[rows].mean(axis=0)) ** 2).sum()
    while touch:
        cost, a, b = min((sse(clusters[a] + clusters[b]) - sse(clusters[a]) - sse(clusters[b]), a, b) for a, b in map(sorted, touch))
        out.append((a, b, cost))
        clusters[n] = clusters.pop(a) + clusters.pop(b)
        touch = {frozenset(n if e in (a, b) else e for e in t) for t in touch} - {frozenset([n])}
        n += 1
    return out


def test_ward_merges_and_cuts():
    rng = np.random.default_rng(6)
    at = np.array(list(itertools.product(range(6), range(7))))
    x = rng.normal(size=(len(at), 3))
    links, _ = spatial.graph_links(at)
    got, want = spatial.ward_merges(x, links), plain_merges(x, links)
    assert [m[:2] for m in got] == [m[:2] for m in want]
    assert [m[2] for m in got] == pytest.approx([m[2] for m in want])
    cuts = spatial.cut(len(at), got, [1, 3, 10, 99])
    assert sorted(cuts) == [1, 3, 10]
    assert all(len(np.unique(v)) == k and v[0] == 1 for k, v in cuts.items())
    assert len(np.unique(cuts[10] * 100 + cuts[3])) == 10, "cuts are nested"


def test_constrained_clusters_of_odd_slides(spark):
    rng = np.random.default_rng(7)
    rows = [("big", r, c, rng.normal(size=12).tolist()) for r in range(11) for c in range(11)]
    rows += [("big", 0, 0, [0.0] * 12), ("big", None, 0, [0.0] * 12), ("big", 50, 50, None), (None, 1, 1, [0.0] * 12)]
    rows += [("small", r, 0, [float(r)] * 12) for r in range(100)]
    df = spark.createDataFrame(rows, "slide string, r int, c int, embedding array<double>")
    got = spatial.constrained_clusters(df, [5, 500]).collect()
    assert {r["slide"] for r in got} == {"big"} and len(got) == 121 and {r["cluster"] for r in got} == {1, 2, 3, 4, 5}
    assert spatial.constrained_clusters(df.limit(0), [5]).count() == 0
    graph = spatial.spatial_graph(df).where("slide = 'small'")
    assert graph.count() == graph.distinct().count() > 100


def test_many_cells_in_one_task():
    import resource

    rng = np.random.default_rng(8)
    at = np.unique(rng.integers(0, 300, (60_000, 2)), axis=0)[:20_000]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    near, forced = spatial.graph_links(at)
    merges = spatial.ward_merges(rng.normal(size=(len(at), 10)), np.vstack([near, forced]))
    assert len(merges) == len(at) - 1
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000, "KB"


@pytest.mark.parametrize("seed", range(4))
def test_linear_machine_is_optimal(seed):
    """No step of a sub-gradient descent, from the found weights or from others, is better by over 1e-6."""
    rng = np.random.default_rng(seed)
    y = np.where(np.arange(90) < 25 + 20 * (seed % 2), 1.0, -1.0)
    x = rng.normal(size=(90, 4)) + y[:, None] * [0.8, 0.3, 0, 0] * (1 + 2 * (seed == 3))
    top = 90 / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
    loss = lambda w, b: w @ w / 2 + (top * np.maximum(0, 1 - y * (x @ w + b))).sum()
    w, b = stats.balanced_svm(x, y)
    # strong duality: a dual point's value is under every loss; rebuild one by a plain projected ascent on pairs
    best = loss(w, b)
    v, u, low = np.zeros(4), 0.0, np.inf
    for step in range(1, 40_001):
        on = y * (x @ v + u) < 1
        v = v - (v - (top * y)[on] @ x[on]) / (10 + step)
        u = u + (top * y)[on].sum() * 0.2 / (10 + step)
        low = min(low, loss(v, u))
    assert best <= low + 1e-6
    for _ in range(3000):
        move, turn = rng.normal(size=4) * 10 ** rng.uniform(-6, 0), rng.normal() * 10 ** rng.uniform(-6, 0)
        assert loss(w + move, b + turn) >= best - 1e-6


@pytest.mark.parametrize("clustered", [True, False])
def test_pruned_neighbours(spark, clustered):
    rng = np.random.default_rng(9)
    centre = rng.normal(size=(12, 8)) * (40 if clustered else 0)
    m = np.vstack([c + rng.normal(size=(30, 8)) for c in centre])
    m[7] = m[8]  # equal vectors
    rows = [(i, x.tolist()) for i, x in enumerate(m)] + [(900, [0.0] * 8), (901, None), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    u = m / np.linalg.norm(m, axis=1)[:, None]
    dist = np.round(1 - u @ u.T, vectors.DECIMALS)
    np.fill_diagonal(dist, np.inf)
    order_ = [sorted(range(len(m)), key=lambda j: (row[j], j))[:5] for row in dist]
    want = sorted((i, r + 1, j) for i, near in enumerate(order_) for r, j in enumerate(near))
    found, met = vectors.pruned_search(df, 5, rows=30)
    assert sorted((r["query"], r["rank"], r["neighbour"]) for r in found.collect()) == want
    blocks = met.select("block").distinct().count()
    share = met.distinct().count() / blocks**2
    assert share < 0.5 if clustered else share > 0.5
    assert sorted((r["query"], r["rank"], r["neighbour"]) for r in vectors.nearest(df, 5, rows=100).collect()) == want
    assert sorted((r["query"], r["rank"], r["neighbour"]) for r in vectors.nearest(df, 5).collect()) == want
    assert vectors.nearest(df.limit(0), 5).count() == 0 == vectors.pruned_search(df.limit(0), 5)[0].count()


def test_pair_quantile_counts_all_pairs(spark):
    rng = np.random.default_rng(11)
    rows = [(g, i, x.astype(np.float32).tolist()) for g, n in ((0, 90), (1, 41), (2, 2), (3, 1)) for i, x in enumerate(rng.normal(size=(n, 6)))]
    rows += [(4, i, [1.0, 2.0, 3.0, 0.5, 0.0, 0.0] if i % 3 else [2.0, -1.0, 0.1, 0.0, 0.0, float(i)]) for i in range(60)]
    rows += [(0, 900, [0.0] * 6), (1, 901, None), (1, None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "g int, i long, v array<float>")
    plain = order.quantiles(vectors.pairs_within(df, ["g"], "i", "v"), F.col("dist"), {"m": 0.3}, ["g"])
    want = {r["g"]: (r["n"], r["m"]) for r in plain.collect()}
    out = vectors.pair_quantile(df, ["g"], "i", "v", 0.3, blocks=3)
    assert {r["g"]: (r["n"], r["m"]) for r in out.collect()} == want  # to the last bit
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInPandas")[-1]


@pytest.mark.parametrize("blocks, most", [(1, 1000), (3, 7)])
def test_pairs_below_counts_all_pairs(spark, blocks, most):
    rng = np.random.default_rng(13)
    rows = [(i, rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(150)] + [(i, [1.0, 1e-5 * i, 0.0]) for i in range(150, 190)]  # ties, and values that rounding decides
    rows += [(3, [1.0, 1.0, 2.0]), (4, [2.0, 2.0, 4.0]), (None, [1.0, 0.0, 0.0]), (200, None), (201, [0.0] * 3)]
    df = spark.createDataFrame(rows, "i long, v array<double>")
    dist = {}
    for a, x in rows:
        for b, y in rows:
            if a is not None and b is not None and a < b:
                size = np.linalg.norm(x) * np.linalg.norm(y) if x and y else 0
                dist.setdefault((a, b), []).append(round(1 - float(np.dot(x, y)) / size, 9) if size else np.inf)
    all_ = np.array([d for ds in dist.values() for d in ds])
    asked = np.unique(np.r_[rng.choice(all_[np.isfinite(all_)], 60), 0.0, 1.0, 2.0, 1.5, -0.1, 3.0])
    probes = spark.createDataFrame([(float(x),) for x in [*asked, asked[0]]] + [(None,)], "d double")
    got = vectors.pairs_below(df, probes, "d", "i", "v", 9, blocks=blocks, most=most).collect()
    assert sorted((r["d"], r["below"], r["pairs"]) for r in got) == [(x, int((all_ < x).sum()), len(all_)) for x in asked.tolist()]


def test_ranks_of_distances_are_among_all_pairs(spark, tmp_path):
    rng = np.random.default_rng(14)
    v = rng.normal(size=(1300, 4))  # more rows than a sample of a thousand
    df = spark.createDataFrame([(i, i % 5, x.tolist()) for i, x in enumerate(v)], "vec_id long, label int, embedding array<double>")
    df.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    dist = np.round(1 - unit @ unit.T, 9)
    pairs = np.sort(dist[np.triu_indices(len(v), 1)])
    np.fill_diagonal(dist, np.inf)
    want = {i: round(np.searchsorted(pairs, d) / len(pairs), 6) for i, d in enumerate(dist.min(axis=1))}
    rows = QUERIES["rank_of_distance_by_relation"](spark, str(tmp_path)).collect()
    assert len(rows) == 4 * len(v)
    assert {r["vec_id"]: r["rank"] for r in rows if r["relation"] == "nearest"} == want


def test_a_row_goes_to_a_bounded_number_of_blocks(spark):
    rng = np.random.default_rng(12)
    df = spark.createDataFrame([(i, i % 3, rng.normal(size=4).tolist()) for i in range(1200)], "vec_id long, k int, embedding array<double>")
    met = vectors.pruned_search(df, 4, rows=10)[1]
    assert met.distinct().groupBy("asking").count().agg(F.max("count")).first()[0] <= 5 * vectors.SIDE
    for n, blocks in ((1200, 8), (10**6, 8), (10**7, 39)):
        assert -(-n // vectors._block_rows(n, 10)) == blocks
    assert vectors._block_rows(1200, vectors.CELL_ROWS) == vectors.CELL_ROWS
