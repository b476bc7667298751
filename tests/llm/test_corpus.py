"""Operators on the whole corpus, against brute force and SQL."""

import collections
import json
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import common, components, mixing, ngram_join, passages, queries, shingles, toolcalls, topk
from gridloom.llm.common import Stages
from tests.llm.helpers import frame, odd_rows, prose
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, sf_dir, name):
    assert_same(queries.QUERIES[name](spark, sf_dir), queries.ORACLES[name], sf_dir)


def words_of(text):
    return (text or "").encode().lower().split()


def sets_of(texts, n):
    out = []
    for t in texts:
        w = words_of(t)
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    return out


def brute_components(rows, n, percent):
    sets = sets_of([t for _, t in rows], n)
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(rows[a][0]), find(rows[b][0])))
                root[y] = x
    return {i: (len(s), find(i)) for (i, _), s in zip(rows, sets, strict=True)}


def families(rng, count, copies, edits, words=60):
    out = []
    for _ in range(count):
        base = prose(rng, int(rng.integers(words // 2, words * 2)), 10**5).split()
        for _ in range(copies):
            own = list(base)
            for _ in range(int(rng.integers(0, edits + 1))):
                own[rng.integers(0, len(own))] = f"edit{rng.integers(0, 10**6)}"
            out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_op4_against_brute_force(spark, n, percent):
    rng = np.random.default_rng(n)
    line = prose(rng, 30, 10**5)
    texts = families(rng, 8, 9, 4) + families(rng, 2, 25, 3, 80) + [f"{line} {prose(rng, k, 10**5)}" for k in (1, 2, 3, 40, 200) for _ in range(5)]
    texts += ["a b", "A B", "a b c", "a b c d", "A b C d", texts[0], texts[0].upper().lower()]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)) + 10, texts, strict=True)]
    docs = frame(spark, [(i, t, *[None] * 6) for i, t in rows])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs, n, percent).collect()}
    want = brute_components(rows, n, percent)
    assert got == want and len({c for _, c in want.values()}) < len(want)


def test_op4_near_copies_without_a_centre_meet_in_few_pairs(spark, monkeypatch):
    """Copies of a text with one to five edits: two of them link with up to six edits in all, so few link with the first."""
    rng = np.random.default_rng(29)
    base, rows = prose(rng, 300, 10**6).split(), []
    for i in range(240):
        own = list(base)
        for k in rng.choice(np.arange(5, 295, 10), 5 if i < 12 else 1 + i % 5, replace=False):
            own[k] = f"own{i}x{k}"
        rows.append((i, " ".join(own)))
    pairs, verified = [], ngram_join.verified

    def counted(found, *rest):
        pairs.append(found.count())
        return verified(found, *rest)

    monkeypatch.setattr(ngram_join, "verified", counted)
    docs = frame(spark, [(i, t, *[None] * 6) for i, t in rows])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs, 5, 80).collect()}
    assert got == brute_components(rows, 5, 80)
    assert sum(pairs) <= 16 * len(rows)


def test_op4_on_a_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op4_ngram_jaccard(spark, sf_dir).collect()}
    assert got == brute_components([tuple(r) for r in docs], 4, 85)


def test_op4_odd_cases(spark):
    got = ngram_join.jaccard_components(frame(spark, odd_rows()), 4, 85).collect()
    assert len(got) == len(odd_rows())
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append((r["n_shingles"], r["component_id"]))
    assert by[0] == [(0, 0)] and by[1] == [(0, 1)] and by[2] == [(0, 2)] and by[3] == [(1, 3)]
    assert (by[9], by[10]) == ([(1, 9)], [(1, 9)] * 2) and (1, None) in by[None]
    assert ngram_join.jaccard_components(frame(spark, []), 4, 85).count() == 0


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(4)
    for _ in range(50):
        s = np.unique(rng.integers(-(2**62), 2**62, int(rng.integers(1, 3000))))
        t = np.unique(np.r_[s[rng.random(len(s)) < 0.95], rng.integers(-(2**62), 2**62, 5)])
        bits = [np.bincount(x & 2047, minlength=2048) & 1 for x in (s, t)]
        assert (bits[0] ^ bits[1]).sum() <= len(np.setxor1d(s, t))


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(7, 7), (5, 4)]
    stage = Stages()
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(links, "a long, b long"), stage).collect()))
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {200 + i: 200 for i in range(9)}
    assert got == want
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), stage).count() == 0


def test_shingle_hashes_tell_sequences_apart(monkeypatch):
    monkeypatch.setattr(shingles, "PIECE", 64)
    rng = np.random.default_rng(5)
    texts = [prose(rng, int(k), 12) for k in rng.integers(0, 90, 60)] + ["x" * 500 + " a b c", None, "a b c d " * 30]
    hashed, plain = shingles.Shingles(4).sets(texts), sets_of(texts, 4)
    assert [len(h) for h in hashed] == [len(p) for p in plain]
    for i in range(0, 60, 7):
        for j in range(0, 60, 5):
            assert len(np.intersect1d(hashed[i], hashed[j])) == len(plain[i] & plain[j])


def test_op5_rates_and_counts(spark):
    rows = [(i, "t", "en", "big" if i < 3000 else "small", 0, None, None, None) for i in range(4000)]
    docs = frame(spark, rows + odd_rows())
    out = mixing.mix(docs, {"big": 1.0, "small": 3.0}, total=2000)
    assert out.columns == [*docs.columns, "copy", "shuffle_key"]
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert set(n) == {"big", "small"} and abs(n["big"] - 500) < 5 * math.sqrt(500) and abs(n["small"] - 1500) < 5 * math.sqrt(1500)
    copies = collections.Counter(r["doc_id"] for r in out.where("source = 'small'").collect())
    share = [sum(v >= k for v in copies.values()) / 1000 for k in (1, 2, 3)]
    tail = [1 - math.exp(-1.5) * sum(1.5**j / math.factorial(j) for j in range(k)) for k in (1, 2, 3)]
    assert share == pytest.approx(tail, abs=0.06)
    again = mixing.mix(docs.repartition(7), {"big": 1.0, "small": 3.0}, total=2000)
    assert again.exceptAll(out).count() == out.exceptAll(again).count() == 0


def test_op5_shuffles_globally_and_takes_odd_cases(spark, monkeypatch):
    rows = [(i, "t", "en", f"s{i % 5}", 0, None, None, None) for i in range(2000)]
    order = [r["doc_id"] for r in mixing.mix(frame(spark, rows)).collect()]
    assert abs(np.corrcoef(np.arange(len(order)), order)[0, 1]) < 0.1
    out = mixing.mix(frame(spark, odd_rows()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    salted = mixing.mix(frame(spark, odd_rows()))
    assert out.exceptAll(salted).count() == salted.exceptAll(out).count() == 0
    assert mixing.mix(frame(spark, [])).count() == 0
    monkeypatch.setattr(mixing, "CHUNK", 100)
    many = mixing.mix(frame(spark, rows[:200]), total=3 * 10**5)  # mean rates over MAX_RATE, copies in several runs
    n, ids, most = many.agg(F.count("*"), F.countDistinct("doc_id", "copy"), F.max("copy")).first()
    assert n == ids == pytest.approx(3 * 10**5, rel=0.01) and most > 1000


def test_op5_draws_rates_of_any_size(spark):
    rows = [(i, "t", "en", "big" if i < 4000 else None if i < 4003 else "rare", 0, None, None, None) for i in range(4006)]
    docs = frame(spark, rows)
    out = mixing.mix(docs, {"big": 1.0, "rare": 1.0, None: 2.0})  # rates of about 0.25, 334 and 668
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    for source, share in (("big", 0.25), ("rare", 0.25), (None, 0.5)):
        assert abs(n[source] - share * 4006) < 5 * math.sqrt(share * 4006)
    few = mixing.mix(docs, {None: 1.0}).groupBy("doc_id").agg(F.count("*"), F.countDistinct("copy"), F.max("copy")).collect()  # a rate of 1,335, three parts
    assert len(few) == 3 and all(r[1] == r[2] == r[3] and abs(r[1] - 4006 / 3) < 5 * math.sqrt(4006 / 3) for r in few)
    assert len({r[1] for r in few}) > 1


def test_op5_rows_without_id_are_drawn_by_their_content(spark):
    rows = [(None, f"t{i}", "en", "a" if i % 2 else "b", 0, None, None, None) for i in range(2000)]
    out = mixing.mix(frame(spark, rows), {"a": 1.0, "b": 3.0})
    n = collections.Counter(r["source"] for r in out.collect())
    assert abs(n["a"] - 500) < 120 and abs(n["b"] - 1500) < 200
    assert out.select("shuffle_key").distinct().count() == out.select("text", "copy").distinct().count()


def exact_windows(rows, size):
    at = collections.defaultdict(set)
    for i, t in rows:
        w = words_of(t)
        for j in range(len(w) - size + 1):
            at[tuple(w[j : j + size])].add((i, j))
    return [v for v in at.values() if len({i for i, _ in v}) > 1]


def test_op6_finds_repeated_passages_and_leaves_the_rest(spark):
    rng = np.random.default_rng(6)
    shared = [prose(rng, int(k), 10**6) for k in (50, 55, 80, 200)]
    rows = [(i, f"{prose(rng, int(rng.integers(5, 150)), 10**6)} {shared[i % 4]} {prose(rng, int(rng.integers(5, 150)), 10**6)}") for i in range(40)]
    rows += [(100 + i, prose(rng, 300, 10**6)) for i in range(20)]
    short = prose(rng, 30, 10**6)
    rows += [(200 + i, f"{prose(rng, 100, 10**6)} {short} {prose(rng, 100, 10**6)}") for i in range(20)]
    near = shared[3].split()
    near[100] = "changed"
    rows.append((300, f"{prose(rng, 40, 10**6)} {' '.join(near)}"))
    got = passages.duplicate_passages(frame(spark, [(i, t, *[None] * 6) for i, t in rows])).collect()
    spans = collections.defaultdict(list)
    for r in got:
        spans[r["doc_id"]].append((r["start_word"], r["end_word"], (r["passage_doc"], r["passage_start"])))
    assert set(spans) == {*range(40), 300}
    for group in exact_windows(rows, 50):
        names = {x[2] for i, j in group for x in spans[i] if x[0] <= j and j + 50 <= x[1]}
        assert all(any(x[0] <= j and j + 50 <= x[1] for x in spans[i]) for i, j in group) and len(names) == 1
    assert {len({x[2] for i in range(k, 40, 4) for x in spans[i]}) for k in range(4)} == {1}


@pytest.mark.parametrize("size", [50, 52, 60, 80])
def test_op6_finds_passages_with_a_changed_word(spark, size):
    rng = np.random.default_rng(size)
    rows = []
    for i in range(150):
        passage = prose(rng, size, 10**6).split()
        own = list(passage)
        own[int(rng.integers(size // 2 - 5, size // 2 + 5))] = "changed"
        for j, w in enumerate((passage, own)):
            rows.append((2 * i + j, f"{prose(rng, 60, 10**6)} {' '.join(w)} {prose(rng, 60, 10**6)}"))
    got = passages.duplicate_passages(frame(spark, [(i, t, *[None] * 6) for i, t in rows])).collect()
    found = {r["doc_id"] for r in got if r["start_word"] <= 60 and r["end_word"] >= 60 + size}
    assert len(found) >= 0.97 * len(rows)


def test_op6_families_with_a_stock_phrase_do_not_compete(spark):
    rng = np.random.default_rng(13)
    stock, rows = prose(rng, 12, 10**6), []
    for i in range(40):
        passage = f"{prose(rng, 19, 10**6)} {stock} {prose(rng, 19, 10**6)}"
        for j in range(2):
            rows.append((2 * i + j, f"{prose(rng, 60, 10**6)} {passage} {prose(rng, 60, 10**6)}"))
    docs = frame(spark, [(i, t, *[None] * 6) for i, t in rows])
    got = passages.duplicate_passages(docs, hashes=1).collect()
    assert {r["doc_id"] for r in got if r["start_word"] <= 60 and r["end_word"] >= 110} == {i for i, _ in rows}


def test_op6_recall_on_a_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    spans = collections.defaultdict(list)
    for r in queries.op6_compact_windows(spark, sf).collect():
        spans[r["doc_id"]].append((r["start_word"], r["end_word"]))
    places = [p for group in exact_windows(rows, 50) for p in group]
    hit = sum(any(a <= j and j + 50 <= b for a, b in spans[i]) for i, j in places)
    assert hit >= 0.99 * len(places) and {i for i, _ in places} <= set(spans)


def test_op6_odd_cases(spark):
    assert passages.duplicate_passages(frame(spark, odd_rows())).count() == 0
    assert passages.duplicate_passages(frame(spark, [])).count() == 0


def test_compact_windows_cover_every_subsequence_once():
    rng = np.random.default_rng(7)
    h = rng.permutation(60).astype(np.uint64)
    windows = passages.compact_windows(h, 8)
    for i in range(60):
        for j in range(i + 7, 60):
            holders = [w for w in windows if w[0] <= i <= w[1] <= j <= w[2]]
            assert len(holders) == 1 and holders[0][1] == i + int(h[i : j + 1].argmin())


def test_compact_windows_of_one_repeated_shingle():
    began = time.perf_counter()
    one = np.full(1_000_000, 7, np.uint64)
    assert passages.compact_windows(one, 46) == [(0, 0, 999_999), (0, 999_999, 999_999)]
    h = np.random.default_rng(3).integers(0, 12, 400).astype(np.uint64)
    windows = passages.compact_windows(h, 8)
    assert windows == passages.compact_windows(h, 8, passages.repeated([h]).tobytes())
    for i in range(0, 380):  # each stretch of 8 or more is inside a window with its smallest value
        for j in (i + 7, i + 19):
            assert any(a <= i and j <= b and h[c] == h[i : j + 1].min() for a, c, b in windows)
    assert time.perf_counter() - began < 20


def brute_topk(vectors, asked, k):
    out = {}
    for q in asked:
        s = [(-int(np.dot(vectors[q], v)), i) for i, v in vectors.items() if i != q]
        out[q] = [(i, -s) for s, i in sorted(s)[:k]]
    return out


@pytest.mark.parametrize("scale", [0.05, 0.4, 3.0])
def test_op7_against_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "CELL_VECTORS", 60)
    monkeypatch.setattr(topk, "CELL_QUERIES", 5)
    monkeypatch.setattr(topk, "LEAST_VECTORS", 30)
    rng = np.random.default_rng(8)
    m = rng.normal(size=(220, 12)) * scale
    m[50:90] = m[40]
    m[7] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(m)]
    odd = [(900, None), (901, [None] * 12), (902, [float("nan")] * 12), (903, [float("inf")] * 12), (None, [0.1] * 12)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 9).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    vectors = {i: np.floor(64 * v).astype(int) for i, v in enumerate(m)}
    assert got == brute_topk(vectors, range(0, 220, 20), 9)


def test_op7_few_rows(spark):
    schema = "vec_id long, embedding array<float>, score string, rank string"
    df = spark.createDataFrame([(0, [1.0], "a", "b"), (20, [0.0, 1.0], "a", "b"), (3, [0.0], "a", "b")], schema)
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 20).collect())
    assert got == [(0, 1, 3, 0), (0, 2, 20, 0), (20, 1, 0, 0), (20, 2, 3, 0)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0
    assert topk.top_k(df.where("vec_id = 3"), F.col("vec_id") % 20 == 0, 20).count() == 0


def test_op7_stops_on_proof():
    rng = np.random.default_rng(9)
    m = rng.integers(-3, 4, (500, 16))
    m[:12] *= 40  # a few vectors of high impact decide
    index, q = topk.Index(m), m[:4].copy()
    got = list(topk.search(index, q, np.zeros((4, 500), bool), 3))
    assert len(index.levels) == 4 and all(0 < levels < len(index.levels) for *_, levels in got)
    for i, members, scores, _ in got:
        want = sorted((-int(q[i] @ v), j) for j, v in enumerate(m))[:3]
        assert [(-s, j) for j, s in zip(members, scores, strict=True)] == want
    for segments, _ in index.levels:  # each value is in one segment
        assert all((m[ids, d] == values).all() and len(set(ids)) == len(ids) for d, ids, values in segments)
    assert sum(len(ids) for segments, _ in index.levels for _, ids, _ in segments) == np.count_nonzero(m)


def test_op7_scores_are_whole_numbers_of_any_size(spark):
    big = [[2.0**40, 1.0], [2.0**40, 2.0], [-(2.0**40), 0.0], [1e300, 0.0]]
    df = spark.createDataFrame([(20 * i, v) for i, v in enumerate(big)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 20).collect()}
    whole = [[min(2**63 - 1, math.floor(64 * x)) for x in v] for v in big]
    for i, v in enumerate(whole):
        for j, w in enumerate(whole):
            if i != j:
                exact = sum(a * b for a, b in zip(v, w, strict=True))
                assert got[20 * i, 20 * j] == max(-(2**63), min(2**63 - 1, exact))


SCHEMAS = {"add": {"required": {"a": "integer", "b": "number"}, "optional": {"note": "string"}}, "ls": {"required": {}, "optional": {"deep": "object"}}}


def linked(spark, calls, results):
    c = spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string, extra string")
    r = spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string, level string")
    return toolcalls.link_calls(c, r, SCHEMAS).collect()


def test_op9_links_orders_and_validates(spark):
    calls = [
        (1, "x", 1, "add", '{"b": 2.5, "a": 1}', "-"),
        (1, "y", 1, "add", '{"a": "$call:z", "b": 1}', "-"),
        (1, "z", 2, "ls", '{"deep": {"q": [1, {"w": null, "a": 2}]}}', "-"),
        (2, "p", 0, "ls", '{"deep": "$call:q"}', "-"),
        (2, "q", 1, "ls", '{"deep": "$call:p"}', "-"),
        (3, "b", 2, "ls", '{"x": "$call:a"}', "-"),
        (3, "a", 1, "nope", "not json", "-"),
        (3, "a", 4, "ls", "{}", "-"),
        (4, None, 1, "ls", "{}", "-"),
    ]
    results = [(1, "x", 3, 'say "hi"\n', "-"), (1, "x", 5, "later", "-"), (1, "z", 1, None, "-"), (9, "w", 1, "lost", "-"), (None, "x", 1, "n", "-")]
    got = {(r["conv_id"], r["call_id"]): r for r in linked(spark, calls, results)}
    assert len(got) == 10
    state = {k: (r["status"], r["valid"], r["level"]) for k, r in got.items()}
    assert state[1, "x"] == ("linked", True, 0) and state[1, "y"] == ("unanswered", False, 1) and state[1, "z"] == ("early", True, 0)
    assert state[2, "p"] == ("unanswered", False, None) and state[2, "q"][2] is None
    assert state[3, "b"] == ("unanswered", False, 0) and state[3, "a"] == ("unanswered", False, 0)
    assert state[9, "w"] == ("orphan", False, 0) and state[4, None][0] == "unanswered" and state[None, "x"][0] == "orphan"
    assert (got[3, "a"]["n_calls"], got[1, "x"]["n_results"]) == (2, 2)
    assert got[1, "x"]["json"] == '{"arguments":{"a":1,"b":2.5},"conv_id":1,"id":"x","name":"add","result":"say \\"hi\\"\\n","status":"linked","valid":true}'
    assert json.loads(got[3, "a"]["json"])["arguments"] == "not json"
    for r in got.values():
        parsed = json.loads(r["json"])
        assert list(parsed) == sorted(parsed)
    assert '{"deep":{"q":[1,{"a":2,"w":null}]}}' in got[1, "z"]["json"]
    assert linked(spark, [], []) == []


def test_op9_reads_conversations(spark):
    tool = json.dumps({"tool_calls": [{"id": "k", "name": "add", "arguments": '{"a":1,"b":2}'}]})
    rows = [
        (1, 0, "system", "be brief"), (1, 1, "user", "hello"), (1, 2, "assistant", "hi"), (1, 3, "user", None), (1, 4, "user", "again"), (1, 5, "assistant", tool),
        (1, 6, "tool", '{"tool_call_id": "k", "content": "3"}'), (1, 7, "critic", "x"), (2, 0, "assistant", "unasked"), (None, 0, "user", "who"),
    ]
    c, r = toolcalls.chat_as_calls(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    got = {(x["conv_id"], x["call_id"]): (x["name"], x["status"]) for x in toolcalls.link_calls(c, r, toolcalls.CHAT_SCHEMAS).collect()}
    assert got == {
        (1, "turn-0"): ("instruct", "unanswered"), (1, "turn-1"): ("reply", "linked"), (1, "turn-3"): ("reply", "unanswered"), (1, "turn-4"): ("reply", "unanswered"),
        (1, "k"): ("add", "linked"), (2, "turn--1"): (None, "orphan"), (None, "turn-0"): ("reply", "unanswered"),
    }


@pytest.mark.parametrize("stock_words", [12, 40, 44])
def test_op6_exact_passages_whatever_else_shares_their_phrase(spark, stock_words):
    """Families of two documents with a passage of 50 words, most of which is a phrase that all families have."""
    rng = np.random.default_rng(stock_words)
    stock, rows = prose(rng, stock_words, 10**6), []
    side = (50 - stock_words) // 2
    for i in range(60):
        passage = f"{prose(rng, side, 10**6)} {stock} {prose(rng, 50 - stock_words - side, 10**6)}"
        for j in range(2):
            rows.append((2 * i + j, f"{prose(rng, 60, 10**6)} {passage} {prose(rng, 60, 10**6)}"))
    got = passages.duplicate_passages(frame(spark, [(i, t, *[None] * 6) for i, t in rows])).collect()
    held = {r["doc_id"]: (r["passage_doc"], r["passage_start"]) for r in got if r["start_word"] <= 60 and r["end_word"] >= 110}
    assert set(held) == {i for i, _ in rows}
    assert all(held[2 * i] == held[2 * i + 1] for i in range(60))


@pytest.mark.parametrize("size,stock_words", [(50, 44), (60, 50), (80, 60)])
def test_op6_near_copies_whatever_else_shares_their_phrase(spark, size, stock_words):
    """Families of two near copies; most of their passage is a phrase that all families have, and one word of it differs."""
    rng = np.random.default_rng(size)
    stock, rows, families = prose(rng, stock_words, 10**6), [], 60
    side = (size - stock_words) // 2
    for i in range(families):
        passage = f"{prose(rng, side, 10**6)} {stock} {prose(rng, size - stock_words - side, 10**6)}".split()
        for j in range(2):
            rows.append((2 * i + j, f"{prose(rng, 60, 10**6)} {' '.join(passage)} {prose(rng, 60, 10**6)}"))
            passage[int(rng.integers(size // 2 - 5, size // 2 + 5))] = f"changed{i}"
    got = passages.duplicate_passages(frame(spark, [(i, t, *[None] * 6) for i, t in rows])).collect()
    held = {r["doc_id"]: (r["passage_doc"], r["passage_start"]) for r in got if r["start_word"] <= 60 and r["end_word"] >= 60 + size}
    assert sum(2 * i in held and held.get(2 * i) == held.get(2 * i + 1) for i in range(families)) >= 0.97 * families


def test_rarest_shingles_of_similar_stretches_meet():
    """Stretches with up to five of 46 broken, all ranks at random: one that stands for the first also stands for the second."""
    rng = np.random.default_rng(29)
    for broken in range(6):
        for _ in range(50):
            order, hole = rng.permutation(46).astype(np.uint64), int(rng.integers(1, 45 - broken))
            whole, rest = np.arange(46), np.r_[:hole, hole + broken : 46]
            first = set(whole[passages.rarest(whole, order, 46, 41, 5)])
            assert first == set(np.argsort(order)[:6])
            assert first & set(rest[passages.rarest(rest, order[rest], 46, 41, 5)])


def test_op6_matches_of_repeated_lines_stay_few(spark):
    rng = np.random.default_rng(17)
    line = prose(rng, 100, 10**6)
    rows = [(i, "\n".join([line] * n), *[None] * 6) for i, n in enumerate((40, 90))]
    tables = passages.window_table(frame(spark, rows), 5, 50, 4, "text", ["doc_id"])
    windows = tables.select(F.col("doc_id").alias("id"), "n", F.inline("windows")).withColumn("multi", F.lit(True))
    pairs = spark.createDataFrame([(0, 1)], "a long, b long")
    found = passages.matched_pairs(pairs, windows, 46, 4).collect()
    most = max(windows.groupBy("id").count().toPandas()["count"])
    assert len(found) == 1 and len(found[0]["matches"]) <= 2 * most
    spans = passages.duplicate_passages(frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["start_word"], r["end_word"]) for r in spans) == [(0, 0, 4000), (1, 0, 9000)]


def test_op6_a_repeated_word_stands_for_its_stretch_twice(spark):
    """A word that documents repeat 300 times gives each of them two places to be held against others, not 300."""
    places = spark.createDataFrame([(i, place, 7) for i in range(3) for place in range(300)], "id long, place int, shingle long")
    got = passages.rare_places(places, 5, 46, 80).collect()
    assert sorted((r["id"], r["place"], r["nth"]) for r in got) == [(i, p, n) for i in range(3) for p, n in ((0, 1), (299, 2))]


def test_op6_equal_texts_and_their_near_copy(spark):
    rng = np.random.default_rng(31)
    text = prose(rng, 70, 10**6)
    near = text.split()
    near[35] = "changed"
    rows = [(i, text) for i in (4, 7, 9, 9)] + [(2, f"{prose(rng, 20, 10**6)} {' '.join(near)}"), (1, prose(rng, 70, 10**6))]
    got = passages.duplicate_passages(frame(spark, [(i, t, *[None] * 6) for i, t in rows])).collect()
    assert sorted(map(tuple, got)) == [(2, 20, 90, 2, 20), *((i, 0, 70, 2, 20) for i in (4, 7, 9))]


def test_op6_chains_of_edits(spark):
    """Each document changes the one before a little; both neighbours of a link are found and share a class."""
    rng = np.random.default_rng(19)
    rows, chains = [], 20
    for c in range(chains):
        passage = prose(rng, 120, 10**6).split()
        for j in range(4):
            rows.append((10 * c + j, f"{prose(rng, 40, 10**6)} {' '.join(passage)} {prose(rng, 40, 10**6)}"))
            passage[int(rng.integers(10, 110))] = f"changed{c}x{j}"
    got = passages.duplicate_passages(frame(spark, [(i, t, *[None] * 6) for i, t in rows])).collect()
    classes = collections.defaultdict(set)
    for r in got:
        classes[r["doc_id"] // 10].add((r["doc_id"], r["passage_doc"], r["passage_start"]))
    whole = [c for c in range(chains) if {d for d, *_ in classes[c]} == {10 * c + j for j in range(4)} and len({x[1:] for x in classes[c]}) == 1]
    assert len(whole) >= 0.95 * chains


def test_op7_wide_vectors_make_smaller_cells(spark, monkeypatch):
    rng = np.random.default_rng(23)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ask = lambda: topk.top_k(df, F.col("vec_id") % 20 == 0, 5)
    want = sorted(map(tuple, ask().collect()))
    monkeypatch.setattr(topk, "CELL_BYTES", 8 * 16 * 40)  # 40 vectors, and 40 queries, a cell
    assert sorted(map(tuple, ask().collect())) == want
    assert ask().count() == len(want) == len(ask().select("score").collect())


def test_op6_pairs_without_a_long_run_in_common_have_no_passage():
    rng = np.random.default_rng(41)
    told = 0
    for trial in range(300):
        s, t = rng.integers(0, 6 if trial % 2 else 60, (2, int(rng.integers(10, 70))))
        if trial % 3 == 0:
            t[5:40] = s[2 : 2 + len(t[5:40])] if len(s) >= 37 else t[5:40]
        both = [(q - p, p, 0, 0, len(s) - 1, 0, len(t) - 1) for p in range(len(s)) for q in range(len(t)) if s[p] == t[q]]
        found = passages.shared_passages(s, t, 20, 80, np.array(sorted(both), np.int64).reshape(-1, 7))
        may = passages.may_share(passages.Places(s), passages.Places(t), 20)
        assert may or not found
        told += not may
    assert told > 20
    # texts that share a word repeated 30 times, as many do, have no 50 words in common
    junk = shingles.Shingles(5).sequences([" ".join(["the"] * 30 + [w] * 30) for w in ("reen", "thly")])
    assert not passages.may_share(*map(passages.Places, junk), 46)


def test_op6_wide_jumps_are_cut_as_one_by_one(monkeypatch):
    rng = np.random.default_rng(42)
    pairs = []
    for _ in range(150):
        s = rng.permutation(900)[: int(rng.integers(60, 500))]
        cuts = np.sort(rng.integers(0, len(s), int(rng.integers(0, 9))))
        blocks = np.split(s, cuts)
        t = np.concatenate([blocks[i] for i in rng.permutation(len(blocks))])
        lost = rng.random(len(t)) < rng.choice([0, 0.05, 0.2])
        pairs.append((passages.Places(s), passages.Places(np.where(lost, 1000 + np.arange(len(t)), t))))
    got = [passages.whole_passages(*p, 46, 80) for p in pairs]
    monkeypatch.setattr(passages._AlikeSingle, "jump", lambda *_: 0)
    monkeypatch.setattr(passages._AlikeSingle, "enough", lambda *_: True)
    assert got == [passages.whole_passages(*p, 46, 80) for p in pairs]
    assert sum(map(bool, got)) > 50


def test_op6_rows_of_one_common_shingle_are_dealt_to_several_tasks(spark):
    """Half the places have one shingle: no task reads them all, neither to count it nor to look for its classes."""
    plans = []

    def stage(df):
        rows = df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
        return spark.createDataFrame(rows, df.schema).repartition(8)

    rows = spark.range(40000).selectExpr("id % 8000 AS id", "cast(id / 8000 AS int) AS place", "if(id % 2 = 0, 7L, id % 16000) AS shingle", "id % 3 AS c")
    odd = spark.createDataFrame([(None, 0, 7, 1), (1, 9, None, 1), (2, 9, None, 2), (3, 9, 99991, None), (4, 9, 99991, 5), (4, 9, 99991, 6)], rows.schema)
    rows = rows.union(odd).repartition(8).cache()
    set_ = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
    }
    with common.settings(spark, set_):
        got = passages.several_classes(rows, stage).select(rows.columns).collect()
        assert "skew=true" in plans[-1]
        picked = passages.rare_places(rows.where("id IS NOT NULL"), 5, 3, 80, stage)
        picks = sorted(map(tuple, picked.collect()))
        assert "skew=true" in picked._jdf.queryExecution().executedPlan().toString()
        assert picks == sorted(map(tuple, passages.rare_places(rows.where("id IS NOT NULL"), 5, 3, 80).collect())) and picks
    classes = {}
    for r in (held := rows.collect()):
        classes.setdefault(r.shingle, set()).add(r.c)
    several = {s for s, c in classes.items() if s is not None and len(c - {None}) > 1}
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted((tuple(r) for r in held if r.shingle in several), key=key)
    rows.unpersist()
