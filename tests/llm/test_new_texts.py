"""Spelling variants, Feistel shards and conversation repair, against plain Python."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import queries, repair, sharding, spelling
from gridloom.llm.common import Stages
from tests.llm.helpers import frame, odd_rows, rows_of
from tests.oracle import assert_same

NAMES = ["op11_spelling_variants", "op12_feistel_shards", "op13_conversation_repair"]


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, sf_dir, name):
    assert_same(queries.QUERIES[name](spark, sf_dir), queries.ORACLES[name], sf_dir)


def lower(w):
    return "".join(c.lower() if c < "\x80" else c for c in w)


def plain_words(rows, one_in=199):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % one_in == 0:
                p = h % len(run)
                run = run[:p] + run[p + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def near(x, y):
    """Distance one, by trying all edits."""
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    x, y = sorted((x, y), key=len)
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def plain_variants(counts):
    forms, out = {}, {}
    for w, n in counts.items():
        others = [v for v in counts if v != w and near(w, v)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        ok = best is not None and counts[best] >= 5 * n
        forms[w] = best if ok else None
        out[w] = (len(others), counts[best] if ok else None)
    rows = []
    for w, n in counts.items():
        root = w
        while forms[root]:
            root = forms[root]
        rows.append((w, forms[w], root, n, *out[w]))
    return sorted(rows, key=repr)


def test_op11_brute_force(spark):
    rng = np.random.default_rng(1)
    stems = ["banana", "élévation", "aaaaaaa", "Kindergarten", "straßen", "letter", "lettuces"]
    words = []
    for k, stem in enumerate(stems):
        chain, n = stem, 800 if k % 2 else 150
        while n >= 1:
            words += [chain] * n
            for _ in range(3):
                p, c = int(rng.integers(0, len(chain) + 1)), "abcéßxÀA"[rng.integers(0, 8)]
                new = [chain[:p] + c + chain[p:], chain[:p] + c + chain[p + 1 :], chain[:p] + chain[p + 1 :]][rng.integers(0, 3)]
                words += [new] * int(n // rng.integers(2, 9))
            chain, n = new, n // 6
    rng.shuffle(words)
    rows = [(i, " ".join(words[i * 40 : i * 40 + 40])) for i in range(len(words) // 40 + 1)]
    rows += [(None, "Banana, banane! banana-banana banane"), (3, None), (4, ""), rows[0], rows[0], (5, "12 34 ×÷ ÷×")]
    df = spark.createDataFrame([(*r, "en", 1) for r in rows], "doc_id long, text string, word string, n long")
    counts = plain_words(rows)
    assert rows_of(spelling.spelling_variants(df)) == plain_variants(counts)
    some = plain_variants(counts)
    assert any(r[1] and r[2] != r[1] for r in some), "a chain of two forms"
    pairs = spelling.near_pairs(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    want = Counter((x, y) for x, y in itertools.permutations(counts, 2) if near(x, y))
    assert Counter((r["word"], r["near"]) for r in pairs) == want, "each pair once"
    assert rows_of(spelling.spelling_variants(df, one_in=2)) == plain_variants(plain_words(rows, 2))


def test_op11_odd_cases(spark):
    assert spelling.spelling_variants(frame(spark, [])).count() == 0
    rows = odd_rows()
    got = spelling.spelling_variants(frame(spark, rows))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert rows_of(got) == plain_variants(plain_words([r[:2] for r in rows]))
    long_run = "y" * 3_000  # one word whose deletions are all alike
    rows = [(i, f"{long_run} {long_run}y", None, None, 0, None, None, None) for i in range(6)]
    assert rows_of(spelling.spelling_variants(frame(spark, rows), one_in=1 << 40)) == [(long_run, None, long_run, 6, 1, None), (long_run + "y", None, long_run + "y", 6, 1, None)]
    with pytest.raises(ValueError):
        spelling.spelling_variants(frame(spark, []), ratio=1)


def test_op11_long_chain_of_forms(spark):
    links = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(13)], "word string, form string")
    assert {r["word"]: r["root"] for r in spelling.roots(links, Stages()).collect()} == {f"w{i}": "w13" for i in range(13)}


def plain_place(x, n, seed):
    a, b = sharding.sides(n)
    while True:
        left, right = divmod(x, b)
        for k, key in enumerate(sharding.round_keys(seed)):
            if k % 2 == 0:
                left = (left + pow(right + key, 3, sharding.PRIME)) % a
            else:
                right = (right + pow(left + key, 3, sharding.PRIME)) % b
        x = left * b + right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 3, 7, 97, 2503])
def test_op12_permutation_and_inverse(spark, n):
    rows = spark.range(n).withColumnRenamed("id", "number")
    shard, slot = sharding.place_of(F.col("number"), n, 8, 9)
    got = sharding.permuted(rows, n, 9).select("number", "place", shard.alias("shard"), slot.alias("slot"))
    back = sharding.number_at(F.col("shard"), F.col("slot"), n, 8, 9)
    got = got.withColumn("back", back).collect()
    assert sorted(r["place"] for r in got) == list(range(n))
    for r in got:
        assert r["place"] == plain_place(r["number"], n, 9) == r["slot"] * 8 + r["shard"]
        assert r["back"] == r["number"]


def test_op12_no_such_slot(spark):
    at = spark.createDataFrame([(0, 2), (7, 1), (8, 0), (-1, 0), (0, -1), (None, 0)], "shard int, slot long")
    got = [r[0] for r in at.select(sharding.number_at(F.col("shard"), F.col("slot"), 10)).collect()]
    assert got == [None] * 6


def plain_shards(rows, shards=8, seed=sharding.SEED):
    order = sorted(rows, key=lambda r: hashlib.md5(f"{'' if r[0] is None else r[0]}:{r[1] or ''}".encode()).hexdigest())
    out = []
    for i, (doc, text) in enumerate(order):
        data = (text or "").encode()
        p = plain_place(i, len(rows), seed)
        out.append((doc, len(data) + 1, zlib.crc32(data), "rows", p % shards, p // shards, None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk", [1 << 16, 4])
def test_op12_odd_cases(spark, monkeypatch, chunk):
    monkeypatch.setattr(sharding, "CHUNK", chunk)
    rows = odd_rows() + [(7, "one row", "en", "s", 0, "a", "b", "c")] * 13
    df = frame(spark, rows).withColumns({"shard": F.lit("x"), "number": F.lit(1), "place": F.lit(2)})
    got = sharding.shard_rows(df)
    assert rows_of(got) == plain_shards([r[:2] for r in rows])
    assert rows_of(sharding.shard_rows(df.repartition(7, "text"))) == rows_of(got), "partitions change nothing"
    for shards in (3, 100):
        sizes = Counter(r["shard"] for r in sharding.shard_rows(df, shards=shards, seed=4).collect())
        counts = [sizes.get(k, 0) for k in range(shards)]
        assert max(counts) - min(counts) <= 1 and sum(counts) == len(rows)
    assert sharding.shard_rows(df.limit(0)).count() == 0
    kept = sharding.shard_rows(df, keep=["text", "lang", "shard"])
    assert kept.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "text", "lang"]
    assert sorted(r["text"] or "" for r in kept.collect()) == sorted(r[1] or "" for r in rows)


def test_op12_files_in_slot_order(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(500)], "doc_id long, text string")
    sharding.write_shards(sharding.shard_rows(df, shards=4, keep=["text"]), str(tmp_path / "out"), rows_per_file=50)
    read = spark.read.parquet(str(tmp_path / "out")).withColumn("file", F.input_file_name())
    assert read.count() == 500
    spans = read.groupBy("shard", "file").agg(F.min("slot").alias("a"), F.max("slot").alias("b"), F.count("*").alias("n")).collect()
    assert all(r["b"] - r["a"] + 1 == r["n"] <= 50 for r in spans)


INITIALS = re.compile("(s?(ua)+)?")


def all_edits(rows):
    """Every way to edit ``rows`` with at most two insertions in a row: (cost, audit, turns), legal or not."""
    inserts = [()] + [(x,) for x in ("user", "assistant")] + [("user", "assistant"), ("assistant", "user")]
    options = []
    for role, text, fault in rows:
        own = [(4, "D", [])]
        if fault not in ("blank", "duplicate"):
            more = 3 if fault == "truncated" else 0
            own += [(more, "K", [(role, text)])] + [(3 + more, "R", [(r, text)]) for r in ("user", "assistant")]
        options.append([(3 * len(x) + c, "I" * len(x) + e, [(r, "") for r in x] + t) for x in inserts for c, e, t in own])
    options.append([(3 * len(x), "I" * len(x), [(r, "") for r in x]) for x in inserts])
    for picked in itertools.product(*options):
        yield sum(p[0] for p in picked), "".join(p[1] for p in picked), [t for p in picked for t in p[2]]


def plain_repair(turns):
    """From damaged (turn, role, text) rows in order: the columns that the operator returns."""
    seen, rows = set(), []
    for _, role, text in turns:
        marks = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else ""
        seen.add((role, text))
        rows.append((role, text, fault))
    known = [t for t, *_ in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    kinds = Counter(r[2] for r in rows)
    illegal = sum(x[0][:1] + y[0][:1] not in ("su", "ua", "au") for x, y in itertools.pairwise(rows))
    cost, audit, left = min((x for x in all_edits(rows) if INITIALS.fullmatch("".join(r[:1] or "-" for r, _ in x[2]))), key=lambda x: x[:2])
    return gaps, kinds["blank"], kinds["duplicate"], kinds["truncated"], illegal, cost, audit, "\n".join(f"{r}:{t}" for r, t in left)


def test_op13_cheapest_edits_of_all(spark):
    """Conversations of up to four turns against all their edits."""
    rng = np.random.default_rng(3)
    roles = ["user", "assistant", "system", "tool", "u", ""]
    texts = ["Yes.", "No", "  ", "", "Why?\n ", "Well! ok", "No"]
    turns, convs = [], {}
    for conv in range(150):
        at = sorted(int(x) for x in rng.choice(7, rng.integers(0, 5), replace=False))
        rows = [(t if rng.random() < 0.95 else None, roles[min(int(rng.exponential(1.5)), 5)], texts[rng.integers(0, 7)]) for t in at]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        if rows:
            convs[conv] = rows
        turns += [(conv, *r, "x") for r in rows]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, cost string").repartition(5, "text")
    got = repair.repair_conversations(df).collect()
    assert len(got) == len(convs)
    for r in got:
        lines = "\n".join(f"{t['role']}:{t['text']}" for t in r["repaired"])
        assert (*[r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")], lines) == plain_repair(convs[r["conv_id"]]), convs[r["conv_id"]]


def test_op13_damage_and_odd_cases(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Turn {t} of {c}.") for c in range(60) for t in range(3)]
    rows += [(None, 0, "user", "A."), (None, 1, None, None), (500, None, "user", "B!"), (500, None, "user", "B!"), (501, 5, "user", None), (502, 9, "a" * 3, " ")]
    rows += [(503, 1, "user", "same"), (503, 1, "assistant", "same"), (503, 1, "user", "same")]
    lonely = next(c for c in range(600, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)  # its only row is dropped
    rows += [(lonely, 0, "user", "gone.")]
    want = {}
    for conv, turn, role, text in rows:
        held = want.setdefault(conv, [])
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        held += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, fault int")
    got = repair.digests(repair.repair_conversations(repair.damaged(df))).collect()
    assert {r["conv_id"] for r in got} == set(want) and len(got) == len(want)
    for r in got:
        turns = sorted(want[r["conv_id"]], key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        *counts, lines = plain_repair(turns)
        assert [r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")] == counts, turns
        assert r["repaired_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
    assert next(tuple(r) for r in got if r["conv_id"] == lonely)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair.repair_conversations(df.limit(0)).count() == 0


def test_op13_long_conversation(spark):
    n = 3000
    rows = [(1, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(n)]
    r = repair.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert (r["cost"], r["audit"], len(r["repaired"])) == (0, "K" * n, n)
