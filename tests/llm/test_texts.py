"""Operators on one text at a time, against plain Python, tiktoken and held-out accuracy."""

import collections
import hashlib
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from gridloom.llm import bpe, langid, quality, queries, repetition, secret_scan, textstats
from tests.llm.helpers import frame, odd_rows, prose

VOCAB = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(again)


def repeats(words):
    """Longest repeat from each place, by comparing all pairs."""
    out = [0] * len(words)
    for i in range(len(words)):
        for j in range(len(words)):
            if i != j:
                k = 0
                while max(i, j) + k < len(words) and words[i + k] == words[j + k]:
                    k += 1
                out[i] = max(out[i], k)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_repeat_lengths(seed):
    rng = np.random.default_rng(seed)
    words = rng.integers(0, [2, 3, 5, 9, 40, 1][seed], 90)
    assert textstats.repeat_lengths(words).tolist() == repeats(words.tolist())


@pytest.mark.parametrize("kept", [0, 2, 8])
def test_long_repeats(monkeypatch, kept):
    monkeypatch.setattr(textstats, "KEPT", kept)
    n = 60_000
    assert (textstats.repeat_lengths(np.zeros(n, np.int64)) == np.r_[n - 1, np.arange(n - 1, 0, -1)]).all()
    rng = np.random.default_rng(kept)
    part = rng.integers(0, 50, 3000)
    s = np.r_[part, rng.integers(50, 90, 700), part[:2500], rng.integers(90, 99, 300), part[100:2800]]
    plain = lambda i: max(next((k for k in range(n) if max(i, j) + k >= len(s) or s[i + k] != s[j + k]), 0) for j in range(len(s)) if j != i and s[j] == s[i])
    got = textstats.repeat_lengths(s)
    for i in (0, 50, 150, 2000, 2999, 3700, 4000, 6600, 9000):
        assert got[i] == plain(i)


def test_op1_verdict_on_a_table(spark, sf_dir):
    """``kept`` and the repeats behind it, by trying all pairs of positions with one word."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60).collect()
    got = {r["doc_id"]: r for r in queries.op1_suffix_repetition(spark, sf_dir).collect()}
    for r in rows:
        w = WORD.findall(r["text"] or "")
        at, rep = {}, [0] * len(w)
        for i, x in enumerate(w):
            at.setdefault(x, []).append(i)
        for places in at.values():
            for i in places:
                for j in places:
                    if i < j:
                        k = 0
                        while j + k < len(w) and w[i + k] == w[j + k]:
                            k += 1
                        rep[i], rep[j] = max(rep[i], k), max(rep[j], k)
        inside = set()
        for i, k in enumerate(rep):
            if k >= repetition.MIN_REPEAT:
                inside.update(range(i, i + k))
        longest = max((k for k in rep if k >= repetition.MIN_REPEAT), default=0)
        three = set().union(*[range(i, i + 3) for i, k in enumerate(rep) if k >= 3])
        failed = len(w) < 50 or 100 * len(three) > 50 * len(w)
        row = got[r["doc_id"]]
        assert (row["repeated_words"], row["longest_repeat"], row["n_repeat_words"], row["base_failed"]) == (len(inside), longest, len(three), failed)
        assert row["kept"] == (not failed and len(inside) <= repetition.MAX_COVERED * len(w) and longest <= repetition.MAX_REPEAT)


def test_repeats_never_cross_documents():
    m = textstats.measure(["a b c d e f g h", "a b c d e f g h", None, "a b a b a b a b a b"], 4)
    assert m["repeated"].tolist() == [0, 0, 0, 10] and m["longest"].tolist() == [0, 0, 0, 8]


def test_op1_counts_on_a_table(spark, sf_dir):
    got = {r["doc_id"]: r for r in queries.op1_suffix_repetition(spark, sf_dir).collect()}
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    assert len(got) == len(docs)
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        r, want = got[i], counts(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_op1_odd_cases_and_limits(spark):
    got = repetition.repetition_verdict(repetition.repetition_stats(frame(spark, odd_rows()))).collect()
    assert len(got) == len(odd_rows()) and all(tuple(r[c] for c in repetition.COUNTS) == counts(r["text"]) for r in got)
    rng = np.random.default_rng(0)
    block = prose(rng, 120, 10**6)
    text = " ".join([block, prose(rng, 900, 10**6), block])
    r = repetition.repetition_verdict(repetition.repetition_stats(frame(spark, [(1, text, *[None] * 6)]))).first()
    assert (r["longest_repeat"], r["base_failed"], r["kept"]) == (120, False, False)
    empty = frame(spark, [])
    assert repetition.repetition_stats(empty).count() == 0


def test_op2_equals_tiktoken(spark):
    ranks = bpe.read_ranks(VOCAB)
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = odd_rows() + [(100 + i, t, *[None] * 6) for i, t in enumerate(["don't 123456 ﷽\x00\x01", "<|endoftext|> a", "▁ ▁▁", "ab" * 3000])]
    got = bpe.bpe_roundtrip(frame(spark, rows), VOCAB, public_tokenizers.PATTERN, keep=["doc_id", "text"])
    assert got.columns == ["doc_id", "text", "ids", "decoded"] and got.count() == len(rows)
    for r in got.collect():
        assert r["ids"] == want.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    d = bpe.digests(got).where("doc_id = 4").first()
    ids = want.encode_ordinary("One two")
    assert d["n_tokens"] == len(ids) and d["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert d["decoded_sha256"] == hashlib.sha256(b"One two").hexdigest()
    assert bpe.bpe_roundtrip(frame(spark, []), VOCAB, public_tokenizers.PATTERN).count() == 0


def test_op2_needs_every_byte():
    with pytest.raises(ValueError):
        bpe.sentencepiece_model({b"a": 0})


def test_op2_on_a_table(spark, sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet").set_index("doc_id").text
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(VOCAB), special_tokens={})
    for r in queries.op2_byte_bpe(spark, sf_dir).collect():
        ids = want.encode_ordinary(docs[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def base_spans(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or "", re.I | re.A):
        out += [(m.start(), 0, m.end())] * (len(m[2]) >= 6)
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24]
    return ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_op3_base_spans_on_a_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet").set_index("doc_id").text
    got = queries.op3_secret_ownership(spark, sf_dir).collect()
    assert len(got) == len(docs) and sum(r["n_assign"] for r in got) > 0
    for r in got:
        want = base_spans(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))


def test_op3_ownership_separates_examples_from_live(spark):
    own, copied = "Zx9Kq27LmPt4Rw8Vb3Ny6Hd1", "Qw7Er5Ty3Ui1Op9As2Df4Gh6"
    rows = [(i, f"key {copied} end", "en", f"owner{i}", 0, None, None, None) for i in range(8)]
    rows += [(100 + i, f"key {own} end", "en", "one", 0, None, None, None) for i in range(8)]
    rows += [(200, "Token: 'abcdef1' 🙂 PASSWORD=zzzzzz9", "en", "one", 0, None, None, None), *odd_rows()]
    found = secret_scan.find_secrets(frame(spark, rows))
    got = {r["doc_id"]: r["spans"] for r in secret_scan.span_digests(found).collect()}
    assert len(found.collect()) == len(rows)
    assert all(got[i] == "" for i in range(8)) and all(got[100 + i] == "opaque:4:28" for i in range(8))
    assert got[200] == base_spans(rows[16][1]) == "assign:0:15,assign:19:35"
    spans = found.where("doc_id = 200").first()["spans"]
    assert secret_scan.redacted(rows[16][1], [s.asDict() for s in spans]) == "[redacted assign]' 🙂 [redacted assign]"
    assert secret_scan.find_secrets(frame(spark, [])).count() == 0
    few = {r["doc_id"]: r["spans"] for r in secret_scan.span_digests(secret_scan.find_secrets(frame(spark, rows), example_repos=8)).collect()}
    assert all(few[100 + i] == "" for i in range(8)) and few[200] == got[200]  # 8 repositories of one owner


def brute_spans(rows, owners, repos):
    """All spans by counting values in dictionaries; an opaque one must be free of base spans."""
    found, holders = {}, collections.defaultdict(set)
    for i, text, source in rows:
        own = [(k, s, e, v) for k, s, e, v in plain_candidates(text)]
        found[i] = own
        for _, _, _, v in own:
            holders[v].add((source, i))
    live = {v: len({o for o, _ in h}) < owners and len({r for _, r in h}) < repos for v, h in holders.items()}
    return {
        i: ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in sorted((s, k, e) for k, s, e, v in own if k < 3 or live[v]))
        for i, own in found.items()
    }


def plain_candidates(text):
    text = text or ""
    base = [(0, m.start(), m.end(), m[2]) for m in re.finditer(r"""(?ia:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    base += [(1, m.start(), m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(2, m.start(), m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    wide = [m for m in re.finditer("[A-Za-z0-9+/_=-]+", text) if len(m[0]) >= 20]
    for m in wide:
        p = [n / len(m[0]) for n in collections.Counter(m[0]).values()]
        mixed = any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0])
        if mixed and -sum(x * math.log2(x) for x in p) >= secret_scan.MIN_ENTROPY and all(e <= m.start() or s >= m.end() for _, s, e, _ in base):
            base.append((3, m.start(), m.end(), m[0]))
    return base


def test_op3_all_spans_on_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = np.random.default_rng(31)
    values = ["".join(rng.choice(list("ABCDEFGHJKabcdefghjk23456789"), 26)) for _ in range(160)]
    extra = [(10**6 + i, f"use {values[i % 160]} or {values[i % 7]} and token={values[i % 5]}", "en", f"s{i % 11}", 0) for i in range(300)]
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long"))
    want = brute_spans([(r["doc_id"], r["text"], r["source"]) for r in rows.collect()], secret_scan.EXAMPLE_OWNERS, secret_scan.EXAMPLE_REPOS)
    got = {r["doc_id"]: r["spans"] for r in secret_scan.span_digests(secret_scan.find_secrets(rows)).collect()}
    assert got == want and any("opaque" in v for v in want.values())


def test_op3_time_is_in_proportion_to_the_text():
    text = " ".join(f"Zx9Kq27LmPt4Rw8Vb3Ny6{i:05d}" for i in range(40_000))
    began = time.perf_counter()
    found = secret_scan.candidates(text)
    spans = [{"start": s, "end": e, "kind": k, "live": True} for k, s, e, _ in found]
    assert secret_scan.redacted(text, spans).count("[redacted opaque]") == len(found) == 40_000
    assert time.perf_counter() - began < 30


def test_op10_letters_are_alphabetic(spark):
    c = langid.Classifier({"en": b"some words of english text", "de": b"einige deutsche worte"})
    assert [c.classify(t)[0] for t in ("½ ² 10 !!", "Ⅷ ① 5", None, "", "a", "é")] [:4] == ["und"] * 4
    assert c.classify("a")[0] != "und" and c.classify("½ a")[0] != "und"
    rows = [(None, f"wort {i} ist ein deutsches wort", "de", None, 0, None, None, None) for i in range(600)]
    assert set(langid.fit_dictionaries(frame(spark, rows))) == {"de"}


def test_op3_keyword_case_is_ascii_only():
    assert secret_scan.candidates("toKen=abcdef123")[:1] == [] and len(secret_scan.candidates("ToKeN=abcdef123")) == 1


def test_op8_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = pd.read_parquet(f"{sf}/labels.parquet").set_index("doc_id").quality
    rows = queries.op8_rff_quality(spark, sf).toPandas()
    assert len(rows) == 1000 and rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.7)).all()
    assert (rows.held_out == rows.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    held = rows[rows.held_out & rows.doc_id.isin(labels.index)]
    assert (held.predicted == held.doc_id.map(labels)).mean() > 0.95


def test_op8_does_not_see_held_out_labels_and_takes_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, prose(rng, 80) if i % 2 else "JUNK!! " * 40, *[None] * 6) for i in range(80)]
    docs = frame(spark, rows + odd_rows())
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(3, None), (999, 1)], "doc_id long, quality int")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    wrong = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = quality.classify_quality(docs, labels).orderBy("doc_id", "score").collect()
    b = quality.classify_quality(docs, wrong).orderBy("doc_id", "score").collect()
    assert a == b and len(a) == len(rows) + len(odd_rows()) and all(0 <= r["score"] <= 1 for r in a)
    none = quality.classify_quality(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.classify_quality(docs.limit(0), labels).count() == 0


def test_isotonic_pools_violators():
    at, level = quality.isotonic(np.arange(5.0), np.array([0.1, 0.5, 0.3, 0.3, 0.9]), np.array([1, 1, 1, 2, 1]))
    assert at.tolist() == [0, 1, 4] and level == pytest.approx([0.1, 0.35, 0.9])


def test_op10_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = pd.read_parquet(f"{sf}/documents.parquet").set_index("doc_id")
    rows = queries.op10_zstd_langid(spark, sf).toPandas()
    assert len(rows) == len(docs) and set(rows.lang_pred) <= {"en", "de", "fr", "es", "und"} and rows.score.between(0, 1).all()
    assert (rows.held_out == rows.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    held = rows[rows.held_out]
    assert (held.lang_pred == held.doc_id.map(docs.lang)).mean() > 0.95


def test_op10_odd_cases(spark):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(160)]
    a = lambda: " ".join(rng.choice(words[:80], 60))
    b = lambda: " ".join(rng.choice(words[80:], 60))
    learn = [(i, a() if i % 2 else b(), "aa" if i % 2 else "bb", *[None] * 5) for i in range(60)]
    fitted = langid.fit_dictionaries(frame(spark, learn + odd_rows()).where("lang <> 'en'"))
    assert set(fitted) == {"aa", "bb"}
    rows = [(500, a(), *[None] * 6), (501, b(), *[None] * 6), (502, "123 -- 456", *[None] * 6), (503, "日本語の文章は学習されていません。" * 9, *[None] * 6)]
    got = {r["doc_id"]: r for r in langid.classify(frame(spark, rows + odd_rows()), fitted).collect()}
    assert (got[500]["lang_pred"], got[500]["lang_rejected"], got[501]["lang_pred"]) == ("aa", False, "bb")
    assert (got[502]["lang_pred"], got[502]["lang_rejected"]) == ("und", True) and got[503]["lang_rejected"]
    assert got[0]["lang_pred"] == got[1]["lang_pred"] == got[2]["lang_pred"] == "und"
    assert langid.fit_dictionaries(frame(spark, [])) == {}
    assert {r["lang_pred"] for r in langid.classify(frame(spark, rows), {}).collect()} == {"und"}


def test_op8_recomputed_in_numpy(spark):
    """The whole query again: statistics, features, ridge by least squares, and isotonic levels by their max-min formula."""
    sf = "/root/testdata/sf0.01"
    docs, labels = pd.read_parquet(f"{sf}/documents.parquet"), pd.read_parquet(f"{sf}/labels.parquet")
    x = quality.statistics(docs.text.tolist())
    part = docs.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4).to_numpy()
    y = docs.doc_id.map(labels.groupby("doc_id").quality.min()).to_numpy(float)
    learn, tune = (part < 2) & ~np.isnan(y), (part == 3) & ~np.isnan(y)
    rng = np.random.default_rng(quality.SEED)
    w = rng.normal(0, math.sqrt(2 * quality.GAMMA), (x.shape[1], quality.FEATURES))
    phase = rng.uniform(0, 2 * math.pi, quality.FEATURES)
    unit = (x - x[learn].mean(axis=0)) / np.maximum(x[learn].std(axis=0), 1e-3)
    z = np.column_stack([np.cos(unit @ w + phase) * math.sqrt(2 / quality.FEATURES), np.ones(len(x))])
    n, d = learn.sum(), z.shape[1]
    lean = math.sqrt(quality.RIDGE * n / d)  # ridge as rows of its own
    weights = np.linalg.lstsq(np.vstack([z[learn], lean * np.eye(d)]), np.r_[y[learn], np.zeros(d)], rcond=None)[0]
    bins = np.floor(np.clip(z @ weights, -1, 2) * quality.BINS)
    at = np.unique(bins[tune])
    good, size = (np.array([f(y[tune & (bins == b)]) for b in at], float) for f in (np.sum, len))
    mean = lambda a, b: good[a : b + 1].sum() / size[a : b + 1].sum()
    level = [max(min(mean(a, b) for b in range(i, len(at))) for a in range(i + 1)) for i in range(len(at))]
    want = np.array(level)[np.clip(np.searchsorted(at / quality.BINS, z @ weights, "right") - 1, 0, None)]
    got = queries.op8_rff_quality(spark, sf).toPandas().set_index("doc_id").score.reindex(docs.doc_id).to_numpy()
    assert np.mean(np.abs(got - want) < 1e-6) > 0.99  # a score next to a step may fall on its other side


def test_op10_recomputed_with_zstandard(spark):
    """Every document again, by compressing with each language's dictionary."""
    import zstandard

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = langid.remainder("doc_id", 5) == 0
    known = langid.fit_dictionaries(docs.where(~held))
    learnt = {r["lang"]: "" for r in docs.where(~held).select("lang").distinct().collect() if r["lang"]}
    for r in docs.where(~held).where("lang IS NOT NULL AND text IS NOT NULL").collect():
        learnt[r["lang"]] += " " + re.sub(r"[\W\d_]+", " ", r["text"].lower())
    for lang, d in known.items():  # a dictionary holds texts of its language only
        assert len(d) <= langid.DICT_BYTES and all(p.decode("utf-8", "ignore")[5:40] in learnt[lang] for p in (d[i : i + 60] for i in range(300, 900, 300)))
    params = zstandard.ZstdCompressionParameters.from_level(langid.LEVEL, min_match=langid.MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
    press = [(k, zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)) for k, v in known.items()]
    got = {r["doc_id"]: r for r in queries.op10_zstd_langid(spark, sf).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for doc, text in rows:
        if not any(map(str.isalpha, text or "")):
            assert (got[doc]["lang_pred"], got[doc]["score"]) == ("und", 0.0)
            continue
        data = re.sub(r"[\W\d_]+", " ", text.lower()).encode()
        sizes = [(sum(len(c.compress(data[i : i + langid.BLOCK])) for i in range(0, len(data), langid.BLOCK)), j, k) for j, (k, c) in enumerate(press)]
        (best, _, lang), (rest, *_) = sorted(sizes)[:2]
        margin = (rest - best) / best
        assert got[doc]["lang_pred"] == lang and got[doc]["score"] == pytest.approx(margin / (margin + 0.05))


def test_pre_tokens_stay_known_beyond_a_megabyte():
    from gridloom.llm.bpe import Codec

    codec = Codec({bytes([b]): b for b in range(256)}, "[a-z0-9]+")
    codec.learn({f"w{i:09d}" for i in range(120_000)})  # 1.2 MB
    codec.learn({"more"})
    assert len(codec.known) == 120_001 and codec.known["w000000007"] == tuple(b"w000000007")
