"""Exact n-gram Jaccard self-join by grouped prefixes, and its connected components.

A document's set is its distinct word shingles. Two sets that are similar enough
share a shingle among the first few of each in a fixed order; that order puts
shingles that repeat in the corpus last. Documents with one set are one class,
and classes with one prefix and size are one group, which its smallest id names.
Groups that share a prefix shingle, with sizes and positions that allow a link,
are expanded to members and verified on whole sets:

1. each group against the first group of each of its shingles, each member
   against the first of its group; the links' components are found;
2. where a shingle still has members of several components, and many pairs of them,
   all its members against a few, others each round, for as long as that merges
   components: near copies needn't link with the first of them, nor with each other;
3. the pairs of members of different components that are left and that a parity
   bitmap of each set does not rule out.

A pair that is left out is of one component already, so no component is lost, and
a large group of copies costs a number of pairs in proportion to its size.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stages, discard, map_text, slices, staged
from .components import connected_components
from .shingles import Shingles

#: Shingles whose corpus counts order the prefixes: a bound of the broadcast (9 bytes each), never of the result.
RANKED = 1 << 21
#: Shingles that a task counts at a time when it looks for repeated ones.
COUNTED_AT_ONCE = 2 << 20
#: Rows of a broadcast table at most; larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000

#: Members of a shingle that all others of it are held against in a round, while it has many pairs.
PIVOTS = 8

#: Longs of a set's parity bitmap, and of its fold, which joins carry.
BITMAP, FOLD = 32, 4


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a staged table, marked for broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def repeated_shingles(docs: DataFrame, words: int, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and ranks by count of the shingles that repeat most, at most RANKED.

    Each task counts all its shingles and sends those that it met twice.
    """

    def count(batches):
        held, size, sets = [], 0, Shingles(words).sets

        def repeats():
            s = np.sort(np.concatenate(held)) if held else np.zeros(0, np.int64)
            at = np.flatnonzero(np.r_[len(s) > 0, s[1:] != s[:-1]])
            n = np.diff(np.r_[at, len(s)])
            return pa.RecordBatch.from_arrays([pa.array(s[at][n > 1]), pa.array(n[n > 1].astype(np.int64))], names=["shingle", "n"])

        for batch in batches:
            for part in slices(batch, 0):
                got = sets(part.column(0).to_pylist())
                held += got
                size += sum(map(len, got))
                if size > COUNTED_AT_ONCE:
                    yield repeats()
                    held, size = [], 0
        yield repeats()

    counts = staged(
        docs.select(text_col).mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    )
    # n as the nearest power of two below: a few dozen classes, however large the corpus is
    classes = counts.groupBy(F.floor(F.log2("n")).alias("c")).count().orderBy(F.desc("c")).collect()
    least, total = 0, 0
    for c, n in classes:
        if total + n > RANKED:
            least = 2 ** (c + 1)
            break
        total += n
    rank = F.least(F.floor(8 * F.log2("n")), F.lit(255)).cast("short").alias("rank")
    top = counts.where(F.col("n") >= least).select("shingle", rank).toArrow()  # no Python objects in the driver
    discard(counts)
    shingles = top.column("shingle").to_numpy()
    order = np.argsort(shingles)
    return shingles[order], top.column("rank").to_numpy()[order].astype(np.uint8)


def prefix_sets(docs: DataFrame, words: int, percent: int, text_col: str, ranked, keep: list[str]) -> DataFrame:
    """Add ``n`` (set size), ``d1``, ``d2`` (the set's digest), ``prefix``, ``g1``, ``g2`` (digest of it and the size), ``bits``, ``fold``.

    A bit is the parity of the set's hashes that fall on it: two bitmaps differ in
    no more bits than the sets in elements. ``fold`` is a shorter bitmap.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranked)
    columns = ("n", "d1", "d2", "g1", "g2", "prefix", "bits", "fold")

    def make():
        sets_of = Shingles(words).sets
        known, ranks = shared.value
        marked = np.zeros(1 << 22, bool)
        marked[known & (len(marked) - 1)] = True

        def run(texts):
            out = {c: [] for c in columns}
            for s in sets_of(texts):
                row = dict.fromkeys(columns)
                row["n"] = len(s)
                if len(s):
                    rank = np.zeros(len(s), np.uint8)
                    maybe = np.flatnonzero(marked[s & (len(marked) - 1)])
                    if len(maybe):
                        at = np.minimum(np.searchsorted(known, s[maybe]), len(known) - 1)
                        hit = known[at] == s[maybe]
                        rank[maybe[hit]] = ranks[at[hit]]
                    p = len(s) - -(-percent * len(s) // 100) + 1
                    row["prefix"] = s[np.argsort(rank, kind="stable")[:p]]  # by count, then by hash
                    row["d1"], row["d2"] = np.frombuffer(xxhash.xxh128_digest(s.tobytes()), np.int64).tolist()
                    row["g1"], row["g2"] = np.frombuffer(xxhash.xxh128_digest(row["prefix"].tobytes(), len(s)), np.int64).tolist()
                    parity = np.bincount(s & (64 * BITMAP - 1), minlength=64 * BITMAP) & 1
                    row["bits"] = np.packbits(parity.astype(np.uint8)).view(np.int64)
                    row["fold"] = np.bitwise_xor.reduce(row["bits"].reshape(-1, FOLD))
                for c in columns:
                    out[c].append(row[c])
            return out

        return run

    added = "n long, d1 long, d2 long, g1 long, g2 long, prefix array<long>, bits array<long>, fold array<long>"
    return map_text(docs, make, added, text_col, keep)


def _need(n: Column, m: Column, percent: int) -> Column:
    """Common shingles that sets of n and m need to link, rounded up in whole numbers."""
    return F.floor((percent * (n + m) + 99 + percent) / (100 + percent))


def _bitmaps_allow(n: Column, m: Column, left: str, right: str, percent: int) -> Column:
    """Whether the bitmaps differ in no more bits than linked sets of n and m may in elements."""
    bits = F.zip_with(left, right, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    apart = F.aggregate(bits, F.lit(0), lambda total, x: total + x)
    return apart <= n + m - 2 * _need(n, m, percent)


def _may_link(n: Column, pos: Column, m: Column, at: Column, percent: int) -> Column:
    """Whether sets of n and m shingles whose first common one is at these places of their orders may be similar enough.

    A pair that links meets this at its first common shingle, so a join that asks it at each loses none.
    """
    sizes = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    return sizes & (F.least(n - pos, m - at) >= _need(n, m, percent))


def _placed(n: Column, pos: Column) -> Column:
    return F.shiftleft(n, 32) + pos


def _size(place: Column) -> Column:
    return F.shiftright(place, 32)


def _pos(place: Column) -> Column:
    return place.bitwiseAND(F.lit((1 << 32) - 1))


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose texts are similar enough; ``texts`` is (id, text)."""

    def check(batches):
        sets, seen = Shingles(words).sets, OrderedDict()

        def of(i, text):
            if (i, text) not in seen:
                seen[i, text] = sets([text])[0]
                if len(seen) > 64:
                    seen.popitem(last=False)
            return seen[i, text]

        for batch in batches:
            good = []
            for a, b, x, y in zip(batch["a"], batch["b"], batch["x"], batch["y"], strict=True):
                s, t = of(a, x), of(b, y)
                both = len(np.intersect1d(s, t, assume_unique=True))
                good.append(bool(both) and 100 * both >= percent * (len(s) + len(t) - both))
            yield batch.loc[good, ["a", "b"]]

    # rows that repeat both id and text are verified once
    texts = texts.repartition("id").withColumn("h", F.xxhash64("text")).dropDuplicates(["id", "h"])
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInPandas(check, "a long, b long")


def crowded(at: DataFrame, before: DataFrame | None) -> DataFrame:
    """(shingle, pairs) where the pairs of members of different components are more than PIVOTS times the members.

    Of those of ``before``, the round before, only shingles that it has rid of a quarter of their pairs: where few of the
    members link, as where documents share one line, more pivots don't help.
    """
    sizes = at.groupBy("shingle", "c").agg(F.count("*").cast("double").alias("k"))
    pairs = (F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2
    now = sizes.groupBy("shingle").agg(pairs.alias("pairs"), F.sum("k").alias("k")).where(F.col("pairs") > PIVOTS * F.col("k"))
    if before is not None:
        now = now.join(before.withColumnRenamed("pairs", "were"), "shingle").where("4 * pairs <= 3 * were")
    return now.select("shingle", "pairs")


def pivots(at: DataFrame, turn: int) -> DataFrame:
    """Up to PIVOTS rows of each shingle of ``at``, others each turn; a document comes first by its own hashes, so it does in all its shingles."""
    row = F.struct(*at.columns[1:])
    picks = [F.min_by(row, F.xxhash64("id", F.lit(turn * PIVOTS + i))).alias(f"p{i}") for i in range(PIVOTS)]
    rows = at.groupBy("shingle").agg(*picks)
    rows = rows.select("shingle", F.explode(F.array_distinct(F.array(*[f"p{i}" for i in range(PIVOTS)]))).alias("p"))
    return rows.select("shingle", "p.*")


def jaccard_components(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """(``id_col``, n_shingles, component_id) and the columns that ``keep`` names, of each row of ``docs``.

    Words are runs without ASCII white space, A-Z in lower case; the set is the
    distinct shingles of ``words`` words (all words as one, if fewer). Rows link when
    100 * intersection >= ``percent`` * union, and the component's id is the smallest
    id that links reach. A null, empty or blank text has size 0 and links with
    nothing, nor does a row with a null id, whose component is null. Rows that repeat an id
    go each by its own text; their id is one node where it stands for a class.
    """
    kept = {f"kept{i}": c for i, c in enumerate(keep or [])}
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(k) for k, c in kept.items()])
    stage = Stages()
    ranked = repeated_shingles(docs, words, "text")
    sets = stage(prefix_sets(docs, words, percent, "text", ranked, ["id", *kept]))
    docs = docs.select("id", "text")
    full = sets.where("n > 0 AND id IS NOT NULL")
    any_ = lambda *names: [F.any_value(c).alias(c) for c in names]
    several = (F.min("d1") != F.max("d1")) | (F.min("d2") != F.max("d2"))
    groups = stage(full.groupBy("g1", "g2").agg(F.min("id").alias("first"), *any_("n", "prefix"), several.alias("several")))
    classes = full.groupBy("d1", "d2").agg(F.min("id").alias("id"), *any_("g1", "g2", "n", "fold"))
    classes = stage(classes.join(groups.select("g1", "g2", "first", "several"), ["g1", "g2"]).drop("g1", "g2"))

    def check(pairs: DataFrame) -> DataFrame:
        """The links among ``pairs`` (a, b): first by short bitmaps, then by long ones, and last by whole texts."""
        marks, near = classes.select("id", "n", "fold"), pairs
        for bits in ("fold", "bits"):  # the short ones leave few pairs for the long ones, and these for the texts
            near = near.join(marks.toDF("a", "n", "left"), "a").join(marks.toDF("b", "m", "right"), "b")
            near = stage(near.where(_bitmaps_allow(F.col("n"), F.col("m"), "left", "right", percent)).select("a", "b").distinct())
            ids = stage(near.select(F.col("a").alias("id")).unionByName(near.select(F.col("b").alias("id"))).distinct())
            marks = full.join(small(ids), "id", "left_semi").select("id", "n", "bits").distinct()
        return stage(verified(near, docs.join(small(ids), "id", "left_semi"), words, percent))

    # 1: against the first group of each shingle, and of each group
    places = groups.select(F.col("first").alias("g"), "n", "several", F.posexplode("prefix").alias("pos", "shingle"))
    places = places.select("shingle", "g", _placed(F.col("n"), F.col("pos")).alias("place"), "several")
    heads = places.groupBy("shingle").agg(
        F.min("g").alias("h"), F.min_by("place", "g").alias("head"), F.max("several").alias("several"), F.count("*").alias("many")
    )
    heads = stage(heads.where("many > 1").drop("many"))
    shared = stage(places.drop("several").join(heads, "shingle"))
    stage.drop(groups, heads)
    may_link = lambda a, b: _may_link(_size(F.col(a)), _pos(F.col(a)), _size(F.col(b)), _pos(F.col(b)), percent)
    stars = shared.where((F.col("g") != F.col("h")) & may_link("place", "head")).select(F.col("h").alias("a"), F.col("g").alias("b"))
    of_members = classes.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    found = stage(connected_components(check(stars.distinct().unionByName(of_members)), stage))

    # 2: what still meets in a shingle from different components; where all groups have one member, its first has been held against all
    labelled = classes.join(found, "id", "left").select("id", "first", "several", "n", "fold", F.coalesce("component", "id").alias("c"))
    labelled = stage(labelled)
    spread = labelled.groupBy(F.col("first").alias("g")).agg(F.min("c").alias("f"), F.max("c").alias("l"))
    rest = shared.where("several OR g <> h").select("shingle", "g", "place")
    open_ = rest.join(spread, "g").groupBy("shingle").agg(F.min("f").alias("f"), F.max("l").alias("l")).where("f <> l").select("shingle")
    members = labelled.select(F.col("first").alias("g"), "id", "c", "fold")
    met = rest.join(open_, "shingle", "left_semi").join(members, "g").select("shingle", "place", "id", "c", "fold")
    # members of one group meet as if in one shingle more
    mixed = labelled.where("several").join(spread.where("f <> l").select(F.col("g").alias("first")), "first", "left_semi")
    mixed = mixed.select(F.xxhash64(F.lit("group"), "first").alias("shingle"), _placed(F.col("n"), F.lit(0)).alias("place"), "id", "c", "fold")
    at, labels = stage(met.unionByName(mixed)), labelled.select("id", "c")

    def links(left: DataFrame, right: DataFrame, apart: str) -> DataFrame:
        """The links of components, (a, b), among rows of ``left`` and ``right`` that meet in a shingle and are ``apart``."""
        right = right.toDF("shingle", "there", "b", "e", "fold2")
        bitmaps = _bitmaps_allow(_size(F.col("place")), _size(F.col("there")), "fold", "fold2", percent)
        pairs = left.join(right, "shingle").where(apart).where(may_link("place", "there") & bitmaps)
        more = check(pairs.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct())
        joined = more.join(labels.toDF("a", "ca"), "a").join(labels.toDF("b", "cb"), "b")
        return joined.select(F.col("ca").alias("a"), F.col("cb").alias("b"))

    def renamed(rows: DataFrame, merged: DataFrame) -> DataFrame:
        names = merged.toDF("c", "component")
        return rows.join(names, "c", "left").withColumn("c", F.coalesce("component", "c")).select(*rows.columns)

    crowd, turn = None, 0
    while not (now := stage(crowded(at, crowd))).isEmpty():
        merged = stage(connected_components(links(at, pivots(at.join(now, "shingle", "left_semi"), turn), "c <> e"), stage))
        labels, at_now = stage(renamed(labels, merged)), renamed(at, merged)
        still = at_now.groupBy("shingle").agg(F.min("c").alias("f"), F.max("c").alias("l")).where("f <> l").select("shingle")
        at, crowd, turn = stage(at_now.join(still, "shingle", "left_semi")), now, turn + 1

    # 3: the pairs that are left
    merged = connected_components(links(at, at, "c < e"), stage)
    names = classes.join(renamed(labels, merged), "id").select("d1", "d2", F.col("c").alias("component"))
    rows = sets.select("id", "n", "d1", "d2", *kept).join(names, ["d1", "d2"], "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    found = [F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id")]
    return stage.last(rows.select(*found, *[F.col(k).alias(c) for k, c in kept.items()]))
