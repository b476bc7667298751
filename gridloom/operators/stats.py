"""Statistics as native aggregates; only last steps on a few numbers use Python."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.order import running_sums
from gridloom.operators.spatial import principal


def with_midranks(df: DataFrame, value: str) -> DataFrame:
    """Add ``midrank`` (1-based, the mean rank of equal values) and ``ties``.

    Rows are counted for each distinct value; running counts are taken inside range
    partitions of the values and then over the partitions' totals.
    """
    counts = df.groupBy(value).agg(F.count("*").alias("ties")).repartitionByRange(value).withColumn("_p", F.spark_partition_id())
    sums = counts.groupBy("_p").agg(F.sum("ties").alias("_t"))
    base = sums.select("_p", F.coalesce(F.sum("_t").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    up_to = F.sum("ties").over(Window.partitionBy("_p").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("_up", up_to).join(F.broadcast(base), "_p")  # a row for each partition
    midrank = F.col("_base") + F.col("_up") - (F.col("ties") - 1) / 2
    return df.join(ranked.select(value, "ties", midrank.alias("midrank")), value)


def mann_whitney(df: DataFrame, value: str, group: Column) -> DataFrame:
    """(n1, n2, u1, tie_sum) of the rows where the boolean ``group`` holds against the others; null values are left out."""
    rows = with_midranks(df.where(F.col(value).isNotNull()).select(value, group.alias("_g")), value)
    n1 = F.count_if("_g")
    u1 = F.sum(F.when(F.col("_g"), F.col("midrank"))) - n1 * (n1 + 1) / 2
    return rows.agg(
        n1.alias("n1"), F.count_if(~F.col("_g")).alias("n2"), u1.alias("u1"), F.sum(F.col("ties") * F.col("ties") - 1).cast("double").alias("tie_sum")
    )


def normal_p(u: DataFrame) -> DataFrame:
    """Add ``p``: two-sided normal approximation with ties and continuity of ``mann_whitney``'s row."""
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    var = n1 * n2 / 12 * (n + 1 - F.try_divide(F.col("tie_sum"), n * (n - 1)))
    z = (F.abs(F.col("u1") - n1 * n2 / 2) - 0.5) / F.sqrt(var)

    @F.pandas_udf("double")
    def tail(z: pd.Series) -> pd.Series:
        return z.map(lambda v: min(1.0, math.erfc(max(v, 0.0) / math.sqrt(2))))

    return u.withColumn("p", tail(z))


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """(groups, n, ss_between, ss_within, f, eta2) of one-way analysis of variance."""
    per = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    total = per.agg(
        F.count("*").alias("groups"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"),
        F.sum(F.col("n") * F.col("v")).alias("ss_within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"),
    )
    total = total.withColumn("ss_between", F.col("q") - F.col("n") * F.col("mean") * F.col("mean"))
    f = F.try_divide(F.col("ss_between") / (F.col("groups") - 1), F.col("ss_within") / (F.col("n") - F.col("groups")))
    return total.select(
        "groups", "n", "ss_between", "ss_within", f.alias("f"), F.try_divide(F.col("ss_between"), F.col("ss_between") + F.col("ss_within")).alias("eta2")
    )


def _beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function I_x(a, b), by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    scale = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # convergents by forward recurrence, scaled so that the denominator is 1
    p0, q0, p1, q1 = 0.0, 1.0, 1.0, 1.0
    for m in range(1, 20001):
        k, odd = divmod(m, 2)
        term = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1)) if odd else k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))
        p0, q0, p1, q1 = p1, q1, p1 + term * p0, q1 + term * q0
        if q1:
            was, now = p0 / q0 if q0 else math.inf, p1 / q1
            p0, q0, p1, q1 = p0 / q1, q0 / q1, now, 1.0
            if abs(now - was) <= 1e-15 * abs(now):
                break
    return scale * p1


def f_p(out: DataFrame) -> DataFrame:
    """Add ``p``, the upper tail of F, to ``anova``'s row; null where F is."""

    @F.pandas_udf("double")
    def tail(f: pd.Series, groups: pd.Series, n: pd.Series) -> pd.Series:
        rows = zip(f, groups - 1.0, n - groups, strict=True)
        return pd.Series([None if v != v or v is None else _beta_share(e / 2, d / 2, e / (e + d * v)) for v, d, e in rows], dtype=float)

    return out.withColumn("p", tail("f", "groups", "n"))


def chi2_p(out: DataFrame) -> DataFrame:
    """Add ``p``, the upper tail of ``chi2`` with one degree of freedom, to ``logrank``'s row; null where ``chi2`` is."""

    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return x.map(lambda v: math.erfc(math.sqrt(max(v, 0.0) / 2)), na_action="ignore")

    return out.withColumn("p", tail("chi2"))


#: Counts of a table are walked in blocks of so many.
BLOCK = 1 << 16


def _fisher_tails(x: int, y: int, z: int, w: int) -> tuple[float, float]:
    """Two-sided and upper tail of the top left count of a 2 x 2 table with given margins.

    Probabilities follow from their quotients, outwards from the likeliest count until they are nothing to a double: some
    eighty standard deviations, in blocks, whatever the margins are.
    """
    row, col, n = x + y, x + z, x + y + z + w
    low, high = max(0, row + col - n), min(row, col)
    mode = min(max((row + 1) * (col + 1) // (n + 2), low), high)

    def walk():
        yield np.array([mode]), np.zeros(1)
        for way in (1, -1):
            at, log = mode, 0.0
            while log > -745 and (at < high if way > 0 else at > low):
                k = at + way * np.arange(1, min(BLOCK, high - at if way > 0 else at - low) + 1, dtype=np.float64)
                if way > 0:  # from k - 1 to k
                    step = np.log(col - k + 1) + np.log(row - k + 1) - np.log(k) - np.log(n - row - col + k)
                else:  # from k + 1 to k
                    step = np.log(k + 1) + np.log(n - row - col + k + 1) - np.log(col - k) - np.log(row - k)
                logs = log + np.cumsum(step)
                yield k, logs
                at, log = int(k[-1]), float(logs[-1])

    own = next((float(logs[k == x][0]) for k, logs in walk() if (k == x).any()), -np.inf)
    total = two = upper = 0.0
    for k, logs in walk():
        p = np.exp(logs)
        total += p.sum()
        two += p[logs <= own + 1e-7].sum()
        upper += p[k >= x].sum()
    return min(1.0, two / total), min(1.0, upper / total)


def fisher_exact(table: DataFrame) -> DataFrame:
    """Add ``odds``, ``p_two`` and ``p_greater`` to rows (a, b, c, d) of 2 x 2 counts; a row with a null count has nulls."""

    @F.pandas_udf("p_two double, p_greater double")
    def p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        rows = zip(a, b, c, d, strict=True)
        out = [(None, None) if any(pd.isna(v) for v in r) else _fisher_tails(*map(int, r)) for r in rows]
        return pd.DataFrame(out, columns=["p_two", "p_greater"], dtype=float)

    got = table.withColumn("p", p("a", "b", "c", "d"))
    odds = F.try_divide(F.col("a") * F.col("d").cast("double"), F.col("b").cast("double") * F.col("c"))
    return got.select(*table.columns, odds.alias("odds"), "p.p_two", "p.p_greater")


def at_risk(df: DataFrame, time: str, event: str, group: str) -> DataFrame:
    """(group, time, d, n): events at each time, and how many are still observed then.

    Windows run over distinct times of a group, not over its rows.
    """
    per = df.where(F.col(time).isNotNull()).groupBy(group, time).agg(F.sum(F.col(event).cast("int")).alias("d"), F.count("*").alias("_k"))
    later = Window.partitionBy(group).orderBy(F.desc(time)).rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumn("n", F.sum("_k").over(later)).drop("_k")


def kaplan_meier(df: DataFrame, time: str, event: str, group: str) -> DataFrame:
    """(group, time, d, n, survival) at each time with an event; 0 once everyone observed has had it."""
    rows = at_risk(df, time, event, group).where("d > 0")
    before = Window.partitionBy(group).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("d") < F.col("n"), F.ln(1 - F.col("d") / F.col("n")))
    over = F.max((F.col("d") == F.col("n")).cast("int")).over(before) == 1
    return rows.withColumn("survival", F.when(over, 0.0).otherwise(F.exp(F.sum(step).over(before))))


def logrank(df: DataFrame, time: str, event: str, group: Column) -> DataFrame:
    """(observed, expected, variance, chi2) of the rows where the boolean ``group`` holds, against all."""
    rows = df.where(F.col(time).isNotNull()).withColumn("_g", group)
    per = rows.groupBy(time).agg(
        F.count_if(F.col(event)).alias("d"), F.count_if(F.col(event) & F.col("_g")).alias("d1"),
        F.count("*").alias("k"), F.count_if("_g").alias("k1"),
    )
    per = running_sums(per, time, ["k", "k1"], descending=True)
    per = per.withColumns({"n": F.col("before_k") + F.col("k"), "n1": F.col("before_k1") + F.col("k1")}).where("d > 0")
    share = F.col("n1") / F.col("n")
    var = F.coalesce(F.col("d") * share * (1 - share) * F.try_divide(F.col("n") - F.col("d"), F.col("n") - 1), F.lit(0.0))
    out = per.agg(F.sum("d1").alias("observed"), F.sum(F.col("d") * share).alias("expected"), F.sum(var).alias("variance"))
    gap = F.col("observed") - F.col("expected")
    return out.withColumn("chi2", F.try_divide(gap * gap, F.col("variance")))


def concordance(df: DataFrame, time: str, event: str, risk: str) -> DataFrame:
    """(pairs, concordant, tied, c_index) of a risk with few distinct values.

    A pair is a row with an event and one that is observed longer; it is concordant if
    the first has the larger risk. Rows are counted for each (time, risk), so that the
    join is of distinct values with running counts, not of rows.
    """
    per = df.where(F.col(time).isNotNull() & F.col(risk).isNotNull()).groupBy(time, risk).agg(F.count("*").alias("k"), F.count_if(F.col(event)).alias("d"))
    times, risks = per.select(time).distinct(), per.select(F.col(risk).alias("other")).distinct()
    levels = risks.agg(F.collect_set("other").alias("all"))  # few by contract
    dense = times.join(F.broadcast(levels)).select(time, F.explode("all").alias("other"))
    dense = dense.join(per.select(time, F.col(risk).alias("other"), "k"), [time, "other"], "left").fillna(0, ["k"])
    after = Window.partitionBy("other").orderBy(F.desc(time)).rowsBetween(Window.unboundedPreceding, -1)
    longer = dense.select(time, "other", F.coalesce(F.sum("k").over(after), F.lit(0)).alias("longer"))
    rows = per.where("d > 0").select(time, risk, "d").join(longer, time)
    n = F.col("d") * F.col("longer")
    out = rows.agg(
        F.sum(n).alias("pairs"), F.coalesce(F.sum(F.when(F.col(risk) > F.col("other"), n)), F.lit(0)).alias("concordant"),
        F.coalesce(F.sum(F.when(F.col(risk) == F.col("other"), n)), F.lit(0)).alias("tied"),
    )
    return out.withColumn("c_index", F.try_divide(F.col("concordant") + F.col("tied") / 2, F.col("pairs")))


def mantel(pairs: DataFrame, stratum: str, permutations: int, seed: int = 0) -> DataFrame:
    """(n, r, p): correlation of two distances over pairs, and its permutation p within strata.

    ``pairs`` is (stratum, a, b, x, y) with a < b, every pair of a stratum once; a
    stratum is small (a patient's samples). Each stratum relabels the y side for every
    permutation and yields only its sums; these are added by permutation, so any number
    of strata meet as one row for each permutation. Strata with a null name are one.
    """
    schema = "k int, n long, x double, y double, xx double, yy double, xy double"

    def sums(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(g[["a", "b"]].to_numpy())
        i, j, x = np.searchsorted(ids, g["a"]), np.searchsorted(ids, g["b"]), g["x"].to_numpy()
        m = np.zeros((len(ids), len(ids)))
        m[i, j] = m[j, i] = g["y"]
        rng = np.random.default_rng([seed, zlib.crc32(repr(key).encode())])
        out = []
        for k in range(permutations + 1):
            order = rng.permutation(len(ids)) if k else np.arange(len(ids))  # 0: as observed
            y = m[order[i], order[j]]
            out.append((k, len(x), x.sum(), y.sum(), x @ x, y @ y, x @ y))
        return pd.DataFrame(out, columns=["k", "n", "x", "y", "xx", "yy", "xy"])

    of = pairs.select(stratum, "a", "b", "x", "y").groupBy(stratum).applyInPandas(sums, schema).groupBy("k")
    added = of.agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    spread = F.sqrt((F.col("n") * F.col("xx") - F.col("x") * F.col("x")) * (F.col("n") * F.col("yy") - F.col("y") * F.col("y")))
    rows = added.select("k", "n", F.try_divide(F.col("n") * F.col("xy") - F.col("x") * F.col("y"), spread).alias("r"))
    observed = rows.where("k = 0").select("n", F.col("r").alias("observed"))  # one row
    hits = rows.where("k > 0").select(F.col("r").alias("drawn")).join(F.broadcast(observed)).groupBy("n", F.col("observed").alias("r"))
    return hits.agg(((F.count_if(F.abs("drawn") >= F.abs("observed") - 1e-12) + 1) / (permutations + 1)).alias("p"))


def balanced_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, gap: float = 1e-7, most: int = 200_000) -> tuple[np.ndarray, float]:
    """(weights, offset) of the linear machine for the hinge loss, whose sides (y = 1, -1) weigh alike.

    Minimises |w|^2 / 2 + sum of c_i * max(0, 1 - y_i (w x_i + b)), c_i = c * n / (2 * size of its side), through its dual: each step moves the
    two multipliers that break the optimum's conditions most, and it stops when none breaks them by more than ``gap``.
    """
    n, q = len(y), (x @ x.T) * np.outer(y, y)
    top = c * n / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
    a, slope = np.zeros(n), -np.ones(n)  # slope: of the dual's objective
    tiny, diagonal = 1e-12, q.diagonal()
    for _ in range(most):
        score = -y * slope
        up = np.where(y > 0, a < top, a > 0)
        down = np.where(y > 0, a > 0, a < top)
        i = int(np.where(up, score, -np.inf).argmax())
        wrong = score[i] - score
        if not (down & (wrong > gap)).any():
            break
        bend = np.maximum(diagonal[i] + diagonal - 2 * y[i] * y * q[i], tiny)
        j = int(np.where(down & (wrong > 0), wrong * wrong / bend, -1.0).argmax())
        move = wrong[j] / bend[j]  # along y_i in a_i, against y_j in a_j
        room = min(top[i] - a[i] if y[i] > 0 else a[i], a[j] if y[j] > 0 else top[j] - a[j])
        move = min(move, room)
        a[i] += y[i] * move
        a[j] -= y[j] * move
        slope += move * (y[i] * q[i] - y[j] * q[j])
    score, free = -y * slope, (a > tiny) & (a < top - tiny)
    if free.any():
        offset = float(score[free].mean())
    else:
        up, down = np.where(y > 0, a < top - tiny, a > tiny), np.where(y > 0, a > tiny, a < top - tiny)
        offset = float((score[up].max() + score[down].min()) / 2)
    return x.T @ (a * y), offset


def separation(rows: DataFrame, keys: list[str], label: str = "side", vector: str = "embedding", dims: int = 10, c: float = 1.0) -> DataFrame:
    """(keys, accuracy): how well a balanced linear SVM tells side 1 from 2, learnt on half of each side.

    Each group is a bounded sample (some hundreds of rows a side): principal components, the machine on rows whose boolean
    ``train`` holds, its accuracy on the others. A null accuracy: one of the sides, or of the halves, is empty.
    Rows with a null vector or side are left out.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = principal(np.stack(pdf[vector].to_numpy()).astype(float), dims)
        y, train = np.where(pdf[label] == 1, 1.0, -1.0), pdf["train"].to_numpy(bool)
        if len(set(y[train])) < 2 or train.all():
            return pdf[keys].head(1).assign(accuracy=np.nan)
        w, b = balanced_svm(x[train], y[train], c)
        return pdf[keys].head(1).assign(accuracy=float((np.where(x[~train] @ w + b > 0, 1.0, -1.0) == y[~train]).mean()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)
    known = rows.where(F.col(label).isNotNull() & F.col(vector).isNotNull())
    return known.groupBy(*keys).applyInPandas(fit, f"{schema}, accuracy double").withColumn("accuracy", F.nanvl("accuracy", F.lit(None).cast("double")))


def cox_fit(df: DataFrame, time: str, event: str, covariates: list[str], rounds: int = 20) -> dict[str, float]:
    """Coefficients of a proportional-hazards model (Breslow's ties) by Newton's steps.

    A step is one aggregation: sums of risks for each distinct time, running sums from
    the last time back over ranges of those, and totals. The columns it needs are kept on disk between steps. Rows with a null are left out.
    """
    p, beta = len(covariates), np.zeros(len(covariates))
    rows = df.select(F.col(time).alias("_t"), F.col(event).alias("_e"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(covariates)]).dropna()
    rows = rows.persist(StorageLevel.DISK_ONLY)
    both = [(i, j) for i in range(p) for j in range(i, p)]
    for _ in range(rounds):
        risk = F.exp(sum((F.lit(float(b)) * F.col(f"_x{i}") for i, b in enumerate(beta)), F.lit(0.0)))
        sums = {"s0": risk} | {f"s1_{i}": risk * F.col(f"_x{i}") for i in range(p)} | {f"s2_{i}_{j}": risk * F.col(f"_x{i}") * F.col(f"_x{j}") for i, j in both}
        per = rows.groupBy("_t").agg(
            F.count_if("_e").alias("d"), *[F.sum(F.when(F.col("_e"), F.col(f"_x{i}")).otherwise(0.0)).alias(f"o_{i}") for i in range(p)],
            *[F.sum(c).alias(n) for n, c in sums.items()],
        )
        per = running_sums(per, "_t", list(sums), descending=True).withColumns({n: F.col(f"before_{n}") + F.col(n) for n in sums}).where("d > 0")
        mean = lambda i: F.col(f"s1_{i}") / F.col("s0")
        slope = [F.sum(F.col(f"o_{i}") - F.col("d") * mean(i)) for i in range(p)]
        curve = [F.sum(F.col("d") * (F.col(f"s2_{i}_{j}") / F.col("s0") - mean(i) * mean(j))) for i, j in both]
        got = per.agg(*[c.alias(f"v{k}") for k, c in enumerate([*slope, *curve])]).first()
        if got[0] is None:
            break
        h = np.zeros((p, p))
        for k, (i, j) in enumerate(both):
            h[i, j] = h[j, i] = got[p + k]
        move = np.linalg.lstsq(h, np.array(got[:p]), rcond=None)[0]
        beta = beta + move
        if np.abs(move).max() < 1e-9:
            break
    rows.unpersist()
    return dict(zip(covariates, beta.tolist(), strict=True))
