"""Statistics and aggregates over scores: correlation, ranks, bootstrap, accuracy, classification, ROUGE.

Correlations look at finite pairs only and are guarded: too few pairs or a constant side give null and a status.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessera.functions import text as T
from tessera.sources.tables import settle


def _by(keys: list[str] | None) -> list[str]:
    return list(keys or [])


def average_rank(x: Column | str, keys: list[str] | None = None, descending: bool = False) -> Column:
    """Rank in which ties share the mean of their places."""
    x = F.col(x) if isinstance(x, str) else x
    by = [F.col(k) for k in _by(keys)] or [F.lit(1)]
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(x.desc() if descending else x)) + (F.count("*").over(w.partitionBy(*by, x)) - 1) / 2


def ranked(df: DataFrame, x: str, out: str) -> DataFrame:
    """``out``: average rank of x over the whole table, null first. Rows go to tasks by ranges of x, are ranked there, and the counts of the
    ranges before are added, so no task ranks more than its range."""
    pid = f"_range_of_{out}"
    parts = settle(df.repartitionByRange(F.col(x)).withColumn(pid, F.spark_partition_id()), "ranges")
    counts = parts.groupBy(pid).agg(F.count("*").alias("_n"))
    before = Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = counts.select(pid, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return parts.join(starts, pid).withColumn(out, F.col("_before") + average_rank(x, [pid])).drop(pid, "_before")


def finite_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.where(T.finite(x).isNotNull() & T.finite(y).isNotNull())


def _guarded(r: Column, least: int) -> list[Column]:
    flat = (F.min("x") == F.max("x")) | (F.min("y") == F.max("y"))
    return [
        F.count("*").alias("n"),
        F.when((F.count("*") >= least) & ~flat, r).alias("coefficient"),
        F.when(F.count("*") < least, "insufficient_data").when(flat, "undefined_constant_input").otherwise("ok").alias("status"),
    ]


def _r() -> Column:
    """Pearson's r from moments about the mean, which Spark merges exactly from task to task; it stays defined where a side is constant."""
    return F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))


def pearson(df: DataFrame, x: str, y: str, keys: list[str] | None = None, least: int = 3) -> DataFrame:
    """(keys, n, coefficient, status), in one pass of partial aggregates: a key with very many rows is no single task's."""
    keys = _by(keys)
    p = finite_pairs(df, x, y).select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return p.groupBy(*keys).agg(*_guarded(_r(), least))


def spearman(df: DataFrame, x: str, y: str, keys: list[str] | None = None, least: int = 3) -> DataFrame:
    """Pearson's r of average ranks."""
    p = finite_pairs(df, x, y)
    if not keys:
        p = ranked(ranked(p.select(F.col(x).alias("_x"), F.col(y).alias("_y")), "_x", x), "_y", y)
        return pearson(p, x, y, None, least)
    return pearson(p.withColumn(x, average_rank(x, keys)).withColumn(y, average_rank(y, keys)), x, y, keys, least)


def kendall(df: DataFrame, x: str, y: str, keys: list[str], ident: str, least: int = 3) -> DataFrame:
    """Tau-b within each group, by comparing the group's rows: for groups of few rows (systems, events)."""
    p = finite_pairs(df, x, y).select(*keys, F.col(ident).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    q = p.select(*keys, F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    s = p.join(q, keys).where("id < id2").select(*keys, F.signum(F.col("x") - F.col("x2")).alias("sx"), F.signum(F.col("y") - F.col("y2")).alias("sy"))
    t = s.groupBy(*keys).agg(F.try_divide(F.sum(F.col("sx") * F.col("sy")), F.sqrt(F.sum(F.abs("sx")) * F.sum(F.abs("sy")))).alias("tau"))
    n = p.groupBy(*keys).agg(*_guarded(F.lit(0.0), least))
    return n.join(t, keys, "left").select(*keys, "n", F.when(F.col("status") == "ok", F.col("tau")).alias("coefficient"), "status")


def _beta_tail(t: float, v: float) -> float:
    """Two-sided tail of Student's t by the continued fraction of the incomplete beta function."""
    x, a, b = v / (v + t * t), v / 2, 0.5
    if x >= 1:
        return 1.0
    if x <= 0:
        return 0.0

    def fraction(a: float, b: float, x: float) -> float:
        tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 400):
            for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 + k * d, 1 + k / c
                d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


@F.pandas_udf(DoubleType())
def r_p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation by Student's t (Pearson, Spearman)."""
    def one(r: float, n: float) -> float | None:
        if r is None or math.isnan(r) or n < 3:
            return None
        return 0.0 if abs(r) >= 1 else _beta_tail(abs(r) * math.sqrt((n - 2) / (1 - r * r)), n - 2)

    return pd.Series([one(a, b) for a, b in zip(r, n)], dtype="float64")


@F.pandas_udf(DoubleType())
def tau_p_value(tau: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of Kendall's tau by the normal approximation."""
    z = tau.astype(float) / np.sqrt(2 * (2 * n + 5) / (9 * n * (n - 1)))
    return z.abs().map(lambda v: math.erfc(v / math.sqrt(2)))


def pairwise_accuracy(df: DataFrame, human: str, candidate: str, keys: list[str] | None = None) -> DataFrame:
    """How often the human text scores strictly higher; ties are errors; rows without both scores are left out."""
    d = df.where(F.col(human).isNotNull() & F.col(candidate).isNotNull())
    n, ok = F.count("*"), F.count_if(F.col(human) > F.col(candidate))
    acc = F.try_divide(ok.cast("double"), n.cast("double"))
    return d.groupBy(*_by(keys)).agg(n.alias("n"), ok.alias("n_correct"), F.count_if(F.col(human) == F.col(candidate)).alias("n_tie"), acc.alias("accuracy"), (1 - acc).alias("fn_rate"))


def error_class(intrinsic: Column, extrinsic: Column) -> Column:
    """``intrinsic`` or ``extrinsic`` where just one holds, else null. Flags as text; only ``true`` holds."""
    i, e = F.coalesce(F.lower(intrinsic.cast("string")) == "true", F.lit(False)), F.coalesce(F.lower(extrinsic.cast("string")) == "true", F.lit(False))
    return F.when(i & ~e, "intrinsic").when(e & ~i, "extrinsic")


def mean_std(df: DataFrame, x: str, keys: list[str] | None = None, single: float | None = 0.0) -> DataFrame:
    """n, mean and sample standard deviation; that of one value is ``single``."""
    std = F.when(F.count(x) == 1, F.lit(single).cast("double")).otherwise(F.stddev_samp(x))
    return df.groupBy(*_by(keys)).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), std.alias("std"))


def quartiles(df: DataFrame, x: str, keys: list[str] | None = None) -> DataFrame:
    q = lambda p: F.percentile(x, p)
    return df.groupBy(*_by(keys)).agg(q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), (q(0.75) - q(0.25)).alias("iqr"))


def centred(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Columns less their mean within ``key``."""
    w = Window.partitionBy(key)
    return df.withColumns({c: F.col(c) - F.avg(c).over(w) for c in columns})


def bootstrap(df: DataFrame, x: str, y: str, unit: str, replicates: int, seed: int = 7, other: str | None = None) -> DataFrame:
    """Percentile interval of Pearson's r under resampling of units (or of its difference to ``other``'s r).

    (estimates, skipped, ci_low, ci_high). The i-th draw of a replicate is the unit numbered MD5(seed:replicate:i) mod n,
    so draws need no random stream. Units are few (events): their sums are drawn, not their rows.
    """
    cols = [x, y] + ([other] if other else [])
    d = df.where(F.array_min(F.array(*[T.finite(c).isNotNull().cast("int") for c in cols])) == 1)
    x_, y_, o_ = F.col(x), F.col(y), F.col(other or x)
    sums = d.groupBy(unit).agg(F.count("*").alias("n"), F.sum(x_).alias("x"), F.sum(y_).alias("y"), F.sum(o_).alias("o"), F.sum(x_ * x_).alias("xx"), F.sum(y_ * y_).alias("yy"), F.sum(o_ * o_).alias("oo"), F.sum(x_ * y_).alias("xy"), F.sum(o_ * y_).alias("oy"))
    every = Window.partitionBy(F.lit(1))
    units = sums.withColumn("k", F.row_number().over(every.orderBy(unit)) - 1).withColumn("m", F.count("*").over(every))
    size = units.select("m").distinct()
    draws = F.broadcast(size).join(df.sparkSession.range(replicates).select(F.col("id").alias("rep")))  # one row
    lot = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), F.col("i").cast("string"))), 1, 8), 16, 10).cast("long"), F.col("m"))
    draws = draws.select("rep", "m", F.explode(F.sequence(F.lit(0), F.col("m").cast("int") - 1)).alias("i")).select("rep", lot.alias("k"))
    s = draws.join(units, "k").groupBy("rep").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "o", "xx", "yy", "oo", "xy", "oy")])

    def r(a: str) -> Column:
        va, vy = F.col(a * 2) - F.col(a) * F.col(a) / F.col("n"), F.col("yy") - F.col("y") * F.col("y") / F.col("n")
        cov = F.col(f"{a}y") - F.col(a) * F.col("y") / F.col("n")
        return F.when((va > 1e-12) & (vy > 1e-12), cov / F.sqrt(F.greatest(va, F.lit(1e-300)) * F.greatest(vy, F.lit(1e-300))))

    stat = r("x") - r("o") if other else r("x")
    s = s.select(stat.alias("r"))
    return s.agg(F.count("r").alias("estimates"), F.count_if(F.col("r").isNull()).alias("skipped"), F.percentile("r", 0.025).alias("ci_low"), F.percentile("r", 0.975).alias("ci_high"))


def classification(df: DataFrame, label: str, score: str, keys: list[str] | None = None) -> DataFrame:
    """AUROC, average precision, F1 and balanced accuracy at 0.5, for labels 0 and 1."""
    keys = _by(keys)
    by = keys or [F.lit(1)]
    d = df.where(F.col(label).isin(0, 1) & F.col(score).isNotNull()).select(*keys, F.col(label).cast("double").alias("y"), F.col(score).alias("s"))
    # one row for each score: ranks and cumulative counts then run over distinct scores
    g = d.groupBy(*keys, "s").agg(F.count("*").alias("n"), F.sum("y").alias("p"))
    up = Window.partitionBy(*by).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*by).orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("below", F.coalesce(F.sum(F.col("n") - F.col("p")).over(up), F.lit(0.0))).withColumn("tp", F.sum("p").over(down)).withColumn("all", F.sum("n").over(down))
    hit = F.col("s") >= 0.5
    pos, neg = F.sum("p"), F.sum(F.col("n") - F.col("p"))
    tp, fp = F.sum(F.when(hit, F.col("p")).otherwise(0.0)), F.sum(F.when(hit, F.col("n") - F.col("p")).otherwise(0.0))
    return g.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("p") * (F.col("below") + (F.col("n") - F.col("p")) / 2)), pos * neg).alias("auroc"),
        F.try_divide(F.sum(F.col("p") * F.col("tp") / F.col("all")), pos).alias("average_precision"),
        F.try_divide(2 * tp, pos + tp + fp).alias("f1"),
        ((F.try_divide(tp, pos) + F.try_divide(neg - fp, neg)) / 2).alias("balanced_accuracy"),
    )


def metric_matrix(df: DataFrame, metrics: str, target: str, source: str) -> DataFrame:
    """(source, metric, n, coefficient, status): Pearson's r of every metric of a map column with the target."""
    return pearson(df.select(F.col(source).alias("source"), F.col(target).alias("t"), F.explode(metrics).alias("metric", "value")), "value", "t", ["source", "metric"])


def system_correlation(df: DataFrame, system: str, x: str, y: str) -> DataFrame:
    """Spearman's correlation of system means."""
    return spearman(df.groupBy(system).agg(F.avg(x).alias("x"), F.avg(y).alias("y")), "x", "y")


def support_rate(df: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """Counts and shares of verdicts; the denominator has all labels."""
    n = F.count("*")
    c = {k: F.count_if(F.col(label) == k) for k in ("SUPPORTED", "CONTRADICTED", "NOT_ENOUGH_INFORMATION")}
    return df.groupBy(*keys).agg(n.alias("n"), *[v.alias("n_" + k.lower()) for k, v in c.items()], (c["SUPPORTED"].cast("double") / n).alias("support_rate"))


def friedman(df: DataFrame, block: str, treatment: str, value: str) -> DataFrame:
    """Friedman's chi-square (without tie correction) over blocks that have every treatment."""
    m = df.groupBy(block, treatment).agg(F.avg(value).alias("v"))
    k = m.select(treatment).distinct().agg(F.count("*").alias("k"))
    full = m.withColumn("c", F.count("*").over(Window.partitionBy(block))).join(F.broadcast(k)).where("c = k")  # one row
    r = full.withColumn("r", average_rank("v", [block])).groupBy(treatment).agg(F.sum("r").alias("r"), F.count("*").alias("n"), F.first("k").alias("k"))
    n, kk = F.max("n").cast("double"), F.max("k").cast("double")
    return r.agg(n.cast("long").alias("blocks"), kk.cast("long").alias("treatments"), (12 / (n * kk * (kk + 1)) * F.sum(F.col("r") * F.col("r")) - 3 * n * (kk + 1)).alias("chi2"))


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way F statistic, from sums."""
    g = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").cast("double").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    n, k = F.sum("n"), F.count("*")
    between = F.sum(F.col("s") * F.col("s") / F.col("n")) - F.sum("s") * F.sum("s") / n
    within = F.sum("q") - F.sum(F.col("s") * F.col("s") / F.col("n"))
    return g.agg(k.alias("groups"), n.cast("long").alias("n"), F.try_divide(between / (k - 1), within / (n - k)).alias("f"))


def tukey(df: DataFrame, group: str, value: str) -> DataFrame:
    """(a, b, difference, q, p): for each two groups the difference of means, b less a, its studentised range statistic and p-value, from each group's sums."""
    g = df.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("a")).agg(F.count("*").cast("double").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    # one row a group: groups are few
    total = g.agg(F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("w"), F.sum("n").alias("all"), F.count("*").alias("k"))
    mean = lambda x, s: g.select(F.col("a").alias(x), (F.col("s") / F.col("n")).alias("m" + s), F.col("n").alias("n" + s))
    p = mean("a", "1").join(mean("b", "2"), F.col("a") < F.col("b")).crossJoin(total)
    free = F.col("all") - F.col("k")
    q = F.try_divide(F.abs(F.col("m2") - F.col("m1")), F.sqrt(F.try_divide(F.col("w"), free) / 2 * (1 / F.col("n1") + 1 / F.col("n2"))))
    return p.select("a", "b", (F.col("m2") - F.col("m1")).alias("difference"), q.alias("q"), range_p_value(q, F.col("k").cast("double"), free).alias("p"))


def _range_tail(q: float, k: int, v: float) -> float:
    """P(Q > q) of the studentised range of k normal means with v degrees of freedom, by sums over fine grids."""
    if not q > 0:
        return 1.0
    z = np.linspace(-9, 9, 1201)
    cdf = np.array([0.5 * math.erfc(-t / math.sqrt(2)) for t in np.linspace(-60, 60, 24001)])
    at = lambda t: np.interp(t, np.linspace(-60, 60, 24001), cdf)
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    wide = 8 / math.sqrt(2 * v)
    s = np.linspace(max(1e-6, 1 - wide), 1 + wide, 401)
    log = math.log(2) + v / 2 * math.log(v / 2) - math.lgamma(v / 2) + (v - 1) * np.log(s) - v * s * s / 2
    inner = k * np.trapezoid(density * np.maximum(at(z)[None, :] - at(z[None, :] - q * s[:, None]), 0) ** (k - 1), z, axis=1)
    return float(min(1.0, max(0.0, 1 - np.trapezoid(np.exp(log) * inner, s))))


@F.pandas_udf(DoubleType())
def range_p_value(q: pd.Series, k: pd.Series, v: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or c < 1 else _range_tail(a, int(b), c) for a, b, c in zip(q, k, v)], dtype="float64")


def wilcoxon(df: DataFrame, x: str, y: str) -> DataFrame:
    """Signed-rank sums of differences that are not zero."""
    d = df.select((F.col(x) - F.col(y)).alias("d")).where("d <> 0").withColumn("a", F.abs("d"))
    # ranks over distinct values: the ordered part is as long as there are distinct differences
    g = d.groupBy("a").agg(F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("p"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("a").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    g = g.withColumn("r", before + (F.col("n") + 1) / 2)
    return g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(F.col("r") * F.col("p")).alias("w_plus"), F.sum(F.col("r") * (F.col("n") - F.col("p"))).alias("w_minus"))


_WORD = re.compile("[a-z0-9]+")


def _overlap(pairs: DataFrame, candidate: str, reference: str, keys: list[str], n: int, hits: Callable[[list[str], list[str]], int]) -> DataFrame:
    """(keys, precision, recall, f1) of runs of n words, from each pair's row alone: words are made, compared and dropped a pair at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("_a"), batch.column("_b")
            out = []
            for k in range(len(batch)):
                x, y = (_WORD.findall(c[k].as_py() or "") for c in (a, b))
                out.append((hits(x, y), float(max(0, len(x) - n + 1)), float(max(0, len(y) - n + 1))))
            cols = [pa.array([r[c] for r in out], k) for c, k in enumerate((pa.int64(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keys], *cols], [*keys, "hit", "nc", "nr"])

    d = pairs.select(*keys, F.lower(F.col(candidate)).alias("_a"), F.lower(F.col(reference)).alias("_b"))
    kinds = dict(d.dtypes)
    return _prf(d.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", hit bigint, nc double, nr double"), keys)


def rouge_n(pairs: DataFrame, candidate: str, reference: str, n: int, keys: list[str]) -> DataFrame:
    """(keys, precision, recall, f1) by clipped n-gram counts."""

    def hits(a: list[str], b: list[str]) -> int:
        grams = lambda w: zip(*[w[k:] for k in range(n)])
        right = Counter(grams(b))
        left = Counter(g for g in grams(a) if g in right)
        return sum(min(c, right[g]) for g, c in left.items())

    return _overlap(pairs, candidate, reference, keys, n, hits)


def _prf(df: DataFrame, keys: list[str]) -> DataFrame:
    p, r = (F.coalesce(F.try_divide(F.col("hit").cast("double"), F.col(c)), F.lit(0.0)) for c in ("nc", "nr"))
    return df.select(*keys, p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def common_words(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence: a row of its table is a whole number with a bit for each word of ``b``, 0 where the length grows."""
    at: dict[str, int] = {}
    for k, w in enumerate(b):
        at[w] = at.get(w, 0) | 1 << k
    full = (1 << len(b)) - 1
    row = full
    for w in a:
        if m := at.get(w):
            up = row & m
            row = ((row + up) | (row - up)) & full
    return len(b) - row.bit_count()


def rouge_l(pairs: DataFrame, candidate: str, reference: str, keys: list[str]) -> DataFrame:
    """(keys, precision, recall, f1) by the longest common subsequence of words."""
    return _overlap(pairs, candidate, reference, keys, 1, common_words)



def multi_reference(scores: DataFrame, keys: list[str], value: str = "f1", method: str = "mean") -> DataFrame:
    if method != "mean":
        raise ValueError("only the mean over references is defined")
    return scores.groupBy(*keys).agg(F.count("*").alias("n_references"), F.avg(value).alias(value))


def align_phrases(phrases: DataFrame, sents: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """The best sentence of every phrase: it holds the phrase; it does but for case and punctuation; it has ``least`` of its words; else
    the most similar by character 3-grams. The first of equals. A phrase without sentences has i = -1 and how = none.

    phrases(keys, p, phrase), sents(keys, i, sentence)."""
    j = phrases.join(sents, keys)
    o = F.coalesce(T.overlap("phrase", "sentence"), F.lit(0.0))
    plain = T.bare("phrase")
    tier = F.when(F.contains("sentence", "phrase"), 0).when((plain != "") & F.contains(T.bare("sentence"), plain), 1).when(o >= least, 2).otherwise(3)
    j = j.withColumn("tier", tier).withColumn("score", F.when(F.col("tier") < 2, 1.0).when(F.col("tier") == 2, o).otherwise(F.coalesce(T.char_jaccard("phrase", "sentence"), F.lit(0.0))))
    best = j.groupBy(*keys, "p").agg(F.min(F.struct("tier", (-F.round("score", 9)).alias("s"), "i", "score")).alias("b"))
    how = F.element_at(F.array(*map(F.lit, ("exact", "casefold", "overlap", "semantic"))), F.col("b.tier") + 1)
    out = phrases.join(best, [*keys, "p"], "left")
    return out.select(*keys, "p", "phrase", F.coalesce("b.i", F.lit(-1)).alias("i"), F.col("b.tier").alias("tier"), F.col("b.score").alias("score"), F.when(F.col("b").isNull(), "none").otherwise(how).alias("how"))


def paired_report(df: DataFrame, a: str, b: str, runtime_a: str, runtime_b: str, coverage_a: str, coverage_b: str) -> DataFrame:
    """Means of a paired experiment, the ratio of runtimes, and whether coverage rose by more than 0.01."""
    ca, cb = F.avg(coverage_a), F.avg(coverage_b)
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(
        F.count("*").alias("n"), ca.alias("coverage_a"), cb.alias("coverage_b"), F.try_divide(F.avg(runtime_b), F.avg(runtime_a)).alias("runtime_multiplier"), (cb - ca > 0.01).alias("coverage_up"),
    )


def wording(coverage_up: Column, delta: Column, low: Column, high: Column) -> Column:
    """Case of a paired report: A for better coverage and correlation beyond doubt, B for a gain that is small or in doubt, else C."""
    zero = F.coalesce((low <= 0) & (high >= 0), F.lit(False))
    modest = (delta > 0) & ((delta < 0.05) | zero)
    return F.when(delta.isNull(), "insufficient_stats").when(coverage_up & (delta > 0) & ~modest, "A").when(coverage_up & modest, "B").otherwise("C")


def repeats(runs: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Mean and standard deviation (0 for one run) of several values over the repeats of each key, nulls left out."""
    std = lambda v: F.when(F.count(v) == 1, 0.0).otherwise(F.stddev_samp(v))
    return runs.groupBy(*keys).agg(F.count("*").alias("runs"), *[f(v).alias(f"{n}_{v}") for v in values for n, f in (("mean", F.avg), ("std", std))])


def within_groups(df: DataFrame, x: str, y: str, key: str, least: int = 3) -> DataFrame:
    """Mean, standard deviation, median and share of positive correlations within groups of ``least`` rows; groups, and those with a coefficient."""
    r = pearson(df, x, y, [key], least)
    c = F.col("coefficient")
    return r.agg(F.count("*").alias("groups"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.percentile(c, 0.5).alias("median"), F.try_divide(F.count_if(c > 0).cast("double"), F.count(c)).alias("positive"))


def isolated(f, kind: str):
    """A column function whose exceptions fail a row only: struct(value, error) for every row of f's arguments."""

    @F.pandas_udf(f"value {kind}, error string")
    def run(*columns: pd.Series) -> pd.DataFrame:
        out = []
        for row in zip(*columns):
            try:
                out.append((f(*row), None))
            except Exception as e:  # noqa: BLE001 - any failure is the row's result
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["value", "error"])

    return run


def reply_rows(df: DataFrame, summary: str, reply: str, method: str) -> DataFrame:
    """Scores of a direct judge's replies: yes or no (``zs``), or stars (``star``), with ``binary`` and a status: ok, empty_summary or parse_failure."""
    blank = F.coalesce(F.trim(summary) == "", F.lit(True))
    score = T.yes_no(reply).cast("double") if method == "zs" else T.stars(reply) / 5.0
    good = T.yes_no(reply).cast("int") if method == "zs" else (T.stars(reply) >= 4).cast("int")
    return df.withColumns({
        "score": F.when(~blank, score), "binary": F.when(~blank, good),
        "status": F.when(blank, "empty_summary").when(score.isNull(), "parse_failure").otherwise("ok"),
    })


def judged_support(phrases: DataFrame, sents: DataFrame, replies: DataFrame, keys: list[str]) -> DataFrame:
    """Support rate of samples: phrases (or, for a sample without any, its sentences) are aligned with sentences, and replies(keys, p,
    reply) judge each; a reply that cannot be read counts in the denominator only."""
    lone = sents.join(phrases.select(*keys).distinct(), keys, "left_anti").select(*keys, F.col("i").alias("p"), F.col("sentence").alias("phrase"))
    a = align_phrases(phrases.select(*keys, "p", "phrase").unionByName(lone), sents, keys)
    j = a.join(replies, [*keys, "p"], "left").withColumn("label", T.verdict("reply"))
    return support_rate(j, "label", keys)
