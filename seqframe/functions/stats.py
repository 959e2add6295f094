"""Statistics of model comparisons, resampling, demographic curves and distances."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType


def lrt(lnl0: Column, lnl1: Column) -> Column:
    """Likelihood-ratio statistic 2 |lnL1 - lnL0|."""
    return 2 * F.abs(lnl1 - lnl0)


def erfc(square: Column) -> Column:
    """Complementary error function of the root of ``square``: below 3 a power series, from there on a continued fraction."""
    x = F.sqrt(square)
    series, fraction = F.lit(1.0), x
    for k in range(40, 0, -1):
        series = 1 + 2 * square / (2 * k + 1) * series
    for k in range(60, 0, -1):
        fraction = x + F.lit(k / 2) / fraction
    scale = F.exp(-square) / math.sqrt(math.pi)
    return F.when(square < 3, 1 - 2 * x * scale * series).otherwise(scale / fraction)


def chi2_sf(x: Column, df: int) -> Column:
    """Upper tail of chi-square: a finite sum, which for odd ``df`` begins with the complementary error function."""
    if df < 1:
        raise ValueError("degrees of freedom start at 1")
    h = F.greatest(x.cast("double"), F.lit(0.0)) / 2
    h = F.when(x.isNotNull(), h)
    total, term, first = (erfc(h), F.sqrt(h) * F.exp(-h) / math.gamma(1.5), 1.5) if df % 2 else (F.exp(-h), h * F.exp(-h), 2.0)
    for k in range((df - 1) // 2):
        total = total + term
        term = term * h / (first + k)
    return total


def pair_models(fits: DataFrame, null_model: int = 1) -> DataFrame:
    """cluster, model, stat, ddf: every tested model against the null model of its cluster."""
    null = fits.where(F.col("model") == null_model).select("cluster", F.col("np").alias("np0"), F.col("lnl").alias("lnl0"))
    return fits.where(F.col("model") != null_model).join(null, "cluster").select("cluster", "model", lrt(F.col("lnl0"), F.col("lnl")).alias("stat"), (F.col("np") - F.col("np0")).alias("ddf"))


def pair_branchsite(fits: DataFrame) -> DataFrame:
    """cluster, species, lnl_fix, lnl_nofix, w_fix, w_nofix, sites, stat, ddf, p of branch-site fits (cluster, species, kind, lnl, w,
    sites) that have both kinds, fix and nofix; one degree of freedom. Of repeated fits of a kind the last by lnl counts."""
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.struct("lnl", "w", "sites"))).alias(kind)
    both = fits.groupBy("cluster", "species").agg(of("fix"), of("nofix")).where("fix is not null and nofix is not null")
    out = both.select("cluster", "species", F.col("fix.lnl").alias("lnl_fix"), F.col("nofix.lnl").alias("lnl_nofix"), F.col("fix.w").alias("w_fix"), F.col("nofix.w").alias("w_nofix"), F.col("nofix.sites").alias("sites"))
    out = out.withColumn("stat", lrt(F.col("lnl_fix"), F.col("lnl_nofix"))).withColumn("ddf", F.lit(1).cast("long"))
    return out.withColumn("p", chi2_sf(F.col("stat"), 1))


def exclude(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``df`` without the listed keys."""
    return df.join(ids.select(key), key, "left_anti")


def restrict(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``df`` with the listed keys only."""
    return df.join(ids.select(key), key, "left_semi")


def failed_clusters(rows: DataFrame, min_len: float = 150, max_ds: float = 2) -> DataFrame:
    """Clusters of which any record is too short or too diverged."""
    return rows.where((F.col("len") < min_len) | (F.col("ds") > max_ds)).select("cluster").distinct()


def bh_fdr(df: DataFrame, by: list[str], p: str = "p", key: str = "cluster") -> DataFrame:
    """``df`` with q: the least p n / rank over ranks from its own, at most 1, within ``by``; a null p counts for nothing and has no q.

    Ranks come from distinct p-values: equal ones share the q of the last of them. P-values are dealt by their size in buckets, 1,024
    to each halving; ranks are summed within a bucket and shifted by the buckets before, minima are taken within a bucket and with
    the least of those behind, so one ``by`` is shared among tasks and only one row for each bucket meets in one.
    """
    bucket = F.when(F.col(p) > 0, F.floor(F.log2(p) * 1024)).otherwise(-(1 << 40))
    values = df.where(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count("*").alias("_m")).withColumn("_b", bucket)
    key, before, behind = [*by, "_b"], W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*by).orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)
    sizes = values.groupBy(*key).agg(F.sum("_m").alias("_s"))
    sizes = sizes.select(*key, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"), F.sum("_s").over(W.partitionBy(*by)).alias("_n"))
    own = W.partitionBy(*key)
    rank = F.col("_before") + F.sum("_m").over(own.orderBy(p).rowsBetween(W.unboundedPreceding, 0))
    ranked = values.join(sizes, key).withColumn("_q", F.col(p) * F.col("_n") / rank)
    least = ranked.groupBy(*key).agg(F.min("_q").alias("_least"))
    least = least.select(*key, F.min("_least").over(behind).alias("_behind"))
    within = F.min("_q").over(own.orderBy(F.desc(p)).rowsBetween(W.unboundedPreceding, 0))
    q = ranked.withColumn("_within", within).join(least, key).select(*by, p, F.least(F.lit(1.0), "_within", "_behind").alias("q"))
    return df.join(q, [*by, p], "left")


def add_counts(df: DataFrame) -> DataFrame:
    """``df`` with ndn = n dn and sds = s ds."""
    return df.withColumn("ndn", F.col("n") * F.col("dn")).withColumn("sds", F.col("s") * F.col("ds"))


def exact(c: str | Column, digits: int = 6) -> Column:
    """A column as decimals of ``digits`` places and 12 before these: their sums do not depend on the order."""
    return (F.col(c) if isinstance(c, str) else c).cast(f"decimal({12 + digits},{digits})")


def exact_ratio(ndn: Column, n: Column, sds: Column, s: Column) -> Column:
    """(ndn / n) / (sds / s) of exact sums; null on a zero sum."""
    ndn, n, sds, s = (c.cast("double") for c in (ndn, n, sds, s))
    return F.try_divide(F.try_divide(ndn, n), F.try_divide(sds, s))


def kaks_ratio() -> Column:
    """Aggregate of n, dn, s, ds: (sum n dn / sum n) / (sum s ds / sum s) of six-digit decimals; null on a zero sum."""
    return exact_ratio(F.sum(exact("n") * exact("dn")), F.sum(exact("n")), F.sum(exact("s") * exact("ds")), F.sum(exact("s")))


def expand_pattern(pattern: Column) -> Column:
    """Group number of each interval of a pattern like ``4+25*2+4+6``: ``a*b`` is a groups of b, ``b`` one group of b."""
    terms = F.split(pattern, r"\+")
    pairs = F.transform(terms, lambda t: F.when(t.contains("*"), F.struct(F.split_part(t, F.lit("*"), F.lit(1)).cast("int").alias("a"), F.split_part(t, F.lit("*"), F.lit(2)).cast("int").alias("b"))).otherwise(F.struct(F.lit(1).alias("a"), t.cast("int").alias("b"))))
    sizes = F.flatten(F.transform(pairs, lambda p: F.array_repeat(p["b"], p["a"])))
    return F.flatten(F.transform(sizes, lambda n, i: F.array_repeat(i, n)))


def last_free_bin(pattern: Column) -> Column:
    """Last index of which the pattern's group is not the final one; null if there is only one group. Counted from the terms, as
    groups are never listed: the final group has the size of the last term."""
    term = lambda t: F.when(t.contains("*"), F.struct(F.split_part(t, F.lit("*"), F.lit(1)).cast("long").alias("a"), F.split_part(t, F.lit("*"), F.lit(2)).cast("long").alias("b"))).otherwise(F.struct(F.lit(1).cast("long").alias("a"), t.cast("long").alias("b")))
    zero = F.struct(F.lit(0).cast("long").alias("all"), F.lit(0).cast("long").alias("last"))
    add = lambda total, p: F.when((p["a"] > 0) & (p["b"] > 0), F.struct((total["all"] + p["a"] * p["b"]).alias("all"), p["b"].alias("last"))).otherwise(total)
    return F.aggregate(F.transform(F.split(pattern, r"\+"), term), zero, add, lambda t: F.when(t["all"] > t["last"], t["all"] - t["last"] - 1))


def select_round(rounds: DataFrame, n: int = 20, least: int = 10) -> DataFrame:
    """sample, round: round ``n``; for n <= 0 the round from ``least`` on with the smallest fit."""
    if n > 0:
        return rounds.where(F.col("round") == n).select("sample", "round").distinct()
    return rounds.where(F.col("round") >= least).groupBy("sample").agg(F.min_by("round", F.struct("fit", "round")).alias("round"))


def scale_psmc(bins: DataFrame, mu: float, generation: float, skip: int = 100, mods: DataFrame | None = None, scaled: bool = True) -> DataFrame:
    """sample, round, k, years, ne of bins (sample, round, k, t, lam, theta).

    N0 = theta / skip / (4 mu) x scale; years = 2 N0 (t + dt)(1 - tau) g + shift; Ne = lambda N0 nu / 10^4. Without ``scaled``
    neither mu nor generation counts: time = scale theta / skip (t + dt)(1 - tau) + shift, size = scale lambda theta / skip nu 1000.
    ``mods`` (sample, and any of fn, fn0, alpha, dt, tau, shift, nu) has one row per sample; scale = 1/(1-fn)/(1-fn0)/alpha'
    with alpha' = 2 (2 + alpha) / 3 / (1 + alpha) where alpha is given.
    """
    rows = bins.join(mods, "sample", "left") if mods is not None else bins
    c = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in rows.columns else F.lit(default)
    scale = 1 / (1 - c("fn", 0.0)) / (1 - c("fn0", 0.0))
    if "alpha" in rows.columns:
        a = F.col("alpha")
        scale = scale / F.coalesce(2 * (2 + a) / 3 / (1 + a), F.lit(1.0))
    n0 = F.col("theta") / skip / (4 * mu) * scale
    if not scaled:
        unit = scale * F.col("theta") / skip
        time = unit * (F.col("t") + c("dt", 0.0)) * (1 - c("tau", 0.0)) + c("shift", 0.0)
        return rows.select("sample", "round", "k", time.alias("years"), (F.col("lam") * unit * c("nu", 1.0) * 1000).alias("ne"))
    years = 2 * n0 * (F.col("t") + c("dt", 0.0)) * (1 - c("tau", 0.0)) * generation + c("shift", 0.0)
    return rows.select("sample", "round", "k", years.alias("years"), (F.col("lam") * n0 * c("nu", 1.0) / 1e4).alias("ne"))


def psmc_summary(curves: DataFrame, key: str = "sample") -> DataFrame:
    """Per sample: replicates, sums and sums of squares of ratio and fit, the most segments and the largest size."""
    return curves.groupBy(key).agg(F.count("*").alias("n"), F.sum("ratio").alias("sum_ratio"), F.sum(F.col("ratio") * F.col("ratio")).alias("sum_ratio2"), F.sum("fit").alias("sum_fit"), F.sum(F.col("fit") * F.col("fit")).alias("sum_fit2"), F.max("segments").alias("max_segments"), F.max("ne").alias("max_ne"))


def psmc_overall(summary: DataFrame) -> DataFrame:
    """One row over all samples of ``psmc_summary``."""
    return summary.agg(*[F.sum(c).alias(c) for c in ("n", "sum_ratio", "sum_ratio2", "sum_fit", "sum_fit2")], *[F.max(c).alias(c) for c in ("max_segments", "max_ne")])


#: Of code points up to 127: whether they are bases, whether pyrimidines, and which of the two of their kind.
KNOWN, PYRIMIDINE, SECOND = (np.isin(np.arange(128), [ord(c) for c in letters]) for letters in ("ACGT", "CT", "GT"))


@F.arrow_udf(BinaryType())
def _planes(seqs: pa.Array) -> pa.Array:
    def one(text: str) -> bytes:
        letters = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 127)
        return b"".join(np.packbits(plane[letters]).tobytes() for plane in (KNOWN, PYRIMIDINE, SECOND))

    return pa.array([None if s is None else one(s) for s in seqs.to_pylist()], pa.binary())


def base_planes(seq: Column) -> Column:
    """An aligned sequence for ``k2p_of_planes``: three bits for each position, which are far fewer bytes than its letters."""
    return _planes(F.upper(seq))


@F.arrow_udf(StructType([StructField(c, LongType()) for c in ("n", "ti", "tv")]))
def _differences(a: pa.Array, b: pa.Array) -> pa.Array:
    def one(x: bytes | None, y: bytes | None) -> dict | None:
        if x is None or y is None:
            return None
        n = min(len(x), len(y)) // 3
        x, y = (np.frombuffer(v, np.uint8).reshape(3, -1)[:, :n] for v in (x, y))
        known, kind, other = x[0] & y[0], x[1] ^ y[1], x[2] ^ y[2]
        bits = lambda v: int(np.bitwise_count(v).sum())
        return {"n": bits(known), "ti": bits(known & other & ~kind), "tv": bits(known & kind)}

    return pa.array([one(*v) for v in zip(a.to_pylist(), b.to_pylist())], pa.struct([(c, pa.int64()) for c in ("n", "ti", "tv")]))


def k2p_of_planes(a: Column, b: Column) -> Column:
    """``k2p`` of two sequences by their ``base_planes``."""

    def distance(total: Column) -> Column:
        p, q = F.try_divide(total["ti"], total["n"]), F.try_divide(total["tv"], total["n"])
        return F.when((1 - 2 * p - q > 0) & (1 - 2 * q > 0), 0.0 - 0.5 * F.ln(1 - 2 * p - q) - 0.25 * F.ln(1 - 2 * q))

    return F.get(F.transform(F.array(_differences(a, b)), distance), F.lit(0))


def k2p(a: Column, b: Column) -> Column:
    """Kimura two-parameter distance of two aligned sequences; positions without A, C, G, T in both are left out."""
    return k2p_of_planes(base_planes(a), base_planes(b))


def k2p_pairs(alns: DataFrame) -> DataFrame:
    """group_id, s1, s2, distance: of every two alignments (group_id, species, aln) of a group, by ``k2p``. Each alignment is turned
    into bits once, before it meets the others of its group."""
    rows = alns.select("group_id", "species", base_planes(F.col("aln")).alias("planes"))
    side = lambda k: rows.select("group_id", F.col("species").alias(f"s{k}"), F.col("planes").alias(f"p{k}"))
    pairs = side(1).join(side(2), "group_id").where("s1 < s2")
    return pairs.select("group_id", "s1", "s2", k2p_of_planes(F.col("p1"), F.col("p2")).alias("distance"))
