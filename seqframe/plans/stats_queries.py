"""Queries on model fits, rates, resampling and demographic curves."""

from pyspark.sql import functions as F

from ..functions import sampling as D
from ..functions import stats as N
from .registry import query

PAIRS = "(SELECT a.cluster, a.model, 2 * abs(a.lnl - b.lnl) AS stat, a.np - b.np AS ddf FROM {fits_v} a JOIN {fits_v} b ON a.cluster = b.cluster AND b.model = 1 AND a.model <> 1)"
KEPT = "(SELECT * FROM {kaks_v} WHERE cluster NOT IN (SELECT cluster FROM {kaks_v} WHERE len < 150 OR ds > 2))"


def _passed(rows: str) -> str:
    """Numbers x of ``rows`` sent once through six rounds: a pair of remainder and quotient whose parts change roles in each, so that
    always the first is moved by the second."""
    sql = f"SELECT *, x % a AS u, x // a AS v, a AS mu, b AS mv FROM {rows}"
    for r in range(6):
        sql = f"SELECT * EXCLUDE (u, v, mu, mv), v AS u, (u + (k{r}[1] * v + k{r}[2]) % 2147483647) % mu AS v, mv AS mu, mu AS mv FROM ({sql})"
    return f"SELECT * EXCLUDE (x, u, v, mu, mv), v * a + u AS x FROM ({sql})"


def _drawn(draws: str, kept: str = KEPT) -> str:
    """Samples of 150 clusters of each species of ``kept``, seed 7: for each (draw, attempt) of ``draws``. Numbers that come out too
    large are sent through again, without a bound."""
    number = lambda r, at: f"CAST('0x' || substring(md5('7:' || attempt || ':' || draw || ':' || species || ':{r}'), {at}, 8) AS BIGINT)"
    keys = ", ".join(f"[1 + {number(r, 1)} % 2147483646, {number(r, 9)} % 2147483647] AS k{r}" for r in range(6))
    return f"""(WITH RECURSIVE kept AS (SELECT * FROM {kept}), numbered AS (SELECT *, row_number() OVER (PARTITION BY species ORDER BY substring(md5(CAST(cluster AS STRING)), 1, 3), cluster) - 1 AS no FROM kept),
sizes AS (SELECT species, count(*) AS size, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a FROM kept GROUP BY species HAVING count(*) >= 150),
named AS (SELECT *, CAST(ceil(size / a) AS BIGINT) AS b, {keys} FROM sizes CROSS JOIN {draws}),
begun AS MATERIALIZED ({_passed("(SELECT *, unnest(range(0, 150)) AS x FROM named)")}),
walk AS (SELECT * FROM begun WHERE x >= size UNION ALL {_passed("(SELECT * FROM walk WHERE x >= size)")}),
found AS (SELECT species, draw, attempt, size, x FROM begun WHERE x < size UNION ALL SELECT species, draw, attempt, size, x FROM walk WHERE x < size)
SELECT q.*, f.draw, f.attempt FROM found f JOIN numbered q ON f.species = q.species AND f.x = q.no)"""


def _times(draws: int, attempts: int = 1) -> str:
    return f"(SELECT * FROM (SELECT unnest(range(1, {draws + 1})) AS draw) CROSS JOIN (SELECT unnest(range(0, {attempts})) AS attempt))"


SUMS = "sum(CAST(n AS DECIMAL(18, 6)) * CAST(dn AS DECIMAL(18, 6))) AS ndn, sum(CAST(n AS DECIMAL(18, 6))) AS n, sum(CAST(s AS DECIMAL(18, 6)) * CAST(ds AS DECIMAL(18, 6))) AS sds, sum(CAST(s AS DECIMAL(18, 6))) AS s"
RATIO = "CASE WHEN n > 0 AND s > 0 AND sds > 0 THEN (CAST(ndn AS DOUBLE) / CAST(n AS DOUBLE)) / (CAST(sds AS DOUBLE) / CAST(s AS DOUBLE)) END"
DRAWS = f"(SELECT species, draw, {RATIO} AS w FROM (SELECT species, draw, {SUMS} FROM {_drawn(_times(10_000))} GROUP BY species, draw))"


@query(f"SELECT cluster, model, round(stat, 6) AS stat, ddf FROM {PAIRS}")
def j4_pair_models(get):
    return N.pair_models(get("fits_v")).withColumn("stat", F.round("stat", 6))


@query(f"SELECT cluster, model, round(exp(-stat / 2), 9) AS p2, round(exp(-stat / 2) * (1 + stat / 2), 9) AS p4 FROM {PAIRS}")
def n2_chi2_sf(get):
    return N.pair_models(get("fits_v")).select("cluster", "model", F.round(N.chi2_sf(F.col("stat"), 2), 9).alias("p2"), F.round(N.chi2_sf(F.col("stat"), 4), 9).alias("p4"))


ERF = "list_sum(list_transform(range(0, 400), lambda k: exp(k * ln(h + 1e-300) + 0.5 * ln(h + 1e-300) - h - lgamma(k + 1.5))))"


@query(f"""
WITH t AS (SELECT cluster, model, stat / 2 AS h FROM {PAIRS}), e AS (SELECT *, greatest(0, 1 - {ERF}) AS p FROM t)
SELECT cluster, model, round(p, 8) AS p1, round(p + 2 * sqrt(h / pi()) * exp(-h), 8) AS p3, round(p + 2 * sqrt(h / pi()) * exp(-h) * (1 + 2 * h / 3), 8) AS p5 FROM e
""")
def n2_chi2_sf_odd(get):
    """The oracle sums the power series of erf, 400 terms of positive sign."""
    pairs = N.pair_models(get("fits_v"))
    return pairs.select("cluster", "model", *[F.round(N.chi2_sf(F.col("stat"), df), 8).alias(f"p{df}") for df in (1, 3, 5)])


SITES = "(SELECT cluster, species, max(CASE WHEN kind = 'fix' THEN lnl END) AS a, max(CASE WHEN kind = 'nofix' THEN lnl END) AS b, max(CASE WHEN kind = 'fix' THEN w END) AS w_fix, max(CASE WHEN kind = 'nofix' THEN w END) AS w_nofix FROM {sitefits_v} GROUP BY ALL)"


@query(f"SELECT cluster, species, round(a, 6) AS lnl_fix, round(b, 6) AS lnl_nofix, w_fix, w_nofix, round(2 * abs(b - a), 6) AS stat, CAST(1 AS BIGINT) AS ddf, round(greatest(0, 1 - {ERF}), 8) AS p FROM (SELECT *, abs(b - a) AS h FROM {SITES} WHERE a IS NOT NULL AND b IS NOT NULL)")
def j4_pair_branchsite(get):
    out = N.pair_branchsite(get("sitefits_v").withColumn("sites", F.lit(None).cast("array<int>")))
    return out.select("cluster", "species", *[F.round(c, 6).alias(c) for c in ("lnl_fix", "lnl_nofix")], "w_fix", "w_nofix", F.round("stat", 6).alias("stat"), "ddf", F.round("p", 8).alias("p"))


@query(f"""
WITH t AS (SELECT cluster, model, exp(-stat / 2) AS p FROM {PAIRS}),
r AS (SELECT *, p * count(*) OVER (PARTITION BY model) / count(*) OVER (PARTITION BY model ORDER BY p) AS v FROM t)
SELECT cluster, model, round(p, 9) AS p, round(least(1, min(v) OVER (PARTITION BY model ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS q FROM r
""")
def w5_bh_fdr(get):
    tests = N.pair_models(get("fits_v")).select("cluster", "model", N.chi2_sf(F.col("stat"), 2).alias("p"))
    return N.bh_fdr(tests, ["model"]).select("cluster", "model", F.round("p", 9).alias("p"), F.round("q", 9).alias("q"))


@query("SELECT DISTINCT cluster FROM {kaks_v} WHERE len < 150 OR ds > 2")
def p15_failed_clusters(get):
    return N.failed_clusters(get("kaks_v"))


@query(f"SELECT cluster, species FROM {KEPT}")
def j5_exclude(get):
    rows = get("kaks_v")
    return N.exclude(rows, N.failed_clusters(rows), "cluster").select("cluster", "species")


@query("SELECT cluster, species, round(n * dn, 6) AS ndn, round(s * ds, 6) AS sds FROM {kaks_v}")
def n3_add_counts(get):
    return N.add_counts(get("kaks_v")).select("cluster", "species", F.round("ndn", 6).alias("ndn"), F.round("sds", 6).alias("sds"))


@query(f"SELECT species, round({RATIO}, 6) AS w FROM (SELECT species, {SUMS} FROM {{kaks_v}} GROUP BY species)")
def n4_kaks_ratio(get):
    return get("kaks_v").groupBy("species").agg(F.round(N.kaks_ratio(), 6).alias("w"))


def _kept(get):
    rows = get("kaks_v")
    return N.exclude(rows, N.failed_clusters(rows), "cluster")


@query(f"SELECT species, draw, cluster FROM {_drawn(_times(20))}")
def w6_sample_n(get):
    return D.sample_n(_kept(get), ["species"], "cluster", 150, 20, 7).select("species", "draw", "cluster")


@query(f"SELECT species, draw, round(w, 6) AS w FROM {DRAWS} WHERE w IS NOT NULL")
def a15_resample_kaks(get):
    return D.resample_kaks(_kept(get), 150, 10_000, 7).withColumn("w", F.round("w", 6))


SPARSE = f"(SELECT * REPLACE (CASE WHEN cluster % 97 = 0 THEN ds ELSE 0 END AS ds, CASE WHEN species = 'S3' THEN 0 ELSE s END AS s) FROM {KEPT})"


@query(f"""
WITH t AS (SELECT species, draw, attempt, {RATIO} AS w FROM (SELECT species, draw, attempt, {SUMS} FROM {_drawn(_times(100, 30), SPARSE)} GROUP BY species, draw, attempt))
SELECT species, draw, round(arg_min(w, attempt) FILTER (w IS NOT NULL), 6) AS w FROM t GROUP BY species, draw HAVING count(w) > 0
""")
def a15_resample_redraws(get):
    """Rates of which one in 97 is not zero, and a species without any: many draws are drawn again. The oracle tries each 30 times."""
    sparse = _kept(get).withColumn("ds", F.when(F.col("cluster") % 97 == 0, F.col("ds")).otherwise(0.0)).withColumn("s", F.when(F.col("species") == "S3", 0.0).otherwise(F.col("s")))
    return D.resample_kaks(sparse, 150, 100, 7).withColumn("w", F.round("w", 6))


@query(f"SELECT species, count(w) AS n, round(min(w), 6) AS low, round(quantile_cont(w, 0.25), 6) AS q1, round(quantile_cont(w, 0.5), 6) AS median, round(quantile_cont(w, 0.75), 6) AS q3, round(max(w), 6) AS high FROM {DRAWS} WHERE w IS NOT NULL GROUP BY species")
def a16_box_stats(get):
    return D.box_stats(D.resample_kaks(_kept(get), 150, 10_000, 7), "species", "w")


CURVES = "SELECT 'p' || CAST(l_suppkey AS STRING) AS sample, l_orderkey % 21 AS round, CAST(l_linenumber AS BIGINT) AS k, max(l_quantity) / 10 AS t, max(l_extendedprice) / 10000 AS lam, max(l_tax) + 0.01 AS theta, max(l_discount) AS fit FROM {lineitem} GROUP BY 1, 2, 3"


def _curves(get):
    x = get("lineitem")
    rows = x.groupBy(F.concat(F.lit("p"), F.col("l_suppkey").cast("string")).alias("sample"), (F.col("l_orderkey") % 21).alias("round"), F.col("l_linenumber").cast("long").alias("k"))
    return rows.agg((F.max("l_quantity") / 10).alias("t"), (F.max("l_extendedprice") / 10000).alias("lam"), (F.max("l_tax") + 0.01).alias("theta"), F.max("l_discount").alias("fit"))


@query(f"SELECT sample, round, k, round(2 * (theta / 100 / (4 * 2.5e-8)) * t * 25, 3) AS years, round(lam * (theta / 100 / (4 * 2.5e-8)) / 1e4, 3) AS ne FROM ({CURVES})")
def n5_scale_psmc(get):
    return N.scale_psmc(_curves(get), 2.5e-8, 25).select("sample", "round", "k", F.round("years", 3).alias("years"), F.round("ne", 3).alias("ne"))


@query(f"SELECT sample, round, k, round(theta / 100 * t, 9) AS years, round(lam * theta / 100 * 1000, 9) AS ne FROM ({CURVES})")
def n5_scale_psmc_unscaled(get):
    return N.scale_psmc(_curves(get), 2.5e-8, 25, scaled=False).select("sample", "round", "k", F.round("years", 9).alias("years"), F.round("ne", 9).alias("ne"))


@query(f"""
WITH m AS (SELECT 'p' || CAST(s_suppkey AS STRING) AS sample, 0.1 AS fn, 0.2 AS dt, 0.05 AS tau, 1.5 AS nu, s_suppkey % 3 + 1.0 AS alpha, 10.0 AS shift FROM supplier WHERE s_suppkey % 2 = 0),
c AS (SELECT c.*, 2 * (theta / 100 / (4 * 2.5e-8)) / (1 - coalesce(fn, 0)) / coalesce(2 * (2 + alpha) / 3 / (1 + alpha), 1) AS n, coalesce(dt, 0) AS dt, coalesce(tau, 0) AS tau, coalesce(nu, 1) AS nu, coalesce(shift, 0) AS shift FROM ({CURVES}) c LEFT JOIN m USING (sample))
SELECT sample, round, k, round(n * (t + dt) * (1 - tau) * 25 + shift, 3) AS years, round(lam * n / 2 * nu / 1e4, 3) AS ne FROM c
""")
def n5_scale_psmc_mods(get):
    mods = get("supplier").where("s_suppkey % 2 = 0").selectExpr("'p' || CAST(s_suppkey AS STRING) AS sample", "0.1D AS fn", "0.2D AS dt", "0.05D AS tau", "1.5D AS nu", "s_suppkey % 3 + 1.0D AS alpha", "10.0D AS shift")
    return N.scale_psmc(_curves(get), 2.5e-8, 25, mods=mods).select("sample", "round", "k", F.round("years", 3).alias("years"), F.round("ne", 3).alias("ne"))


@query(f"SELECT sample, CAST(min([fit * 1000 + round, round])[2] AS BIGINT) AS round FROM ({CURVES}) WHERE round >= 10 GROUP BY sample")
def w7_select_round(get):
    return N.select_round(_curves(get).withColumn("fit", F.col("fit") * 1000 + F.col("round")), 0, 10)


@query(f"SELECT DISTINCT sample, round FROM ({CURVES}) WHERE round = 20")
def w7_select_round_fixed(get):
    return N.select_round(_curves(get), 20)


@query(f"SELECT sample, count(*) AS n, round(sum(theta), 6) AS sum_ratio, round(sum(theta * theta), 6) AS sum_ratio2, round(sum(fit), 6) AS sum_fit, round(sum(fit * fit), 6) AS sum_fit2, max(k) AS max_segments, round(max(lam), 6) AS max_ne FROM ({CURVES}) GROUP BY sample")
def n7_psmc_summary(get):
    rows = _curves(get).select("sample", F.col("theta").alias("ratio"), "fit", F.col("k").alias("segments"), F.col("lam").alias("ne"))
    out = N.psmc_summary(rows)
    return out.select("sample", "n", *[F.round(c, 6).alias(c) for c in ("sum_ratio", "sum_ratio2", "sum_fit", "sum_fit2")], "max_segments", F.round("max_ne", 6).alias("max_ne"))


@query(f"SELECT CAST(count(*) AS BIGINT) AS n, round(sum(theta), 4) AS sum_ratio, round(sum(theta * theta), 4) AS sum_ratio2, round(sum(fit), 4) AS sum_fit, round(sum(fit * fit), 4) AS sum_fit2, max(k) AS max_segments, round(max(lam), 6) AS max_ne FROM ({CURVES})")
def n7_psmc_overall(get):
    rows = _curves(get).select("sample", F.col("theta").alias("ratio"), "fit", F.col("k").alias("segments"), F.col("lam").alias("ne"))
    out = N.psmc_overall(N.psmc_summary(rows))
    return out.select("n", *[F.round(c, 4).alias(c) for c in ("sum_ratio", "sum_ratio2", "sum_fit", "sum_fit2")], "max_segments", F.round("max_ne", 6).alias("max_ne"))


@query("SELECT p_partkey, CAST(p_size AS BIGINT) * 2 + 3 - 1 AS last_bin FROM part")
def n6_last_free_bin(get):
    pattern = F.concat(F.col("p_size").cast("string"), F.lit("*2+3+"), (F.col("p_partkey") % 5 + 1).cast("string"))
    return get("part").select("p_partkey", N.last_free_bin(pattern).alias("last_bin"))


@query("SELECT 's' || CAST(s_suppkey AS STRING) AS sample, s_acctbal AS depth, CAST(trunc(s_acctbal / 3) AS BIGINT) - 1 AS low, CAST(trunc(s_acctbal * 2) AS BIGINT) + 1 AS high FROM supplier WHERE s_acctbal >= 20")
def p13_depth_bounds(get):
    from ..functions.seq import depth_bounds

    return depth_bounds(get("supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("sample"), F.col("s_acctbal").alias("depth")))


@query(f"SELECT cluster, model, round(stat, 6) AS stat FROM {PAIRS} WHERE ddf = 1")
def n1_lrt(get):
    fits = get("fits_v")
    null = fits.where("model = 1").select("cluster", F.col("lnl").alias("lnl0"))
    return fits.where("model = 2").join(null, "cluster").select("cluster", "model", F.round(N.lrt(F.col("lnl0"), F.col("lnl")), 6).alias("stat"))
