"""Samples without replacement, named by a seed, and quantities of them.

A draw is the image of 0 .. n - 1 under a permutation of 0 .. N - 1, so its members are distinct and exactly ``n`` whatever N is.
The permutation is a Feistel network on pairs (x mod a, x div a), a near the root of N, that is walked until it comes back below
N. Of a b - N numbers that are not, a walk meets each once at most, which bounds it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .lineage import settled
from .stats import exact, exact_ratio

ROUNDS = 6
#: A prime above all halves of a pair: rounds add (A v + B) mod PRIME, A and B from md5.
PRIME = 2**31 - 1
#: Numbered rows, of about 120 bytes, are sent to all tasks if there are no more than this; else draws are sent to them.
BROADCAST_ROWS = 500_000


def _keys(by: list[str], seed: int) -> list[Column]:
    """A and B of each round, of columns by, draw and attempt."""
    out = []
    for r in range(ROUNDS):
        name = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("attempt").cast("string"), F.col("draw").cast("string"), *[F.col(c).cast("string") for c in by], F.lit(str(r))))
        number = lambda at, name=name: F.conv(F.substring(name, at, 8), 16, 10).cast("long")
        out += [(1 + number(1) % (PRIME - 1)).alias(f"_k{2 * r}"), (number(9) % PRIME).alias(f"_k{2 * r + 1}")]
    return out


def _feistel(x: Column) -> Column:
    """One pass of the network over 0 .. _a _b - 1; every round can be undone."""
    a, b = F.col("_a"), F.col("_b")
    left, right = x % a, F.floor(x / a)
    add = lambda v, r: (F.col(f"_k{2 * r}") * v + F.col(f"_k{2 * r + 1}")) % PRIME
    for r in range(ROUNDS):
        if r % 2:
            right = (right + add(left, r)) % b
        else:
            left = (left + add(right, r)) % a
    return right * a + left


def drawn_numbers(draws: DataFrame, by: list[str], n: int, seed: int) -> DataFrame:
    """by, draw, attempt, no: ``n`` distinct numbers below ``_size`` for each row (by, draw, attempt, _size), _size at least ``n``
    and less than 2^53."""
    size = F.col("_size")
    root = F.ceil(F.sqrt(size.cast("double"))).cast("long")
    rows = draws.withColumn("_a", root).withColumn("_b", F.ceil(size / F.col("_a")).cast("long"))
    rows = rows.select(*by, "draw", "attempt", "_size", "_a", "_b", *_keys(by, seed)).withColumn("_x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    rows = rows.withColumn("_x", _feistel(F.col("_x")))
    further = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1), F.col("_a") * F.col("_b") - size)), F.col("_x"), lambda x, _: F.when(x < size, x).otherwise(_feistel(x)))
    return rows.select(*by, "draw", "attempt", F.when(F.col("_x") < size, F.col("_x")).otherwise(further).alias("no"))


def _numbered_groups(df: DataFrame, by: list[str], key: str) -> DataFrame:
    """``df`` with no: numbers from 0 within ``by``, in the order of md5's first three digits and ``key``."""
    return numbered(df, [key], F.substring(F.md5(F.col(key).cast("string")), 1, 3), "no", by=tuple(by))


def _draws(sizes: DataFrame, by: list[str], draws: int) -> DataFrame:
    """by, _size, draw, attempt 0: the draws of every group, dealt out evenly: they are few bytes, but much work."""
    parts = 2 * sizes.sparkSession.sparkContext.defaultParallelism
    return sizes.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).repartition(parts, *by, "draw").withColumn("attempt", F.lit(0))


def _sizes(df: DataFrame, by: list[str], n: int) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("_size")).where(F.col("_size") >= n)


def sample_n(df: DataFrame, by: list[str], key: str, n: int, draws: int, seed: int) -> DataFrame:
    """``draws`` samples of exactly ``n`` rows without replacement from each group of ``by``; ``key`` names a row of a group.

    Groups of fewer rows are not drawn. A group's rows are numbered once, each draw takes ``n`` distinct numbers, and rows join these:
    nothing is sorted or dealt out for each draw but the rows it takes.
    """
    rows = _numbered_groups(df, by, key)
    drawn = drawn_numbers(_draws(_sizes(df, by, n), by, draws), by, n, seed).drop("attempt")
    return rows.join(drawn, [*by, "no"]).drop("no")


def resample_kaks(rows: DataFrame, n: int = 150, draws: int = 10_000, seed: int = 1) -> DataFrame:
    """species, draw, w of samples of ``n`` clusters, ``draws`` for each species of at least ``n``.

    A draw with a zero sum has no ratio and is drawn again until it has one: its sample is that of the first attempt with a ratio.
    Rounds try 1, 2, 4, ... attempts of the draws that are left. A species of which no sample has a ratio has no rows: one without
    a positive n or s ds, or, for samples of one, without a row of both. Sums are of decimals, so they do not depend on the order.
    """
    by = ["species"]
    # written once: it is counted, numbered and, in every round, drawn from
    counted = settled(rows.select("species", "cluster", exact("n").alias("n"), (exact("n") * exact("dn")).alias("ndn"), exact("s").alias("s"), (exact("s") * exact("ds")).alias("sds")))
    numbers = _numbered_groups(counted, by, "cluster").drop("cluster")

    def ratios(todo: DataFrame, many: int) -> DataFrame:
        """w of the draws ``todo``, ``many`` at most: few are sent to the numbered rows if these are many."""
        taken = drawn_numbers(todo, by, n, seed)
        drawn = numbers.join(F.broadcast(taken) if many * n <= BROADCAST_ROWS < state["rows"] else taken, [*by, "no"])
        sums = [F.sum(c) for c in ("ndn", "n", "sds", "s")]
        return drawn.groupBy("species", "draw", "attempt").agg(exact_ratio(*sums).alias("w"))

    first = _draws(_sizes(counted, by, n), by, draws)
    # sums of what is not negative: only a species with ``n`` zeros of a kind can have a draw of zeros
    some = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    zeros = reduce(F.greatest, [F.count_if(~some(c)) for c in ("n", "s", "sds")])
    can = (F.count_if(some("n") & some("sds")) if n == 1 else F.least(F.count_if(some("n")), F.count_if(some("sds")))) > 0
    kinds = counted.groupBy("species").agg(zeros.alias("zeros"), can.alias("can"), F.count("*").alias("rows"))
    risky = kinds.where(F.col("zeros") >= n)
    state = kinds.agg(F.coalesce(F.max(F.col("zeros") >= n), F.lit(False)).alias("risky"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count("*").alias("species")).first()
    if state["rows"] <= BROADCAST_ROWS:
        numbers = F.broadcast(numbers)
    if not state["risky"]:
        return ratios(first, state["species"] * draws).select("species", "draw", "w")
    numbers = settled(numbers) if state["rows"] > BROADCAST_ROWS else numbers
    tried = settled(ratios(first, state["species"] * draws))
    done = tried.where("w is not null").select("species", "draw", "w")
    left = first.join(risky.where("can").select("species"), "species", "left_semi").join(tried.where("w is null").select("species", "draw"), ["species", "draw"], "left_semi")
    left, begin, many = settled(left.select("species", "_size", "draw")), 1, 1
    while count := left.count():
        attempts = left.withColumn("attempt", F.explode(F.sequence(F.lit(begin), F.lit(begin + many - 1))))
        found = settled(ratios(attempts, count * many).where("w is not null").groupBy("species", "draw").agg(F.min_by("w", "attempt").alias("w")))
        done = done.unionByName(found)
        left = settled(left.join(found, ["species", "draw"], "left_anti"))
        begin, many = begin + many, 2 * many
    return done


def box_stats(df: DataFrame, by: str, value: str) -> DataFrame:
    """by, n, low, q1, median, q3, high, to six digits; quantiles lie between neighbours in order, as ``percentile`` has them."""
    low, q1, median, q3, high = (F.round(F.get("q", F.lit(k)), 6) for k in range(5))
    got = quantiles(df, by, value, [0.0, 0.25, 0.5, 0.75, 1.0])
    return got.select(by, "n", low.alias("low"), q1.alias("q1"), median.alias("median"), q3.alias("q3"), high.alias("high"))


def quantiles(df: DataFrame, by: str, value: str, of: list[float], bins: int = 1 << 12, levels: int = 2) -> DataFrame:
    """by, n, q: of the values of each ``by`` that are not null, the quantiles ``of``, interpolated between neighbours in order.

    Ranks are found by counting: values are put in ``bins`` equal bins between the least and the greatest, those of the bins that
    hold wanted ranks again, ``levels`` times; then the distinct values of the bins that are left are counted. What meets in one
    task are the counts of a key's bins, and those distinct values; no key's values do. NaN counts as greater than any number. A null
    key has no row, nor has one without values.
    """
    # written once, as every level reads the values twice, and what gives them may be much work
    rows = settled(df.where(F.col(value).isNotNull()).select(F.col(by).alias("_by"), F.col(value).cast("double").alias("_v")))
    n = rows.groupBy("_by").agg(F.count("*").alias("_n"))
    ranks = F.explode(F.array_distinct(F.flatten(F.array(*[F.array(F.floor((F.col("_n") - 1) * p), F.ceil((F.col("_n") - 1) * p)) for p in of]))))
    want = n.select("_by", ranks.alias("_rank")).withColumn("_left", F.col("_rank"))
    rows = rows.withColumn("_cell", F.lit(0).cast("long"))
    want = want.withColumn("_cell", F.lit(0).cast("long"))
    for _ in range(levels):
        ends = rows.groupBy("_by", "_cell").agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        rows = rows.join(ends, ["_by", "_cell"])
        # halves, so that the width of a bin is finite for any two finite ends
        share = F.try_divide(F.col("_v") / 2 - F.col("_low") / 2, F.col("_high") / 2 - F.col("_low") / 2)
        own = F.when(F.col("_low") == F.col("_high"), F.lit(0)).when(F.isnan("_v"), F.lit(bins)).otherwise(F.least(F.lit(bins - 1), F.floor(F.coalesce(F.nanvl(share, F.lit(0.0)), F.lit(0.0)) * bins)))
        rows = rows.select("_by", "_v", (F.col("_cell") * (bins + 1) + own).cast("long").alias("_next"), "_cell")
        counts = rows.groupBy("_by", "_cell", "_next").agg(F.count("*").alias("_m"))
        want = _stepped(want, counts, ["_by", "_cell"], "_next").withColumnRenamed("_next", "_cell")
        kept = want.select("_by", "_cell").distinct()
        rows = rows.drop("_cell").withColumnRenamed("_next", "_cell").join(kept, ["_by", "_cell"], "left_semi")
    counts = rows.groupBy("_by", "_cell", "_v").agg(F.count("*").alias("_m"))
    found = _stepped(want, counts, ["_by", "_cell"], "_v").groupBy("_by").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))

    def one(p: float) -> Column:
        at = (F.col("_n") - 1) * F.lit(p)
        low, high = F.element_at("_at", F.floor(at)), F.element_at("_at", F.ceil(at))
        return F.when(F.floor(at) == F.ceil(at), low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    return found.join(n, "_by").select(F.col("_by").alias(by), F.col("_n").alias("n"), F.array(*map(one, of)).alias("q"))


def _stepped(want: DataFrame, counts: DataFrame, key: list[str], into: str) -> DataFrame:
    """``want`` (key, _rank, _left) with the ``into`` of ``counts`` (key, into, _m) that holds the rank, and _left within it."""
    upto = F.sum("_m").over(W.partitionBy(*key).orderBy(into).rowsBetween(W.unboundedPreceding, 0))
    spans = counts.withColumn("_upto", upto)
    held = want.join(spans, key).where((F.col("_left") < F.col("_upto")) & (F.col("_left") >= F.col("_upto") - F.col("_m")))
    return held.select(key[0], "_rank", (F.col("_left") - F.col("_upto") + F.col("_m")).alias("_left"), into)
