"""Draws, redraws and quantiles against plain versions."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seqframe.functions import sampling as D

P = 2**31 - 1


def plain_numbers(size, n, name):
    """The first ``n`` images of a permutation of 0 .. size - 1 that the strings name(round) key."""
    a = math.ceil(math.sqrt(size))
    b = -(-size // a)
    keys = []
    for r in range(6):
        m = hashlib.md5(name(r).encode()).hexdigest()
        keys.append((1 + int(m[:8], 16) % (P - 1), int(m[8:16], 16) % P))

    def once(x):
        u, v, mu, mv = x % a, x // a, a, b
        for ka, kb in keys:
            u, v, mu, mv = v, (u + (ka * v + kb) % P) % mu, mv, mu
        return v * a + u

    out = []
    for x in range(n):
        x = once(x)
        while x >= size:
            x = once(x)
        out.append(x)
    return out


@pytest.mark.parametrize("size,n", [(1, 1), (2, 2), (3, 2), (150, 150), (151, 150), (2100, 150), (10**12 + 7, 40)])
def test_draws_are_images_of_a_permutation(spark, size, n):
    draws = spark.createDataFrame([("S1", d, t, size) for d in range(1, 9) for t in (0, 3)], "species string, draw int, attempt int, _size long")
    got = {}
    for r in D.drawn_numbers(draws, ["species"], n, 7).collect():
        got.setdefault((r.draw, r.attempt), []).append(r.no)
    for d, t in ((d, t) for d in range(1, 9) for t in (0, 3)):
        assert got[d, t] == plain_numbers(size, n, lambda r, d=d, t=t: f"7:{t}:{d}:S1:{r}")
        assert len(set(got[d, t])) == n


def test_every_draw_has_all_its_members(spark):
    """10,000 draws each of groups of 150 to 20,000 rows; S1 of 4,200 rows and draws 1644 and 5891 have been short once."""
    sizes = spark.createDataFrame([("S0", 150), ("S1", 4200), ("S2", 2100), ("S4", 16400), ("S5", 20000)], "species string, _size long")
    drawn = D.drawn_numbers(D._draws(sizes, ["species"], 10_000), ["species"], 150, 7)
    each = drawn.groupBy("species", "draw").agg(F.size(F.array_distinct(F.collect_list("no"))).alias("n"), F.max("no").alias("most"), F.min("no").alias("least"))
    got = each.groupBy("species").agg(F.count("*"), F.min("n"), F.max("n"), F.max("most"), F.min("least")).collect()
    assert {tuple(r) for r in got} == {(s, 10_000, 150, 150, n - 1, 0) for s, n in (("S0", 150), ("S1", 4200), ("S2", 2100), ("S4", 16400), ("S5", 20000))}


def test_draws_are_even_and_independent(spark):
    """Members, and pairs of members, of 3,000 draws of 20 of 100 are as frequent as chance has them."""
    sizes = spark.createDataFrame([("x", 100)], "species string, _size long")
    lists = D.drawn_numbers(D._draws(sizes, ["species"], 3000), ["species"], 20, 3).groupBy("draw").agg(F.collect_list("no").alias("l")).collect()
    single = Counter(x for r in lists for x in r.l)
    expected = 3000 * 20 / 100
    assert sum((single[k] - expected) ** 2 / expected for k in range(100)) < 160  # 99 degrees of freedom, less by a fifth
    pairs = Counter((x, y) for r in lists for x in r.l for y in r.l if x < y)
    each = 3000 * 190 / 4950
    assert sum((pairs[x, y] - each) ** 2 / each for x in range(100) for y in range(x + 1, 100)) / 4950 < 1.1


def test_sample_is_reproducible_and_skips_small_groups(spark):
    df = spark.createDataFrame([(k, "A" if k < 40 else "B") for k in range(45)], "cluster int, species string")
    rows = lambda x: sorted(map(tuple, x.select("species", "draw", "cluster").collect()))
    one = rows(D.sample_n(df, ["species"], "cluster", 10, 3, 7))
    assert one == rows(D.sample_n(df.repartition(7), ["species"], "cluster", 10, 3, 7))
    assert len(set(one)) == 30 and {r[0] for r in one} == {"A"}
    assert D.sample_n(df.limit(0), ["species"], "cluster", 10, 3, 7).count() == 0


def plain_kaks(rows, n, draws, seed):
    """First attempts with a ratio; species without such samples are not asked for."""
    out = {}
    for species in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == species), key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest()[:3], r[0]))
        for d in range(1, draws + 1 if len(own) >= n else 1):
            for t in range(10_000):
                drawn = [own[k] for k in plain_numbers(len(own), n, lambda r, d=d, t=t, s=species: f"{seed}:{t}:{d}:{s}:{r}")]
                a, b, c, e = (sum(f(r) for r in drawn) for f in (lambda r: r[2] * r[3], lambda r: r[2], lambda r: r[4] * r[5], lambda r: r[4]))
                if b and c and e:
                    out[species, d] = (a / b) / (c / e)
                    break
    return out


@pytest.mark.parametrize("n,broadcast", [(1, 0), (3, 500_000)])
def test_draws_with_a_zero_sum_are_drawn_again_until_they_have_a_ratio(spark, monkeypatch, n, broadcast):
    monkeypatch.setattr(D, "BROADCAST_ROWS", broadcast)
    rng = random.Random(1)
    rows = []
    for species, share in (("all", 1.0), ("some", 0.3), ("rare", 0.04)):
        rows += [(len(rows) + k, species, 100.0 + k, 0.25, 30.0, 0.5 if rng.random() < share or k == 7 else 0.0) for k in range(60)]
    plain = plain_kaks(rows, n, 40, 5)
    rows += [(1000 + k, "none", 50.0, 0.1, 20.0, 0.0) for k in range(30)] + [(2000 + k, "few", 50.0, 0.1, 20.0, 0.1) for k in range(n - 1)]
    rows += [(3000 + k, "nulls", None, None, 20.0, 0.1) for k in range(30)]
    df = spark.createDataFrame(rows, "cluster int, species string, n double, dn double, s double, ds double")
    got = {(r.species, r.draw): r.w for r in D.resample_kaks(df, n, 40, 5).collect()}
    assert set(got) == set(plain) and len(got) == 120
    assert all(got[k] == pytest.approx(plain[k], rel=1e-12) for k in got)


def test_sums_do_not_depend_on_partitions(spark):
    rng = random.Random(2)
    rows = [(k, "x", rng.randrange(10**6) / 100, rng.randrange(10**5) / 10**5, rng.randrange(1, 10**6) / 100, rng.randrange(10**5) / 10**5) for k in range(400)]
    df = spark.createDataFrame(rows, "cluster int, species string, n double, dn double, s double, ds double")
    values = [{(r.draw, r.w) for r in D.resample_kaks(df.repartition(p), 150, 50, 5).collect()} for p in (1, 5)]
    assert values[0] == values[1] and len(values[0]) == 50


@pytest.mark.parametrize("bins,levels", [(3, 2), (4096, 2)])
def test_quantiles_equal_percentile(spark, bins, levels):
    rng = random.Random(4)
    groups = {
        "one": [3.5], "two": [1.0, 2.0], "ties": [1.0] * 50 + [2.0] * 51, "range": [10.0 ** rng.uniform(-300, 300) * rng.choice((-1, 1)) for _ in range(500)],
        "even": [rng.random() for _ in range(1000)], "close": [1.0 + k * 2**-52 for k in range(100)], "tiny": [5e-324 * k for k in range(9)],
        "odd": [float("inf"), float("-inf"), 0.0, 1.0, 2.0, 3.0, 4.0], "nan": [1.0, 2.0, 3.0, float("nan"), float("nan")], "wide": [-1.7e308, 1.7e308, 0.0],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("one", None), ("none", None)]
    df = spark.createDataFrame(rows, "key string, value double").repartition(3)
    of = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {r.key: (r.n, r.q) for r in D.quantiles(df, "key", "value", of, bins, levels).collect()}
    want = {r.key: (r.n, r.q) for r in df.where("value is not null").groupBy("key").agg(F.count("*").alias("n"), F.percentile("value", of).alias("q")).collect()}
    assert repr(sorted(got.items())) == repr(sorted(want.items()))
    box = {r.key: r for r in D.box_stats(df, "key", "value").collect()}
    assert set(box) == set(want) and (box["ties"].low, box["ties"].median, box["ties"].high) == (1.0, 2.0, 2.0)


def test_what_gives_the_values_is_computed_once(spark):
    """Rows of quantiles and of draws are read many times; what they come from runs for each row once."""
    runs = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def costly(x):
        runs.add(1)
        return x

    df = spark.range(40).select((F.col("id") % 2).alias("k"), costly(F.col("id").cast("double")).alias("v"))
    got = {r.k: r.q for r in D.quantiles(df, "k", "v", [0.0, 0.5, 1.0]).collect()}
    assert got == {0: [0.0, 19.0, 38.0], 1: [1.0, 20.0, 39.0]}
    # the filter on null may compute a value once more
    assert runs.value <= 80


def test_few_draws_go_to_many_rows(spark, monkeypatch):
    rows = spark.createDataFrame([(f"c{k}", "S", 300.0, 10.0, 5.0, 0.1 + k / 1000, 0.5 if k % 5 == 0 else 0.0) for k in range(60)], "cluster string, species string, len double, n double, s double, dn double, ds double")
    found = lambda: sorted((r.species, r.draw, round(r.w, 9)) for r in D.resample_kaks(rows, 4, 20, 3).collect())
    want = found()
    assert len(want) == 20
    monkeypatch.setattr(D, "BROADCAST_ROWS", 59)
    assert found() == want
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    assert found() == want
