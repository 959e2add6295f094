"""Phrase mining against a plain count of all n-grams."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from seqframe.llm import phrases

SCHEMA = "doc_id long, text string, lang string, shard string, words string"


def texts():
    rng = random.Random(3)
    vocabulary = ["the", "of", "New", "York", "stock", "exchange", "é", "ÉÀ", "İx", "𝔘", "a-b", "x\x1cy", *(f"w{k}" for k in range(25))]
    rows = []
    for k in range(90):
        n = rng.choice((0, 1, 2, 7, 60, 200))
        words = rng.choices(vocabulary, [30, 20, *[6] * 10, *[2] * 25], k=n)
        text = "".join(w + rng.choice((" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ; ")) for w in words)
        rows.append((k % 80, text + " New York Stock Exchange " * rng.randrange(3), rng.choice(("en", "en", "de", None))))
    rows += [(None, None, "fr"), (200, "", None), (201, " \t.,;:!?\n\x0b\x0c\r", "es"), (202, "same " * 3000, "xx"), (203, "one two three four five " * 600, "yy")]
    rows += [(300, "hot phrase of copies", "en")] * 40
    return [(i, t, lang, "s", "w") for i, t, lang in rows]


def counted(rows, longest):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            f.update((lang or "und", *words[i : i + d]) for d in range(1, longest + 1) for i in range(len(words) - d + 1))
    return f, n


def plain(rows, longest, least=10, top=2000):
    f, n = counted(rows, longest)
    found = {k: v for k, v in f.items() if len(k) > 2 and v >= least}
    within = {}
    for (lang, *w), v in found.items():
        for d in range(2, len(w)):
            for i in range(len(w) - d + 1):
                part = (lang, *w[i : i + d])
                within[part] = max(within.get(part, 0), v)
    out = {}
    for (lang, *w), a in found.items():
        cuts = [(1000000 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w))]
        score, _, l, r = min(cuts)
        if 100 * within.get((lang, *w), 0) < 50 * a:
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return {(lang, k + 1, p.decode(), -a, l, r, n[lang], -score) for lang, rows in out.items() for k, (score, a, p, l, r) in enumerate(sorted(rows)[:top])}


@pytest.mark.parametrize("size", [40, 700, 1 << 21])
def test_report_equals_plain_counts(spark, monkeypatch, size):
    monkeypatch.setattr(phrases, "SHARD", size)
    rows = texts()
    got = phrases.report(spark.createDataFrame(rows, SCHEMA).repartition(3), top=30)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows, 3, top=30)


def test_longer_phrases_and_extensions(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD", 300)
    rows = texts()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    f, n = counted(rows, 5)
    found, total = phrases.ngrams(docs, longest=5)
    assert {(r.lang, r.n) for r in total.collect()} == {x for x in n.items() if x[1]}
    frequent = {k: v for k, v in f.items() if v >= 10}
    got = {(r.lang, *r.text.split(" ")): r for r in found.collect()}
    assert set(got) == set(frequent)
    for (lang, *w), r in got.items():
        assert (r.words, r.f) == (len(w), f[lang, *w])
        assert r.heads == [f[lang, *w[:k]] for k in range(1, len(w) + 1)] and r.tails == [f[lang, *w[-k:]] for k in range(1, len(w) + 1)]
        if len(w) < 5:
            assert r.left == max((v for k, v in frequent.items() if k[0] == lang and len(k) == len(w) + 2 and k[2:] == tuple(w)), default=None)
            assert r.right == max((v for k, v in frequent.items() if k[0] == lang and len(k) == len(w) + 2 and k[1:-1] == tuple(w)), default=None)
    rows_, _ = phrases.collocations(docs, longest=4)
    assert {(r.lang, r.phrase, r.a, r.l, r.r, r.score) for r in rows_.collect()} == {(x[0], *x[2:6], x[7]) for x in plain(rows, 4, top=10**9)}


def test_intervals_of_both_transforms():
    """Sizes and starts of extensions, to either side, are those of a plain search in the sorted contexts."""
    shard = phrases.Shard()
    shard.add(b"a b a b c. b a b a c a b, c c c a b a")
    x = shard.index(3)
    back = np.frombuffer(phrases.zstandard.decompress(x["backwards"]), np.int32)
    start, size = np.array(x["starts"]), np.array(x["sizes"])
    gram, end, at, wide, n = phrases._extended(back, start, start, size, np.arange(len(size)))
    names = [w.decode() for w in x["words"]]
    pairs = {(names[g], names[e]): int(k) for g, e, k in zip(gram, end, n)}
    assert pairs == {("a", "b"): 5, ("b", "a"): 4, ("b", "c"): 1, ("a", "c"): 1, ("c", "a"): 2, ("c", "c"): 2}
    assert all(start[g] <= w < start[g] + size[g] for g, w in zip(gram, wide)) and all(start[e] <= a < start[e] + size[e] for e, a in zip(end, at))


def test_scores_beyond_64_bits(spark):
    rows = spark.createDataFrame([(10**14, 10**14 + 1, 10**14 + 3)], "a long, l long, r long")
    assert rows.select(phrases._quotient(rows.a, rows.l, rows.r)).first()[0] == 10**34 // ((10**14 + 1) * (10**14 + 3))


def test_empty_tables(spark):
    assert phrases.report(spark.createDataFrame([], SCHEMA)).collect() == []
    assert phrases.report(spark.createDataFrame([(1, None, None, "", "")], SCHEMA)).collect() == []


def test_rows_of_frequent_phrases_are_not_joined_with_them(spark, monkeypatch):
    """A row for each shard and phrase meets its phrase once, for the sum, and takes its id there."""
    plans, cut = [], phrases.cut

    def seen(df, name, *by):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, name, *by)

    monkeypatch.setattr(phrases, "cut", seen)
    rows = spark.createDataFrame([(k, k, k, k % 3 + 1, k % 7, k % 2) for k in range(210)], "shard long, forth int, back int, size int, first long, last long").repartition(5)
    found, spans = phrases._frequent(rows, ["first", "last"], 30)
    want = Counter()
    for k in range(210):
        want[k % 7, k % 2] += k % 3 + 1
    ids = {r.phrase: (r["first"], r["last"]) for r in found.collect()}
    assert len(ids) == found.count() and {ids[r.phrase]: r.f for r in found.collect()} == {k: n for k, n in want.items() if n >= 30}
    assert sorted((*ids[r.phrase], r.shard, r.size) for r in spans.collect()) == sorted((k % 7, k % 2, k, k % 3 + 1) for k in range(210) if want[k % 7, k % 2] >= 30)
    assert plans and not any("Join" in p for p in plans)
