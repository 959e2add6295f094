"""Sequences that no row holds: FASTA in splits, and k-mers, gaps and elements from its chunks."""

import random

import pytest
from pyspark.sql import functions as F

from seqframe.operators import align as A
from seqframe.operators import elements as E
from seqframe.operators import intervals as I
from seqframe.operators import locate as P
from seqframe.sources import tables as T


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def letters(rng, n, of="ACGT"):
    return "".join(rng.choice(of) for _ in range(n))


@pytest.fixture(scope="module")
def fasta(spark, tmp_path_factory):
    """Two files, of many splits of 1,500 bytes; three records cut by several of them; repeated, empty and nameless records."""
    rng = random.Random(6)
    long = letters(rng, 2500) + "N" * 700 + letters(rng, 1500) + "nnnN" * 60 + letters(rng, 3000)
    records = [("HEX1 a contig", long), ("short", "ACGTNNNNNNNNNNNNACGT"), ("empty", ""), ("two\tx", letters(rng, 900)), ("two", letters(rng, 1300)), ("oneline", letters(rng, 1900)), ("last", long[100:4000])]
    folder = tmp_path_factory.mktemp("fasta")
    text = "; text before\n" + "".join(f">{h}\n" + ("" if h == "oneline" else "\n").join(s[k : k + 50] for k in range(0, len(s), 50)) + "\n\n" for h, s in records)
    (folder / "a.fa").write_text(text)
    (folder / "b.fa").write_text(">b1\r\n" + "\r\n".join([long[:60]] * 30) + "\r\n> \nACGT\n>b2\nAC GT\n  acgt")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    df = T.read_fasta_chunks(spark, str(folder), 256)
    assert spark.read.text(str(folder)).rdd.getNumPartitions() > 10
    wanted = [("a.fa", k + 1, h.split()[0], s) for k, (h, s) in enumerate(records)] + [("b.fa", 1, "b1", long[:60] * 30), ("b.fa", 3, "b2", "ACGTacgt")]
    yield df, wanted
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_records_in_splits(fasta):
    df, wanted = fasta
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.source_file, r.record, r.chunk_no)):
        key = (r.source_file.rsplit("/", 1)[1], r.record, r.seq_id)
        assert r.chunk_start == r.chunk_no * 256 + 1 == len(got.get(key, "")) + 1 and 0 < len(r.chunk) <= 256
        got[key] = got.get(key, "") + r.chunk
    assert got == {k[:3]: k[3] for k in wanted if k[3]}


def test_chunks_are_cut_anew(fasta):
    df, wanted = fasta
    long = dict((k[2], k[3]) for k in wanted)["HEX1"]
    for size, overlap in ((256, 0), (100, 350), (1000, 37), (10**6, 5)):
        got = rows(I.chunks(df.where("seq_id = 'HEX1'"), size, overlap))
        assert got == [("HEX1", c, c * size + 1, long[c * size : (c + 1) * size + overlap]) for c in range(-(-len(long) // size))]


def test_gaps_kmers_and_elements_equal_those_of_whole_sequences(spark, fasta):
    df, wanted = fasta
    names = ["HEX1", "short", "oneline", "last"]
    pieces = df.where(F.col("seq_id").isin(names))
    whole = spark.createDataFrame([(k[2], k[3]) for k in wanted if k[2] in names], "seq_id string, seq string")
    for compat in (False, True):
        assert rows(I.find_gaps(pieces, 10, compat=compat, size=300)) == rows(I.find_gaps(whole, 10, compat=compat)) != []
    assert rows(A.kmer_counts(pieces, pieces, 11)) == rows(A.kmer_counts(whole, whole, 11))
    long = dict((k[2], k[3]) for k in wanted)["HEX1"]
    elements = spark.createDataFrame([("e1", "HEX1", long[230:2900], 10, 12), ("e2", "HEX1", long[4000:4700], 10, 12), ("e3", "last", long[200:350], 10, 12), ("e4", "short", "CGTNN", 1, 1), ("e5", "HEX1", long[:40] + "A" + long[40:99], 1, 1)], "element string, seqname string, seq string, ltr5 int, ltr3 int")
    got = rows(E.locate_elements(elements, pieces, size=512, longest=4096))
    assert got == rows(E.locate_elements(elements, whole, size=512, longest=4096))
    assert [r[2] for r in got] == [231, 4001, 101, 2, 0]
    features = spark.createDataFrame([("x", "HEX1", "LTR_retrotransposon", 200, 3300, "-"), ("x", "HEX1", "five_prime_LTR", 200, 300, "-"), ("x", "HEX1", "three_prime_LTR", 3100, 3300, "-")], "element string, seqname string, feature string, start long, stop long, strand string")
    assert rows(E.join_feature_seqs(features, pieces, 256)) == rows(E.join_feature_seqs(features, whole))


def test_seeds_of_a_part_are_seeds_of_the_whole():
    rng = random.Random(9)
    for least in (1, 2, 4, 8, 16, 32, 64, 128, 256):
        text = letters(rng, 700, "AAAACGTNé") + "A" * 300
        whole = set(zip(*(x.tolist() for x in P.seeds_of(text, least))))
        for _ in range(15):
            a = rng.randrange(900 - least)
            part = text[a : a + least + rng.randrange(60)]
            found = list(zip(*(x.tolist() for x in P.seeds_of(part, least))))
            assert found and {(c, p + a) for c, p in found} <= whole
        assert not len(P.seeds_of(text[: least - 1], least)[0])


def test_many_elements_of_one_sequence(spark):
    """2,000 elements of all lengths in one sequence, by its first place; some are nowhere, some are everywhere."""
    rng = random.Random(10)
    unit = letters(rng, 171)
    seq = letters(rng, 60_000) + unit * 40 + "A" * 500 + letters(rng, 20_000, "AC") + "é" * 3 + letters(rng, 500)
    cases = []
    for k in range(2000):
        n = rng.choice((1, 2, 3, 5, 9, 17, 40, 100, 300, 1500))
        a = rng.randrange(len(seq) - n)
        text = seq[a : a + n]
        if k % 7 == 0:
            text = text[: n // 2] + "x" + text[n // 2 :]
        cases.append((f"e{k}", "c", text))
    cases += [("copy", "c", cases[1][2]), ("copy", "c", cases[1][2]), ("unit", "c", unit), ("run", "c", "A" * 60), ("empty", "c", ""), ("null", "c", None), ("other", "d", seq[:50]), ("absent", "z", "ACGT")]
    elements = spark.createDataFrame([(*c, 1, 1) for c in cases], "element string, seqname string, seq string, ltr5 int, ltr3 int").repartition(3)
    seqs = spark.createDataFrame([("c", seq), ("d", "ACGT")], "seq_id string, seq string")
    of = {"c": seq, "d": "ACGT"}
    got = sorted((r.element, r.start) for r in E.locate_elements(elements, seqs, size=4096, longest=2048).collect())
    assert got == sorted((e, 0 if t is None else of[s].find(t) + 1) for e, s, t in cases if s in of)


def test_too_long_an_element_fails(spark):
    elements = spark.createDataFrame([("e", "c", "ACGT" * 30, 1, 1)], "element string, seqname string, seq string, ltr5 int, ltr3 int")
    with pytest.raises(Exception, match="longer than the overlap"):
        E.locate_elements(elements, spark.createDataFrame([("c", "ACGT" * 99)], "seq_id string, seq string"), longest=64).collect()


def test_empty_tables(spark):
    elements = spark.createDataFrame([], "element string, seqname string, seq string, ltr5 int, ltr3 int")
    seqs = spark.createDataFrame([("c", "ACGT")], "seq_id string, seq string")
    assert E.locate_elements(elements, seqs).collect() == [] and E.locate_elements(elements, seqs.limit(0)).collect() == []


@pytest.mark.parametrize("k,task,prefilter", [(1, 1 << 22, False), (5, 1 << 22, True), (20, 300, False), (27, 1 << 22, False), (28, 300, True), (54, 1 << 22, False), (55, 1 << 22, True)])
def test_kmer_counts_equal_a_plain_count(spark, monkeypatch, k, task, prefilter):
    """K-mers of all letters, over several chunks, with buckets that would fill a task and a query that is a part of the target."""
    from collections import Counter

    from seqframe.operators import kmers as C

    monkeypatch.setattr(C, "TASK", task)
    rng = random.Random(k)
    unit = letters(rng, 70)
    texts = [letters(rng, 300, "ACGTACGTACGTN") + unit * 3 + "A" * 250 + letters(rng, 40, "acgtRY") + unit + "éA𝔘" + unit, unit * 2, "N" * 90, "", "ACG", letters(rng, 400), None]
    target = spark.createDataFrame([(f"s{j}", t) for j, t in enumerate(texts)], "seq_id string, seq string").repartition(3)
    query = target.where("seq_id in ('s0', 's1', 's3', 's6')").unionByName(spark.createDataFrame([("new", letters(rng, 120))], "seq_id string, seq string"))
    n = Counter(t[i : i + k] for t in texts if t for i in range(len(t) - k + 1))
    want = {(r.seq_id, i + 1): n[r.seq[i : i + k]] for r in query.collect() if r.seq for i in range(len(r.seq) - k + 1)}
    got = [tuple(r) for r in A.kmer_counts(query, target, k, prefilter).collect()]
    assert len(got) == len(want) and {r[:2]: r[2] for r in got} == want


def test_a_run_of_one_minimizer_is_one_string():
    import numpy as np

    from seqframe.operators import kmers as C

    rng = random.Random(4)
    text = letters(rng, 20_000, "ACGT") + "R" + letters(rng, 500) + "A" * 1000
    start, n, bucket = C.runs(C.DIGIT[np.frombuffer(text.encode(), np.uint8)], 20)
    assert n.sum() == len(text) - 19 - 20 and len(n) < n.sum() / 5 and n.max() <= C.RUN
    assert not any("R" in text[s : s + m + 19] for s, m in zip(start, n))
    where = {}
    for s, m, b in zip(start.tolist(), n.tolist(), bucket.tolist()):
        for i in range(m):
            assert where.setdefault(text[s + i : s + i + 20], b) == b
