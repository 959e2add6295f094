"""What a step must not do as tables grow, and rules on the edges."""

import math
import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from seqframe.functions import seq as S
from seqframe.functions import stats as N
from seqframe.operators import align as A
from seqframe.operators import elements as E
from seqframe.operators import groups as G
from seqframe.operators import intervals as I
from seqframe.operators import kmers as C
from seqframe.plans import queries as P
from seqframe.plans.views import VIEWS
from seqframe.sources import models as M
from seqframe.sources import reports as R
from seqframe.sources import sinks as K
from seqframe.sources import trees as X
from seqframe.sources.lines import numbered_lines


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_trees_are_read_without_shuffles_or_windows(spark):
    trees = spark.createDataFrame([("a", "((A: 1, B: 2): 3, C: 4);")], "tree_id string, tree string")
    nodes = X.tree_nodes(trees, ["tree_id"])
    assert nodes.count() == 5 and not any(step in plan(nodes) for step in ("Exchange", "Window", "Join"))


def test_two_reports_of_a_folder_keep_their_own_trees(spark):
    text = " 4 300\nlnL(ntime: 11  np: 16):  -1.0  +0.0\n   6..2  0.1  2.0  4.0  0.2\ndS tree:\n((A: {0}, B: 9): 8, C: 7);\ndN tree:\n((A: {0}, B: 9): 8, C: 7);\nw ratios as labels for TreeView:\n((A #{0}, B #9) #8, C #7);"
    lines = [(f"d/c/r{k}.mlc", no, line) for k in (1, 2) for no, line in enumerate(text.format(k).split("\n"))]
    files = spark.createDataFrame([("d/c/tree/tree.A", 0, "((A #1, B), C);")], "source_file string, line_no int, line string")
    got = X.codeml_clade(spark.createDataFrame(lines, "source_file string, line_no int, line string"), files)
    assert sorted((r.label, r.dn, r.ds, r.w) for r in got.collect()) == [("A", 1.0, 1.0, 1.0), ("A", 2.0, 2.0, 2.0)]


def test_target_sites_that_begin_at_zero_are_features(spark):
    block = "[1] chr1 Len:9\nLocation : 5 - 90 Len: 1 Strand:+\nScore    : 7\n5'-LTR   : 5 - 9 Len: 2\n3'-LTR   : 80 - 90 Len: 2\nTSR      : 0 - 4 , 91 - 95 [CTTTT]"
    lines = spark.createDataFrame([("x", k, line) for k, line in enumerate(block.split("\n"))], "source_file string, line_no int, line string")
    assert sorted((r.start, r.stop) for r in R.ltrfinder_to_gff(lines).where("feature = 'target_site_duplication'").collect()) == [(0, 4), (91, 95)]
    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT 1 AS event_id, 'a' AS event_type, 1 AS user_id, TIMESTAMP '2024-01-01 00:04:00' AS ts, 3.5 AS value")
    rows = con.execute(P.ORACLE_SQL["s13_ltrfinder"]).fetchall()
    assert len([r for r in rows if "target_site_duplication" in r]) == 2


def test_equal_fits_go_to_the_first_round(spark):
    """0.07 * 1000 + 10 = 0.06 * 1000 + 20, in whatever order the rows come."""
    rows = [(1, k, r, d) for k in range(8) for r, d in (((20, 0.06), (10, 0.07)) if k % 2 else ((10, 0.07), (20, 0.06)))]
    con = duckdb.connect()
    con.execute("CREATE TABLE lineitem (l_suppkey BIGINT, l_linenumber BIGINT, l_orderkey BIGINT, l_discount DOUBLE, l_quantity DOUBLE DEFAULT 1, l_extendedprice DOUBLE DEFAULT 1, l_tax DOUBLE DEFAULT 0)")
    for s, k, r, d in [(s, *x[1:]) for s in range(50) for x in rows]:
        con.execute("INSERT INTO lineitem (l_suppkey, l_linenumber, l_orderkey, l_discount) VALUES (?, ?, ?, ?)", [s, k, r, d])
    assert {r[1] for r in con.execute(P.ORACLE_SQL["w7_select_round"]).fetchall()} == {10}
    df = spark.createDataFrame([("p", r, d * 1000 + r) for _, _, r, d in rows], "sample string, round long, fit double")
    assert [r.round for r in N.select_round(df, 0, 10).collect()] == [10]


@pytest.mark.parametrize("pattern, want", [("4+25*2+4+6", 57), ("1+1", 0), ("5", None), ("1*7", None), ("2*3", 2), ("3+0", None), ("1000000*1000+5", 10**9 - 1)])
def test_last_free_bin_counts_without_listing(spark, pattern, want):
    assert spark.createDataFrame([(pattern,)], "p string").select(N.last_free_bin(F.col("p"))).first()[0] == want


def test_long_sequences_are_wrapped_in_one_pass(spark):
    """Four million bases take far less than a substring for each of 66,667 lines."""
    seqs = ["", None, "A" * 59, "A" * 60, "AC" * 60, "A" * 121, "é\n" * 50, "ACGT" * 1_000_000]
    started = time.monotonic()
    got = [r[0] for r in spark.createDataFrame([(k, s) for k, s in enumerate(seqs)], "k int, s string").orderBy("k").select(K.wrapped(F.col("s"))).collect()]
    assert time.monotonic() - started < 60
    assert got == ["\n".join((s or "")[k : k + 60] for k in range(0, len(s or ""), 60)) for s in seqs]


@pytest.mark.parametrize("find", [G.ortholog_pairs, G.in_paralogs])
def test_hits_are_used_once_and_not_joined(spark, find):
    rows = [("A|1", "A|2", 1e-9, 5.0), ("A|2", "A|1", 1e-9, 5.0), ("A|2", "A|1", 1e-9, 5.0), ("A|1", "B|1", 1e-8, 5.0), ("B|1", "A|1", 1e-8, 5.0), ("A|2", "A|3", 1e-7, 5.0), ("A|3", "A|2", 1e-7, 5.0), ("A|3", "B|2", 1e-8, 5.0), ("A|1", "A|1", 0.5e-9, 5.0), (None, "A|1", 1e-9, 5.0)]
    hits = spark.createDataFrame([(*r, 90.0) for r in rows], "qry string, sub string, e double, bits double, pct double").repartition(3)
    out = find(hits)
    assert sorted(tuple(r) for r in out.collect()) == [("A|1", "B|1" if find is G.ortholog_pairs else "A|2")]
    assert "Join" not in plan(out) and plan(out).split("Initial Plan")[0].count("Scan ExistingRDD") == 1


def test_sites_are_found_without_a_window_over_all_lines(spark):
    text = "lnL(ntime: 11  np: 16):  -1.5  +0.0\nNaive\n   1 K 0.9\nBayes Empirical Bayes\n   22 A 0.612\n   10 K 0.987*\nThe grid\n   3 C 0.5\nforeground w  0.1  1.0  2.5  1.5"
    lines = spark.createDataFrame([("d/c/s/fix.mlc", k, line) for k, line in enumerate(text.split("\n"))], "source_file string, line_no int, line string").repartition(3)
    out = M.codeml_branchsite(lines)
    assert [(r.lnl, r.w, [(s.pos, s.aa, s.prob) for s in r.sites]) for r in out.collect()] == [(-1.5, 2.5, [(10, "K", 0.987), (22, "A", 0.612)])]
    assert "Window" not in plan(out)


def test_lines_of_curves_travel_as_numbers(spark):
    text = "CC\tx\nRD\t3\nLK\t1\nRI\t0.5\nTR\t0.01\t0.002\nDT\t0.25\nRS\t0\t0.5\t1.5\nRS\t1\t0.75\nPA\t4+5*3\n//\nRD\t4\nRS\t0\t1\t2"
    lines = spark.createDataFrame([("d/u.psmc", k, line) for k, line in enumerate(text.split("\n"))], "source_file string, line_no int, line string").repartition(3)
    out = M.read_psmc(lines)
    assert sorted((r.round, r.k, r.fit, r.theta, r.rho, r.dt, r.t, r.lam) for r in out.collect()) == [(3, 0, 0.5, 0.01, 0.002, 0.25, 0.5, 1.5), (3, 1, 0.5, 0.01, 0.002, 0.25, 0.75, None), (4, 0, None, None, None, None, 1.0, 2.0)]
    sorts = [line for line in plan(out).split("\n") if "Exchange" in line]
    assert sorts and not any("line#" in line for line in sorts)


def test_proteins_are_judged_from_one_translation(spark):
    rows = spark.createDataFrame([("a", "ATGTTTTAAÉ"), ("b", "ATGNNN"), ("c", None), ("d", "at")], "seq_id string, seq string")
    judged = S.judge_proteins(rows.select("seq_id", S.translate_cds(F.col("seq")).alias("pep")), "pep", 2, 0.4)
    assert sorted((r.seq_id, r.pep, r.good) for r in judged.collect()) == [("a", "MF*", True), ("b", "MX", True), ("d", "", False)]
    query = plan(P.QUERIES["p11_filter_proteins"](spark, "/root/testdata/sf0.001"))
    assert "Union" not in query and query.count("Scan parquet") == 1


def test_alignments_travel_to_their_pairs_as_bits(spark):
    rows = [(1, s, a) for s, a in (("A", "ACGTACGTAC"), ("B", "ACGTACGTAT"), ("C", "NNNNé"), ("D", None))]
    out = N.k2p_pairs(spark.createDataFrame(rows, "group_id long, species string, aln string"))
    want = -0.5 * math.log(1 - 2 * 0.1) - 0.25 * math.log(1)
    assert sorted((r.s1, r.s2, r.distance and round(r.distance, 9)) for r in out.collect()) == [("A", "B", round(want, 9)), ("A", "C", None), ("A", "D", None), ("B", "C", None), ("B", "D", None), ("C", "D", None)]
    sent = [line for line in plan(out).split("\n") if "Exchange" in line or "Join" in line]
    assert sent and not any("aln#" in line for line in sent)


@pytest.mark.parametrize("stretch", [1, 3, 1 << 14])
def test_fourfold_sites_of_stretches_without_a_second_count(spark, monkeypatch, stretch):
    monkeypatch.setattr(A, "STRETCH", stretch)
    one, two = "CTAAAACCCGTé" + "GGA" * 20, "CTCAAACCTGTT" + "GGC" * 17 + "GG"
    rows = [(1, "A", one), (1, "B", two), (2, "A", one), (2, "B", one), (2, "C", "A"), (3, "A", one), (3, "B", None), (4, "A", one)]
    out = A.fourfold_sites(spark.createDataFrame(rows, "group_id long, species string, aln string"), 2)
    assert sorted(tuple(r) for r in out.collect()) == [(1, "A", "ACé" + "A" * 17), (1, "B", "CTT" + "C" * 17)]
    assert "LeftSemi" not in plan(out) and "lambda codons" not in plan(out)


def test_covered_bases_are_counted_with_one_sort(spark):
    rng = random.Random(5)
    blocks = [(f"q{rng.randrange(3)}", 9000, f"t{rng.randrange(2)}", rng.randrange(8600), rng.choice((0, 1, 50, 400))) for _ in range(120)] + [("q9", 0, "t", 4096, 0)]
    df = spark.createDataFrame(blocks, "query string, qlen long, target string, qstart long, size long")
    out = I.best_target_coverage(df)
    held = {}
    for query, _, target, start, size in blocks:
        held.setdefault((query, target), set()).update(range(start, start + size))
    want = {q: max((len(v), t) for (p, t), v in held.items() if p == q) for q, *_ in blocks}
    assert {r.query: (r.covered, r.target) for r in out.collect()} == want
    assert plan(out).split("Initial Plan")[0].count("Window [") == 1


def test_sequences_that_elements_are_looked_up_in_are_computed_once(spark):
    runs = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def costly(x):
        runs.add(1)
        return x

    seqs = spark.createDataFrame([(f"s{k}", "ACGGTCATTGCAAGTC" * (k + 2)) for k in range(6)], "seq_id string, seq string").select("seq_id", costly("seq").alias("seq"))
    elements = spark.createDataFrame([("e", "s1", "GGTCATTG", 2, 2), ("f", "s2", "TTTTTTTT", 2, 2), ("g", "s9", "GGTC", 2, 2)], "element string, seqname string, seq string, ltr5 int, ltr3 int")
    got = sorted((r.element, r.start, r.stop) for r in E.locate_elements(elements, seqs, 16, 12).collect())
    assert got == [("e", 3, 10), ("f", 0, None)] and runs.value == 6


def test_kmers_of_one_minimizer_are_dealt_out_anew(spark, monkeypatch):
    """K-mers that differ but have one minimizer do not go the way of those that are everywhere."""
    rng = random.Random(7)
    words = ["".join(rng.choice("ACGT") for _ in range(C.MINIMIZER)) for _ in range(3000)]
    hashes = C._minimizers(C.DIGIT[np.frombuffer("".join(words).encode(), np.uint8)], C.MINIMIZER, C.MINIMIZER)[:: C.MINIMIZER]
    least = words[int(hashes.argmin())]
    texts = ["".join(least + "".join(rng.choice("ACGT") for _ in range(11)) for _ in range(30)) for _ in range(12)]
    texts += [texts[0], texts[1][:200]]
    monkeypatch.setattr(C, "TASK", 600)
    monkeypatch.setattr(C, "counted_apart", None)
    seqs = spark.createDataFrame([(f"s{j}", t) for j, t in enumerate(texts)], "seq_id string, seq string").repartition(3)
    n = Counter(t[i : i + 20] for t in texts for i in range(len(t) - 19))
    got = [tuple(r) for r in A.kmer_counts(seqs, seqs, 20).collect()]
    assert sorted(got) == sorted((f"s{j}", i + 1, n[t[i : i + 20]]) for j, t in enumerate(texts) for i in range(len(t) - 19))


def test_sequences_whose_kmers_are_counted_are_computed_once(spark):
    runs = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def costly(x):
        runs.add(1)
        return x

    seqs = spark.createDataFrame([(f"s{k}", "ACGGTCATTGCAAGTC" * (k + 2)) for k in range(6)], "seq_id string, seq string").select("seq_id", costly("seq").alias("seq"))
    assert A.kmer_counts(seqs, seqs, 20).count() == sum(16 * (k + 2) - 19 for k in range(6)) and runs.value == 6


@pytest.mark.parametrize("k", [20, 40])
def test_kmers_that_share_a_hash_stay_apart(monkeypatch, k):
    monkeypatch.setattr(C, "MIX", np.uint64(1 << 40))
    rng = np.random.default_rng(5)
    first, rest = rng.integers(0, 60, 4000) << 20, rng.integers(0, 5, 4000)
    order, new = C._equals(first, rest, k)
    keys = [(first[j], rest[j] if k > C.FIT else 0) for j in order]
    assert sorted(order.tolist()) == list(range(4000)) and int(new.sum()) == len(set(keys))
    assert all(bool(new[j]) == (j == 0 or keys[j] != keys[j - 1]) for j in range(4000))


def test_whole_reports_of_fits_are_read_where_they_are(spark):
    texts = ["seed\r\nlnL(ntime: 11  np: 14):  -9.5  +0.0\r\nlnL(ntime: 11  np: 13):  -1.5e\r\nomega (dN/dS) =  0.5000\r\n", "lnL(ntime: 1  np: 15):  -3.25\nw (dN/dS) for branches:  0.25000 1.75000\nw (dN/dS) for branches:  0.5\n 9", "lnL(np: 2): -1.2.3\nlnL(np: 7):\n-8", " lnL(np: 2): -1\nomega (dN/dS) =  1", "lnL(np: 99999999999999999999): -4", "", None]
    reports = spark.createDataFrame([(f"d/c{k}_m{k}.mlc", t) for k, t in enumerate(texts)], "source_file string, text string")
    out = M.codeml_branch(reports)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, M.codeml_branch(numbered_lines(reports)).collect()), key=str) and out.count() == 3
    assert "Exchange" not in plan(out)
    assert plan(P.QUERIES["s25_codeml_branch"](spark, "/root/testdata/sf0.001")).count("Exchange") == 1


def sent(df):
    """Rows that a plan that has run wrote into its shuffles."""
    n, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "ShuffleExchangeExec":
            n += node.metrics().apply("shuffleRecordsWritten").value()
        children = node.children()
        todo += [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [children.apply(k) for k in range(children.length())] if kind != "ReusedExchangeExec" else []
    return n


GENES = "group_id long, species string, gene string, q double, p double, d double"


@pytest.mark.parametrize("marks", [None, 3, 1])
@pytest.mark.parametrize("seed", range(2))
def test_in_paralogs_of_groups_are_those_of_all_hits(spark, monkeypatch, seed, marks):
    """Few genes in many groups, so that many pairs are in several; some rows come twice or lack a value. Equal hashes of unlike genes change nothing."""
    rng = random.Random(seed)
    some = lambda *x: rng.choice(x)
    rows = [(some(None, *range(60)), f"S{rng.randrange(3)}", str(rng.randrange(12 if k % 2 else 200)), some(20.0, 24.0, 30.0, 40.0), some(1.0, 2.0, 3.0), some(0.0, 0.05, 0.2)) for k in range(400)]
    rows += rows[:5] + [(1, None, "1", 40.0, 1.0, 0.0), (1, "S1", None, 40.0, 1.0, 0.0), (2, "S1", "1", None, 1.0, 0.0), (3, "S1", "2", 40.0, 2.0, None), (70, "S1", "900", 40.0, 2.0, 0.0), (71, "S1", "901", 40.0, 2.0, 0.0), (71, "S1", "902", 40.0, 2.0, 0.0)]
    genes = spark.createDataFrame(rows, GENES)
    hits = spark.sql(re.sub(r"\{genes_v\}", "{genes}", VIEWS["hits_all_v"]), genes=genes)
    want = sorted(map(tuple, G.in_paralogs(hits).collect()))
    if marks:
        real = F.hash
        monkeypatch.setattr(F, "hash", lambda c: F.abs(real(c)) % marks)
    got = G.in_paralogs_of_groups(genes, lambda a, b: (F.exp(-(a["q"] + b["q"]) / 4), a["p"] + b["p"], 100 - F.abs(a["d"] - b["d"]) * 500))
    assert sorted(map(tuple, got.collect())) == want and ("S1|901", "S1|902") in want and len(want) > 9


def test_a_pair_of_several_groups_has_its_best_figures(spark):
    """A|1 and B|1 are worse together in group 2, so A|1's limit is not the hit of group 1, and A|2 is as good."""
    score = lambda a, b: (F.exp(-(a["q"] + b["q"]) / 4), a["p"] + b["p"], 100 - F.abs(a["d"] - b["d"]) * 500)
    rows = [(1, "A", "1", 30.0, 1.0, 0.0), (1, "B", "1", 40.0, 1.0, 0.0), (1, "A", "2", 30.0, 1.0, 0.0)]
    more = [(2, "A", "1", 24.0, 1.0, 0.0), (2, "B", "1", 24.0, 1.0, 0.0), (3, "A", "2", 24.0, 1.0, 0.0), (3, "B", "1", 24.0, 1.0, 0.0)]
    pairs = lambda rows: [tuple(r) for r in G.in_paralogs_of_groups(spark.createDataFrame(rows, GENES), score).collect()]
    assert pairs(rows) == [] and pairs(rows + more) == [("A|1", "A|2")]


def test_hits_of_groups_do_not_travel(spark):
    out = P.QUERIES["j9_in_paralogs"](spark, "/root/testdata/sf0.001")
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert len(out.collect()) > 0 and 0 < sent(out) < 3 * rows
