"""Small hand-made cases: edges, quirks, invariants."""

import math
import random

import pytest
from pyspark.sql import functions as F

from seqframe.functions import seq as S
from seqframe.functions import stats as N
from seqframe.operators import align as A
from seqframe.operators import elements as E
from seqframe.operators import groups as G
from seqframe.operators import intervals as I
from seqframe.operators import numbering as B
from seqframe.sources import lines as L
from seqframe.sources import models as M
from seqframe.sources import reports as R
from seqframe.sources import sinks as K
from seqframe.sources import tables as T


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def report(spark, text, path="dir/HEX1.txt"):
    return L.numbered_lines(spark.createDataFrame([(path, text)], "source_file string, text string"))


def test_chi2_critical_values(spark):
    df = spark.createDataFrame([(3.841459,), (6.634897,), (0.0,)], "x double")
    got = [r[0] for r in df.select(N.chi2_sf(F.col("x"), 1)).collect()]
    assert got == pytest.approx([0.05, 0.01, 1.0], abs=1e-6)
    three = df.select(N.chi2_sf(F.lit(7.814728), 3)).first()[0]
    assert three == pytest.approx(0.05, abs=1e-6)
    assert df.select(N.chi2_sf(F.lit(5.991465), 2)).first()[0] == pytest.approx(0.05, abs=1e-6)
    with pytest.raises(ValueError):
        N.chi2_sf(F.lit(1.0), 0)


def test_chi2_tails_of_odd_degrees(spark):
    """Against math.erfc and the tail's recurrence."""
    xs = [0.0, 1e-12, 0.3, 2.0, 5.9, 6.0, 6.1, 30.0, 200.0, 1400.0]
    df = spark.createDataFrame([(x,) for x in [*xs, None]], "x double")
    for d in (1, 3, 7):
        got = [r[0] for r in df.select(N.chi2_sf(F.col("x"), d)).collect()]
        for x, p in zip(xs, got):
            h = x / 2
            exact = math.erfc(math.sqrt(h)) + sum(h ** (k + 0.5) * math.exp(-h) / math.gamma(k + 1.5) for k in range((d - 1) // 2))
            assert p == pytest.approx(exact, rel=1e-10, abs=1e-300)
        assert got[-1] is None


def test_fdr_of_one_comparison_with_all_rows(spark):
    rng = random.Random(3)
    ps = [rng.choice([rng.random(), rng.random() ** 9, 0.0, 1.0, 1e-300 * rng.random(), 0.25]) for _ in range(5000)]
    df = spark.createDataFrame([("a", i, p) for i, p in enumerate(ps)] + [("a", 9999, None), ("b", 1, 0.5)], "m string, cluster int, p double")
    got = {(r["m"], r["cluster"]): r["q"] for r in N.bh_fdr(df, ["m"]).collect()}
    order, least, expected = sorted(range(len(ps)), key=lambda i: ps[i]), 1.0, {}
    for k in range(len(order) - 1, -1, -1):
        least = min(least, ps[order[k]] * len(ps) / (k + 1))
        expected[order[k]] = least
    assert len(got) == 5002 and got["a", 9999] is None and got["b", 1] == 0.5
    assert all(got["a", i] == pytest.approx(expected[i], rel=1e-12) for i in range(len(ps)))


def test_fdr_is_monotone_and_at_least_p(spark):
    df = spark.createDataFrame([("a", i, p) for i, p in enumerate([0.01, 0.02, 0.02, 0.5, 1.0])], "m string, cluster int, p double")
    got = sorted((r["p"], r["q"]) for r in N.bh_fdr(df, ["m"]).collect())
    assert all(q >= p for p, q in got) and [q for _, q in got] == sorted(q for _, q in got)
    assert got[0][1] == pytest.approx(0.02 * 5 / 3) and got[-1][1] == 1.0


def test_subseq_and_revcomp(spark):
    df = spark.createDataFrame([("AACGTNx", 2, 4, "-"), ("AACGTNx", 2, 4, "+")], "s string, a int, b int, strand string")
    assert [r[0] for r in df.select(S.subseq(F.col("s"), F.col("a"), F.col("b"), F.col("strand"))).collect()] == ["CGT", "ACG"]
    assert df.select(S.revcomp(S.revcomp(F.col("s")))).first()[0] == "AACGTNx"
    with pytest.raises(Exception, match="end before start"):
        df.select(S.subseq(F.col("s"), F.lit(4), F.lit(2), F.lit("+"))).collect()
    with pytest.raises(ValueError):
        S.hardmask(F.col("s"), "Z")


def test_fourfold_prefixes():
    assert set(S.FOURFOLD) == {"CT", "GT", "TC", "CC", "AC", "GC", "CG", "GG"}


def test_merge_touching_and_contained(spark):
    df = spark.createDataFrame([("a", "c", 1, 5), ("a", "c", 6, 9), ("a", "c", 2, 3), ("a", "c", 11, 11), ("b", "c", 4, 12)], "track string, seqname string, start long, stop long")
    assert rows(I.merge(df, ["track", "seqname"]).where("track = 'a'").select("start", "stop")) == [(1, 9), (11, 11)]
    shared = {(r[0], r[1]): r[2] for r in I.overlap_join(df, 4).collect()}
    assert shared == {("a", "a"): 10, ("b", "b"): 9, ("a", "b"): 7, ("b", "a"): 7}


def test_gaps_over_chunk_edges_and_compat(spark):
    df = spark.createDataFrame([("s", "ACNNNNNNACGTnnNN"), ("t", "ACGT"), ("u", "")], "seq_id string, seq string")
    assert rows(I.find_gaps(df, 3, size=4)) == [("s", 3, 8), ("s", 13, 16)]
    assert rows(I.find_gaps(df, 3, size=100, compat=True)) == [("s", 3, 9)]


def test_segments_open_and_steps(spark):
    df = spark.createDataFrame([("c", i, i * 10, i * 10 + 5, s) for i, s in enumerate([1.0, 9.0, 9.0, 1.0, 9.0])], "seqname string, row_no int, start int, stop int, score double")
    assert rows(I.segment_scores(df, 5).select("start", "stop")) == [(10, 25), (40, 45)]
    assert rows(I.segment_scores(df, 5, emit_open=False).select("start", "stop")) == [(10, 25)]
    assert rows(I.segment_scores(df, 5, max_step=5).select("start", "stop")) == [(10, 15), (20, 25), (40, 45)]


def test_psl_minus_strand_is_turned(spark):
    df = spark.createDataFrame([("q", 100, "t", "-", [10], [5])], "q_name string, q_size long, t_name string, strand string, block_sizes array<long>, q_starts array<long>")
    assert I.psl_blocks(df).first()["qstart"] == 86
    assert I.psl_blocks(df, compat=True).first()["qstart"] == 6


def test_numbers_do_not_depend_on_partitions(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 7 + 1).alias("w"))
    for n in (1, 16):
        got = B.numbered(df.repartition(n), ["id"], F.floor(F.col("id") / 9), "no", F.col("w"), "upto").orderBy("id").collect()
        assert [r["no"] for r in got] == list(range(100))
        assert got[50]["upto"] == sum(i % 7 + 1 for i in range(50))
    assert {r[0] for r in B.split_balanced(df, 4, F.col("w"), ["id"], F.floor(F.col("id") / 9)).select("part").distinct().collect()} == {0, 1, 2, 3}


def test_clade_filter_modes(spark):
    df = spark.createDataFrame([(1, "A", 1), (1, "B", 1), (2, "A", 1), (2, "B", 1), (2, "C", 1), (2, "D", 1), (3, "A", 5)], "group_id int, species string, n int")
    clades = {"x": ["A", "B"], "y": ["C", "D"]}
    assert rows(G.clade_filter(df, clades)) == [(2,)]
    assert rows(G.clade_filter(df, clades, "or")) == [(1,), (2,)]
    assert rows(G.size_split(df, 5)) == [(1, "main"), (2, "main"), (3, "large")]


def test_missing_sequence_fails(spark):
    groups = spark.createDataFrame([(1, "A", "x")], "group_id int, species string, gene string")
    seqs = spark.createDataFrame([], "species string, gene string, seq string")
    with pytest.raises(Exception, match="no sequence"):
        E.join_group_seqs(groups, seqs).collect()
    assert E.join_group_seqs(groups, seqs, strict=False).count() == 0


def test_k2p(spark):
    df = spark.createDataFrame([("AAAAAAAAAA", "GAAAAAAAAC"), ("", ""), ("ACGT", "ACGT")], "a string, b string")
    got = [r[0] for r in df.select(N.k2p(F.col("a"), F.col("b"))).collect()]
    p, q = 0.1, 0.1
    assert got[0] == pytest.approx(-0.5 * math.log(1 - 2 * p - q) - 0.25 * math.log(1 - 2 * q))
    assert got[1] is None and got[2] == 0


def test_k2p_against_a_count_by_base(spark):
    rng = random.Random(3)
    cases = [(None, "ACGT"), ("ACGT", None), ("", ""), ("ACG", ""), ("0123acgt", "0123ACGA"), ("NN--", "ACGT")]
    for n in [*range(1, 50), 151]:
        a = "".join(rng.choice("ACGTacgtN-4é") for _ in range(n))
        cases.append((a, "".join(rng.choice("ACGTN") if rng.random() < 0.2 else c for c in a)[: n - n % 3]))

    def plain(a, b):
        pairs = [x + y for x, y in zip((a or "").upper(), (b or "").upper()) if x in "ACGT" and y in "ACGT"]
        if not pairs:
            return None
        p, differ = sum(x in ("AG", "GA", "CT", "TC") for x in pairs) / len(pairs), sum(x[0] != x[1] for x in pairs)
        q = differ / len(pairs) - p
        return -0.5 * math.log(1 - 2 * p - q) - 0.25 * math.log(1 - 2 * q) if 1 - 2 * p - q > 0 and 1 - 2 * q > 0 else None

    df = spark.createDataFrame(cases, "a string, b string")
    for a, b, d in df.select("a", "b", N.k2p(F.col("a"), F.col("b"))).collect():
        want = plain(a, b)
        assert d is None if want is None else d == pytest.approx(want, abs=1e-12), (a, b)


def test_pattern(spark):
    df = spark.createDataFrame([("4+2*3+2",)], "p string")
    r = df.select(N.expand_pattern(F.col("p")), N.last_free_bin(F.col("p"))).first()
    assert list(r[0]) == [0] * 4 + [1] * 3 + [2] * 3 + [3] * 2 and r[1] == 9


def test_codons(spark):
    df = spark.createDataFrame([("g", "A", "ATG---TA"), ("g", "B", "AT-AAA"), ("g", "C", "ATG---")], "group_id string, species string, aln string")
    assert rows(S.check_codons(df)) == [("g", "A"), ("g", "B")]
    with pytest.raises(Exception, match="broken codons"):
        S.check_codons(df, strict=True).collect()


def test_gene_total_error(spark):
    df = spark.createDataFrame([("f", "Aly.fasta:12"), ("f", "nonsense")], "source_file string, line string")
    with pytest.raises(Exception, match="not a gene total"):
        T.parse_gene_totals(df).collect()


def test_evalue_zero(spark):
    df = spark.createDataFrame([(0.0,), (3e-5,)], "e double")
    m, x = S.evalue_parts(F.col("e"))
    assert [tuple(r) for r in df.select(m, x).collect()] == [(1.0, -181), (3.0, -5)]


def test_fasta_file_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("s1", "ACGT" * 40), ("s2", "A")], "seq_id string, seq string")
    K.write_fasta(df, str(tmp_path / "fa"))
    got = T.read_fasta(spark, str(tmp_path / "fa" / "*" / "*.txt"))
    assert rows(got.select("seq_id", "seq")) == rows(df)


def test_gff_file_round_trip(spark, tmp_path):
    text = "##gff\nc\tx\texon\t1\t9\t.\t+\t.\tID=a;Name=b\nshort\tline\n"
    (tmp_path / "a.gff").write_text(text)
    df = T.read_gff(spark, str(tmp_path / "a.gff"))
    K.write_gff(df, str(tmp_path / "out"))
    again = T.read_gff(spark, str(tmp_path / "out"))
    assert rows(df.drop("source_file").select("seqname", "start", "stop", "attribute")) == rows(again.select("seqname", "start", "stop", "attribute")) == [("c", 1, 9, "ID=a;Name=b")]


def test_other_sinks(spark, tmp_path):
    groups = spark.createDataFrame([(1, "A", "x"), (1, "B", "y"), (2, "A", "z")], "group_id int, species string, gene string")
    K.write_species_lists(G.species_lists(groups), str(tmp_path / "lists"))
    assert spark.read.text(str(tmp_path / "lists")).count() == 3
    K.write_clusters(G.cluster_summary(groups), str(tmp_path / "clusters"))
    assert spark.read.csv(str(tmp_path / "clusters"), sep="\t", header=True).columns == ["#Fam_id", "Genes", "Species", "members"]
    alns = spark.createDataFrame([(1, "A", "ACG" * 30), (1, "B", "ACT" * 30)], "group_id int, species string, aln string")
    K.write_paml(alns, str(tmp_path / "paml"))
    text = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "paml"), wholetext=True).select("value").collect())
    assert text.startswith("\t2\t90\nA\n" + ("ACG" * 20) + "\n" + "ACG" * 10)
    K.write_group_fasta(alns.selectExpr("group_id", "species", "'cds' AS type", "aln AS seq"), str(tmp_path / "groups"))
    assert rows(spark.read.text(str(tmp_path / "groups")).select("group_id", "type").distinct()) == [(1, "cds")]
    K.write_ltr_pairs(E.ltr_pair_records(spark.createDataFrame([("e", "f", "AC", "GT")], "element string, family string, five string, three string")), str(tmp_path / "pairs"))
    assert rows(spark.read.text(str(tmp_path / "pairs")).select("value")) == [(">e#f#five_prime_LTR",), (">e#f#three_prime_LTR",), ("AC",), ("GT",)]


def test_tenest_solo_and_ordered_ends(spark):
    got = R.tenest_to_gff(report(spark, "82726\nqry\nSOLO s0 Ang 1 1\ns0 90 80 1 11\nPAIR p1 Ang 0\np1 L 5 9 1 5\np1 M 20 10 1 11 30 40 1 11\n")).select("feature", "start", "stop", "attribute")
    assert rows(got) == [("LTR_retrotransposon", 10, 20, "pair_Ang_p1"), ("LTR_retrotransposon", 30, 40, "pair_Ang_p1"), ("LTR_retrotransposon", 80, 90, "solo_Ang_s0"), ("five_prime_LTR_component", 5, 9, "pair_Ang_p1")]


def test_findltr_ignores_other_widths(spark):
    got = R.findltr_to_gff(report(spark, "1\t5\t9\t20\t29\t+\t5\t10\t11\t98.6\nonly three tokens\n")).select("feature", "start", "stop")
    assert rows(got) == [("LTR_retrotransposon", 5, 29), ("five_prime_LTR", 5, 9), ("three_prime_LTR", 20, 29)]


def test_repseek_compat(spark):
    line = "Tandem.dir\t10\t30\t5\t6\t0\tx\t90\t3.5\t1\t1\t1"
    ends = lambda **k: rows(R.repseek_to_gff(report(spark, line), **k).select("feature", "start", "stop"))
    assert ends() == [("tandem_direct_repeat", 10, 14), ("tandem_direct_repeat", 30, 35)]
    assert ends(compat=True) == [("tandem_direct_repeat", 10, 15), ("tandem_direct_repeat", 30, 36)]


def test_reports_without_content(spark):
    for parse in (R.ltrfinder_to_gff, R.ltrseq_to_gff, R.findltr_to_gff, R.repseek_to_gff, R.trf_to_gff, R.tenest_to_gff, R.findmite_to_gff, R.genscan_to_gff, R.genemark_to_gff, M.codeml_branch, M.codeml_freeratio, M.codeml_branchsite, M.read_psmc, M.read_pair_distance, M.read_time_tree):
        assert parse(report(spark, "")).count() == 0


def test_clade_rate_levels(spark):
    fits = spark.createDataFrame([("c", "((A: 1, B: 2): 0.5, C: 4);")], "cluster string, t string").selectExpr("cluster", "t AS dn_tree", "t AS ds_tree", "t AS w_tree")
    marked = spark.createDataFrame([("c", "A", 1), ("c", "B", 1)], "cluster string, label string, up int")
    assert {r["dn"] for r in M.clade_rates(fits, marked).collect()} == {0.5}


def test_psmc_scaling(spark):
    bins = spark.createDataFrame([("s", 20, 0, 1.0, 2.0, 0.01)], "sample string, round int, k int, t double, lam double, theta double")
    mods = spark.createDataFrame([("s", 0.5, 2.0)], "sample string, fn double, nu double")
    r = N.scale_psmc(bins, 2.5e-8, 25, mods=mods).first()
    n0 = 0.01 / 100 / 1e-7 * 2
    assert r["years"] == pytest.approx(2 * n0 * 25) and r["ne"] == pytest.approx(2 * n0 * 2 / 1e4)


def test_segments_over_stretches(spark, monkeypatch):
    rng = random.Random(1)
    data = [("c", i, i * 10 + 7 * rng.randrange(2), i * 10 + 9, rng.choice([1.0, 9.0, 9.0, 9.0])) for i in range(200)] + [("d", i, i, i, 9.0) for i in range(50)]
    df = spark.createDataFrame(data, "seqname string, row_no int, start int, stop int, score double")
    whole = [rows(I.segment_scores(df, 5, **k)) for k in ({}, {"emit_open": False}, {"max_step": 10})]
    monkeypatch.setattr(I, "STRETCH", 7)
    assert [rows(I.segment_scores(df, 5, **k)) for k in ({}, {"emit_open": False}, {"max_step": 10})] == whole and len(whole[2]) > len(whole[0]) > 10


def test_elements_over_several_chunks(spark):
    rng = random.Random(2)
    seq = "".join(rng.choice("ACGT") for _ in range(1000))
    seqs = spark.createDataFrame([("c", seq)], "seq_id string, seq string")
    spans = [("LTR_retrotransposon", 95, 350), ("five_prime_LTR", 95, 130), ("three_prime_LTR", 320, 350)]
    features = spark.createDataFrame([(f"e{s}", "c", f, a, b, s) for s in "+-" for f, a, b in spans] + [("f", "c", "LTR_retrotransposon", 1000, 1000, "+")], "element string, seqname string, feature string, start long, stop long, strand string")
    turn = lambda x: x[::-1].translate(str.maketrans("ATCG", "TAGC"))
    expected = [("e+", "c", *[seq[a - 1 : b] for _, a, b in spans]), ("e-", "c", *[turn(seq[a - 1 : b]) for _, a, b in spans]), ("f", "c", seq[-1], None, None)]
    for size in (64, 1 << 20):
        assert sorted((tuple(r) for r in E.join_feature_seqs(features, seqs, size).collect()), key=str) == sorted(expected, key=str)
    part = seq[94:350]
    elements = spark.createDataFrame([("e", "c", part, 36, 31, part[40:50], part[200:212], "AAAAA", "CCCC"), ("g", "c", "A" * 60, 3, 3, "T", "A", "A", "A")], "element string, seqname string, seq string, ltr5 int, ltr3 int, pbs string, ppt string, tsr5 string, tsr3 string")
    for size in (100, 1 << 20):
        got = {r["element"]: tuple(r)[2:] for r in E.locate_elements(elements, seqs, size, 300).collect()}
        assert got == {"e": (95, 350, 130, 320, 135, 144, 295, 306, 90, 94, 351, 354), "g": (0, *[None] * 11)}
    with pytest.raises(Exception, match="longer than the overlap"):
        E.locate_elements(elements, seqs, 100, 30).collect()


def test_kmers_over_chunks_and_other_letters(spark):
    seq = "ACGTNACGTACGTAACGTAC" * 3 + "0123ACGT01"
    df = spark.createDataFrame([("s", seq), ("t", "ACGTA"), ("u", "AC")], "seq_id string, seq string")
    plain = {}
    for name, x in (("s", seq), ("t", "ACGTA"), ("u", "AC")):
        for i in range(len(x) - 3):
            plain[name, i + 1] = sum(y[j : j + 4] == x[i : i + 4] for y in (seq, "ACGTA", "AC") for j in range(len(y) - 3))
    for k, prefilter in ((4, False), (4, True)):
        assert {(r["seq_id"], r["position"]): r["n"] for r in A.kmer_counts(df, df, k, prefilter).collect()} == plain
    assert {(r["seq_id"], r["position"]) for r in A.kmers(df, 4, (13, 7, 3)).collect()} == set(plain)
    assert A.kmer_counts(df, df, 33).where("n = 0").count() == 0 and A.kmers(df, 40).where("kmer is null").count() == 0


def test_fourfold_sites_of_ragged_groups(spark):
    df = spark.createDataFrame([(1, "A", "CTAGGGCTC"), (1, "B", "CTGAGGCTTAA"), (2, "A", "CTA"), (3, "A", "AAA"), (3, "B", "CTA")], "group_id int, species string, aln string")
    assert rows(A.fourfold_sites(df, 2)) == [(1, "A", "AC"), (1, "B", "GT")]


def test_base26_grows_past_four_letters(spark):
    edge = 26**4
    df = spark.createDataFrame([(0,), (27,), (edge - 1,), (edge,), (edge + 1,), (26**5 - 1,), (26**5,)], "n long")
    assert [r[0] for r in df.select(S.base26(F.col("n"))).collect()] == ["aaaa", "aabb", "zzzz", "baaaa", "baaab", "zzzzz", "baaaaa"]
    around = spark.range(edge - 3, edge + 3).select(S.base26(F.col("id")).alias("s"))
    assert around.distinct().count() == 6 and spark.range(3).select(S.base26(F.col("id")).alias("s")).intersect(around).count() == 0
