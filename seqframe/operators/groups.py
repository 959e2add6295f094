"""Ortholog groups: matrices, summaries, histograms, Venn regions and filters of (group_id, species, gene) rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def family_counts(groups: DataFrame) -> DataFrame:
    """group_id, species, n: members of each family and species."""
    return groups.groupBy("group_id", "species").agg(F.count("*").alias("n"))


def family_matrix(groups: DataFrame, species: list[str]) -> DataFrame:
    """One row per family, one zero-filled column per species."""
    return groups.groupBy("group_id").pivot("species", species).agg(F.count("gene")).fillna(0, species)


def family_summary(groups: DataFrame, totals: DataFrame) -> DataFrame:
    """Per species: total, in-family and unclustered genes, families, unique families, genes per family, largest family.

    Genes count once in a family, as a species with a family of its own counts it as unique.
    """
    per = groups.groupBy("group_id", "species").agg(F.count_distinct("gene").alias("n"))
    width = F.count("*").over(W.partitionBy("group_id"))
    per = per.withColumn("width", width)
    got = per.groupBy("species").agg(F.sum("n").alias("in_family"), F.count("*").alias("families"), F.count_if(F.col("width") == 1).alias("unique_families"), F.max("n").alias("max_size"))
    joined = with_totals(got, totals)
    return joined.select("species", F.col("n_genes").alias("total"), F.coalesce("in_family", F.lit(0)).alias("in_family"), (F.col("n_genes") - F.coalesce("in_family", F.lit(0))).alias("unclustered"), F.coalesce("families", F.lit(0)).alias("families"), F.coalesce("unique_families", F.lit(0)).alias("unique_families"), F.round(F.try_divide("in_family", "families"), 6).alias("genes_per_family"), F.coalesce("max_size", F.lit(0)).alias("max_size"))


def with_totals(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Every species of ``totals`` with its counts, if any."""
    return totals.join(counts, "species", "left")


def ortho_type_hist(groups: DataFrame, totals: DataFrame, species: list[str]) -> DataFrame:
    """species, kind, n: genes in single- and multi-copy orthologs (families of all species), other families of several
    species, paralogs (one species) and unclustered genes."""
    per = family_counts(groups).withColumn("width", F.count("*").over(W.partitionBy("group_id")))
    everyone = F.col("width") == len(species)
    kind = F.when(everyone & (F.col("n") == 1), "single_copy").when(everyone, "multi_copy").when(F.col("width") > 1, "other").otherwise("paralog")
    got = per.groupBy("species", kind.alias("kind")).agg(F.sum("n").alias("n"))
    rest = with_totals(groups.groupBy("species").agg(F.count("*").alias("in_groups")), totals)
    rest = rest.select("species", F.lit("unclustered").alias("kind"), (F.col("n_genes") - F.coalesce("in_groups", F.lit(0))).alias("n"))
    return got.unionByName(rest)


def cluster_summary(groups: DataFrame, order: str = "gene") -> DataFrame:
    """group_id, genes, species, members: all members counted, listed in order."""
    members = F.sort_array(F.collect_list(F.struct(order, F.concat_ws("|", "species", "gene").alias("m"))))
    return groups.groupBy("group_id").agg(F.count("*").alias("genes"), F.count_distinct("species").alias("species"), F.array_join(F.transform(members, lambda x: x["m"]), ",").alias("members"))


def venn_regions(groups: DataFrame, species: list[str]) -> DataFrame:
    """region, n: groups by the exact set of the chosen species they hold."""
    sets = groups.where(F.col("species").isin(species)).groupBy("group_id").agg(F.array_join(F.array_sort(F.collect_set("species")), "+").alias("region"))
    return sets.groupBy("region").agg(F.count("*").alias("n"))


def species_lists(groups: DataFrame) -> DataFrame:
    """species, group_id: the distinct groups of each species."""
    return groups.select("species", "group_id").distinct()


def clade_filter(counts: DataFrame, clades: dict[str, list[str]], mode: str = "and") -> DataFrame:
    """group_id of families of which each clade ('or': any two species) has two species with copies; no clades: any two species."""
    held = F.col("n") > 0
    each = [F.count_if(held & F.col("species").isin(s)) >= 2 for s in clades.values()]
    wide = F.count_if(held) >= 2
    keep = wide
    if each:
        every = each[0]
        for e in each[1:]:
            every = every & e
        keep = every if mode == "and" else every | wide
    return counts.groupBy("group_id").agg(keep.alias("keep")).where("keep").select("group_id")


def size_split(counts: DataFrame, most: int = 100) -> DataFrame:
    """group_id, route: ``large`` where a species has ``most`` copies or more, else ``main``."""
    return counts.groupBy("group_id").agg(F.when(F.max("n") >= most, "large").otherwise("main").alias("route"))


def unclustered(genes: DataFrame, groups: DataFrame) -> DataFrame:
    """Genes (species, gene) that no group holds."""
    return genes.join(groups.select("species", "gene"), ["species", "gene"], "left_anti")


def _species(gene: str) -> Column:
    return F.split_part(gene, F.lit("|"), F.lit(1))


def _good(e: Column, pct: Column, exponent: float, percent: float) -> Column:
    return (F.log10(e) <= exponent) & (pct >= percent)


def _rank(e: Column, bits: Column) -> Column:
    return F.struct(e.alias("e"), (-bits).alias("bits"))


def good_hits(hits: DataFrame, exponent: float = -5.0, percent: float = 50.0) -> DataFrame:
    """Hits between genes with an e-value exponent of at most ``exponent`` and at least ``percent`` matched."""
    return hits.where(_good(F.col("e"), F.col("pct"), exponent, percent))


def ortholog_pairs(hits: DataFrame, exponent: float = -5.0, percent: float = 50.0) -> DataFrame:
    """qry, sub: best hits between species that hold in both directions; ties all stay.

    The best are taken for each query and target species, by e-value and then bits, so the window's groups are one gene's hits.
    """
    good = good_hits(hits, exponent, percent).withColumn("other", _species("sub")).where(_species("qry") != F.col("other"))
    first = F.rank().over(W.partitionBy("qry", "other").orderBy("e", F.desc("bits")))
    best = good.withColumn("r", first).where("r = 1").select("qry", "sub")
    return _both_ways(best)


def in_paralogs(hits: DataFrame, exponent: float = -5.0, percent: float = 50.0) -> DataFrame:
    """qry, sub: hits within a species, in both directions, that are at least as good, by e-value and then bits, as the best hit of
    each gene in another species; a gene without such a hit sets no limit."""
    return _both_ways(_within_limits(hits, exponent, percent))


def _within_limits(hits: DataFrame, exponent: float, percent: float) -> DataFrame:
    """qry, sub: hits within a species that are at least as good as the best hit of their query in another species."""
    good = good_hits(hits, exponent, percent).where("qry <> sub").select("qry", "sub", _rank(F.col("e"), F.col("bits")).alias("rank"), (_species("qry") != _species("sub")).alias("across"))
    # one gene's hits meet, so hits are made once, not once for the limits and once more for what they limit
    limit = F.min(F.when(F.col("across"), F.col("rank"))).over(W.partitionBy("qry"))
    kept = good.withColumn("limit", limit).where(~F.col("across")).where(_in_limit(F.col("rank")))
    return kept.select("qry", "sub")


#: Of two genes, structs: e, bits and pct of the first's hit on the second.
Score = Callable[[Column, Column], tuple[Column, Column, Column]]


def in_paralogs_of_groups(genes: DataFrame, score: Score, exponent: float = -5.0, percent: float = 50.0) -> DataFrame:
    """qry, sub: ``in_paralogs`` of the hits of every two genes of a group, of which few need be rows.

    ``genes``: group_id, species, gene and what ``score`` reads. A pair that several groups hold has their highest e, bits and pct.

    From each of its groups a gene sends the best hit in another species, the hits within its own that this leaves, and hashes of all
    partners. Where no hash comes twice, each pair is in one group and that is enough; all hits are made of the other genes only.
    """
    named = genes.withColumn("qry", F.concat_ws("|", "species", "gene")).where("group_id is not null and species is not null and gene is not null")
    across = F.filter("found", lambda h: h["across"] & _good(h["e"], h["pct"], exponent, percent))
    within = F.filter("found", lambda h: ~h["across"] & _good(h["e"], h["pct"], exponent, percent) & _in_limit(_rank(h["e"], h["bits"])))
    told = _found_in_groups(named, score).withColumn("limit", F.array_min(F.transform(across, lambda h: _rank(h["e"], h["bits"])))).withColumn("fit", F.transform(within, lambda h: F.struct(h["sub"].alias("sub"), h["e"].alias("e"), h["bits"].alias("bits"))))
    told = told.select("qry", "group_id", "limit.e", "limit.bits", F.when(F.size("fit") > 0, F.col("fit")).alias("fit"), F.transform("found", lambda h: F.hash(h["sub"])).alias("marks"))
    # dealt out first: lists begun in a group's task would be sorted there too, and are longer
    met = told.repartition("qry").groupBy("qry").agg(F.collect_list(F.struct("group_id", "e", "bits", "fit", "marks")).alias("told"))
    met = met.withColumn("limit", F.array_min(F.transform(F.filter("told", lambda g: g["e"].isNotNull()), lambda g: F.struct(g["e"], g["bits"])))).withColumn("marks", F.flatten("told.marks"))
    met = met.withColumn("twice", F.size("marks") > F.size(F.array_distinct("marks"))).withColumn("fit", F.flatten(F.filter("told.fit", lambda x: x.isNotNull())))
    # one list of both, which needs all that was dealt out whichever is read, so that it is dealt out once
    kept = F.transform(F.filter("fit", lambda h: ~F.col("twice") & _in_limit(_rank(h["e"], h["bits"]))), lambda h: h["sub"])
    said = met.withColumn("sub", kept).withColumn("again", F.filter("told.group_id", lambda _: F.col("twice"))).select("qry", F.inline(F.arrays_zip("sub", "again")))
    wanted = said.where("again is not null").groupBy(F.col("again").alias("group_id")).agg(F.collect_set("qry").alias("wanted"))
    hits = _found_in_groups(named.join(wanted, "group_id"), score).where(F.array_contains("wanted", F.col("qry"))).select("qry", F.inline("found"))
    hits = hits.repartition("qry").groupBy("qry", "sub").agg(*(F.max(c).alias(c) for c in ("e", "bits", "pct")))
    return _both_ways(said.where("sub is not null").select("qry", "sub").unionByName(_within_limits(hits, exponent, percent)))


def _in_limit(rank: Column) -> Column:
    return F.col("limit").isNull() | (rank <= F.col("limit"))


def _found_in_groups(genes: DataFrame, score: Score) -> DataFrame:
    """Genes that are not alone in a group, and as ``found`` their hits there: sub, across, e, bits, pct."""
    own = F.struct("qry", _species("qry").alias("_head"), *(c for c in genes.columns if c not in ("group_id", "species", "gene", "qry", "wanted")))
    listed = genes.withColumn("_own", own).withColumn("_mates", F.collect_list("_own").over(W.partitionBy("group_id"))).where(F.size("_mates") > 1)

    def hit(mate: Column) -> Column:
        e, bits, pct = score(F.col("_own"), mate)
        return F.struct(mate["qry"].alias("sub"), (mate["_head"] != F.col("_own._head")).alias("across"), e.alias("e"), bits.alias("bits"), pct.alias("pct"))

    return listed.withColumn("found", F.transform(F.filter("_mates", lambda m: m["qry"] != F.col("qry")), hit)).drop("_own", "_mates")


def _both_ways(pairs: DataFrame) -> DataFrame:
    """The pairs that are there in both directions, once each: the two directions of a pair are one key, seen from both its ends."""
    ends = pairs.where("qry is not null and sub is not null").groupBy(F.least("qry", "sub").alias("_a"), F.greatest("qry", "sub").alias("_b"))
    return ends.agg(F.bool_or(F.col("qry") < F.col("sub")).alias("_up"), F.bool_or(F.col("qry") > F.col("sub")).alias("_down")).where("_up and _down").select(F.col("_a").alias("qry"), F.col("_b").alias("sub"))


def best_hit(hits: DataFrame) -> DataFrame:
    """qry, sub, bits: the hit of most bits for each query; equal ones by name."""
    top = F.max_by(F.struct("sub", "bits"), F.struct("bits", "sub"))
    return hits.groupBy("qry").agg(top.alias("t")).select("qry", "t.sub", "t.bits")
