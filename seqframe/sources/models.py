"""Results of model fits, demographic curves, distances and trees. Input: numbered lines (source_file, line_no, line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lines import carried, file_name, number, pick

NUMBER = r"(-?[\d.]+(?:[eE][-+]?\d+)?)"
LNL = r"^lnL\(.*np:\s*(\d+)\):\s*(-?[\d.]+)"


def codeml_branch(lines: DataFrame) -> DataFrame:
    """cluster, model, np, lnl, w1, w2: one ratio gives both w, and the model name ``All``; else the file's name after ``_``.

    ``lines`` may also be whole reports (source_file, text), one row for each: these are read where they are, without a shuffle.
    """
    one, two = rf"^omega \(dN/dS\) =\s*{NUMBER}", rf"^w \(dN/dS\) for branches:\s*{NUMBER}\s+{NUMBER}"
    kinds = {"np": (LNL, 1, "bigint"), "lnl": (LNL, 2, "double"), "w": (one, 1, "double"), "w1": (two, 1, "double"), "w2": (two, 2, "double")}
    if "text" in lines.columns:
        told = lines.select("source_file", F.split("text", "\r?\n").alias("told"))
        most = lambda pattern, group, kind: F.array_max(F.transform("told", lambda c: number(F.nullif(F.regexp_extract(c, pattern, group), F.lit("")), kind)))
        # a list of one, so that the numbers are taken out once and not again for each use of them
        found = told.select("source_file", F.explode(F.array(F.struct(*[most(*k).alias(name) for name, k in kinds.items()]))).alias("x")).select("source_file", "x.*")
    else:
        found = lines.groupBy("source_file").agg(*[F.max(number(pick(F.col("line"), pattern, group), kind)).alias(name) for name, (pattern, group, kind) in kinds.items()])
    name = file_name(F.col("source_file"))
    model = F.when(F.col("w").isNotNull(), "All").otherwise(F.regexp_extract(name, r"_([^_]*)$", 1))
    return found.where("lnl is not null").select(F.regexp_replace(name, r"_[^_]*$", "").alias("cluster"), model.alias("model"), "np", "lnl", F.coalesce("w", "w1").alias("w1"), F.coalesce("w", "w2").alias("w2"))


def _tips(tree: Column, value: str) -> Column:
    """Tips of a tree line and what follows them: arrays of names and numbers."""
    pattern = rf"[(,]\s*([A-Za-z][\w.|-]*)\s*(?:#|:)\s*{NUMBER}"
    names, numbers = F.regexp_extract_all(tree, F.lit(pattern), F.lit(1)), F.regexp_extract_all(tree, F.lit(pattern), F.lit(2))
    return F.map_from_arrays(names, F.transform(numbers, lambda x: x.cast("double"))).alias(value)


def codeml_freeratio(lines: DataFrame) -> DataFrame:
    """cluster, species, len, n, s, dn, ds, w, ndn, sds of every tip: sites from the last branch row, rates from the three trees."""
    c = F.col("line")
    branch = rf"^\s*\d+\.\.\d+\s+{NUMBER}\s+{NUMBER}\s+{NUMBER}"
    headed = carried(lines, F.when(c.rlike(r"^(dS tree:|dN tree:|w ratios as)"), F.regexp_extract(c, r"^(dS|dN|w)", 1)), "head")
    after = lambda head: F.when(F.col("head") == head, F.when(c.startswith("("), c))
    rows = headed.select("source_file", "line_no", c, after("dS").alias("ds"), after("dN").alias("dn"), after("w").alias("w"))
    last = F.max_by(F.struct(pick(c, branch, 2).cast("double").alias("n"), pick(c, branch, 3).cast("double").alias("s")), F.when(c.rlike(branch), F.col("line_no")))
    got = rows.groupBy("source_file").agg(F.max(F.when(F.col("line_no") == 0, number(pick(c, r"^\s*\d+\s+(\d+)")))).alias("len"), last.alias("x"), *[F.max(k).alias(k) for k in ("ds", "dn", "w")])
    wide = got.where("ds is not null").select(file_name(F.col("source_file")).alias("cluster"), "len", "x.n", "x.s", _tips(F.col("ds"), "ds_of"), _tips(F.col("dn"), "dn_of"), _tips(F.col("w"), "w_of"))
    keys = F.array_sort(F.array_union(F.map_keys("ds_of"), F.array_union(F.map_keys("dn_of"), F.map_keys("w_of"))))
    tips = wide.select("*", F.explode(keys).alias("species"))
    out = tips.select("cluster", "species", "len", "n", "s", *[F.try_element_at(f"{k}_of", F.col("species")).alias(k) for k in ("dn", "ds", "w")])
    return out.withColumn("ndn", F.col("n") * F.col("dn")).withColumn("sds", F.col("s") * F.col("ds"))


def clade_rates(fits: DataFrame, marked: DataFrame) -> DataFrame:
    """cluster, label, dn, ds, w of marked branches: ``fits`` (cluster, dn_tree, ds_tree, w_tree) against ``marked`` (cluster,
    label, up). The branch ``up`` levels above a label is named by the label and that many closing brackets."""
    joined = fits.join(marked, "cluster")
    number_of = lambda tree: number(F.expr(f"nullif(regexp_extract({tree}, concat('[(,]\\\\s*\\\\Q', label, '\\\\E[^()]*', repeat('\\\\)[^()]*?', up - 1), '\\\\)\\\\s*[#:]\\\\s*(-?[0-9.]+)'), 1), '')"), "double")
    return joined.select("cluster", "label", *[number_of(f"{k}_tree").alias(k) for k in ("dn", "ds", "w")])


def codeml_branchsite(lines: DataFrame) -> DataFrame:
    """cluster, species, kind (fix or nofix), lnl, w, sites: paths end in cluster/species/kind; files without lnL have no row.

    w is the larger foreground value, sites the list of (pos, aa, prob), null if there are none.
    """
    c = F.col("line")
    fore = rf"^foreground w\s+{NUMBER}\s+{NUMBER}\s+{NUMBER}\s+{NUMBER}"
    site = r"^\s*(\d+) ([A-Z*-]) ([\d.]+)\**\s*$"
    # where the wanted list begins and ends, and what looks like a site: only these meet, as one list for each file
    mark = F.when(c.startswith("Bayes Empirical Bayes"), True).when(c.startswith("The grid"), False)
    entry = F.when(c.rlike(site), F.struct(number(pick(c, site, 1), "int").alias("pos"), pick(c, site, 2).alias("aa"), number(pick(c, site, 3), "double").alias("prob")))
    told = F.collect_list(F.when(mark.isNotNull() | entry.isNotNull(), F.struct("line_no", mark.alias("mark"), entry.alias("site"))))
    used = lines.where(c.rlike(LNL) | c.rlike(fore) | c.rlike(site) | mark.isNotNull())
    got = used.groupBy("source_file").agg(F.max(number(pick(c, LNL, 2), "double")).alias("lnl"), F.max(F.greatest(number(pick(c, fore, 3), "double"), number(pick(c, fore, 4), "double"))).alias("w"), told.alias("told"))
    got = got.withColumn("marks", F.filter("told", lambda v: v["mark"].isNotNull()))
    last = lambda v: F.array_max(F.transform(F.filter("marks", lambda m: m["line_no"] < v["line_no"]), lambda m: F.struct(m["line_no"].alias("line_no"), m["mark"].alias("mark"))))
    listed = F.filter("told", lambda v: v["site"].isNotNull() & F.coalesce(last(v)["mark"], F.lit(False)))
    got = got.withColumn("sites", F.sort_array(F.transform(listed, lambda v: v["site"])))
    part = lambda k: F.element_at(F.split("source_file", "/"), k)
    return got.where("lnl is not null").select(part(-3).alias("cluster"), part(-2).alias("species"), F.regexp_replace(part(-1), r"\..*$", "").alias("kind"), "lnl", "w", F.when(F.size("sites") > 0, F.col("sites")).alias("sites"))


def missing_fits(lines: DataFrame) -> DataFrame:
    """source_file of reports without a likelihood."""
    return lines.groupBy("source_file").agg(F.max(F.col("line").rlike(LNL)).alias("ok")).where(~F.col("ok")).select("source_file")


def read_psmc(lines: DataFrame) -> DataFrame:
    """sample, round, fit, theta, rho, dt, k, t, lam: the bins (RS) of every round with its RD, RI, TR and DT lines."""
    # of the lines used only the numbers travel on
    field = lambda i, kind="double": number(F.split_part("line", F.lit("\t"), F.lit(i)), kind)
    of = lambda *tags: F.col("tag").isin(*tags)
    rows = lines.withColumn("tag", F.split_part("line", F.lit("\t"), F.lit(1))).where(of("RD", "RI", "TR", "DT", "RS"))
    kept = [c for c in ("source_file", "line_no", "split") if c in lines.columns]
    rows = rows.select(*kept, "tag", F.when(of("RD", "RS"), field(2, "bigint")).alias("n"), F.when(of("RI", "TR", "DT"), field(2)).when(of("RS"), field(3)).alias("a"), F.when(of("TR"), field(3)).when(of("RS"), field(4)).alias("b"))
    rows = carried(rows, F.when(of("RD"), F.col("n")), "round")
    own = W.partitionBy("source_file", "round")
    for name, tag, value in (("fit", "RI", "a"), ("theta", "TR", "a"), ("rho", "TR", "b"), ("dt", "DT", "a")):
        rows = rows.withColumn(name, F.max(F.when(of(tag), F.col(value))).over(own))
    return rows.where("tag = 'RS'").select(file_name(F.col("source_file")).alias("sample"), "round", "fit", "theta", "rho", "dt", F.col("n").alias("k"), F.col("a").alias("t"), F.col("b").alias("lam"))


def read_pair_distance(lines: DataFrame) -> DataFrame:
    """element, distance: second number of the first data row of a 2 x 2 matrix; the element is the file's folder."""
    data = lines.where(F.col("line").rlike(rf"^\s*\S+\s+{NUMBER}\s+{NUMBER}\s*$"))
    top = F.min_by("line", "line_no")
    got = data.groupBy("source_file").agg(top.alias("line"))
    return got.select(F.element_at(F.split("source_file", "/"), -2).alias("element"), number(pick(F.col("line"), rf"^\s*\S+\s+{NUMBER}\s+{NUMBER}", 2), "double").alias("distance"))


def merge_distances(distances: DataFrame, families: DataFrame) -> DataFrame:
    """element, family, distance."""
    return distances.join(families.select("element", "family"), "element").select("element", "family", "distance")


def read_time_tree(lines: DataFrame) -> DataFrame:
    """tree_id, ord, length, ci_lo, ci_hi: branch lengths and intervals of each file's last ``tree`` line, in order."""
    c = F.col("line")
    tree = lines.where(F.lower(c).rlike(r"^\s*u?tree\s+\S+\s*=")).groupBy("source_file").agg(F.max_by("line", "line_no").alias("tree"))
    part = rf"(?:\[&[^\]]*\{{\s*{NUMBER}\s*,\s*{NUMBER}\s*\}}\s*\])?\s*:\s*{NUMBER}"
    pick_all = lambda g: F.regexp_extract_all("tree", F.lit(part), F.lit(g))
    rows = tree.select(file_name(F.col("source_file")).alias("tree_id"), F.posexplode(F.arrays_zip(pick_all(3).alias("length"), pick_all(1).alias("ci_lo"), pick_all(2).alias("ci_hi"))).alias("ord", "x"))
    return rows.select("tree_id", F.col("ord").cast("bigint").alias("ord"), *[number(F.nullif(F.col("x")[k], F.lit("")), "double").alias(k) for k in ("length", "ci_lo", "ci_hi")])
