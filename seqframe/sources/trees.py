"""Trees in brackets as node tables, and back.

A tree's text is one row, so it is read within it, a token at a time; brackets and nodes never travel on their own.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lines import file_name, number, pick, read_lines
from .models import LNL, NUMBER

#: A bracket, a comma, or a run of anything else; what stands in square brackets or quotes is one.
TOKEN = re.compile(r"[(),]|(?:\[[^\]]*\]|'[^']*'|[^(),;\[\]'])+", re.ASCII)
COMMENT = re.compile(r"\[[^\]]*\]")
LABEL = re.compile(r"'[^']*'|[^\s:#]+", re.ASCII)
LENGTH, MARK = (re.compile(rf"{c}\s*{NUMBER}", re.ASCII) for c in ":#")
INTERVAL = re.compile(rf"\[&[^\]]*\{{\s*{NUMBER}\s*,\s*{NUMBER}\s*\}}\s*\]", re.ASCII)
FIELDS = (("node", pa.int64()), ("post", pa.int64()), ("depth", pa.int64()), ("parent", pa.int64()), ("tip", pa.bool_()), ("size", pa.int64()), ("label", pa.string()), ("length", pa.float64()), ("mark", pa.float64()), ("ci_lo", pa.float64()), ("ci_hi", pa.float64()))
KINDS = {pa.int64(): T.LongType(), pa.bool_(): T.BooleanType(), pa.string(): T.StringType(), pa.float64(): T.DoubleType()}


def _value(found: re.Match | None, group: int = 1) -> float | None:
    try:
        return float(found[group]) if found else None
    except ValueError:
        return None


def _read(tree: str, out: list[list]) -> int:
    """Adds a tree's nodes to the columns ``out``, children before parents; their number."""
    tokens = [t for x in TOKEN.findall(tree) if (t := x.strip(" "))]
    opened, nodes = [], []
    for pos, token in enumerate(tokens):
        if token == "(":
            opened.append(pos)
        elif token == ")":
            text = tokens[pos + 1] if pos + 1 < len(tokens) and tokens[pos + 1] not in ("(", ")", ",") else ""
            if opened:
                nodes.append((opened.pop(), len(opened), opened[-1] if opened else -1, False, text))
        elif token != "," and (pos == 0 or tokens[pos - 1] != ")"):
            nodes.append((pos, len(opened), opened[-1] if opened else -1, True, token))
    of = {first: k for k, first in enumerate(sorted(n[0] for n in nodes))}
    for post, (first, depth, around, tip, text) in enumerate(nodes):
        bare = COMMENT.sub(" ", text) if "[" in text else text
        label = LABEL.match(bare.strip(" "))
        ci = INTERVAL.search(text) if "[" in text else None
        name = re.sub("^'|'$", "", label[0]) or None if label else None
        row = (of[first], post, depth, of.get(around), tip, post - of[first] + depth, name, _value(LENGTH.search(bare)), _value(MARK.search(bare)) if "#" in bare else None, _value(ci), _value(ci, 2))
        for column, value in zip(out, row):
            column.append(value)
    return len(nodes)


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField(n, KINDS[t]) for n, t in FIELDS])))
def nodes_of(tree: pa.Array) -> pa.Array:
    """The nodes of a tree's text, children before parents; none of a null."""
    columns, ends = [[] for _ in FIELDS], [0]
    for text in tree.to_pylist():
        ends.append(ends[-1] + _read(text or "", columns))
    rows = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, FIELDS)], [n for n, _ in FIELDS])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)


def tree_nodes(trees: DataFrame, by: list[str], tree: str = "tree") -> DataFrame:
    """by, node, post, depth, parent, tip, size, label, length, mark, ci_lo, ci_hi: a row for each node of each tree.

    ``node`` numbers a tree's nodes from 0, parents before children and siblings in the text's order, ``post`` children before
    parents; the root's ``parent`` is null. ``size`` counts the nodes below, which are node + 1 to node + size. What follows a
    node's text or closing bracket gives its label, its length (after ``:``), its mark (after ``#``) and its interval (in square
    brackets); what is missing is null. Roots may have any number of children. A null or empty tree has no rows.
    """
    return trees.select(*by, nodes_of(tree).alias("_nodes")).select(*by, F.inline("_nodes"))


def tree_text(nodes: DataFrame, by: list[str], digits: int = 6) -> DataFrame:
    """by, tree: the text of ``tree_nodes``, numbers with ``digits`` places; a tree's nodes meet in one row."""
    show = lambda c: F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}f", c))
    tail = F.concat(
        F.coalesce("label", F.lit("")),
        F.coalesce(F.concat(F.lit(" #"), show("mark")), F.lit("")),
        F.coalesce(F.concat(F.lit(" [&95%={"), show("ci_lo"), F.lit(", "), show("ci_hi"), F.lit("}]")), F.lit("")),
        F.coalesce(F.concat(F.lit(": "), show("length")), F.lit("")),
    )
    # a first child comes next after its parent
    comma = F.when(F.col("node") != F.col("parent") + 1, ", ").otherwise("")
    rows = nodes.select(*by, "post", "depth", "size", "tip", tail.alias("tail"), comma.alias("comma"))
    # an inner node opens before the first tip below it, and closes in its turn
    opens = F.struct((F.col("post") - F.col("size")).alias("at"), F.lit(0).alias("kind"), "depth", F.concat("comma", F.lit("(")).alias("text"))
    closes = F.struct(F.col("post").alias("at"), F.lit(1).alias("kind"), "depth", F.when(F.col("tip"), F.concat("comma", "tail")).otherwise(F.concat(F.lit(")"), "tail")).alias("text"))
    parts = rows.select(*by, F.explode(F.when(F.col("tip"), F.array(closes)).otherwise(F.array(opens, closes))).alias("x"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["text"]), "")
    return parts.groupBy(*by).agg(F.concat(joined, F.lit(";")).alias("tree"))


def time_tree_nodes(lines: DataFrame) -> DataFrame:
    """tree_id and the nodes of each file's last ``tree`` line."""
    c = F.col("line")
    mark = r"^\s*u?tree\s+\S+\s*="
    last = lines.where(F.lower(c).rlike(mark)).groupBy("source_file").agg(F.max_by("line", "line_no").alias("line"))
    return tree_nodes(last.select(file_name(F.col("source_file")).alias("tree_id"), F.regexp_replace(c, f"(?i){mark}", "").alias("tree")), ["tree_id"])


def read_time_tree_nodes(spark: SparkSession, path: str | list[str], large: bool = False) -> DataFrame:
    """The nodes of each file's last tree: tree_id, node, post, depth, parent, tip, size, label, length, ci_lo, ci_hi."""
    return time_tree_nodes(read_lines(spark, path, large))


def _folder(up: int) -> Column:
    """The name of the folder so many levels up from a file."""
    return F.element_at(F.split("source_file", "/"), -1 - up)


def _marked(nodes: Column) -> Column:
    """Of a tree's nodes the branch marked ``#1``, the first of several, as (last, up); null without a mark."""
    first = F.array_min(F.transform(F.filter(nodes, lambda n: n["mark"] == 1), lambda n: F.struct(*[n[c].alias(c) for c in ("post", "node", "size", "depth")])))
    below = lambda m: F.filter(nodes, lambda n: n["tip"] & n["node"].between(m["node"], m["node"] + m["size"]))
    last = F.transform(F.array(first), lambda m: F.array_max(F.transform(below(m), lambda n: F.struct(n["node"].alias("node"), n["label"].alias("last"), (n["depth"] - m["depth"]).alias("up")))))
    return F.when(first.isNotNull(), F.get(last, F.lit(0)))


def marked_branches(trees: DataFrame) -> DataFrame:
    """cluster, label, last, up: of each tree (cluster, label_of, tree) the branch marked ``#1``, the first of several, as its clade's last
    tip and the levels from that up to it. Trees without a mark have no row."""
    found = trees.select("cluster", F.col("label_of").alias("label"), nodes_of("tree").alias("_nodes")).select("cluster", "label", _marked(F.col("_nodes")).alias("x"))
    return found.where("x is not null").select("cluster", "label", "x.last", "x.up")


def _branches(nodes: Column, last: Column, up: Column) -> Column:
    """The nodes ``up`` levels above the tips named ``last``; one for each tip."""
    tips = F.filter(nodes, lambda n: n["tip"] & (n["label"] == last))
    return F.flatten(F.transform(tips, lambda t: F.filter(nodes, lambda n: (n["depth"] == t["depth"] - up) & t["node"].between(n["node"], n["node"] + n["size"]))))


def codeml_clade(lines: DataFrame, trees: DataFrame, tips: DataFrame | None = None) -> DataFrame:
    """cluster, len, label, n, s, dn, ds, ndn, sds, w, lnl of marked branches of free-ratio reports.

    ``lines`` are reports in a folder for each cluster, ``trees`` (source_file, line_no, line) files ``cluster/tree/tree.label``: the
    branch that its tree marks gives a label's rates. Of ``tips`` (label) those without a tree file stand for themselves. A label
    whose tip the report's tree lacks has no row; a branch without a number gives null.
    """
    c = F.col("line")
    branch = rf"^\s*\d+\.\.\d+\s+{NUMBER}\s+{NUMBER}\s+{NUMBER}"
    last = F.max_by(F.struct(pick(c, branch, 2).cast("double").alias("n"), pick(c, branch, 3).cast("double").alias("s")), F.when(c.rlike(branch), F.col("line_no")))
    size = F.max(F.when(F.col("line_no") == 0, number(pick(c, r"^\s*\d+\s+(\d+)"))))
    lnl = F.max_by(number(pick(c, LNL, 2), "double"), F.when(c.rlike(LNL), F.col("line_no")))
    # the three headings and the trees, few in a report; a tree belongs to the last heading before it
    head = F.when(c.rlike(r"^(dS tree:|dN tree:|w ratios as)"), F.regexp_extract(c, r"^(dS|dN|w)", 1))
    told = F.collect_list(F.when(head.isNotNull() | c.startswith("("), F.struct("line_no", head.alias("head"), F.when(head.isNull(), c).alias("tree"))))
    fits = lines.groupBy("source_file").agg(size.alias("len"), last.alias("x"), lnl.alias("lnl"), F.sort_array(told).alias("told"))
    under = lambda a, k, v: F.when((a["head"] == k) & v["head"].isNull(), v["tree"]).otherwise(a[k]).alias(k)
    none = F.struct(*[F.lit(None).cast("string").alias(k) for k in ("head", "dS", "dN", "w")])
    texts = F.aggregate("told", none, lambda a, v: F.struct(F.coalesce(v["head"], a["head"]).alias("head"), *[under(a, k, v) for k in ("dS", "dN", "w")]))
    fits = fits.select(_folder(1).alias("cluster"), "len", "x.n", "x.s", "lnl", texts.alias("t")).select("cluster", "len", "n", "s", "lnl", F.col("t.dS").alias("ds"), F.col("t.dN").alias("dn"), F.col("t.w").alias("w"))
    files = trees.where("line_no = 0").select(_folder(2).alias("cluster"), F.regexp_extract(_folder(0), r"^tree\.(.*)$", 1).alias("label"), nodes_of("line").alias("_nodes"))
    wanted = files.select("cluster", "label", _marked(F.col("_nodes")).alias("x")).groupBy("cluster").agg(F.collect_list(F.struct("label", "x.last", "x.up")).alias("wanted"))
    # trees travel as texts and are read where they meet the labels
    both = fits.join(wanted, "cluster", "left" if tips is not None else "inner").withColumns({k: nodes_of(k) for k in ("ds", "dn", "w")})
    labels = F.transform(F.filter("wanted", lambda v: v["last"].isNotNull()), lambda v: F.struct(v["label"].alias("label"), v["last"].alias("last"), v["up"].cast("long").alias("up"), F.lit(False).alias("plain")))
    labels = F.coalesce(labels, F.array().cast("array<struct<label string, last string, up bigint, plain boolean>>"))
    if tips is not None:
        own = F.array_distinct(F.transform(F.filter("ds", lambda n: n["tip"] & n["label"].isNotNull()), lambda n: n["label"]))
        own = F.array_except(own, F.coalesce(F.transform("wanted", lambda v: v["label"]), F.array().cast("array<string>")))
        labels = F.concat(labels, F.coalesce(F.transform(own, lambda v: F.struct(v.alias("label"), v.alias("last"), F.lit(0).cast("long").alias("up"), F.lit(True).alias("plain"))), F.array().cast("array<struct<label string, last string, up bigint, plain boolean>>")))
    at = lambda k, v: _branches(F.col(k), v["last"], v["up"])
    rates = F.transform(labels, lambda v: F.struct(v["label"].alias("label"), v["plain"].alias("plain"), *[F.struct(at(k, v).alias("at")).alias(k) for k in ("ds", "dn", "w")]))
    largest = lambda k, field: F.array_max(F.transform(F.col(f"x.{k}.at"), lambda n: n[field])).alias(k)
    found = F.size("x.dn.at") + F.size("x.ds.at") + F.size("x.w.at") > 0
    # not explode, before which the rates would be computed once more to ask whether there are any
    out = both.select("cluster", "len", "n", "s", "lnl", F.explode_outer(rates).alias("x")).where(found).select("cluster", "len", "n", "s", "lnl", "x.label", "x.plain", largest("dn", "length"), largest("ds", "length"), largest("w", "mark"))
    if tips is not None:
        known = tips.select("label").distinct().withColumn("known", F.lit(True))
        out = out.join(known, "label", "left").where(~F.col("plain") | F.col("known"))
    return out.select("cluster", "len", "label", "n", "s", "dn", "ds", (F.col("n") * F.col("dn")).alias("ndn"), (F.col("s") * F.col("ds")).alias("sds"), "w", "lnl")


def read_codeml_clade(spark: SparkSession, reports: str | list[str], trees: str | list[str], tips: DataFrame | None = None, large: bool = False) -> DataFrame:
    """``codeml_clade`` of report files and of the files with marked trees."""
    return codeml_clade(read_lines(spark, reports, large), read_lines(spark, trees), tips)
