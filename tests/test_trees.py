"""Trees in brackets against a plain recursive reading, written back, and rates of marked branches from files."""

import random
import re

import pytest

from seqframe.sources import readers as X
from seqframe.sources import trees as N


def plain_nodes(text):
    """Rows (node, post, depth, parent, tip, size, label, length, mark, ci_lo, ci_hi) by recursive descent."""
    rows, at, posts = [], 0, iter(range(10**6))

    def tail():
        nonlocal at
        m = re.compile(r"(?:\[[^\]]*\]|'[^']*'|[^(),;\[\]'])*").match(text, at)
        at = m.end()
        bare = re.sub(r"\[[^\]]*\]", " ", m[0]).strip()
        label = re.match(r"('[^']*'|[^\s:#]+)", bare)
        find = lambda p, s: float(x[1]) if (x := re.search(p, s)) else None
        ci = re.search(r"\[&[^\]]*\{\s*([\d.]+)\s*,\s*([\d.]+)\s*\}", m[0])
        return [label[1].strip("'") if label else None, find(r":\s*(-?[\d.]+(?:[eE][-+]?\d+)?)", bare), find(r"#\s*(-?[\d.]+)", bare), float(ci[1]) if ci else None, float(ci[2]) if ci else None]

    def one(parent, depth):
        nonlocal at
        while text[at] == " ":
            at += 1
        node = len(rows)
        rows.append(None)
        inner = text[at] == "("
        while inner:
            at += 1
            one(node, depth + 1)
            inner = text[at] == ","
        if text[at] == ")":
            closed = rows[node + 1 :] != []
            at += closed
        rest = tail()
        rows[node] = (node, next(posts), depth, parent, len(rows) == node + 1, len(rows) - node - 1, *rest)

    one(None, 0)
    return rows


def made(rng, n):
    """A tree of ``n`` tips, of two to four children a node, with lengths, marks, intervals and odd blanks here and there."""
    def tail(tip):
        out = rng.choice((f"T{rng.randrange(99)}", "'a b'", "x|y.1")) if tip else rng.choice(("", "", "N1"))
        out += rng.choice(("", "", f" #{rng.randrange(3)}", " #0.25"))
        out += rng.choice(("", f" [&95%={{{rng.randrange(9)}.5, 1{rng.randrange(9)}}}]", "[c(o,m)]"))
        return out + rng.choice(("", f": {rng.randrange(100) / 8}", ":1e-3", ":  -0.5 "))

    def one(k):
        if k == 1:
            return tail(True)
        parts = []
        while k:
            j = rng.randint(1, max(1, min(k, k - 1 if not parts else k)))
            parts.append(one(j))
            k -= j
        return "(" + rng.choice((",", ", ")).join(parts) + ")" + tail(False)

    return one(n) + ";"


FIELDS = ["node", "post", "depth", "parent", "tip", "size", "label", "length", "mark", "ci_lo", "ci_hi"]


def test_nodes_equal_a_recursive_reading_and_are_written_back(spark):
    rng = random.Random(1)
    trees = {"nested": "(((A:1,B:2)ab:3,C:4):5,D:6)r;", "unrooted": "(A: 0.1, B: 0.2, (C: 0.3, D: 0.4): 0.5);", "tip": "A: 3;", "star": "(A,B,C,D,E)", "deep": "(" * 40 + "x" + "".join(f", y{k})" for k in range(40)) + ";"}
    trees |= {f"r{k}": made(rng, rng.choice((2, 3, 5, 9, 20))) for k in range(40)}
    df = spark.createDataFrame([(k, v) for k, v in trees.items()] + [("null", None), ("empty", "")], "tree_id string, tree string").repartition(3)
    nodes = N.tree_nodes(df, ["tree_id"])
    got = {}
    for r in nodes.collect():
        got.setdefault(r.tree_id, []).append(tuple(r[c] for c in FIELDS))
    assert set(got) == set(trees)
    for k, text in trees.items():
        assert sorted(got[k]) == plain_nodes(text), (k, text)
    back = {r.tree_id: r.tree for r in N.tree_text(nodes, ["tree_id"], digits=4).collect()}
    assert back["nested"] == "(((A: 1.0000, B: 2.0000)ab: 3.0000, C: 4.0000): 5.0000, D: 6.0000)r;"
    for k, text in trees.items():
        assert plain_nodes(back[k].replace("a b", "'a b'")) == plain_nodes(text)


REPORT = """ 5 300

lnL(ntime: 11  np: 16):  -1234.500000  +0.0
   7..1  0.1  10.0  10.0
   7..2  0.1  250.5  50.5  0.2

dS tree:
((({a}: 1.1, {b}: 1.2): 1.3, C: 1.4): 1.5, D: 1.6, E: 1.7);
dN tree:
((({a}: 0.1, {b}: 0.2): 0.3, C: 0.4): 0.5, D: 0.6, E: 0.7);

w ratios as labels for TreeView:
((({a} #2.1 , {b} #2.2 ) #2.3 , C #2.4 ) #2.5 , D #2.6 , E #2.7 );
"""


@pytest.mark.parametrize("large", [False, True])
def test_marked_branches_of_report_files(spark, tmp_path, large):
    for cluster, a, b in (("c1", "A", "B"), ("c2", "A1", "A")):
        folder = tmp_path / cluster
        (folder / "tree").mkdir(parents=True)
        (folder / "branch.freeratio.mlc").write_text(REPORT.format(a=a, b=b))
        (folder / "tree" / "tree.pair").write_text(f"((({a}, {b}) #1, C), D, E);\n")
        (folder / "tree" / "tree.three").write_text(f"((({a}: 1, {b}: 1): 1, C: 1) #1: 1, D: 1, E: 1);\nmore\n")
        (folder / "tree" / "tree.none").write_text(f"((({a}, {b}), C), D, E);\n")
        (folder / "tree" / "tree.tip").write_text(f"((({a}, {b} #1), C), D, E);\n")
        (folder / "tree" / "tree.gone").write_text("((X #1, Y), Z);\n")
    tips = spark.createDataFrame([("A",), ("D",), ("none",), ("pair",), ("Q",)], "label string")
    got = sorted((r.cluster, r.label, r.dn, r.ds, r.w) for r in X.read_codeml_clade(spark, str(tmp_path / "*/branch.freeratio.mlc"), str(tmp_path / "*/tree/tree.*"), tips, large=large).collect())
    branches = {"pair": (0.3, 1.3, 2.3), "three": (0.5, 1.5, 2.5), "tip": (0.2, 1.2, 2.2), "D": (0.6, 1.6, 2.6)}
    want = [(c, k, *v) for c in ("c1", "c2") for k, v in branches.items()] + [("c1", "A", 0.1, 1.1, 2.1), ("c2", "A", 0.2, 1.2, 2.2)]
    assert got == sorted(want)
    r = X.read_codeml_clade(spark, str(tmp_path / "c1/*.mlc"), str(tmp_path / "c1/tree/tree.pair"), large=large).first()
    assert (r.len, r.n, r.s, r.lnl) == (300, 250.5, 50.5, -1234.5) and (r.ndn, r.sds) == pytest.approx((250.5 * 0.3, 50.5 * 1.3))


def test_time_tree_files(spark, tmp_path):
    (tmp_path / "t.tre").write_text("#NEXUS\nBEGIN TREES;\n\tUTREE 1 = (old: 9);\n\tUTREE 2 = ((A: 1.5, B: 2.5) [&95%={0.5, 0.75}]: 3, C: 4);\nEND;")
    got = sorted((r.node, r.parent, r.label, r.length, r.ci_lo, r.ci_hi) for r in X.read_time_tree_nodes(spark, str(tmp_path)).collect())
    assert got == [(0, None, None, None, None, None), (1, 0, None, 3.0, 0.5, 0.75), (2, 1, "A", 1.5, None, None), (3, 1, "B", 2.5, None, None), (4, 0, "C", 4.0, None, None)]
