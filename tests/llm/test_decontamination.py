"""Sketches by size, and many items of one text, against plain sets of shingles."""

import random
from collections import Counter, defaultdict

from test_text_operators import frame, plain_contained, prose

from seqframe.llm import decontaminate

ITEMS = "item_id long, text string"


def test_many_items_of_one_text(spark):
    """300 items of one to nine words that one text of 6,000 words holds, in a table with copies and repeated rows."""
    rng = random.Random(3)
    words = prose(6000, 5).split(" ")
    items = []
    for k in range(300):
        n, a = rng.choice((1, 1, 1, 2, 4, 5, 6, 9)), rng.randrange(5900)
        items.append((k, " ".join(words[a : a + n])))
    items += [(1000, "never there at all"), (5, items[5][1]), (None, items[6][1]), (1001, None)]
    docs = frame(spark, [(1, " ".join(words), "x"), (1, " ".join(words), "x"), (2, " ".join(words[:700]), "x"), (3, prose(50, 9), "x"), (4, None, "x")])
    got = Counter((r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in decontaminate.report(docs, spark.createDataFrame(items, ITEMS)).collect())
    assert got == plain_contained([(r.doc_id, r.text) for r in docs.collect()], items) and got.total() > 700


def test_sketches_of_a_partition(spark, monkeypatch):
    """Items of a partition have sketches of one size: all hashes of short ones, else the least but for common ones."""
    monkeypatch.setattr(decontaminate, "COMMON", 3)
    same = prose(12, 1)
    items = [(k, f"{same} {prose(18, 10 + k)}") for k in range(6)] + [(10 + k, prose(4 + k, 40 + k)) for k in range(9)] + [(20, same)]
    df = decontaminate.with_width(spark.createDataFrame(items, ITEMS).selectExpr("item_id AS item", "text"))
    sketched, every = defaultdict(list), {}
    for r in decontaminate.sketches(df).collect():
        sketched[r.item].append((r.h, r.size, r.needed))
    hashes = decontaminate._by_width(df, decontaminate.shingle_hashes, "h").collect()
    shared = defaultdict(int)
    for r in hashes:
        every[r.item] = r.h
        for h in r.h:
            shared[h] += 1
    for item, hs in every.items():
        n, need = len(hs), -(-len(hs) * 4 // 5)
        kept = n if n < decontaminate.SHORT else n - need + 1
        assert {x[1:] for x in sketched[item]} == {(n, need)}
        assert {x[0] for x in sketched[item]} == set(sorted(hs, key=lambda h: (shared[h] > 3, h))[:kept])
    assert any(shared[h] > 3 for h in every[0]) and not any(shared[x[0]] > 3 for x in sketched[0])
