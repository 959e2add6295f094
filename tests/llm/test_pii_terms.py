"""Term spans against counts of all pairs, on corpora where documents share values and words in many ways."""

import random

from test_pipeline import plain_terms
from test_text_operators import frame, plain_base

from seqframe.llm import common, pii

LETTERS = "abcdefghijklmnop"


def word(k):
    return "w" + "".join(LETTERS[int(c, 16)] for c in f"{k:05x}")


def spans_of(text, terms):
    every = [(a, no, k, b) for a, no, k, b in plain_base(text)] + [(a, 9, "term", b) for a, b in terms]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(every))


def test_term_spans_equal_counts_of_all_pairs(spark):
    rng = random.Random(1)
    people = [(f"p{k}@mail.example.org", [word(3 * k), word(3 * k + 1)]) for k in range(25)] + [(f"10.0.0.{k}", [word(900 + k)]) for k in range(10)]
    rows = []
    for k in range(160):
        parts = [word(5000 + rng.randrange(40)) for _ in range(rng.randrange(12))]
        for value, near in rng.sample(people, rng.choice((0, 0, 0, 1, 1, 2, 12))):
            parts += [value] * rng.randrange(2) + [x for x in near if rng.random() < 0.8] * rng.randrange(1, 3)
        rng.shuffle(parts)
        rows.append((k, " ".join(parts), "x"))
    hot = " ".join(x for k in range(60) for x in (word(2000 + k), f"h{k}@mail.example.org"))
    rows += [(500, hot, "x"), (501, hot, "x"), *((510 + k, f"{word(2000 + k)} h{k}@mail.example.org", "x") for k in range(0, 60, 3))]
    terms = plain_terms({k: t for k, t, _ in rows})
    got = {r["doc_id"]: r["spans"] for r in pii.report(frame(spark, rows)).collect()}
    want = {k: spans_of(t, terms[k]) for k, t, _ in rows}
    assert got == want and sum("term" in x for x in want.values()) > 60


def test_values_and_rare_words_of_one_text_make_no_product(spark):
    """Two copies of 1,500 addresses and words, and a text that shares each of 1,500 others with another one: few pairs are made."""
    copies = " ".join(f"{word(k)} a{k}@x.org" for k in range(1500))
    shared = " ".join(f"{word(k)} b{k}@x.org" for k in range(2000, 3500))
    rows = [(1, copies, "x"), (2, copies + " ", "x"), (3, shared, "x"), *((10_000 + k, f"{word(k)} b{k}@x.org", "x") for k in range(2000, 3500))]
    rows += [(100 + k, "some plain words", "x") for k in range(90)]
    made = []
    with common.scratch() as tables:
        got = {r["doc_id"]: r["spans"] for r in pii.report(frame(spark, rows)).collect()}
        made = [t.count() for t in tables if "pii-together" in t._cut_path]
    assert got[1].count("term") == 1500 and got[3].count("term") == 1500 and got[12_000].count("term") == 1
    assert made == [1501]
