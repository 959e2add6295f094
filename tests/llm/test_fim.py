"""The fill-in-middle operator against a plain version that counts characters."""

import random
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqframe.llm import fim

TEXTS = ["", "a", "é", "𝔘", "plain words of one byte", "ßtraße é 中文 𝔘 mixed " * 40, "a <P> b", "x <S", "S> y < P>", "<M>", "中" * 5000 + "a" * 5000 + "é" * 5000, "\x00\t\n  end ", "word " * 40_000 + "é"]


def plain(doc_id, text):
    text = text or ""
    n = len(text)
    if doc_id is None:
        return n, "plain", None, None, text
    m = sha256(f"1:{doc_id}".encode()).hexdigest()
    h = [int(m[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = "<P>" + text[:a], "<M>" + text[a:b], "<S>" + text[b:]
    return (n, "spm", a, b - a, s + p + m) if h[3] % 100 < 20 else (n, "psm", a, b - a, p + s + m)


def test_forms_cuts_and_restored_texts(spark):
    rows = [(k, TEXTS[k % len(TEXTS)] if k % 29 else None) for k in range(400)] + [(None, "no id"), (7, "again"), (7, "again")]
    docs = spark.createDataFrame([(i, t, "kept", "clash") for i, t in rows], "doc_id long, text string, _key string, FORM string").repartition(3)
    out = fim.transform(docs)
    assert out.columns == ["doc_id", "text", "_key", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows) and {r._key for r in got} == {"kept"}
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    digests = {(r.doc_id, r.output_sha256, r.restored_sha256) for r in fim.report(docs).collect()}
    assert digests == {(i, sha256(plain(i, t)[4].encode()).hexdigest(), sha256((t or "").encode()).hexdigest()) for i, t in rows}


def test_empty_table(spark):
    assert fim.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("bound,step", [(fim.BOUND, fim.STEP), (2, 4), (0, 3)])
def test_rank_index_is_exact(monkeypatch, bound, step):
    """Every boundary comes back, and segments keep within their bound, whatever the mix of widths."""
    monkeypatch.setattr(fim, "BOUND", bound)
    monkeypatch.setattr(fim, "STEP", step)
    rng = random.Random(5)
    texts = [*TEXTS, *("".join(rng.choice("aé中𝔘") * rng.choice((1, 3, 200)) for _ in range(60)) for _ in range(20))]
    for t in texts[:-1] if bound else texts:
        raw = t.encode()
        index = fim.RankIndex(raw)
        cuts = list(range(len(t) + 1)) if len(t) < 30_000 else rng.sample(range(len(t) + 1), 500)
        assert index.n == len(t)
        assert index.offsets(cuts) == [len(t[:k].encode()) for k in cuts]
        assert np.abs(index.rest.astype(int)).max() <= bound + 1


def test_one_segment_where_widths_do_not_change():
    assert len(fim.RankIndex(b"x" * 100_000).starts) == 1
    assert len(fim.RankIndex(("x" * 1000 + "é" * 1000).encode()).starts) == 2
    mixed = "".join(random.Random(1).choice("aaaaaaaé") for _ in range(50_000))
    assert len(fim.RankIndex(mixed.encode()).starts) < 200
