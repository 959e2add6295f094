"""The pipeline's rows against a plain version of its five stages."""

import hashlib
import math
import pathlib
import random
from collections import Counter, defaultdict

import pytest
import regex
from pyspark.sql import functions as F
from test_text_operators import DOCS, PATTERNS, groups_of, plain_base, plain_contained, plain_fingerprint, prose

import corpus_pipeline
from seqframe.llm import bpe, pii
from seqframe.llm.common import shared_dir


def plain_terms(docs):
    """rid -> spans (start, end, ratio) of terms, by counts of documents that hold a value and, outside of values, a term."""
    total, df_c, df_t, co, places = len(docs), defaultdict(set), Counter(), defaultdict(set), defaultdict(list)
    for rid, text in docs.items():
        df_t.update(set(regex.findall(r"\p{L}{3,}", text.lower())))
        base = plain_base(text)
        for m in regex.finditer(r"\p{L}+", "".join("0" if any(a <= k < b for a, _, _, b in base) else c for k, c in enumerate(text))):
            if len(m[0]) >= 3:
                places[rid].append((m[0].lower(), *m.span()))
        for a, _, kind, b in base:
            df_c[kind, text[a:b]].add(rid)
    for value, rids in df_c.items():
        for rid in rids:
            for term in {p[0] for p in places[rid]}:
                co[value, term].add(rid)
    out = defaultdict(dict)
    for (value, term), rids in co.items():
        n, c = len(rids), len(df_c[value])
        if n >= pii.TOGETHER and c >= pii.TOGETHER and total > c:
            ratio = math.log(n * total / (c * max(df_t[term], n))) / math.log(total / c)
            if ratio >= pii.GENERALISE:
                for rid in rids:
                    out[rid] |= {(a, b): max(out[rid].get((a, b), 0), ratio) for t, a, b in places[rid] if t == term}
    return out


def plain_sanitised(docs):
    terms, out = plain_terms(docs), {}
    for rid, text in docs.items():
        base = [(a, b, no, f"[{k.upper()}]") for a, no, k, b in plain_base(text)]
        free = [(a, b, 9, "" if r >= pii.REMOVE else None) for (a, b), r in terms[rid].items() if not any(a < y and x < b for x, y, _, _ in base)]
        runs = []
        for a, b, no, label in sorted(base + free, key=lambda s: (s[0], s[2])):
            if runs and a < runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b, label])
        done, at = "", 0
        for a, b, label in runs:
            assert label is not None, "no generalised term is planned in this test"
            done, at = done + text[at:a] + label, b
        out[rid] = done + text[at:]
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    items = [(1, prose(30, 901)), (2, prose(50, 902))]
    rng = random.Random(8)
    rows = [(k, prose(rng.randrange(5, 300), k), "aa", "s", 1) for k in range(60)]
    rows += [(100 + k, prose(80, 300), "aa", "s", 1) for k in range(20)]  # copies
    rows += [(200, prose(40, 5) + " " + items[0][1], "aa", "s", 1), (201, items[1][1], "bb", "s", 1), (202, None, "aa", "s", 1), (203, "12 34 --", "aa", "s", 1), (204, "", None, "s", 1)]
    rows += [(300 + k, f"{prose(40, 400 + k)} quixotry secret@mail.example.com {prose(40, 500 + k)} 10.0.0.{k}", "bb", None, None) for k in range(4)]
    rows += [(400, prose(20_000, 77), "aa", "s", 1), (None, prose(60, 78), "aa", "s", 1), (401, prose(70, 79), "aa", "s", 1), (401, prose(70, 79), "aa", "s", 1)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), rows, items


def tables(spark):
    folder = pathlib.Path(shared_dir(spark).removeprefix("file:").replace("//", "/"))
    return {p.name for p in folder.iterdir()}


def test_pipeline_rows(spark, folder):
    path, rows, items = folder
    vocabulary = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    docs = [(r[0], r[1]) for r in rows if regex.search(r"\p{L}", r[1] or "")]
    root = groups_of([plain_fingerprint(t) for _, t in docs], lambda a, b: (a ^ b).bit_count() <= 3)
    low = {}
    for (i, _), k in zip(docs, root, strict=True):
        if i is not None:
            low[k] = min(low.get(k, i), i)
    kept = {(i, t) for (i, t), k in zip(docs, root, strict=True) if i is None or low[k] == i}
    dirty = {k[0] for k in plain_contained(list(kept), items)}
    kept = {(i, t): t for i, t in kept if i not in dirty}
    clean = plain_sanitised(kept)
    own, expected = bpe.Bpe(str(vocabulary)), Counter()
    for (i, _), text in clean.items():
        ids = own.encode(text)
        expected[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), tuple(ids)] += 1
    before = tables(spark)
    got = corpus_pipeline.run(spark, path).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], tuple(r["ids"])) for r in got) == expected
    assert {200, 201, 202, 203, 204} & {r["doc_id"] for r in got} == set() and {300, 301, 302, 303, 400, None} <= {r["doc_id"] for r in got}
    assert not [n for n in tables(spark) - before if not n.startswith("pipeline-pii")]  # what the lazy last stage reads stays
    assert any("quixotry" in t for t in kept.values()) and not any("quixotry" in t or "secret" in t for t in clean.values())


def test_stages_keep_columns(spark, folder):
    path = folder[0]
    names = ["rid", "__rid", "__cuts", "__lang", "cuts", "Lang_Known", "hashes", "fp"]
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumns({c: F.lit(k) for k, c in enumerate(names)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == [*[c.split(" ")[0] for c in DOCS.split(", ")], *names]
    assert {tuple(r) for r in docs.select(*names).collect()} == {tuple(range(len(names)))}


def test_empty_documents(spark, folder, tmp_path):
    path = folder[0]
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{path}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
