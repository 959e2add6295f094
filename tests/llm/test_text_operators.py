"""The operators on edge cases, against plain versions."""

import binascii
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from seqframe.llm import bpe, chat, common, decontaminate, embedding, langid, pii, quality, simhash, substring, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b + c for a in "bdklmnprst" for b in "aeiou" for c in ("n", "r", "st", "l")]


def prose(n, seed=0, words=WORDS):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and odd texts, copies, near copies, repeated rows and a very long text."""
    base = prose(120, 1)
    near = base.split(" ")
    near[60] = "changed"
    long = prose(30_000, 2)
    rows = [(1, base, "x"), (2, base, "x"), (3, " ".join(near), "x"), (4, prose(200, 3), "y"), (5, None, "x"), (6, "", None), (7, "   \n\t ", "y"), (8, "12 !! 34", "y"), (9, "one", None), (10, "one two", "x"), (11, long, "x"), (12, prose(40, 4) + " " + base[20:700], "y"), (13, prose(34, 5), "x"), (14, prose(35, 6), "x"), (14, prose(35, 6), "x"), (None, prose(50, 7), "x"), (15, "É ǅ ß İ ſ 𝔘 中文 é  x y\x1cz", "y"), (16, "word " * 400, "x")]
    return frame(spark, rows).repartition(3)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- fingerprints


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups_of(values, linked):
    parent = list(range(len(values)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(values)):
        for b in range(a):
            if linked(values[a], values[b]):
                parent[root(a)] = root(b)
    return [root(k) for k in range(len(values))]


def test_fingerprints_and_groups(docs):
    got = docs.select("doc_id", "text").join(simhash.report(docs), "doc_id").distinct().collect()
    for r in got:
        assert int(r["fingerprint"], 16) == plain_fingerprint(r["text"])
    all_rows = docs.select("doc_id", "text").collect()
    root = groups_of([plain_fingerprint(r["text"]) for r in all_rows], lambda a, b: (a ^ b).bit_count() <= 3)
    low = {}
    for r, k in zip(all_rows, root, strict=True):
        if r["doc_id"] is not None:
            low[k] = min(low.get(k, r["doc_id"]), r["doc_id"])
    expected = Counter((r["doc_id"], low.get(k)) for r, k in zip(all_rows, root, strict=True))
    assert Counter((r["doc_id"], r["component_id"]) for r in simhash.report(docs).collect()) == expected


@pytest.mark.parametrize(("hot", "block"), [(128, 2048), (2, 2048), (2, 3)])
def test_links_keep_components_in_hot_groups(spark, hot, block):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(60)}
    seed = rng.getrandbits(64)
    fps |= {seed ^ sum(1 << b for b in rng.sample(range(20), rng.randrange(4))) for _ in range(60)} | {0, 1, 7, (1 << 63) | 3, (1 << 64) - 1}
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    found = simhash.links(df, hot, block).collect()
    as_u = lambda v: v & ((1 << 64) - 1)
    assert all((as_u(r["a"]) ^ as_u(r["b"])).bit_count() <= 3 for r in found)
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for r in found:
        parent[root(as_u(r["a"]))] = root(as_u(r["b"]))
    expected = groups_of(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    pairs = lambda roots: {tuple(sorted(x)) for x in _classes(fps, roots)}
    assert pairs([root(f) for f in fps]) == pairs(expected)
    if hot == 128:  # every link once
        n = sum((a ^ b).bit_count() <= 3 for k, a in enumerate(fps) for b in fps[:k])
        assert len(found) == n


def _classes(values, roots):
    out = {}
    for v, r in zip(values, roots, strict=True):
        out.setdefault(r, []).append(v)
    return out.values()


def test_components_of_a_chain_and_odd_edges(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 100), (7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in common.components(df).collect()}
    assert got == {i: 0 for i in range(41)} | {99: 99, 100: 99}
    assert common.components(df.limit(0)).count() == 0


def test_deduplicate_keeps_one_of_each(docs):
    kept = simhash.deduplicate(docs.withColumns({"fp": F.lit("own"), "component_id": F.lit(0), "rid": F.lit(7), "__rid": F.lit(8)}))
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert kept.columns == [*docs.columns, "fp", "component_id", "rid", "__rid"] and {(r["rid"], r["__rid"]) for r in kept.collect()} == {(7, 8)}
    report = {r["doc_id"]: r["component_id"] for r in simhash.report(docs).collect()}
    assert ids == sorted([i for i, c in report.items() if i is not None and i == c] + [None], key=str)


# --- passages


def plain_removed(texts, length=35):
    words = [split(t) for t in texts]
    n = Counter(tuple(w[k : k + length]) for w in words for k in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = set()
        for k in range(len(w) - length + 1):
            if n[tuple(w[k : k + length])] > 1:
                gone |= set(range(k, k + length))
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("unique", [True, False])
def test_substring_removal(docs, unique):
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"]) if unique else docs
    held = rows.select("doc_id", "text").collect()
    expected = Counter((r["doc_id"], *e) for r, e in zip(held, plain_removed([r["text"] for r in held]), strict=True))
    assert Counter(tuple(r) for r in substring.report(rows).collect()) == expected


def test_substring_gatherers_that_flush_often(docs, monkeypatch):
    monkeypatch.setattr(substring, "GATHER", 50)
    held = docs.select("doc_id", "text").collect()
    expected = Counter((r["doc_id"], *e) for r, e in zip(held, plain_removed([r["text"] for r in held]), strict=True))
    assert Counter(tuple(r) for r in substring.report(docs).collect()) == expected


def test_cover_meets_every_shift():
    c = set(substring.COVER)
    for d in range(substring.PERIOD):
        assert any((x + d) % substring.PERIOD in c for x in c)


def test_substring_too_short_window(docs):
    with pytest.raises(ValueError):
        substring.remove(docs, 20)


# --- benchmark


def plain_contained(docs, items, threshold=0.8):
    def words(t):
        return re.findall(r"[^\W_]+", (t or "").lower())

    def shingles(w, width):
        return {" ".join(w[k : k + width]) for k in range(len(w) - width + 1)}

    out = Counter()
    for i, t in docs:
        for j, u in items:
            width = min(5, len(words(u)))
            q = shingles(words(u), width) if width else set()
            s = shingles(words(t), width) if q else q
            if q and len(q & s) >= threshold * len(q):
                out[i, j, len(q & s), len(q)] += 1
    return out


def test_decontamination(spark):
    items = [(1, prose(30, 11)), (2, prose(60, 12)), (3, "too few words"), (4, None), (5, " -- "), (None, prose(20, 13)), (7, prose(30, 11))]
    partly = items[1][1].split(" ")
    partly[30] = "other"
    worse = list(partly)
    worse[10], worse[45] = "a", "b"
    rows = [(1, prose(5000, 14) + " " + items[0][1].upper().replace(" ", ", ") + " " + prose(3000, 15), "x"), (2, prose(30, 16) + " " + " ".join(partly), "x"), (3, prose(50, 17) + " " + " ".join(worse), "x"), (4, None, "x"), (5, "", "x"), (6, prose(200, 18), "x"), (None, items[5][1], "x"), (8, items[0][1], "x"), (8, items[0][1], "x"), (9, prose(100_000, 19) + " " + items[1][1], "x")]
    df, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(9))
    got = Counter((r["doc_id"], r["item_id"], r["n_shared"], r["n_shingles"]) for r in decontaminate.report(df, bench).collect())
    assert got == plain_contained([(r[0], r[1]) for r in rows], items)
    kept = decontaminate.decontaminate(df.withColumns({"hashes": F.lit(1), "RID": F.col("doc_id"), "__rid": F.lit(2)}), bench)
    assert sorted(r["RID"] for r in kept.collect()) == sorted(r[0] for r in rows if not any(k[0] == r[0] for k in got))
    assert kept.columns == [*df.columns, "hashes", "RID", "__rid"] and {r["__rid"] for r in kept.collect()} == {2}
    assert decontaminate.report(df, bench.limit(0)).count() == 0 and decontaminate.report(df.limit(0), bench).count() == 0


def test_short_items_in_long_documents(spark):
    items = [(k, " ".join(f"{w}{k}" for w in prose(1 + k % 8, 3000 + k).split(" "))) for k in range(80)]
    rows = [(k, prose(700, 4000 + k) + " " + t + " " + prose(700, 5000 + k), "x") for k, t in items] + [(100 + k, " ".join(reversed(t.split(" "))), "x") for k, t in items]
    got = Counter((r["doc_id"], r["item_id"], r["n_shared"], r["n_shingles"]) for r in decontaminate.report(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == plain_contained([(r[0], r[1]) for r in rows], items) and {(k, k) for k in range(80)} <= {x[:2] for x in got}


def test_items_that_share_most_shingles(spark):
    head = prose(25, 1)
    items = [(k, f"{head} {prose(4, 60 + k)}") for k in range(40)]
    rows = [(k, f"{prose(20, k)} {head} {prose(4, 60 + k)}", "x") for k in range(0, 40, 3)] + [(100, head, "x"), (101, prose(30, 9) + head, "x")]
    df, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    assert Counter((r["doc_id"], r["item_id"], r["n_shared"], r["n_shingles"]) for r in decontaminate.report(df, bench).collect()) == plain_contained([(r[0], r[1]) for r in rows], items)


def test_decontamination_beyond_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "fits", lambda df, width: False)
    monkeypatch.setattr(decontaminate, "sized", lambda df, width: df)
    item = prose(30, 11)
    df = frame(spark, [(1, prose(100, 3) + " " + item, "x"), (2, prose(100, 4), "x")])
    assert [r["doc_id"] for r in decontaminate.report(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()] == [1]


# --- personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum((2 * int(c) - 9 * (int(c) > 4)) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0


def plain_base(text):
    out = []
    for no, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((m.start(), no, kind, m.end()))
    return sorted(out)


ODD = ["a@b.c_d@e.f.g x@y", "é😀 me.you+1@mail-x.example.com.", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.255", "4111 1111 1111 1111 and 4111-1111-1111-1112, 79927398713", "+1 (499) 555-6503 +49.30.123456 +1 +12", "7" * 5000, "x" * 5000 + "@", "a@b..c .@-.- @a.b", "1.1.1.1@2.2.2.2", "+4111111111111111", "", None]


def test_base_spans(spark):
    rows = [(k, t, "x") for k, t in enumerate(ODD)] + [(50, ODD[1], "x"), (50, ODD[1], "x"), (None, ODD[2], "x")]
    df = frame(spark, rows)
    got = pii.report(df).collect()
    assert len(got) == len(rows)
    text = dict((r[0], r[1]) for r in rows)
    for r in got:
        base = plain_base(text[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(x[2] == k for x in base) for k in PATTERNS]
        assert [s for s in r["spans"].split(",") if s and not s.startswith("term")] == joined.split(",") * bool(joined)


def test_terms_that_reveal(spark):
    rows = [(k, f"{prose(30, k)} zebulon wrote to secret@mail.example.com about {prose(30, 100 + k)}", "x") for k in range(3)] + [(10 + k, f"{prose(40, 200 + k)} wrote about", "x") for k in range(60)]
    df = frame(spark, rows)
    got = {r["doc_id"]: r for r in pii.report(df).collect()}
    for k in range(3):
        text, terms = rows[k][1], [s.split(":") for s in got[k]["spans"].split(",") if s.startswith("term")]
        assert "zebulon" in [text[int(a) : int(b)] for _, a, b in terms]
        assert not {"wrote", "about"} & {text[int(a) : int(b)] for _, a, b in terms}
    clean = {r["doc_id"]: r for r in pii.sanitise(df.withColumn("rid", F.lit(1)).withColumn("cuts", F.lit(2))).collect()}
    assert "zebulon" not in clean[0]["text"] and "secret" not in clean[0]["text"] and "[EMAIL]" in clean[0]["text"]
    assert clean[0]["n_chars"] == len(clean[0]["text"]) and clean[10]["text"] == rows[3][1]
    assert pii.report(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [4096, 7])
def test_terms_far_from_the_value_and_at_every_place(spark, monkeypatch, block):
    monkeypatch.setattr(pii, "BLOCK", block)
    rows = [(k, f"Zebulon {prose(60, k)} zebulon {prose(60, 50 + k)} secret@mail.example.com {prose(60, 100 + k)} (zebulon), {prose(9, 150 + k)}", "x") for k in range(3)]
    rows += [(10 + k, prose(40, 200 + k), "x") for k in range(60)]
    df = frame(spark, rows)
    got = {r["doc_id"]: r["spans"] for r in pii.report(df).collect()}
    for k, text, _ in rows[:3]:
        terms = [s.split(":") for s in got[k].split(",") if s.startswith("term")]
        assert sorted((int(a), int(b)) for _, a, b in terms if text[int(a) : int(b)].lower() == "zebulon") == [m.span() for m in re.finditer("(?i)zebulon", text)]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert not any("zebulon" in clean[k].lower() or "secret" in clean[k] for k in range(3)) and clean[10] == rows[3][1]


def test_many_matches_in_one_text(spark):
    text = " ".join(f"a{k}@mail{k % 7}.example.com" for k in range(20_000))
    r = pii.report(frame(spark, [(1, text, "x"), (2, text, "x")])).first()
    assert r["n_email"] == 20_000 and r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in plain_base(text)).encode()).hexdigest()


def test_sanitise_nulls_and_overlaps(spark):
    df = frame(spark, [(1, None, "x"), (2, "a 1.1.1.1@2.2.2.2 b", "x"), (None, "c@d.ee", "x"), (4, "😀 +49 30 1234567 é", "x")])
    got = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert got[1] is None and got[None] == "[EMAIL]" and got[4] == "😀 [PHONE] é"
    assert not plain_base(got[2]) and got[2].startswith("a [") and got[2].endswith("] b")


# --- language, quality


def two_languages(n=40):
    a, b = WORDS[:100], ["ü" + w for w in WORDS[100:]]
    return [(k, prose(60, k, a if k % 2 else b), "aa" if k % 2 else "bb") for k in range(n)]


def test_language_profiles(spark):
    rows = two_languages()
    docs = frame(spark, rows)
    profiles = langid.fit(docs)
    counts = Counter()
    for _, t, lang in rows:
        if lang == "aa":
            for w, n in langid.words(t).items():
                for g in langid.grams(w):
                    counts[g] += n
    expected = sorted(counts, key=lambda g: (-counts[g], g))[: langid.PROFILE]
    assert sorted(profiles["aa"], key=profiles["aa"].get) == expected
    odd = frame(spark, [(100, None, None), (101, "", "aa"), (102, "123 --", "aa"), (103, "中文", None), (104, "banbanban " * 20_000, None), (None, prose(50, 3, WORDS[:100]), None), (105, "z" * 200_000, None)]).withColumns({"lang_pred": F.lit("no"), "__lang": F.lit(1), "lang_known": F.lit(2)})
    got = {r["doc_id"]: r for r in langid.predict(odd, profiles).collect()}
    assert [got[k]["lang_pred"] for k in (100, 101, 102, 103)] == ["und", "und", "und", "aa"] and got[104]["lang_pred"] == "aa" and got[None]["lang_pred"] == "aa"
    assert all(0 <= r["lang_score"] <= 1 and r["__lang"] == 1 for r in got.values())
    report = langid.report(docs).collect()
    right = {r[0]: r[2] for r in rows}
    assert all(r["lang_pred"] == right[r["doc_id"]] for r in report) and {r["held_out"] for r in report} == {True, False}
    assert {r["lang_pred"] for r in langid.report(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.report(docs.limit(0)).count() == 0
    more = docs.unionByName(odd, allowMissingColumns=True)
    kept = langid.keep_identified(more)
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [*range(40), 103, 104, 105] and kept.columns == more.columns


def test_training_cuts_long_words(spark, monkeypatch):
    monkeypatch.setattr(langid, "PIECE", 5)
    word, counts = "".join(WORDS[:30]), Counter()
    for w in [word, "ab", "abcd", "abcde"]:
        assert sum(k for _, k in langid.pieces(w)) == len(w) + 2
        for g in langid.grams(w):
            counts[g] += 1
    docs = frame(spark, [(1, f"{word} ab abcd abcde", "aa")])
    expected = sorted(counts, key=lambda g: (-counts[g], g))[: langid.PROFILE]
    got = langid.fit(docs)["aa"]
    assert sorted(got, key=got.get) == expected


def plain_distances(text, profiles):
    """The text's own n-grams in rank order, and the out-of-place distance to each profile."""
    counts = Counter(g for w in regex.findall(r"\p{L}+", text.lower()) for n in (1, 2, 3, 4) for k in range(len(w) + 3 - n) if (g := f"_{w}_"[k : k + n]) != "_")
    top = sorted(counts, key=lambda g: (-counts[g], g))[:300]
    return top, {lang: sum(abs(p[g] - k) if g in p else 400 for k, g in enumerate(top)) for lang, p in profiles.items()}


@pytest.mark.parametrize("stretch", [1 << 20, 7])
def test_out_of_place_distance(monkeypatch, stretch):
    monkeypatch.setattr(langid, "STRETCH", stretch)
    rng, letters = random.Random(1), {"a": "abcdefgh", "b": "efghijéü", "c": "ijéüß中文𝔘"}
    word = lambda lang: "".join(rng.choice(letters[lang]) for _ in range(rng.randrange(1, 9)))
    profiles = {}
    for lang in letters:
        counts = Counter(g for _ in range(2000) for g in langid.grams(word(lang)))
        profiles[lang] = {g: k for k, g in enumerate(sorted(counts, key=lambda g: (-counts[g], g))[:400])}
    scorer = langid.Scorer(profiles)
    texts = [" ".join(word(rng.choice("abc")) for _ in range(rng.randrange(1, 400))) + rng.choice(["", "! 12", " İ ǅ", " \ud800x", " zzz"]) for _ in range(60)]
    for t in [*texts, "zzz", "a", "_a_", "中"]:
        top, distances = plain_distances(t, profiles)
        assert ["".join(chr(c) for c in row if c) for row in scorer.top(t).tolist()] == top
        lang, score = scorer.score(t)
        low, second, *_ = sorted(distances.values())
        assert lang == min(sorted(distances), key=distances.get) and score == pytest.approx(0.5 + 0.5 * (second - low) / second)
    assert scorer.score("12 _")[0] == scorer.score(None)[0] == "und" and scorer.score("zzz") == ("a", 0.5)
    monkeypatch.setattr(langid, "ALPHABET", 3)
    for t in texts[:5]:
        assert scorer.score(t)[0] == min("abc", key=plain_distances(t, profiles)[1].get)


def test_quality_network(spark):
    rows = [(k, prose(80, k) if k % 2 else prose(80, k).upper().replace(" ", "!! "), "x") for k in range(80)]
    docs = frame(spark, [*rows, (100, None, "x"), (101, "", "x"), (102, prose(20_000, 9), "x"), (None, "a", "x")])
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(80)] + [(3, 0, 0), (None, 1, 0), (999, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.report(docs, labels).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 84 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [k for k in range(80) if by[k]["held_out"]]
    assert held and sum(by[k]["predicted"] == k % 2 for k in held) >= 0.9 * len(held)
    assert by[102]["predicted"] == 1
    assert {r["score"] for r in quality.report(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.report(docs.limit(0), labels).count() == 0


def test_quality_reads_every_chunk():
    net = quality.Network()
    text = "a" * 200_000 + "!!!!!!"
    whole = net.pooled(text)
    data = quality.as_bytes(text)
    assert len(whole) == -(-(len(data) - quality.WIDTH + 1) // quality.CHUNK)
    plain = sum(net.table[k].take(data[k : len(data) - quality.WIDTH + 1 + k], axis=0) for k in range(quality.WIDTH))
    assert np.allclose(np.maximum(plain.max(axis=0), 0), whole.max(axis=0), atol=1e-4)


def test_quality_scores_equal_a_plain_convolution():
    net = quality.train([prose(80, k) if k % 2 else prose(80, k).upper() for k in range(40)], [k % 2 for k in range(40)], epochs=2)
    for text in (prose(300, 5), "é中 " * 200, "", "ab", prose(40, 6).upper()):
        data = list(text.encode()) + [0] * max(0, quality.WIDTH - len(text.encode()))
        best = []
        for at in range(len(data) - quality.WIDTH + 1):
            if at % quality.CHUNK == 0:
                best.append(np.full(quality.FILTERS, -np.inf))
            best[-1] = np.maximum(best[-1], sum(net.table[k, data[at + k]].astype(float) for k in range(quality.WIDTH)))
        pooled = np.maximum(np.array(best) + net.bias, 0)
        expected = 1 / (1 + np.exp(-(np.concatenate([pooled.max(axis=0), pooled.mean(axis=0)]) @ net.weight + net.offset[0])))
        assert net.score(text) == pytest.approx(expected, abs=1e-5)


def test_quality_sample_is_bounded_and_counts_a_document_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "train", lambda texts, labels: seen.append((texts, labels)))
    docs = frame(spark, [(k, f"{prose(5, k)} {k}", "x") for k in range(2000)] + [(7, "again", "x")] * 50)
    labels = spark.range(2000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    quality.fit(docs, labels, sample=200)
    quality.fit(docs, labels)
    n = sum(binascii.crc32(str(k).encode()) % 5 != 0 for k in range(2000))
    assert 130 < len(seen[0][0]) < 270 and len(seen[1][0]) == n and set(seen[0][0]) < set(seen[1][0])


def test_quality_gradient():
    net, data = quality.Network(3), quality.as_bytes("some text!! " * 90)
    grads = [np.zeros(p.shape) for p in net.params()]
    loss = net.gradient(data, 1, grads)
    k = int(np.abs(grads[2]).argmax())
    net.weight[k] += 1e-3
    again = net.gradient(data, 1, [np.zeros(p.shape) for p in net.params()])
    assert (again - loss) / 1e-3 == pytest.approx(grads[2][k], rel=0.05)


# --- archives


def test_archives(spark):
    big, other = "x" * 1500, "é" * 700
    rows = [(1, "u1", big), (2, None, big), (3, "u\r\n3", "small"), (4, "u4", "small"), (5, "u5", None), (6, "u6", other), (7, "u7", other + "y"), (8, "u8", other), (9, "u9", big), (None, "n", big)] + [(k, f"http://h/{k}", prose(300, k)) for k in range(20, 60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(2)
    archives = warc.write(pages, archive_bytes=20_000)
    assert archives.count() > 2
    got = {r["page_id"]: r for r in warc.read(archives, payloads=True).collect()}
    last = {big: 9, other: 8}
    for i, _, html in rows:
        raw = (html or "").encode()
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        revisit = len(raw) >= 1000 and html in last and i is not None and i != last[html]
        assert (r["record_type"], r["refers_to"]) == (("revisit", last[html]) if revisit else ("response", None))
        assert r["payload"] is None if revisit else bytes(r["payload"]) == raw
    assert warc.report(pages.limit(0)).count() == 0


def test_archives_tell_rows_of_one_page_apart(spark):
    x, y = "x" * 1500, "y" * 2000
    rows = [(5, x), (9, x), (5, y), (5, "twelve bytes"), (9, x), (7, y), (3, x), (3, x), (None, x), (None, x)]
    pages = spark.createDataFrame([(i, "u", t) for i, t in rows], "page_id long, url string, html string").repartition(3)
    archives = warc.write(pages)
    got = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in warc.read(archives, payloads=True).collect())
    assert got == Counter([(5, 1500, "revisit", 9, None), (9, 1500, "response", None, x.encode()), (5, 2000, "revisit", 7, None), (5, 12, "response", None, b"twelve bytes"), (9, 1500, "response", None, x.encode()), (7, 2000, "response", None, y.encode()), (3, 1500, "revisit", 9, None), (3, 1500, "revisit", 9, None), (None, 1500, "response", None, x.encode()), (None, 1500, "response", None, x.encode())])
    raw = [warc.parse(r) for a in archives.collect() for r in warc.unpack(bytes(a["data"]))]
    ids = {r["WARC-Record-ID"]: r for r in raw}
    assert len(ids) == len(rows)
    assert {r["WARC-Refers-To"] for r in raw if r["X-Page-ID"] == "5" and "WARC-Refers-To" in r} == {k for k, r in ids.items() if r["X-Page-ID"] == "7"}


def test_archive_of_large_records_has_a_dictionary():
    records = [warc.record(k, "u", prose(40_000, k).encode(), "d", 1, None) for k in range(6)]
    data = warc.pack(records)
    assert int.from_bytes(data[4:8], "little") > 0 and list(warc.unpack(data)) == records
    assert sum(map(len, warc.samples(records * 4))) <= warc.SAMPLE_BYTES + warc.SLICE


def test_archive_layout(spark, tmp_path):
    import zstandard

    records = [warc.record(k, f"http://h/{k}", prose(200, k).encode(), "d", 1, None) for k in range(40)]
    data = warc.pack(records)
    assert data[:4] == bytes.fromhex("5d2a4d18") and list(warc.unpack(data)) == records
    n = int.from_bytes(data[4:8], "little")
    assert n > 0 and data[8:12] == bytes.fromhex("37a430ec")
    alone = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + n])).decompressobj().decompress(data[8 + n :])
    assert alone == records[0] and len(data) < sum(map(len, records))
    tiny = warc.pack(records[:1])
    assert list(warc.unpack(tiny)) == records[:1]
    pages = spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string")
    out = warc.export(warc.write(pages), str(tmp_path)).collect()
    assert [(tmp_path / r["name"]).stat().st_size for r in out] == [r["bytes"] for r in out]


# --- vectors


@pytest.mark.parametrize(("block", "small", "kind"), [(2048, 64, "double"), (7, 4, "double"), (7, 4, "float")])
def test_vectors(spark, monkeypatch, block, small, kind):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    near = base[rng.integers(0, 8, 120)] + 0.12 * rng.standard_normal((120, 16))
    rows = [(k, v.tolist(), k % 2) for k, v in enumerate(np.concatenate([base, near]))]
    rows += [(500, rows[0][1], 0), (501, rows[0][1], 0), (502, rows[0][1], 1), (503, rows[0][1], None), (504, None, 0), (505, [0.0] * 16, 0), (506, [float("nan")] * 16, 0), (507, [1.0, None] * 8, 0), (508, [float("inf")] + [0.0] * 15, 0), (509, [1.0, 2.0], 0), (510, [2.0, 4.0], 0), (511, [], 0), (512, [1e200] * 16, 0), (513, [1e-200] * 16, 0), (None, rows[0][1], 0), (514, rows[0][1], 0), (514, rows[0][1], 0)]
    if kind == "float":
        rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v if x is None or not np.isfinite(x) or abs(x) < 1e30], k) for i, v, k in rows]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").withColumn("rep", F.lit("clash")).repartition(3)
    monkeypatch.setattr(embedding, "SMALL", small)
    got = embedding.near_duplicates(df, block=block).collect()
    assert len(got) == len(rows)
    usable = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]

    def unit(v):
        v = np.array(v) / np.abs(v).max()
        return v / np.linalg.norm(v)

    linked = lambda a, b: a[2] == b[2] and len(a[1]) == len(b[1]) and unit(a[1]) @ unit(b[1]) >= 0.93
    roots = groups_of(usable, linked)
    low, expected = {}, Counter()
    for r, k in zip(usable, roots, strict=True):
        low[k] = min(low.get(k, r[0]), r[0])
    for j, (r, k) in enumerate(zip(usable, roots, strict=True)):
        expected[r[0], sum(linked(r, o) for m, o in enumerate(usable) if m != j), low[k]] += 1
    others = [r[0] for r in got if r[0] not in {u[0] for u in usable}]
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got if r["vec_id"] not in others) == expected
    assert all(r["n_links"] == 0 and r["component_id"] == r["vec_id"] for r in got if r["vec_id"] in others)
    assert embedding.report(df.limit(0)).count() == 0


@pytest.mark.parametrize("dim", [64, 63, 5])
def test_estimates_are_unbiased_and_bounded(dim):
    rng = np.random.default_rng(1)
    o = rng.standard_normal((4000, dim))
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    units = np.concatenate([o, o + 0.35 * rng.standard_normal((4000, dim)) / np.sqrt(dim)])
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    packed = embedding.Coder(dim, 8, 2).pack(units)
    codes = embedding.unpack(packed, dim)
    assert packed.shape[1] == -(-dim // 8) + -(-dim // 2) + 12
    exact = (units[:4000] * units[4000:]).sum(axis=1)
    estimate = (codes.signs[:4000] * codes.turned[4000:]).sum(axis=1) / np.sqrt(dim) / codes.factor[:4000]
    near = exact >= embedding.THRESHOLD
    reach = embedding.Z * embedding.deviation(codes.factor[:4000], codes.step[4000:], dim)
    assert near.sum() > 1000 and (np.abs(estimate - exact)[near] <= reach[near]).mean() > 0.999
    if dim > 60:
        assert abs((estimate - exact).mean()) < 0.003
    units[1:150] = units[0] + 0.3 * rng.standard_normal((149, dim)) / np.sqrt(dim)
    units[1:150] /= np.linalg.norm(units[1:150], axis=1, keepdims=True)
    codes = embedding.unpack(embedding.Coder(dim, 8, 2).pack(units), dim)
    pairs = np.stack(np.triu_indices(200, 1))
    close = (units[pairs[0]] * units[pairs[1]]).sum(axis=1) >= embedding.THRESHOLD
    assert close.sum() > 1000
    left = embedding.maybe_pairs(codes, *pairs, embedding.THRESHOLD)
    dense = embedding.maybe_dense(codes.take(slice(0, 200)), codes.take(slice(0, 200)), embedding.THRESHOLD)[pairs[0], pairs[1]]
    assert left[close].mean() > 0.999 and (dense >= left).all()


def test_the_bound_passes_over_far_pairs():
    rng = np.random.default_rng(2)
    units = rng.standard_normal((400, 64))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    codes = embedding.unpack(embedding.Coder(64, 8, 2).pack(units), 64)
    assert np.triu(embedding.maybe_dense(codes, codes, embedding.THRESHOLD), 1).sum() == 0


# --- BPE


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_bpe_equals_the_library(docs, vocabulary):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(str(vocabulary)), bpe.Bpe(str(vocabulary))
    texts = [r["text"] or "" for r in docs.select("text").collect()] + ["", " ", "a<|endoftext|>b<|startoftext|>", "it's we'LL 'S ''", "ΑΣ ΣΑΣ", "ab\x1c\x1dcd\x85ef", "x" * 3000, "x<|y", "é́ ﬁ ㍍", "a​b﻿c"]
    rng = random.Random(4)
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x500), rng.randrange(0x4E00, 0x9000)])) for _ in range(50)) for _ in range(200)]
    for t in texts:
        e = library.encode(t, add_special_tokens=False)
        ids = own.encode(t)
        assert ids == e.ids and own.decode(ids) == library.decode(e.ids, skip_special_tokens=False), repr(t[:60])


def test_bpe_frames(docs, vocabulary):
    path = str(vocabulary)
    own = bpe.Bpe(path)
    digests = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_digest(docs, path).collect())
    expected = Counter()
    for r in docs.collect():
        ids = own.encode(r["text"])
        expected[r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest()] += 1
    assert digests == expected
    full = bpe.decode(bpe.encode(docs.withColumn("ids", F.lit("clash")), path), path)
    assert all(r["decoded"] == own.decode(own.encode(r["text"])) and r["n_tokens"] == len(r["ids"]) for r in full.collect())
    assert bpe.encode_digest(docs.limit(0), path).count() == 0


# --- chats


def plain_viterbi(model, codes):
    of = chat.values(codes)
    emit, free = model["emit"][codes], (of["row"] > 0) | (of["marker"] > 0)
    best, back = model["start"] + emit[0], []
    for k in range(1, len(emit)):
        step = best[:, None] + (model["move"] if free[k] else np.where(np.eye(4, dtype=bool), 0, -np.inf))
        back.append(step.argmax(axis=0))
        best = step.max(axis=0) + emit[k]
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


CHATS = "conv_id long, turn long, role string, text string"


def chats(spark):
    rows = []
    for c in range(60):
        rows.append((c, 0, "system", "Follow the rules.\n- be short\n- be kind"))
        for t in range(1, 7):
            rows.append((c, t, "user" if t % 2 else "assistant", prose(4, c * 10 + t) + "?" if t % 2 else "\n".join(prose(30, c * 10 + t + k) + "." for k in range(3))))
    return rows


def test_chat_roles(spark):
    rows = chats(spark)
    odd = [(100, 0, None, None), (101, None, "user", ""), (102, 0, "user", "User: hello\nthere\nAssistant: hi\n### System\nbe kind<|im_end|>"), (None, 0, "bot", "a"), (1, 1, "user", rows[8][3]), (103, 0, "who", "x" * 50_000)]
    df = spark.createDataFrame(rows + odd, CHATS).withColumns({"line": F.lit("clash"), "c": F.lit(1), "codes": F.lit(2)})
    got = chat.report(df).collect()
    assert len(got) == len(rows) + len(odd)
    right = {(c, t): role for c, t, role, _ in rows}
    held = [r for r in got if r["held_out"] and (r["conv_id"], r["turn"]) in right]
    assert held and sum(r["role_pred"] == right[r["conv_id"], r["turn"]] for r in held) >= 0.95 * len(held)
    marked = next(r for r in got if r["conv_id"] == 102)
    assert marked["rendered"] == "<|user|>\nhello\nthere\n<|end|>\n<|assistant|>\nhi\n<|end|>\n<|system|>\nbe kind\n<|end|>\n"
    assert chat.report(df.limit(0)).count() == 0


def test_line_codes(spark):
    text = "User: is it?\n- a list\n\n    code\nplain words here"
    of = chat.values(np.array(spark.createDataFrame([(text,)], "t string").select(chat.line_codes(F.col("t"))).first()[0]))
    assert of["marker"].tolist() == [2, 0, 0, 0, 0] and of["shape"].tolist() == [0, 1, 3, 2, 4]
    assert of["length"].tolist() == [int(np.log2(len(x) + 1)) for x in text.split("\n")] and of["row"].tolist() == [int(1.5 * np.log2(len(text) + 1)) + 1, 0, 0, 0, 0]


def plain_counts(rows):
    """Starts, moves and labelled rows of conversations, by roles."""
    starts, moves, by = Counter(), Counter(), {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn is not None, turn or 0, text or "", role if role in chat.ROLES else None))
    for held in by.values():
        roles = [r[3] for r in sorted(held, key=lambda r: r[:3])]
        starts[roles[0]] += roles[0] is not None
        moves.update((a, b) for a, b in zip(roles, roles[1:]) if a and b)
    return starts, moves


@pytest.mark.parametrize(("lines", "chunk"), [(1 << 16, 50_000), (40, 50_000), (40, 8)])
def test_long_conversations_in_blocks(spark, monkeypatch, lines, chunk):
    monkeypatch.setattr(chat, "BLOCK_LINES", lines)
    monkeypatch.setattr(chat, "CHUNK_LINES", chunk)
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", prose(3 + 30 * (t % 2), t)) for t in range(300)] + [(1, 77, "user", f"again {prose(3, k)}") for k in range(100)] + [(1, 78, "assistant", "equal")] * 30
    rows += [(1, None, "system", "before all\nUser: no"), (1, 79, "who", "none")] + [(k, t, ("user", "assistant")[t % 2], prose(3 + 20 * (t % 2), t)) for k in range(2, 9) for t in range(k)]
    df = spark.createDataFrame(rows, CHATS).repartition(3)
    model = chat.fit(df)
    starts, moves = plain_counts(rows)
    first, move = np.full(4, 0.5) + [0, 1, 0, 0], np.full((4, 4), 0.5)
    for a, b in ((1, 2), (2, 1), (0, 1)):
        move[a, b] += 1
    for r, n in starts.items():
        if r:
            first[chat.ROLES.index(r)] += n
    for (a, b), n in moves.items():
        move[chat.ROLES.index(a), chat.ROLES.index(b)] += n
    assert np.allclose(np.exp(model["start"]), first / first.sum()) and np.allclose(np.exp(model["move"]), move / move.sum(axis=1, keepdims=True))
    expected = Counter()
    coded = chat.rows_of(df).collect()
    for c in {r["c"] for r in coded}:
        held = sorted((r for r in coded if r["c"] == c), key=lambda r: (r["at"], r["text"]))
        path = plain_viterbi(model, np.concatenate([r["codes"] for r in held]))
        for r in held:
            own, path = path[: len(r["codes"])], path[len(r["codes"]) :]
            expected[r["conv"], r["turn"], chat.ROLES[own[0]], len(own), chat.render(r["text"], np.array(own), chat.values(np.array(r["codes"]))["marker"] > 0)] += 1
    assert Counter(tuple(r) for r in chat.parse(df, model).collect()) == expected


def test_markers_are_learned():
    seen = np.zeros((int(np.prod(list(chat.SIZES.values()))), 4))
    plain = chat.emissions(seen)
    of = chat.values(np.arange(len(seen)))
    at = lambda marker: np.flatnonzero((of["marker"] == marker) & (of["row"] == 0) & (of["length"] == 3) & (of["shape"] == 4))[0]
    assert plain[at(2)].argmax() == 1 and plain[at(3)].argmax() == 2 and np.ptp(plain[at(0)]) == 0
    seen[at(2), 2] = 10_000  # here, lines marked as the user's are the assistant's
    assert chat.emissions(seen)[at(2)].argmax() == 2
