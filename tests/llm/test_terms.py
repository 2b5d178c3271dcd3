"""Term divergence, spelling variants and the quality model against brute force, SQL and held-out labels."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthframe.llm import divergence, quality, spelling

DOCS = "doc_id long, text string, lang string, source string, size string"


def brute_divergence(rows, min_docs):
    n, has, groups, out = defaultdict(Counter), defaultdict(Counter), set(), []
    for text, lang, source in ((t or "", g or "", s or "") for _, t, g, s, *_ in rows):
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        groups.add((lang, source))
        n[lang, source].update(words)
        has[lang].update(set(words))
    for lang in {g for g, _ in groups}:
        kept = [w for w, k in has[lang].items() if k >= min_docs]
        count = {s: [n[lang, s][w] for w in kept] for g, s in groups if g == lang}
        p = lambda c: [1 + 1_000_000_000 * (x + 5) // (sum(c) + 5 * len(kept)) for x in c]
        q = p([sum(x) for x in zip(*count.values())])
        for s, c in count.items():
            pairs = sorted((-sum(abs(x - y) for x, y in zip(p(c), p(d))), o.encode()) for o, d in count.items() if o != s)
            terms = sorted((y - x, w.encode()) for w, x, y, k in zip(kept, p(c), q, c) if k and x > y)[:50]
            out += [(lang, s, part, w.decode(), -v, i) for part, found in (("pair", pairs), ("term", terms)) for i, (v, w) in enumerate(found, 1)]
    return sorted(out)


def test_divergence_matches_brute_force(spark, monkeypatch):
    r = random.Random(3)
    words = [w + x for w in ("the", "The", "ÀB", "àb", "word", "漢字", "k") for x in ("", "s", "ß", "q")]
    rows = [(i, " ".join(r.choices(words, [1 / (k + 1) for k in range(len(words))], k=r.randrange(12))), r.choice(["en", "de", "", None, "xx"]), r.choice(["a", "b", "B", "é", None, ""]), "clash") for i in range(300)]
    rows += [(None, None, "en", "a", None), (1, "x" * 50_000, "en", "a", None), (1, "x" * 50_000, "en", "a", None), (7, "alone", "zz", "only", None)]
    monkeypatch.setattr(divergence, "TERMS_A_SHARD", 4)
    monkeypatch.setattr(divergence, "HELD_ROWS", 50)
    for least in (1, 12):
        got = [tuple(x) for x in divergence.divergence(spark.createDataFrame(rows, DOCS).repartition(3), least).collect()]
        assert sorted(got) == brute_divergence(rows, least)
    assert {x[0] for x in got if x[2] == "pair"} >= {"xx", "en", ""} and not any(x[0] == "zz" for x in got)


def test_divergence_of_groups_without_terms_and_of_no_rows(spark):
    rows = spark.createDataFrame([(1, "12 34", "en", "a", ""), (2, None, "en", "b", ""), (3, "", None, None, "")], DOCS)
    assert sorted(tuple(x) for x in divergence.divergence(rows).collect()) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert divergence.divergence(rows.limit(0)).count() == 0


def test_divergence_with_odd_columns_and_its_sql(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    clash = docs.withColumns({c: F.lit("clash") for c in ("term", "n", "size", "shard", "part", "doc_")})
    assert sorted(map(tuple, divergence.divergence(clash, 5).collect())) == sorted(map(tuple, divergence.divergence(docs, 5).collect()))


def brute_variants(rows):
    n = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    cut = lambda w: {w[:i] + w[i + 1 :] for i in range(len(w))}
    holes = lambda w: {(w[:i], w[i + 1 :]) for i in range(len(w))}
    near = {w: [v for v in n if v != w and (v in cut(w) or w in cut(v) or len(v) == len(w) and holes(v) & holes(w))] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    def root(w):
        return w if form[w] is None else root(form[w])
    return sorted((w, form[w], root(w), n[w], len(near[w]), form[w] and n[form[w]]) for w in n)


def test_variants_match_brute_force(spark, monkeypatch):
    r = random.Random(4)
    base = ["".join(r.choices("abÿÀé", k=r.randrange(6, 10))) for _ in range(40)] + ["aaaaaa", "aaaaaaa", "abcabc", "Xabcabc", "contra", "contre", "contras"]
    words = []
    for i, w in enumerate(base * 8):
        at = r.randrange(len(w))
        words += [w[:at] + r.choice(["", "b", "é", w[at]]) + w[at + r.randrange(2) :]] * r.choice([1, 5, 30, 200])
    words += ["chaina"] * 5 + ["chainb"] * 25 + ["chainbb"] * 125 + ["chanbb"] * 625 + ["Short", "Kelvin\u212aelvin"] * 9
    r.shuffle(words)
    rows = [(i, " ".join(words[k : k + 90])) for i, k in enumerate(range(0, len(words), 90))] + [(None, "abcabc " * 7), (None, None), (3, ""), (5, "q" * 40_000), (5, "q" * 40_000)]
    monkeypatch.setattr(spelling, "WORDS_A_SHARD", 12)
    monkeypatch.setattr(spelling, "HELD_WORDS", 100)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit(1), "n": F.lit("clash")}).repartition(3)
    got, want = sorted((tuple(x) for x in spelling.variants(docs).collect()), key=str), sorted(brute_variants(rows), key=str)
    assert got == want and any(w[1] and w[2] != w[1] for w in want) and max(w[4] for w in want) > 3
    assert spelling.variants(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("a", "b", "near"), [("abc", "abc", False), ("abc", "abd", True), ("abc", "ab", True), ("bc", "abc", True), ("abc", "acb", False), ("aab", "ab", True), ("abcd", "ab", False)])
def test_one_edit(a, b, near):
    assert spelling.one_edit(a, b) is near and spelling.one_edit(b, a) is near


def labelled(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        words = ["".join(r.choices("abcdeiou", k=r.randrange(2, 9))) for _ in range(r.randrange(3, 80))]
        bad = r.random() < 0.3
        if bad:
            words = r.choice([lambda: words[:2] * 20, lambda: [w + r.choice("#$%&*") * 3 for w in words], lambda: [w.upper() + "!!" for w in words]])()
        out.append((i, " ".join(words) + ".", 0 if bad else 1))
    return out


def test_quality_on_held_out_rows(spark):
    rows = labelled(1500, 5)
    docs, labels = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"), spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, label int")
    model = quality.fit(docs, labels)
    out = quality.score(docs, model).withColumn("held_out", quality.held_out(F.col("doc_id"))).collect()
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) and 0 <= x.score <= 1 for x in out)
    right = [(x.score >= 0.5) == (rows[x.doc_id][2] == 1) for x in out if x.held_out]
    assert len(right) > 400 and np.mean(right) >= 0.95
    flipped = spark.createDataFrame([(x[0], 1 - x[2] if zlib.crc32(str(x[0]).encode()) % 3 == 1 else x[2]) for x in rows], "doc_id long, label int")
    again = {x.doc_id: x.score for x in quality.score(docs, quality.fit(docs, flipped)).collect()}
    assert all(abs(again[x.doc_id] - x.score) < 1e-9 for x in out)  # held-out labels teach nothing


def test_quality_sums_equal_direct_equations(spark):
    rows = labelled(200, 6)
    docs, labels = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string").repartition(5), spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, label int")
    model, sample = quality.fit(docs, labels), quality.labelled_statistics(docs, labels).collect()
    stats, y, apart = np.array([x.stats for x in sample]), np.array([x.label for x in sample]), np.array([x.apart for x in sample])
    assert np.allclose(model.mean, stats.mean(0)) and len(sample) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(200))
    z = model.features(stats[~apart])
    want = np.linalg.solve(z.T @ z + quality.RIDGE * np.eye(z.shape[1]) * len(z) / quality.FEATURES, z.T @ y[~apart])
    assert np.allclose(z @ model.weights, z @ want, atol=1e-6)
    assert np.all(np.diff(model.chances) >= 0) and len(quality.labelled_statistics(docs, labels, 40).collect()) < 80


def test_quality_of_odd_rows(spark):
    odd = [(1, None), (None, "a b"), (2, ""), (3, "x" * 300_000), (3, "x" * 300_000), (None, None)]
    docs = spark.createDataFrame(odd, "doc_id long, text string").withColumns({"score": F.lit("clash"), "stats": F.lit("clash"), "label": F.lit(1)})
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 1), (9, 0), (3, 1)], "doc_id long, label int")
    for model in (quality.fit(docs, labels), quality.fit(docs, labels.limit(0)), quality.fit(docs.limit(0), labels)):
        got = quality.score(docs, model).collect()
        assert len(got) == len(odd) and all(0 <= x.score <= 1 for x in got) and len({x.score for x in got if x.text in (None, "")}) == 1
    assert quality.fit(docs, labels.limit(0)) is None and quality.score(docs.limit(0), None).count() == 0


def test_pairs_at_one_edit_alike_one_by_one_and_at_once(monkeypatch):
    r = random.Random(8)
    words = sorted({"".join(r.choices("abÿ", k=r.choice([4, 5, 6]))) for _ in range(400)})
    for m, n in ((4, 4), (4, 5), (6, 5)):
        a, b = ([w for w in words if len(w) == k] for k in (m, n))
        want = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if spelling.one_edit(x, y)}
        for at_once in (200, 1 << 20):
            monkeypatch.setattr(spelling, "CODES_AT_ONCE", at_once)
            got = list(spelling.edit_pairs(a, b))
            assert want and set(got) == want and len(got) == len(want)
