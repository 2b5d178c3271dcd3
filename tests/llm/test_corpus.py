"""Corpus operators against brute force, exact round trips and held-out accuracy; edge cases of rows and texts."""

import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from hearthframe.llm import bpe, html_diff, license_scan, line_dedup, media, mixing, order_minhash, token_counts, topk, toxicity
from hearthframe.llm.common import components

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [(1, None), (None, "a b"), (2, ""), (3, "x" * 30000), (3, "x" * 30000), (4, "é 漢字 \n\n!! 12"), (None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "n_links": F.lit("clash"), "n_tokens": F.lit("clash"), "severity": F.lit("clash"), "source": F.lit(None).cast("string")})


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def edited(r, s, k):
    s = list(s)
    for _ in range(k):
        i = r.randrange(len(s))
        s[i : i + r.randrange(2)] = r.choice(["", "é", "q"])
    return "".join(s)


def test_line_links_and_distance_match_brute_force(spark):
    r = random.Random(1)
    base = ["".join(r.choice("abcd ") for _ in range(r.randrange(24, 50))) for _ in range(25)]
    rows = [(i, "\n".join(edited(r, r.choice(base), r.randrange(3)) for _ in range(3))) for i in range(60)]
    lines = sorted({x for _, t in rows for x in t.split("\n") if len(x) >= 24})
    want = {(a, b) for i, a in enumerate(lines) for b in lines[i + 1 :] if abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2}
    df = spark.createDataFrame(rows, "doc long, text string").select("doc", F.explode(F.split("text", "\n")).alias("line")).where("char_length(line) >= 24").withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64("line", F.lit(17))})
    name = {x.h1: x.line for x in df.collect()}
    got = {tuple(sorted((name[x.u.h1], name[x.v.h1]))) for x in line_dedup.linked_lines(df, 2, 24).collect()}
    assert want and got == want


def test_line_dedup_keeps_first_and_short_lines(spark, odd):
    long = "a line that is surely long enough to be a passage"
    rows = spark.createDataFrame([(1, f"{long}\nhi\nhi"), (2, f"{long}s\nhi\nanother line that nobody else has at all"), (3, long)], "doc_id long, text string")
    got = {x.doc_id: x for x in line_dedup.line_dedup(rows).collect()}
    assert got[1].text == f"{long}\nhi\nhi" and got[2].text == "hi\nanother line that nobody else has at all" and got[3].text == ""
    assert got[2].class_id == 1 and got[2].n_links == 1
    out = line_dedup.line_dedup(odd)
    assert out.count() == len(ODD) and dict(out.dtypes)["n_links"] == "bigint"
    assert line_dedup.line_dedup(odd.limit(0)).count() == 0


def test_lines_from_twelve_characters_are_joined(spark):
    r = random.Random(10)
    base = ["".join(r.choice("abcd ") for _ in range(r.randrange(12, 24))) for _ in range(20)] + ["All rights reserved."]
    rows = [(i, "\n".join(edited(r, r.choice(base), r.randrange(3)) for _ in range(3))) for i in range(50)]
    lines = sorted({x for _, t in rows for x in t.split("\n") if len(x) >= 12})
    label = {x: x for x in lines}
    links = [(a, b) for i, a in enumerate(lines) for b in lines[i + 1 :] if abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2]
    for _ in lines:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = [x for _, t in sorted((x.doc_id, x.text) for x in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()) for x in t.split("\n")]
    assert links and sorted(label[x] for x in got if len(x) >= 12) == sorted(set(label.values()))  # one line of each class
    assert sorted(x for x in got if 0 < len(x) < 12) == sorted(x for _, t in rows for x in t.split("\n") if 0 < len(x) < 12)


def test_line_dedup_of_rows_without_or_with_one_id(spark):
    r = random.Random(12)
    base = ["".join(r.choice("abcd ") for _ in range(r.randrange(14, 30))) for _ in range(25)]
    rows = [(r.choice([None, None, 7, 7, i]), "\n".join([edited(r, r.choice(base), r.randrange(2)) for _ in range(3)] + [f"of row {i} alone" * 3])) for i in range(60)]
    rows += [(7, "the very same line\nseven"), (7, "the very same line\neight"), (None, "a passage without id\nx"), (None, "a passage without id\ny")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_doc": F.lit("a"), "_lines": F.lit("b"), "__gone": F.lit("c"), "id": F.lit("d"), "sign": F.lit("e")})
    out = line_dedup.line_dedup(df)
    got = out.collect()
    assert len(got) == len(rows) and all((x._doc, x._lines, x["__gone"], x.id, x.sign) == tuple("abcde") for x in got)
    lines = sorted({x for _, t in rows for x in t.split("\n") if len(x) >= 12})
    label = {x: x for x in lines}
    links = [(a, b) for i, a in enumerate(lines) for b in lines[i + 1 :] if abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2]
    for _ in lines:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    kept = [(x, i.doc_id) for i in got for x in i.text.split("\n") if len(x) >= 12]
    assert links and sorted(label[x] for x, _ in kept) == sorted(set(label.values()))  # each class once, whatever ids its rows have
    least = {}
    for i, t in rows:
        for x in t.split("\n"):
            if len(x) >= 12:
                least[label[x]] = min(least.get(label[x], 1 << 62), 1 << 62 if i is None else i)
    assert all((1 << 62 if i is None else i) == least[label[x]] for x, i in kept)
    assert sum("the very same line" in x.text for x in got) == sum("a passage without id" in x.text for x in got) == 1


def test_characters_beyond_the_basic_plane_count_once(spark):
    r = random.Random(11)
    rows = []
    for i in range(60):
        x = [r.choice("abcdefgh") for _ in range(30)]
        for at in (5, 9, 20, 25):
            x[at] = "😀"
        y = list(x)
        y[9], y[20] = "q", "z"  # two edits
        rows += [(2 * i, "".join(x)), (2 * i + 1, "".join(y))]
    df = spark.createDataFrame(rows, "doc long, line string").withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64("line", F.lit(17))})
    bits = [x.bits for x in df.select("doc", line_dedup.bigram_parity(F.col("line")).alias("bits")).orderBy("doc").collect()]
    assert all(sum(bin((p ^ q) & (1 << 64) - 1).count("1") for p, q in zip(a, b, strict=True)) <= 8 for a, b in zip(bits[::2], bits[1::2], strict=True))
    assert {tuple(sorted((x.u.owner, x.v.owner))) for x in line_dedup.linked_lines(df, 2, 12).collect()} == {(2 * i, 2 * i + 1) for i in range(60)}


def test_bpe_equals_tiktoken(spark, odd):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
    got = bpe.encode_docs(odd, PATH, public_tokenizers.PATTERN, ids=True).collect()
    assert len(got) == len(ODD)
    for x in got:
        assert x.token_ids == enc.encode_ordinary(x.text or "") and x.decoded_sha256 == hashlib.sha256((x.text or "").encode()).hexdigest()
    r = random.Random(2)
    for _ in range(300):
        t = "".join(r.choice("ab AB\n\t\x1c\x85\xa0 'sted 12٣éß漢😀_-.") for _ in range(r.randrange(60)))
        assert bpe.encode_text(t, PATH, public_tokenizers.PATTERN) == (",".join(map(str, enc.encode_ordinary(t))), t.encode())
    for t in ("x" * 30000, "漢é" * 9000, "".join(r.choice("abcdest") for _ in range(20000))):  # one word each
        assert bpe.encode_text(t, PATH, public_tokenizers.PATTERN)[0] == ",".join(map(str, enc.encode_ordinary(t)))


def test_bpe_fold_in_higher_order_functions(spark):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
    r = random.Random(12)
    words = {" hello", "unbelievably", "é漢", "zqxjk"} | {"".join(r.choice("abcdeinorst漢é") for _ in range(r.randrange(1, 12))) for _ in range(2000)}
    ids = bpe.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), PATH)
    for x in ids.collect():
        assert x.ids == enc.encode_ordinary(x.word)
    pieces = spark.createDataFrame([(i, bytearray(b)) for b, i in bpe.load_ranks(PATH).items()], "id int, piece binary")
    back = bpe.decode_arrays(ids.unionAll(spark.createDataFrame([("", []), ("\0", None)], "word string, ids array<int>")), pieces)
    assert sorted((x.word, x.text) for x in back.collect()) == sorted([*((w, w) for w in words), ("", ""), ("\0", "")])


def test_sixty_four_bit_ids_pass_through_beside_nulls(spark):
    ids = [9007199254740993, None, -1, (1 << 63) - 2]
    df = spark.createDataFrame([(i, "under the mit license") for i in ids], "doc_id long, text string")
    got = [bpe.encode_docs(df, PATH, public_tokenizers.PATTERN), license_scan.scan_licenses(df), media.media_columns(df), media.media_columns(df, arrays=False)]
    got.append(html_diff.extract_pages(df.selectExpr("doc_id as page_id", "'http://a/b' as url", "text as html")).withColumnRenamed("page_id", "doc_id"))
    got.append(toxicity.score(df, toxicity.OrdinalModel({}, np.array([np.inf]))))
    for x in got:
        assert {r.doc_id for r in x.collect()} == set(ids)


def test_html_extraction(spark):
    page = "<html><head><title>t</title></head><body><nav>menu</nav>{}<div class=ad>buy</div><footer>f</footer></body></html>"
    rows = [(1, "http://b/x/1", page.format("<article><h1>T &amp; u</h1><p>one\n two<p>three<section id=comments>c</section></article>")), (2, "http://a/x/2", "<p>shared line</p><p>own</p>"), (3, "https://a/x/3?q", "<p>shared line</p><p>mine 1 < 2</p>"), (4, None, None)]
    got = {x.page_id: x for x in html_diff.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "T & u\none two\nthree" and got[2].text == "own" and got[3].text == "mine 1 < 2" and got[4].text == "" and got[4].n_chars == 0
    r = random.Random(3)
    for _ in range(300):
        a, b = ([r.randrange(4) for _ in range(r.randrange(9))] for _ in "ab")
        best = max(bin(m).count("1") for m in range(1 << len(a)) if (lambda s, it: all(x in it for x in s))([a[i] for i in range(len(a)) if m >> i & 1], iter(b)))
        assert len(html_diff.shared_lines(a, b)) == best


def test_html_lines_within_articles(spark):
    r = random.Random(9)
    own = [" ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(12)) for _ in range(8)]
    page = "<body><p>head</p><article><h1>t{}</h1><p>{}</p>{}<p>Read on by letter.</p></article>{}</body>"
    quoted = "<p>one sentence that two pages quote</p>"
    rows = [(i, f"http://h/a/{i}", page.format(i, x, quoted if i in (2, 3) else "", "<p>Read on by letter.</p>" if i == 6 else "")) for i, x in enumerate(own)]
    rows += [(10 + i, f"http://copies/{i}", "<article><p>a copied article</p><p>of two lines</p></article>") for i in range(4)]
    rows += [(20 + i, f"http://two/{i}", f"<main><p>{own[i]}</p><p>Read on by letter.</p></main>") for i in range(2)]
    rows += [(30 + i, f"http://bare/{i}", "<p>same story para</p><p>second para</p>") for i in range(3)]
    rows += [(40 + i, f"http://all/{i}", f"<p>head</p><article><p>{own[i]}</p><p>on all pages, in articles alone</p></article>") for i in range(5)]
    got = {x.page_id: x.text for x in html_diff.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, x in enumerate(own):  # the notice, which also stands outside an article, goes but from where it does; the quoted sentence stays
        kept = ("\none sentence that two pages quote" if i in (2, 3) else "") + ("\nRead on by letter." if i == 6 and got[6].endswith("letter.") else "")
        assert got[i] == f"t{i}\n{x}" + kept
    assert all(got[10 + i] == "a copied article\nof two lines" for i in range(4))
    assert all(got[20 + i] == f"{own[i]}\nRead on by letter." for i in range(2))  # may be quoted
    assert all(got[30 + i] == "same story para\nsecond para" for i in range(3))  # copies do not erase each other
    assert all(got[40 + i] == f"{own[i]}\non all pages, in articles alone" for i in range(5))


def test_html_names_of_content(spark):
    rows = [(i, f"http://h{i}/a", f"<article><div class='{c}'><p>Real text</p></div></article>") for i, c in enumerate(["tags content", "entry share", "tags", "share-buttons x"])]
    got = {x.page_id: x.text for x in html_diff.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(4)] == ["Real text", "Real text", "", ""]


def test_html_places_are_told_by_what_they_say_alone(spark):
    keep = ['<article id="share-prices"><p>{}</p></article>', '<section aria-label="Notes on social media"><p>{}</p></section>', '<article><div class="post-header"><h1>{}</h1></div></article>', "<article><math>{}</math></article>", '<div id="search-for-truth"><p>{}</p></div>']
    drop = ['<div class="x ad-slot">{}</div>', '<div id="cookieBanner">{}</div>', '<ul class="comment-list"><li>{}</li></ul>', '<div role="navigation">{}</div>', '<div class="site-header">{}</div>']
    rows = [(i, f"http://h{i}/a", page.format(f"words of page {i}")) for i, page in enumerate(keep + drop)]
    got = {x.page_id: x.text for x in html_diff.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(10)] == [f"words of page {i}" for i in range(5)] + [""] * 5


def test_html_rows_without_id_and_repeated_rows(spark):
    rows = [(None, "http://h/a", "<p>head</p><p>one</p>"), (None, "http://h/b", "<p>head</p><p>two</p>"), (None, None, None), (5, "http://i/a", "<p>alone</p>"), (5, "http://i/a", "<p>alone</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "page": F.lit("x"), "hashes": F.lit(2.0)})
    assert sorted(x.text for x in html_diff.extract_pages(df).collect()) == ["", "alone", "alone", "one", "two"]
    assert html_diff.extract_pages(df.limit(0)).count() == 0


def test_license_scan(spark, odd):
    rows = spark.createDataFrame([(1, "Released under the MIT License. under the MIT-license"), (2, "Licensed undr the Apache Licence, Version 2"), (3, "nothing here")], "doc_id long, text string")
    got = {x.doc_id: x for x in license_scan.scan_licenses(rows).collect()}
    assert [(p.word, p.label) for p in got[1].phrases] == [(1, "mit"), (5, "mit")] and got[1].n_words == 9
    assert not got[2].phrases and {s.label for s in got[2].spans} == {"apache-2"} and got[2].spans[0].errors == 2
    assert not got[3].spans and license_scan.scan_licenses(odd).count() == len(ODD)


def test_license_labels_do_not_depend_on_length():
    scanner = license_scan.Scanner(license_scan.PHRASES, license_scan.NOTICES)
    for n in (1, 60, 70, 300):
        spans = scanner.scan("licensed under the gnu general public license version 3 and more. " * n)[2]
        assert len(spans) == n and {(x[2], x[3]) for x in spans} == {("gpl-3", 0)} and spans == sorted(spans)


def test_license_notices_before_a_better_one_are_found():
    scanner = license_scan.Scanner(license_scan.PHRASES, license_scan.NOTICES)
    notice, worse, worst = "released under the mit license", "relxased under the mit license", "relxased undxr the mit license"
    for parts in ([worse, notice], [notice, worse], [worst, worse, notice, worse, worst], [worse] * 5, [worst, notice] * 50):
        got = scanner.scan(" ".join(parts))[2]
        assert [(x[0], x[1], x[3]) for x in got] == [(31 * i, 31 * i + 30, [notice, worse, worst].index(x)) for i, x in enumerate(parts)]


def test_mixing_hits_targets(spark, odd):
    r = random.Random(4)
    docs = spark.createDataFrame([(i, "w " * r.randrange(1, 40), r.choice(["a", "b", "c", None])) for i in range(200)], "doc_id long, text string, source string")
    sizes = mixing.document_sizes(docs)
    got = mixing.mix(sizes, mixing.source_targets(sizes)).toPandas()
    for _, g in got.groupby(got["source"].fillna("~")):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 1 and (g.taken <= 2 * g["size"]).all()
    assert abs(got.taken.sum() - 1.5 * got["size"].sum()) <= 4
    again = mixing.document_sizes(odd)
    assert mixing.mix(again, mixing.source_targets(again)).count() == len(ODD)
    clash = sizes.withColumns({c: F.lit("x") for c in ("target", "rows", "source_size", "taken", "w", "cap")})
    assert sorted(mixing.mix(clash, mixing.source_targets(clash)).select(*got.columns).collect(), key=str) == sorted(mixing.mix(sizes, mixing.source_targets(sizes)).collect(), key=str)
    none = mixing.document_sizes(docs.limit(0))
    assert mixing.mix(none, mixing.source_targets(none)).count() == 0


def test_toxicity_on_held_out_rows(spark, odd):
    r = random.Random(5)
    plain = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60)]

    def text(bad):
        words = [r.choice(plain) for _ in range(r.randrange(8, 30))]
        for _ in range(r.randrange(1, 4) if bad else 0):
            words.insert(r.randrange(len(words)), "vequ" + "".join(r.choice("abc") for _ in range(3)))
        return " ".join(words)

    rows = [(i, text(i % 5 == 0), int(i % 5 == 0)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = toxicity.fit(df, df.where("doc_id < 400"), 2)
    got = toxicity.score(df.where("doc_id >= 400"), model).toPandas()
    assert ((got.p_toxic >= toxicity.REJECT) == (got.grade > 0)).mean() > 0.98 and (got.severity >= got.p_toxic - 1e-9).all()
    assert toxicity.score(odd, toxicity.fit(odd, df.limit(0).select("doc_id", "grade"), 2)).where("p_toxic > 0").count() == 0


def test_expected_severity_orders_the_grades(spark):
    r = random.Random(15)
    plain, mild, harsh = (["".join(r.choice("abcdefgh") for _ in range(5)) + end for _ in range(n)] for end, n in (("", 60), ("mild", 4), ("harsh", 4)))
    rows = []
    for i in range(900):
        grade = r.choice([0, 0, 0, 1, 2])
        rows.append((i, " ".join(r.choices(plain, k=r.randrange(8, 30)) + r.choices(mild if grade == 1 else harsh, k=2 if grade else 0)), grade))
    rows += [(5, "another text of one id", 0)] * 3 + [(None, "no id", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = toxicity.fit(df, df.where("doc_id < 600"), 2)
    got = toxicity.score(df.where("doc_id >= 600"), model).groupBy("grade").agg(F.avg("severity").alias("s"), F.min("p_toxic").alias("low"), F.max("p_toxic").alias("high")).orderBy("grade").collect()
    assert got[0].s < 0.2 < got[1].s < 1.5 < got[2].s and got[0].high < toxicity.REJECT < min(got[1].low, got[2].low)
    few = toxicity.fit(df, df, 2, sample_rows=50)
    assert len(few.thresholds) == 2 and few.thresholds[0] <= few.thresholds[1]


def test_media_round_trip(spark, odd):
    for x in media.media_columns(odd).collect():
        text = next(t for i, t in ODD if i == x.doc_id and len((t or "").encode()) == x.n_bytes)
        assert bytes(x.payload).rstrip() == (text or "").encode().rstrip() and len(x.payload) % 192 == 0 and media.from_wav(bytes(x.media)) == bytes(x.payload)
        assert len(x.times) == len(x.codes) and x.times == sorted(x.times)
    assert media.payload_of("a" * 192)[1] == b"a" * 192 and media.payload_of(None) == (0, b" " * 192)


def test_media_features_tell_short_texts_and_ends_apart(spark):
    r = random.Random(8)
    texts = ["".join(r.choice("abcdefgh ijklmnop") for _ in range(n)) + "." for n in range(100, 384)]
    for n in (192, 384, 960, 1000, 4992):  # the same but for the last bytes
        same = "".join(r.choice("abcdefgh ijklmnop") for _ in range(n - 32))
        texts += [same + "".join(r.choice(x) for _ in range(32)) for x in ("abcdefgh", "qrstuvw", "0123456789")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [x.feature for x in media.media_columns(df, arrays=False).collect()]
    assert len(set(got)) == len(texts) and not any(x.startswith("0:") for x in got)
    for n in (2, 63, 64, 65, 192, 256, 257, 1000):  # a click in silence counts wherever it stands
        x = bytes([128] * n)
        for at in {0, n // 2 - 1, n - 2}:
            assert (media.spectral_peaks(x[:at] + b"\xff\x00" + x[at + 2 :]) != media.spectral_peaks(x)).any()


def test_token_counts_match_direct_sums(odd):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
    n = [len(enc.encode_ordinary(t or "")) for _, t in ODD]
    got = token_counts.context_limits(token_counts.length_histogram(odd, PATH, public_tokenizers.PATTERN), block=3).collect()
    assert {x.context_limit for x in got} == set(n)
    for x in got:
        assert x.tokens_truncated == sum(min(v, x.context_limit) for v in n) and x.docs_over == sum(v > x.context_limit for v in n) and x.tokens_within == sum(v for v in n if v <= x.context_limit)


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_components_of_paths_stars_and_random_graphs(spark):
    r = random.Random(21)
    order = r.sample(range(1000, 1200), 200)
    pairs = list(zip(order, order[1:])) + [(5, i) for i in range(6, 60)] + [(r.randrange(2000, 2100), r.randrange(2000, 2100)) for _ in range(60)] + [(7000, 7000)]
    label = {x: x for p in pairs for x in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = {x.node: x.label for x in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == label


def test_near_duplicates_match_brute_force(spark, odd):
    r = random.Random(6)
    words = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    base = [[r.choice(words) for _ in range(120)] for _ in range(6)]
    rows = []
    for i in range(40):
        w = list(base[i % 6])
        for _ in range(i % 4 * 2):
            w[r.randrange(120)] = "new"
        rows.append((i, " ".join(w)))
    split = [t.split() for _, t in rows]
    label = list(range(40))
    near = [(i, j) for i in range(40) for j in range(i) if (c := common(split[i], split[j])) / (len(split[i]) + len(split[j]) - c) >= 0.8]
    for _ in range(40):
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
    got = order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: x.class_id for x in got} == dict(enumerate(label)) and sorted(x.doc_id for x in got if x.keep) == sorted(set(label))
    hashed = [order_minhash.word_hashes(t) for _, t in rows]
    for i, j in [(0, 6), (1, 7), (2, 3), (5, 35)]:
        assert order_minhash.common_words(hashed[i], hashed[j], 200) == common(split[i], split[j])
        bits = order_minhash.parity(hashed[i]) ^ order_minhash.parity(hashed[j])
        assert sum(bin(int(x) & (1 << 64) - 1).count("1") for x in bits) <= len(set(order_minhash.labelled(hashed[i])) ^ set(order_minhash.labelled(hashed[j])))
    out = order_minhash.near_duplicates(odd)
    assert out.count() == len(ODD) and out.where("doc_id = 3").select("class_id").distinct().count() == 1
    assert order_minhash.near_duplicates(odd.limit(0)).count() == 0


def test_near_copies_are_recalled(spark):
    """Nine in ten copies with a tenth of their words changed, a similarity of about 0.82, are found at least."""
    r = random.Random(13)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows, near = [], 0
    for i in range(300):
        a = [word() for _ in range(200)]
        b = [word() if r.random() < 0.1 else x for x in a]
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
        near += (c := common(a, b)) / (400 - c) >= 0.8
    got = order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).where("not keep").collect()
    assert all(x.class_id == x.doc_id - 1 for x in got) and near > 150 and len(got) >= 0.9 * near


def test_near_duplicates_tell_rows_without_or_with_one_id_apart(spark):
    t, u, v = ("word%s " % c * 3 + " ".join(f"{c}{i}" for i in range(50)) for c in "abc")
    rows = [(1, t), (None, t), (None, u), (7, v), (7, u + " x"), (7, v), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"keep": F.lit(1), "n": F.lit("x"), "_nth": F.lit(0)})
    got = sorted(order_minhash.near_duplicates(df).collect(), key=str)
    assert len(got) == len(rows) and [(x.doc_id, x.class_id) for x in got if x.keep].count((1, 1)) == 1
    kept = order_minhash.without_near_duplicates(df)
    assert kept.columns == df.columns and sorted((x.text or "") for x in kept.collect()) == sorted(["", t, u + " x", v])


def test_top_k_matches_sql(spark):
    r = np.random.default_rng(7)
    rows = [(i, [float(x) for x in r.normal(size=8).round(1)]) for i in range(120)] + [(500, None), (501, [float("nan")] * 8), (502, [None] * 8), (503, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = topk.quantized(df)
    got = [tuple(x) for x in topk.top_k(v, v.where("id % 20 = 0"), k=5).orderBy("query_id", "rank").collect()]
    e = {i: np.floor(64 * np.array(x, np.float32).astype(float)) for i, x in rows[:120]}
    want = []
    for q in range(0, 120, 20):
        best = sorted(((-int(e[q] @ e[i]), i) for i in e if i != q))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == want and topk.top_k(v, v.limit(0)).count() == 0 and topk.top_k(v.limit(0), v).count() == 0


def test_top_k_of_ties_repeats_odd_widths_and_many_cells(spark, monkeypatch):
    r = np.random.default_rng(8)
    rows = [(i, [int(x) for x in r.integers(-2, 3, size=6)]) for i in range(150)] + [(3, [1] * 6), (3, [1] * 6), (900, []), (901, []), (902, [5])]
    df = spark.createDataFrame(rows, "id long, vector array<long>").withColumns({"row": F.lit("x"), "score": F.lit(1)})
    monkeypatch.setattr(topk, "QUERY_BLOCK", 16)
    monkeypatch.setattr(topk, "VECTOR_BLOCK", 40)
    got = [tuple(x) for x in topk.top_k(df, df.where("id % 10 = 0 or id > 800"), k=7, slices=3).orderBy("query_id", "rank").collect()]
    want = []
    for q, a in sorted({i: v for i, v in rows if i % 10 == 0 or i > 800}.items()):
        best = sorted((-sum(x * y for x, y in zip(a, v)), i) for i, v in rows if i != q and len(v) == len(a))[:7]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == want


def test_top_k_of_rows_that_share_an_id(spark):
    rows = [(20, [1, 0]), (20, [0, 2]), (21, [3, 1]), (20, [1, 0])]
    df = spark.createDataFrame(rows, "id long, vector array<long>")
    got = sorted(map(tuple, topk.top_k(df, df.where("id = 20"), k=3).collect()))
    assert got == sorted([(20, 1, 21, 3), (20, 2, 20, 0), (20, 1, 21, 2), (20, 2, 20, 0), (20, 3, 20, 0)])


def test_oracles_on_small_tables(spark):
    from hearthframe.llm.queries import ORACLE_SQL, QUERIES

    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    for name, sql in ORACLE_SQL.items():
        got = QUERIES[name](spark, folder)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, con.execute(f"select {', '.join(got.columns)} from ({sql})").fetchall()))
