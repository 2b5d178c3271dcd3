"""Line dedup where keys are too many to broadcast, and where lines occur often."""

import random

from pyspark.sql import functions as F

from hearthframe.llm import line_dedup


def hashed(df):
    return df.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64("line", F.lit(17))})


def test_a_common_line_is_signed_once(spark):
    rows = hashed(spark.createDataFrame([(i, "a line that every document has") for i in range(300)] + [(7, "a line that one document has only")], "doc long, line string"))
    assert sorted((x.doc, x.line) for x in line_dedup.once(rows).collect()) == [(0, "a line that every document has"), (7, "a line that one document has only")]


def test_bits_keep_all_wanted_keys_and_few_others(spark):
    rows = spark.range(40_000).select("id", F.xxhash64("id").alias("key"))
    kept = {x.id for x in line_dedup.probably_among(rows, "key", rows.where("id % 10 = 3").select("key")).collect()}
    assert kept >= set(range(3, 40_000, 10)) and len(kept) < 4_100


def test_links_and_lines_are_the_same_without_broadcasts(spark, monkeypatch):
    r = random.Random(5)
    base = ["".join(r.choice("abcdefgh ") for _ in range(40)) for _ in range(30)]
    near = lambda s: s[: (k := r.randrange(40))] + r.choice("xyz") + s[k + 1 :]
    docs = spark.createDataFrame([(i, "\n".join(r.choice([x := r.choice(base), x, near(x)]) for _ in range(6))) for i in range(80)], "doc_id long, text string")
    rows = lambda: sorted(map(tuple, line_dedup.line_dedup(docs).collect()))
    want = rows()
    assert sum(x[4] for x in want) > 100
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 5)
    assert rows() == want


def test_keys_are_refined_by_one_join_a_round(spark, monkeypatch):
    r = random.Random(8)
    base = "".join(r.choice("abcdefgh ") for _ in range(60))
    lines = hashed(spark.createDataFrame([(i, base[: (k := r.randrange(60))] + r.choice("xyz") + base[k + 1 :]) for i in range(60)], "doc long, line string"))
    made, under = [], line_dedup._under

    def counted(rows, keys):
        out = under(rows, keys)
        made.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "_under", counted)
    found = {tuple(sorted((x.u.h1, x.v.h1))) for x in line_dedup.linked_lines(lines, 2, 12).collect()}
    alike = {x.h1 for x in lines.collect()}
    assert len(found) == len(alike) * (len(alike) - 1) // 2  # each differs from base by one replaced character
    # before, a round put out the rows under all live keys, and then once more those under one of the keys that hold the same lines
    assert len(made) == 2 + line_dedup.REFINE
