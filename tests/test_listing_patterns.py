import re

from pyspark.sql import functions as F

from hearthframe.operators import listings as L


def test_side_by_side_searches_each_pattern_of_a_block_once(spark):
    pages = spark.createDataFrame([("p", 0, "MLS® 201234567\n5 Elm St\nLot Size: 5 x 6")], "path string, page_number int, text string")
    plan = L.side_by_side(pages, 2026, {"obend": "River Bend"}, ("Oak Park",))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("|carport)") == 1  # once a kind of garage and use before
    assert plan.count("(?:sqft|sf|sq ft)") == 1
    assert plan.count(L.ADDRESS) == 1  # for the matches and once more for what lies between them before


def test_matches_are_those_of_the_pattern(spark):
    plain = rf"(?i)\d{{1,5}}\s+[A-Za-z0-9 .,'\-]+(?:{L.STREETS})"
    texts = ["12 Elm Street\n12 Elm St 3 Elm St\n7 Oak Avenue, 8 bay cres", "1 a st 1 a st\n11 a st", "®é 123456 Long Road 9\nPl 5 Crescenta ctx", "no", "", "4 St", "44 Parkwayway Courts 5 blvd", "1\n\n2 x LANE"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", L.matches(F.col("t"), L.ADDRESS).alias("m")).collect()
    for r in got:
        assert [(m.start, m.match) for m in r.m] == [(m.start() + 1, m.group()) for m in re.finditer(plain, texts[r.i])]


def test_words_of_texts(spark):
    got = spark.createDataFrame([("A-b  C.", "®d_É\n9")], "a string, b string").select(L.plain_words(F.col("a"), F.col("b"))).first()[0]
    assert got == "a b c d_ 9"
