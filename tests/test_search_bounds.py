"""The bounded search against scoring every pair; numbers that are sold twice."""

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from hearthframe.operators import comparables as C
from tests.test_core import frame, sale, search


def test_a_number_sold_twice_serves_with_the_sale_before_the_valuation(spark):
    s = sale(1, 300000, date(2026, 4, 1))
    later = [sale(2, 310000, date(2026, 3, 1)), sale(2, 999000, date(2026, 6, 1)), sale(3, 320000, date(2026, 2, 1)), sale(4, 330000, date(2026, 2, 2))]
    found, comps = search(spark, s, later)
    assert found.candidate_count == 3 and sorted(int(x.c_sold_price) for x in comps.collect()) == [310000, 320000, 330000]
    twice = [sale(2, 310000, date(2026, 3, 1)), sale(2, 311000, date(2026, 3, 20)), sale(3, 320000, date(2026, 2, 1)), sale(3, 321000, date(2026, 2, 1), nb="N2"), sale(4, 330000, date(2026, 2, 2))]
    found, comps = search(spark, s, twice)
    assert found.candidate_count == 3 and sorted(int(x.c_sold_price) for x in comps.collect()) == [311000, 320000, 330000]
    gone = [sale(2, 310000, date(2025, 3, 1)), sale(2, 311000, date(2026, 4, 2)), sale(3, 320000, date(2026, 2, 1)), sale(4, 330000, date(2026, 2, 2))]
    found, _ = search(spark, s, gone)  # out of the first tier's lookback, within the third's
    assert (found.tier_index, found.candidate_count) == (2, 3)
    assert search(spark, s, [sale(1, 5, date(2026, 1, 1)), *later])[0].candidate_count == 3  # the subject's own number never serves


def sales(r, n):
    rows = []
    for i in range(n):
        hot = r.random() < 0.8
        rows.append(sale(i if r.random() < 0.97 else max(0, i - 5), 100000 + r.randrange(400000), date(2024, 1, 1) + timedelta(r.randrange(900)), nb="N1" if hot else r.choice(["N2", "N3", None]), area=r.choice(["A1", "A1", "A2"]), size=r.choice([400, 1000, 1400, 2500, 9000]) + r.randrange(300),
                         bedrooms_total=r.choice([None, 1, 2, 3, 4]), full_bathrooms=r.choice([None, 1, 2]), year_built=r.choice([None, 1950, 1990, 2000]), style=r.choice(["BUNGALOW", "2S", None])))
    return rows


def ranked(found):
    return sorted((x.s_mls_number, x.s_valuation_date, x.rk, x.c_mls_number, x.c_sold_date, x.similarity) for x in found.collect())


def test_bounded_search_equals_scoring_every_pair(spark, monkeypatch):
    rows = frame(spark, sales(random.Random(2), 700)).dropDuplicates(["mls_number", "sold_date"])
    monkeypatch.setattr(C, "FEW_CANDIDATES", 1 << 40)
    whole = C.find_comparables(C.as_subjects(rows), C.as_candidates(rows))
    monkeypatch.setattr(C, "FEW_CANDIDATES", 5)
    monkeypatch.setattr(C, "PROBES", 12)
    few = C.find_comparables(C.as_subjects(rows), C.as_candidates(rows))
    counts = lambda x: sorted((y.s_mls_number, y.s_valuation_date, y.tier_index, y.candidate_count) for y in x.collect())
    assert counts(few[0]) == counts(whole[0]) and ranked(few[1]) == ranked(whole[1]) and few[1].where("rk = 10").count() > 300


def test_far_fewer_pairs_are_scored_in_a_hot_place(spark):
    r = random.Random(3)
    rows = frame(spark, [sale(i, 1000, date(2026, 1, 1) + timedelta(r.randrange(360)), size=int(300 * 1.0015**i), bedrooms_total=3) for i in range(2000)])
    subjects = C.as_subjects(rows.where("mls_number < '202600040'")).withColumn("s_row", F.monotonically_increasing_id())
    candidates = C.usable_candidates(C.as_candidates(rows)).cache()
    every = C.tier_pairs(subjects, candidates, "neighbourhood", 365).count()
    scored = C.bounded_pairs(subjects, candidates, "neighbourhood", 365, 10).count()
    assert 0 < scored < every / 4
    candidates.unpersist()
