"""The search deals each side of a cell out once, and finds the same where its small tables are too many to broadcast."""

import random

from pyspark.sql import functions as F

from hearthframe.functions import shared
from hearthframe.operators import comparables as C
from tests.test_core import frame
from tests.test_search_bounds import ranked, sales


def test_subjects_and_candidates_are_dealt_out_once(spark, monkeypatch):
    monkeypatch.setattr(C, "FEW_CANDIDATES", 3)
    rows = shared.written(frame(spark, sales(random.Random(5), 150)).dropDuplicates(["mls_number", "sold_date"]).withColumn("row", F.monotonically_increasing_id()))
    comps = C.find_comparables(C.as_subjects(rows), C.as_candidates(rows))[1]
    plan = comps._jdf.queryExecution().executedPlan().toString()
    # before, both sides were shuffled by type, place and bin to meet the numbers of their parts, and once more with these
    assert "hashpartitioning(_cell" in plan and "hashpartitioning(_kind" not in plan
    whole = ranked(comps)
    for module in (C, shared):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    assert ranked(C.find_comparables(C.as_subjects(rows), C.as_candidates(rows))[1]) == whole and len(whole) > 500


def test_values_are_sorted_in_tasks_of_few_comparables(spark, monkeypatch):
    monkeypatch.setattr(C, "VALUED_AT_ONCE", 100)
    rows = [(s, f"{s}", k, 100_000 + 1_000 * k, 1000 + k, 1000) for s in range(100) for k in range(1, 6)]
    comps = spark.createDataFrame(rows, "s_row long, s_mls_number string, c long, c_sold_price int, c_living_area_sqft int, s_living_area_sqft int")
    comps = comps.selectExpr("*", "cast(c as string) c_mls_number", "cast(90 - c as decimal(18,2)) similarity", "cast(0.5 as decimal(18,4)) data_coverage", "cast(c as decimal(18,1)) size_diff_pct", "5L candidate_count", "'t' tier", "false tier_widened", "date'2020-01-01' c_sold_date")
    few = C.value_subjects(comps, subjects=100)
    # before, the shuffle's few partitions grew with the input, and so did what a task sorted
    assert "REPARTITION_BY_NUM" in few._jdf.queryExecution().executedPlan().toString()
    assert sorted(few.collect()) == sorted(C.value_subjects(comps).collect()) and few.count() == 100
