"""Goldens of the scalar functions, and small end-to-end runs over built rows."""

from datetime import date, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from hearthframe.functions import scalars as S
from hearthframe.operators import backtest, comparables, ingestion, market
from hearthframe.sources import tables as T

COLUMNS = "mls_number string, sold_date date, sold_price decimal(12,2), living_area_sqft int, neighbourhood string, area_code string, property_type string, data_quality_status string, bedrooms_total int, full_bathrooms int, half_bathrooms int, year_built int, style string, garage_type string, basement_type string"


def sale(i, price, day=date(2026, 4, 1), nb="N1", area="A1", size=1000, **more):
    row = dict(mls_number=f"2026{i:05d}", sold_date=day, sold_price=Decimal(price), living_area_sqft=size, neighbourhood=nb, area_code=area, property_type="RD", data_quality_status="approved", bedrooms_total=3, full_bathrooms=2, half_bathrooms=0, year_built=2000, style="BUNGALOW", garage_type=None, basement_type="Full")
    return row | more


def frame(spark, rows):
    names = [x.split()[0] for x in COLUMNS.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], COLUMNS)


def search(spark, subject, others):
    found = comparables.find_comparables(comparables.as_subjects(frame(spark, [subject])), comparables.as_candidates(frame(spark, [subject, *others])))
    return found[0].collect()[0], found[1]


def test_scalars(spark):
    row = spark.sql("select 'MLS # 202611485' a, 'N/A' b, '$415,250.00' c, 'Sold 04/05/2026' d, cast(0.145 as double) e, '012R1' f")
    got = row.select(S.normalize_mls("a"), S.normalize_mls("b"), S.money("c"), S.us_date("d"), S.rdp("e", 2), S.mask_mls("a"), S.property_id("f", F.lit(None), F.lit(None))).collect()[0]
    assert got[:5] == ("202611485", None, Decimal("415250.00"), date(2026, 4, 5), Decimal("0.15"))
    assert got[5].endswith("485") and set(got[5][:-3]) == {"*"} and got[6] == "linc:012r1"
    near = spark.range(1).select(comparables.nearest_500(F.lit(415250.0)), comparables.nearest_500(F.lit(415249.0))).collect()[0]
    assert tuple(near) == (415500, 415000)


def test_tiers(spark):
    s = sale(1, 300000)
    first, _ = search(spark, s, [sale(i, 300000 + i, date(2026, 3, 1)) for i in range(2, 7)])
    assert (first.tier, first.tier_widened, first.candidate_count) == ("tier1_neighbourhood_365", False, 5)
    wide, _ = search(spark, s, [sale(2, 1), sale(3, 1), *[sale(i, 1, nb="N2") for i in (4, 5, 6)]])
    assert (wide.tier, wide.tier_widened, wide.candidate_count) == ("tier2_area_365", True, 5)
    old, _ = search(spark, s, [sale(i, 1, date(2026, 4, 1) - timedelta(500)) for i in range(2, 6)])
    assert (old.tier, old.candidate_count) == ("tier3_area_730", 4)
    none, comps = search(spark, s, [sale(2, 1, date(2026, 4, 2))])
    assert none.candidate_count == 0 and comps.count() == 0


def test_similarity_rank_and_value(spark):
    s = sale(1, 300000)
    twin, older = sale(2, 310000), sale(3, 320000, date(2026, 3, 1))
    _, comps = search(spark, s, [older, twin, sale(4, 330000, size=2000), sale(5, 5000000, size=1000)])
    rows = comps.orderBy("rk").collect()
    assert rows[0].similarity == 98 and rows[0].c_sold_date == date(2026, 4, 1)  # garages unknown: two points less
    assert [r.rk for r in rows] == [1, 2, 3, 4]
    value = comparables.value_subjects(comps).collect()[0]
    assert value.extreme_ppsf_excluded and value.indicated_value in (310000, 320000) and value.first_sold == date(2026, 3, 1)


def test_metrics(spark):
    rows = spark.createDataFrame([(Decimal(e), Decimal(e) / 100000, "a") for e in ("10000", "10000", "5000", "5000")], "absolute_error decimal(12,2), percentage_error decimal(18,6), k string")
    m = backtest.metrics(rows).collect()[0]
    assert (m.mae, m.median_error, m.rmse, m.mape, m.within_05, m.within_10) == (Decimal("7500.00"), Decimal("7500.00"), Decimal("7905.69"), Decimal("7.50"), Decimal("50.00"), Decimal("100.00"))


def test_backtest_accounts_for_every_sale(spark):
    rows = frame(spark, [sale(i, 300000 + 5000 * i, date(2026, 3, 1) + timedelta(10 * i)) for i in range(6)] + [sale(9, 1, property_type=None), sale(10, 0), sale(11, 1, year_built=2030)])
    cases = backtest.cases(rows)
    skipped = {r.reason_code: r.n for r in backtest.skips(rows, cases).collect()}
    assert cases.count() == 3 and skipped == {"INSUFFICIENT_COMPARABLES": 3, "MISSING_PROPERTY_TYPE": 1, "INVALID_SOLD_PRICE": 1, "ENGINE_ERROR": 1}
    assert backtest.coverage(rows, cases).collect()[0].eligible == 7


def test_reconcile_and_promote(spark):
    schema = "mls_number string, sold_date date, sold_price decimal(12,2), list_price decimal(12,2), address string, area_code string, _ord long"
    single = spark.createDataFrame([("202600001", date(2026, 1, 2), Decimal(1), Decimal(1), "1 A St", "A", 1), ("202600002", date(2026, 1, 2), Decimal(5), Decimal(5), "2 B St", "A", 2)], schema)
    full = single.where("_ord = 1").select("mls_number", F.date_add("sold_date", 1).alias("sold_date"), "sold_price", "list_price", "address", F.lit("012R1").alias("linc_number"), F.lit("RD").alias("property_type"), F.lit(900).alias("living_area_sqft"), F.lit(1990).alias("year_built"), F.lit(2).alias("bedrooms_total"), "_ord")
    got = {r.mls_number: r for r in ingestion.validate(ingestion.reconcile(single, full), "2026-02-01").collect()}
    told = {n: [(i.code, i.field) for i in r.issues] for n, r in got.items()}
    assert told["202600001"] == [("SOLD_DATE_CONFLICT", "sold_date")] and got["202600001"].status == "rejected" and got["202600001"].sale_year == 2026
    assert told["202600002"] == [("MISSING_CLIENT_FULL_RECORD", ""), ("MISSING_REQUIRED_FIELD", "property_type")]
    assert got["202600001"].issues[0].detail == "single=2026-01-02 full=2026-01-03"


def test_reconcile_skips_rows_without_number_and_falls_back(spark):
    schema = "mls_number string, sold_date date, sold_price decimal(12,2), list_price decimal(12,2), address string, area_code string, property_type string, year_built int, _ord long"
    row = lambda n, address, kind, year, i: (n, date(2026, 1, 2), Decimal(5), Decimal(5), address, "A", kind, year, i)
    single = spark.createDataFrame([row(None, "x", "RD", 1, 1), row("", "x", "RD", 1, 2), row("ABCD12345", "12 A St", "RD", 1990, 3), row("202600009", "12-A St", "RD", 1990, 4)], schema)
    full = spark.createDataFrame([row("ABCD12345", "12, a  st", "", None, 3), row("202600009", "12 A St", "CN", 1991, 4)], schema)
    got = {r.mls_number: r for r in ingestion.validate(ingestion.reconcile(single, full), "2026-02-01").collect()}
    assert set(got) == {"ABCD12345", "202600009"}
    assert (got["ABCD12345"].property_type, got["ABCD12345"].year_built, got["ABCD12345"].mls_year_hint, got["ABCD12345"].issues) == ("RD", 1990, None, [])
    assert (got["202600009"].property_type, got["202600009"].mls_year_hint, [i.code for i in got["202600009"].issues]) == ("CN", 2026, ["ADDRESS_CONFLICT"])


def test_promotion_gates(spark):
    canonical = spark.createDataFrame([("a", "f1"), ("b", "f2")], "mls_number string, record_fingerprint string")
    staged = spark.createDataFrame([("a", "f1", 1), ("c", "f3", 1), ("b", "x", 2), ("d", "f4", 2), ("e", "f5", 3), ("g", "f6", 4), ("h", "f7", 5), ("i", "f8", 6)], "mls_number string, record_fingerprint string, batch_id int")
    batches = spark.createDataFrame([(1, "staged", 2), (2, "staged", 2), (3, "parsed", 1), (4, "staged", 1), (5, "staged", 9), (6, "staged", 1)], "batch_id int, status string, accepted_count int")
    issues = spark.createDataFrame([(4, "conflict", False), (1, "conflict", True), (6, "rejection", None)], "batch_id int, severity string, resolved boolean")
    plan = ingestion.promotion(staged, canonical)
    gate = ingestion.promotion_gate(plan, batches, issues)
    assert {r.batch_id: r.blocked_by for r in gate.collect()} == {1: None, 2: "canonical conflict", 3: "status", 4: "unresolved conflicts", 5: "accepted_count", 6: "unresolved rejections"}
    once = ingestion.promote(plan, canonical, gate)
    assert {r.mls_number for r in once.collect()} == {"a", "b", "c"}
    again = ingestion.promotion(staged, once)
    assert ingestion.promote(again, once, ingestion.promotion_gate(again, batches, issues)).count() == 3
    after, told = ingestion.promotion_outcome(plan, batches, gate)
    assert {r.batch_id: r.status for r in after.collect()}[1] == "approved" and [(r.batch_id, r.mls_number, r.reason_code) for r in told.collect()] == [(2, "b", "CANONICAL_FINGERPRINT_CONFLICT")]


def test_fingerprints_equal_compact_json(spark):
    import hashlib
    import json

    rows = [("1", " 12 \"A\" é St ", "---", 10.0), ("2", "a\\b\tc 漢😀", None, 2.5), ("3", "", "012 r-1", None)]
    df = spark.createDataFrame(rows, "mls_number string, address string, linc_number string, list_price double")
    for r in T.fingerprinted(df).collect():
        plain = lambda x: "" if x is None else str(int(x)) if isinstance(x, float) and x.is_integer() else str(x).strip()
        fields = {"mls_number": r.mls_number, "linc_number": r.linc_number, "normalized_property_id": r.normalized_property_id, "sold_date": None, "sold_price": None, "list_price": r.list_price, "address": r.address, "postal_code": None}
        text = json.dumps({k: plain(v) for k, v in fields.items()}, sort_keys=True, separators=(",", ":"))
        assert r.record_fingerprint == hashlib.sha256(text.encode()).hexdigest()
    assert [r.normalized_property_id for r in T.fingerprinted(df).orderBy("mls_number").collect()] == ["addr:12ast|", "addr:abc|", "linc:012r1"]


def test_market_dedup(spark):
    rows = spark.createDataFrame([("123456789", 1), ("123-456-789", 2), ("12", 3), ("12", 4), (None, 5)], "mls_number string, _ord long")
    assert {(r.mls_number, r._ord) for r in market.dedupe_valid_mls(rows).collect()} == {("123456789", 2), ("12", 3), ("12", 4), (None, 5)}
    x = spark.createDataFrame([("a", None, 1), ("a", None, 2), ("b", date(2026, 1, 1), 3), ("b", date(2026, 1, 1), 4), ("c", date(2026, 1, 1), 5)], "address string, listing_date date, _ord long")
    assert sorted(r._ord for r in market.insert_new(x, x.where("_ord = 5")).collect()) == [1, 2, 3]


def test_market_tables(spark):
    v = spark.createDataFrame([("Tuxedo", True, "Crawl Space"), ("Nowhere", True, None), (None, True, "Full (Finished)"), ("Tuxedo", False, "x")], "n string, m boolean, b string")
    got = v.select(market.suggested_premium(F.col("n"), F.col("m")), market.basement_adjustment(F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(9.0, -45000), (5.0, 0), (5.0, 25000), (0.0, 0)]
    bands = spark.createDataFrame([(899,), (900,), (1300,), (2499,), (2500,)], "x int").select(S.sqft_band("x")).collect()
    assert [r[0] for r in bands] == ["<900", "900-1299", "1300-1799", "1800-2499", "2500+"]


def test_insufficient_subjects_get_a_row(spark):
    s = sale(1, 300000)
    rows = frame(spark, [s, sale(2, 310000), sale(2, 1, date(2026, 1, 1)), sale(3, 320000, nb="", area="")])
    found = comparables.find_comparables(comparables.as_subjects(frame(spark, [s, sale(9, 1, nb="", area="A1")])), comparables.as_candidates(rows))
    got = {r.s_mls_number: r for r in comparables.search_results(*found).collect()}
    assert got["202600001"].status == "insufficient_data" and got["202600001"].confidence == "insufficient" and got["202600001"].indicated_value is None
    assert got["202600001"].candidate_count == 1 and got["202600001"].confidence_reasons == ["only 1 usable comparables (minimum 3)"]  # a number counts once
    assert got["202600009"].candidate_count == 2


def test_report_pages(spark):
    lines = ["MLS® #:", "202611485", "Sell Price: $310,000", "Sell Date: 04/05/2026", "Remarks: secret", "Baths: F2/H1", "Liv Area: 100 M2 / 1,076 SF", "12 Elm St, Winnipeg r3t 3l2", "Features: pool"]
    page = [("f", 1, 700.04 - 12 * i, 40.0, 90.0, f" {x} ") for i, x in enumerate(lines)] + [("f", 2, 700.0, 1.0, 2.0, "thin"), ("g", 1, 700.0, 1.0, 2.0, " ")]
    df = spark.createDataFrame(page, "file string, page_number int, y double, x0 double, x1 double, text string")
    got = ingestion.client_full_records(df).collect()
    assert len(got) == 1 and (got[0].mls_number, got[0].sold_price, got[0].sold_date, got[0].full_bathrooms, got[0].half_bathrooms, got[0].living_area_sqft, got[0].address, got[0].postal_code) == ("202611485", 310000, date(2026, 4, 5), 2, 1, 1076, "12 Elm St", "R3T 3L2")
    kv = ingestion.flat_pages(df).where("page_number = 1").select(ingestion.labels("lines").alias("kv")).collect()[0].kv
    assert not {"Remarks", "Features"} & set(kv)
    said = {(r.file, r.page_number): (r.status, r.records_found) for r in ingestion.page_diagnostics(df, ingestion.client_full_records(df), "client_full").collect()}
    assert said == {("f", 1): ("ok", 1), ("f", 2): ("needs_ocr", 0)}


def test_storage_guards(spark, tmp_path):
    import pytest

    from hearthframe.operators import reports, storage

    for bad in (tmp_path, tmp_path / "src" / "x"):
        with pytest.raises(storage.Refused):
            storage.guarded(str(bad), ("src",), str(tmp_path))
    assert storage.guarded(str(tmp_path / "out"), ("src",), str(tmp_path)).endswith("out")
    with pytest.raises(storage.Refused):
        storage.without_private(spark.range(1).withColumn("Agent_Email", F.lit(1)))
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    target = str(tmp_path / "t")
    assert storage.append_once(rows, target, "k") == 2 and not storage.exists(spark, target)
    assert [storage.append_once(rows, target, "k", authorized=True) for _ in range(2)] == [2, 0] and spark.read.parquet(target).count() == 2
    tables = {"import_batches": spark.range(3), "staging_sales": spark.createDataFrame([(0, "a"), (0, "a"), (7, "b")], "batch_id long, mls_number string")}
    assert {(r.rule, r.n) for r in storage.violations(tables).collect()} == {("unique staging_sales(batch_id, mls_number)", 1), ("reference staging_sales.batch_id", 1)}
    assert storage.cascade(tables, spark.range(1))["staging_sales"].count() == 1
    sales = frame(spark, [sale(i, 300000 + 5000 * i, date(2026, 3, 1) + timedelta(10 * i)) for i in range(6)])
    parts = reports.write_report_set(sales, str(tmp_path / "report"))
    assert len(parts) == 13 and spark.read.csv(f"{tmp_path}/report/backtest_cases", header=True).count() == 3
    assert "202600005" not in "".join(str(r) for r in spark.read.csv(f"{tmp_path}/report/backtest_failure_cases", header=True).collect())


def test_listing_parsers(spark):
    from hearthframe.operators import listings as L

    rows = [("BDA: 2 TBD: 0 FB: 1 HB: 1 OL / 1987 half", "DOM\n7 days\nDOM 9 or 9 or 3"), ("3 bdrm 1.5 baths Age: 20 Walkout garage", "none here 5 200 40"), (None, ""), ("three quarter bedroom", "DOM listed\nin 12")]
    t = F.col("t")
    got = spark.createDataFrame(rows, "t string, d string").select(L.bedrooms(t), L.bathrooms(t), L.year_built(t, 2026), L.basement(t), L.garage(t), L.days_on_market(F.col("d"))).collect()
    assert [tuple(r) for r in got] == [(2, 1.5, 1987, "Half", "None", 9), (3, 1.5, 2006, "Walkout", "None", 40), (None, None, None, "None", "None", 14), (None, None, None, "Three Quarter", "None", 12)]
    at = spark.createDataFrame([("x 1 Elm St y 22 Oak Ave",)], "t string").select(L.matches(t, L.ADDRESS).alias("m")).collect()[0].m
    assert [(m.start, m.match) for m in at] == [(3, "1 Elm St y 22 Oak Ave")]
    near = L.place_by_likeness(spark.createDataFrame([("by old oak prak now",), ("zz yy xx",), (None,)], "t string"), "t", ("Oak Park", "Elm Bay")).collect()
    assert {(r.t, r.place) for r in near} == {("by old oak prak now", "Oak Park"), ("zz yy xx", None)}


def test_landing_stream_loads_a_fingerprint_once(spark, tmp_path):
    from hearthframe.streaming.landing import load_landing

    (tmp_path / "in").mkdir()
    for i in (1, 2):
        (tmp_path / "in" / f"{i}.csv").write_text("batch_fingerprint,mls_number\nf,1\nf,2\n")
        load_landing(spark, str(tmp_path / "in"), "batch_fingerprint string, mls_number string", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_canonical_scan_orders_and_limits(spark):
    rows = frame(spark, [sale(i, 1, date(2026, 1, i + 1)) for i in range(5)] + [sale(7, 1, None), sale(8, 1, data_quality_status="flagged")])
    assert [r.mls_number for r in T.query_canonical(rows, limit=2).collect()] == ["202600004", "202600003"]
    assert T.query_canonical(rows, min_quality="flagged").count() == 7 and T.query_canonical(rows, undated=False).count() == 5
