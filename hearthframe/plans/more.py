"""Registered queries over report pages, load plans, listings in free text, result views and models, beside those of queries.py."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.shared import shared_folder
from ..operators import backtest, comparables, ingestion, listings, loading, market, models, reports, storage
from ..operators.commits import Store
from ..sources import tables as T
from .queries import _KEYS, _METRICS, _SB, CASES, COMPS, HOUSING, ORACLE_SQL, PREMIUM, SALES, SPLIT, VALUED, _fade, _json_sha, _searched, _split, query, rdp

_BATHS = "({0}.full_bathrooms + {0}.half_bathrooms * 0.5::DOUBLE)"
_PARTS = {
    "geography": "CASE WHEN c.neighbourhood = s.neighbourhood THEN 1.0::DOUBLE WHEN c.area_code = s.area_code THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END", "living_area": _fade("abs(c.living_area_sqft - s.living_area_sqft) / CAST(s.living_area_sqft AS DOUBLE)", 0.5), "recency": _fade("date_diff('day', c.sold_date, s.sold_date)", 730),
    "bedrooms": _fade("abs(c.bedrooms_total - s.bedrooms_total)", 3), "bathrooms": _fade(f"abs({_BATHS.format('c')} - {_BATHS.format('s')})", 3), "year_built": _fade("abs((year(s.sold_date) - s.year_built) - (year(c.sold_date) - c.year_built))", 50), "style": "CASE WHEN c.style = s.style THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END",
    "garage": "0.0::DOUBLE", "basement": "CASE WHEN c.basement_type = s.basement_type THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END",
}
_BOTH = "comps p JOIN sales s ON p.s_mls_number = s.mls_number JOIN sales c ON p.c_mls_number = c.mls_number"
_signed = lambda x, n: f"(CASE WHEN {x} >= 0 THEN '+' ELSE '-' END || CAST(abs({x}) AS DECIMAL(18,{n})))"


# -- comparables, results, reports ----------------------------------------------------------------------------------
@query("scl_02_components", f"WITH {COMPS} SELECT p.s_mls_number, p.rk, {', '.join(f'{rdp(x, 4)} AS {n}, {rdp(f'{comparables.WEIGHTS[n]}.0::DOUBLE * ({x})', 2)} AS weighted_{n}' for n, x in _PARTS.items())} FROM {_BOTH} WHERE p.rk <= 3")
def scl_02(spark: SparkSession, d: str) -> DataFrame:
    comps = _searched(spark, d)[1].where("rk <= 3")
    return comps.select("s_mls_number", F.col("rk").cast("long").alias("rk"), *[c for n in _PARTS for c in (F.col(f"components.{n}").alias(n), F.col(f"weighted.{n}").alias(f"weighted_{n}"))])


@query("str_19_reasons", f"""WITH {COMPS}, x AS (SELECT p.s_mls_number, p.rk, p.size_diff_pct, p.age_days, p.data_coverage, coalesce(s.neighbourhood = c.neighbourhood, false) AS same, coalesce(s.area_code = c.area_code, false) AS area, c.bedrooms_total - s.bedrooms_total AS bd, CAST({_BATHS.format('c')} - {_BATHS.format('s')} AS DECIMAL(10,1)) AS bt, c.year_built - s.year_built AS yd FROM {_BOTH})
SELECT s_mls_number, rk, bd AS bedrooms_diff, bt AS bathrooms_diff, yd AS year_built_diff, array_to_string(list_filter([CASE WHEN same THEN 'same neighbourhood' WHEN area THEN 'same area code (different/unknown neighbourhood)' END, 'living area ' || {_signed('size_diff_pct', 1)} || '% vs subject', 'sold ' || age_days || ' days before valuation date', 'bedrooms ' || {_signed('bd', 0)}, 'bathrooms ' || {_signed('bt', 1)}], lambda x: x IS NOT NULL), '; ') AS reasons,
 array_to_string(list_filter([CASE WHEN data_coverage < 0.5 THEN 'low_data_coverage' END, CASE WHEN abs(size_diff_pct) >= 30 THEN 'large_size_difference' END, CASE WHEN age_days > 365 THEN 'older_than_one_year' END], lambda x: x IS NOT NULL), ';') AS warnings FROM x""")
def str_19(spark, d):
    comps = _searched(spark, d)[1]
    return comps.select("s_mls_number", F.col("rk").cast("long").alias("rk"), "detail.bedrooms_diff", "detail.bathrooms_diff", "detail.year_built_diff", F.array_join(comparables.reasons(), "; ").alias("reasons"), F.array_join(comparables.comparable_warnings(), ";").alias("warnings"))


@query("scl_08_search_results", f"""WITH {VALUED} SELECT s_mls_number, r.candidate_count, CASE WHEN r.candidate_count < 3 THEN 'insufficient_data' ELSE 'ok' END AS status, coalesce(confidence, 'insufficient') AS confidence, indicated_value, CASE WHEN r.candidate_count < 3 THEN 'only ' || r.candidate_count || ' usable comparables (minimum 3)' ELSE n_comps || ' comparables|median similarity ' || {rdp('median_similarity', 1)} || '|mean coverage ' || {rdp('mean_coverage', 2)} || '|price spread ' || {rdp('price_spread', 2)} || '|' || CASE WHEN tier_widened THEN 'geography widened beyond neighbourhood' ELSE 'no geographic widening' END END AS confidence_reasons,
 array_to_string(list_filter([CASE WHEN r.tier_index > CASE WHEN neighbourhood IS NULL THEN 1 ELSE 0 END THEN 'geographic_or_temporal_widening' END, CASE WHEN r.candidate_count < 3 THEN 'insufficient_data' END, CASE WHEN extreme_ppsf_excluded THEN 'extreme_ppsf_excluded' END], lambda x: x IS NOT NULL), ';') AS warnings FROM srch r JOIN sales ON r.s_mls_number = sales.mls_number LEFT JOIN valued v ON v.mls_number = r.s_mls_number""")
def scl_08(spark, d):
    out = comparables.search_results(*_searched(spark, d))
    return out.select("s_mls_number", "candidate_count", "status", "confidence", "indicated_value", F.array_join("confidence_reasons", "|").alias("confidence_reasons"), F.array_join("warnings", ";").alias("warnings"))


@query("prj_03_case_view", f"WITH {CASES} SELECT repeat('*', length(mls_number) - 3) || right(mls_number, 3) AS mls_masked, area_code, neighbourhood, property_type, CAST(sold_date AS VARCHAR) AS sold_date, CAST({rdp('sold_price', 2)} AS VARCHAR) AS actual_sold_price, CAST(indicated_value AS VARCHAR) AS indicated_value, CAST({rdp('absolute_error', 2)} AS VARCHAR) AS absolute_error, CAST({rdp('percentage_error', 4)} AS VARCHAR) AS percentage_error, confidence, tier, tier_widened, n_comps AS selected_comparable_count, median_similarity, price_spread, mean_coverage, failure_category FROM cases")
def prj_03(spark, d):
    return reports.case_view(backtest.cases(T.sales(spark, d)))


@query("srt_03_ranked_groups", f"WITH {CASES}, g AS ({' UNION ALL '.join(f'''SELECT '{k}' AS dimension, coalesce({v}, '<none>') AS key, absolute_error, percentage_error FROM cases''' for k, v in _KEYS.items())}), m AS (SELECT dimension, key, {_METRICS}, count(*) >= 3 AS stable FROM g GROUP BY dimension, key) SELECT *, CAST(row_number() OVER (PARTITION BY dimension ORDER BY n DESC, key) AS INTEGER) AS position FROM m")
def srt_03(spark, d):
    return reports.ranked_groups(backtest.cases(T.sales(spark, d)))


# -- report pages ---------------------------------------------------------------------------------------------------
def _client_full(spark, d):
    """A page of fragments for each sale, of which some are thin."""
    v = T.sales(spark, d)
    whole = lambda c: F.concat(F.lit("$"), F.format_number(F.floor(c), 0))
    line = lambda label, x: F.concat(F.lit(f"{label}: "), x)
    lines = [
        line("MLS® #", F.col("mls_number")), line("List Price", whole("list_price")), F.lit("Sell Price:"), whole("sold_price"), line("Sell Date", F.date_format("sold_date", "MM/dd/yyyy")), line("DOM", F.col("dom").cast("string")), line("Area", F.col("area_code")), line("Nghbrhd", F.col("neighbourhood")),
        line("Type", F.col("property_type")), line("Style", F.col("style")), line("Yr Built/Age", F.concat(F.col("year_built").cast("string"), F.lit("/20"))), line("Liv Area", F.concat(F.lit("100.5 M2 / "), F.format_number("living_area_sqft", 0), F.lit(" SF"))), line("Baths", F.concat(F.lit("F"), F.col("full_bathrooms"), F.lit("/H"), F.col("half_bathrooms"))),
        line("TBD", F.col("bedrooms_total").cast("string")), line("Remarks", F.lit("call 555")), F.concat("address", F.lit(", Winnipeg R3T 3L2")), line("Linc #", F.col("linc_number")), line("Basement", F.col("basement_type")), line("Lot Front", F.lit("15.2 M / 50.0 F")), line("Gross Tax", F.lit("$3,210.55")),
    ]
    thin = F.col("_ord") % 61 == 0
    v = v.select(F.concat(F.lit("f"), (F.col("_ord") % 7).cast("string")).alias("file"), F.col("_ord").cast("int").alias("page_number"), F.posexplode(F.array_compact(F.when(thin, F.array(F.lit(" scan "))).otherwise(F.array(*lines)))).alias("i", "text"))
    return v.select("file", "page_number", (F.lit(700.04) - F.col("i") * 12).alias("y"), F.lit(40.0).alias("x0"), F.lit(90.0).alias("x1"), "text")


@query("str_06_client_full", f"WITH {SALES} SELECT CAST(_ord AS INTEGER) AS page_number, mls_number, linc_number, address, 'R3T 3L2' AS postal_code, area_code, neighbourhood, CAST(floor(list_price) AS BIGINT) AS list_price, CAST(floor(sold_price) AS BIGINT) AS sold_price, sold_date, CAST(dom AS BIGINT) AS dom, property_type, style, year_built, living_area_sqft, CAST(bedrooms_total AS BIGINT) AS bedrooms_total, full_bathrooms, half_bathrooms, basement_type, 50.0::DOUBLE AS lot_front_ft, CAST(NULL AS DOUBLE) AS lot_depth_ft, 3210.55::DOUBLE AS gross_tax FROM sales WHERE _ord % 61 <> 0")
def str_06(spark, d):
    return ingestion.client_full_records(_client_full(spark, d)).drop("file", "status", "bedrooms_above_grade", "tax_year")


@query("agg_30_page_diagnostics", f"WITH {SALES} SELECT status, count(*) AS n, CAST(sum(records) AS BIGINT) AS records, CAST(count(w) AS BIGINT) AS warned FROM (SELECT CASE WHEN _ord % 61 = 0 THEN 'needs_ocr' ELSE 'ok' END AS status, CASE WHEN _ord % 61 = 0 THEN 0 ELSE 1 END AS records, CASE WHEN _ord % 61 = 0 THEN 1 END AS w FROM sales) GROUP BY 1")
def agg_30(spark, d):
    pages = _client_full(spark, d)
    x = ingestion.page_diagnostics(pages, ingestion.client_full_records(pages), "client_full")
    return x.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("records_found").alias("records"), F.count("warning").alias("warned"))


_COLUMNS = (("MLS® #", 50.0), ("S", 110.0), ("Ar Address", 130.0), ("List Price", 300.0), ("Sold Price", 360.0), ("Date", 420.0), ("DOM", 480.0), ("Ty", 510.0), ("Style", 560.0), ("YrBt", 640.0), ("SqFt", 690.0))


def _single_line(spark, d):
    """Table pages of forty sales, with a header, row numbers at the left and texts a little off their columns."""
    k = F.col("_ord")
    page = (k / 40).cast("int")
    v = T.sales(spark, d)
    cells = ["mls_number", F.lit("S"), F.concat((k % 30).cast("string"), F.when(k % 3 == 0, "A").otherwise(""), F.lit(" "), "address"), F.concat(F.lit("$"), F.format_number(F.floor("list_price"), 0)), F.format_number(F.floor("sold_price"), 0), F.date_format("sold_date", "MM/dd/yyyy"), F.col("dom").cast("string"), "property_type", "style", F.col("year_built").cast("string"), F.col("living_area_sqft").cast("string")]
    at = [F.struct(F.lit(x + 3.0).alias("x0"), (F.col(c) if isinstance(c, str) else c).alias("text")) for (_, x), c in zip(_COLUMNS, cells, strict=True)] + [F.struct(F.lit(20.0).alias("x0"), (k % 40).cast("string").alias("text"))]
    rows = v.select(page.alias("page_number"), (F.lit(680.0) - (k % 40) * 12).cast("double").alias("y"), F.explode(F.array(*at)).alias("c")).where("c.text is not null").select("page_number", (F.col("y") + F.when(F.col("c.x0") > 400, 1.5).otherwise(0.0)).alias("y"), "c.x0", "c.text")
    head = v.select(page.alias("page_number")).distinct().select("page_number", F.lit(700.0).alias("y"), F.explode(F.array(*[F.struct(F.lit(x).alias("x0"), F.lit(n).alias("text")) for n, x in _COLUMNS])).alias("c")).select("page_number", "y", "c.x0", "c.text")
    return rows.unionByName(head).select(F.lit("s").alias("file"), "page_number", "y", "x0", (F.col("x0") + 30).alias("x1"), "text")


@query("str_09_single_line", f"WITH {SALES} SELECT mls_number, CAST(_ord // 40 AS INTEGER) AS page_number, CAST(_ord % 30 AS VARCHAR) || CASE WHEN _ord % 3 = 0 THEN 'A' ELSE '' END AS area_code, address, sold_date, property_type, style, CAST(floor(list_price) AS BIGINT) AS list_price, CAST(floor(sold_price) AS BIGINT) AS sold_price, CAST(dom AS BIGINT) AS dom, CAST(year_built AS BIGINT) AS year_built, CAST(living_area_sqft AS BIGINT) AS living_area_sqft FROM sales")
def str_09(spark, d):
    return ingestion.single_line_records(_single_line(spark, d)).drop("file", "status")


# -- load plans, constraints ----------------------------------------------------------------------------------------
def _manifests(spark, d):
    """A manifest per batch of sales, files with some faults, all as text."""
    v = T.staged(spark, d)
    day = F.when(F.col("_ord") % 301 == 4, "1998-13-45").otherwise(F.col("sold_date").cast("string"))
    accepted = v.select("batch_id", "mls_number", day.alias("sold_date"), F.lit(None).cast("string").alias("issue_codes"))
    accepted = accepted.unionByName(accepted.where("batch_id = 0 and mls_number like '%16'"))
    rejected = v.where("_ord % 40 = 9").select("batch_id", "mls_number", F.when(F.col("_ord") % 80 == 9, "INVALID_PRICE|FUTURE_SOLD_DATE").otherwise("").alias("issue_codes"))
    conflicts = v.where("batch_id = 1 and _ord % 90 = 13").select("batch_id", "mls_number", F.lit("SOLD_PRICE_CONFLICT").alias("code"), F.lit("sold_price").alias("field"), F.lit(" single=1 full=2 ").alias("detail"))
    warnings = v.where("_ord % 70 = 3").select("batch_id", "mls_number", F.lit("").alias("code"), F.lit("dom").alias("field"), F.lit(None).cast("string").alias("detail"))
    diagnostics = v.where("_ord % 100 = 7").select("batch_id", F.when(F.col("_ord") % 200 == 7, "needs_ocr").otherwise("ok").alias("status"), F.col("_ord").cast("string").alias("page_number"), F.lit("client_full").alias("report_type"))
    counts = [x.groupBy("batch_id").agg(F.count(F.lit(1)).alias(n)) for n, x in zip(ingestion.COUNTS, (accepted, rejected, conflicts), strict=True)]
    m = v.select("batch_id").distinct()
    for c in counts:
        m = m.join(c, "batch_id", "left")
    k = F.col("batch_id")
    m = m.fillna(0, list(ingestion.COUNTS)).withColumn("rejected", F.col("rejected") + F.when(k == 6, 1).otherwise(0))
    m = m.withColumns({"contract_version": F.when(k == 2, " ").when(k == 3, "old/0").otherwise(ingestion.CONTRACT_VERSIONS[0]), "critical_reconciliation_failed": k == 5, "parser_version": F.lit("p/1"), "single_line_sha256": F.sha2(k.cast("string"), 256), "client_full_sha256": F.sha2(F.concat(F.lit("c"), k.cast("string")), 256)})
    return m, accepted, rejected, conflicts, warnings, diagnostics


_BATCH = "CAST(CASE WHEN _ord % 4 < 2 THEN _ord % 4 ELSE 2 + _ord % 6 END AS INTEGER)"
_REFUSED = f"""{SALES}, b AS (SELECT *, {_BATCH} AS batch_id FROM sales), m AS (SELECT batch_id, CAST(sum((_ord % 40 = 9)::INT) AS BIGINT) AS rej, CAST(sum((batch_id = 1 AND _ord % 90 = 13)::INT) AS BIGINT) AS con FROM b GROUP BY 1),
refused AS (SELECT batch_id, 'missing or empty contract_version in summary.json' AS refusal FROM m WHERE batch_id = 2 UNION ALL SELECT batch_id, 'unsupported contract_version: ' || chr(39) || 'old/0' || chr(39) FROM m WHERE batch_id = 3 UNION ALL SELECT batch_id, 'critical_reconciliation_failed is true in summary.json' FROM m WHERE batch_id = 5 UNION ALL SELECT batch_id, 'summary.rejected=' || (rej + 1) || ' != rejected.csv rows=' || rej FROM m WHERE batch_id = 6
 UNION ALL SELECT batch_id, 'batch has ' || con || ' unresolved critical conflict(s)' FROM m WHERE con > 0 UNION ALL SELECT batch_id, 'duplicate MLS within batch: ' || mls_number FROM b WHERE batch_id = 0 AND mls_number LIKE '%16' UNION ALL SELECT batch_id, 'accepted row MLS ' || mls_number || ' has an invalid sold_date' FROM b, range(CASE WHEN batch_id = 0 AND mls_number LIKE '%16' THEN 2 ELSE 1 END) WHERE _ord % 301 = 4)"""


@query("cst_04_refusals", f"WITH {_REFUSED} SELECT * FROM refused")
def cst_04(spark, d):
    return ingestion.load_refusals(*_manifests(spark, d)[:4])


_BATCH_SHA = _json_sha({"single_line_sha256": "sha256(CAST(batch_id AS VARCHAR))", "client_full_sha256": "sha256('c' || batch_id)", "parser_version": "'p/1'", "contract_version": f"CASE batch_id WHEN 2 THEN ' ' WHEN 3 THEN 'old/0' ELSE '{ingestion.CONTRACT_VERSIONS[0]}' END"})


@query("q_06_load_plan", f"WITH {_REFUSED} SELECT batch_id, {_BATCH_SHA} AS batch_fingerprint, batch_id NOT IN (SELECT batch_id FROM refused) AS safe_to_write FROM m")
def q_06(spark, d):
    parts = _manifests(spark, d)
    return ingestion.load_plan(parts[0], ingestion.load_refusals(*parts[:4])).select("batch_id", "batch_fingerprint", "safe_to_write")


_PLAN_ISSUES = f"""{SALES}, b AS (SELECT *, {_BATCH} AS batch_id FROM sales), issues AS (SELECT batch_id, mls_number, 'conflict' AS severity, 'SOLD_PRICE_CONFLICT' AS reason_code, 'sold_price' AS field_name, CAST(NULL AS INTEGER) AS source_page, 'single=1 full=2' AS message FROM b WHERE batch_id = 1 AND _ord % 90 = 13 UNION ALL SELECT batch_id, mls_number, 'warning', 'WARNING', 'dom', NULL, NULL FROM b WHERE _ord % 70 = 3
 UNION ALL SELECT batch_id, mls_number, 'rejection', unnest(CASE WHEN _ord % 80 = 9 THEN ['INVALID_PRICE', 'FUTURE_SOLD_DATE'] ELSE ['REJECTED'] END), NULL, NULL, NULL FROM b WHERE _ord % 40 = 9 UNION ALL SELECT batch_id, NULL, 'needs_ocr', 'NEEDS_OCR', NULL, CAST(_ord AS INTEGER), 'client_full' FROM b WHERE _ord % 200 = 7)"""


def _plan_issues(spark, d):
    _, _, rejected, conflicts, warnings, diagnostics = _manifests(spark, d)
    return ingestion.plan_issues(conflicts, warnings, rejected, diagnostics)


@query("snk_05_plan_issues", f"WITH {_PLAN_ISSUES} SELECT * FROM issues")
def snk_05(spark, d):
    return _plan_issues(spark, d)


@query("q_07_status_after_load", f"WITH {_PLAN_ISSUES} SELECT batch_id, count(severity) AS n_unresolved, CASE WHEN count(severity) > 0 THEN 'review_required' ELSE 'staged' END AS status FROM (SELECT DISTINCT batch_id FROM b) LEFT JOIN (SELECT * FROM issues WHERE severity <> 'conflict') USING (batch_id) GROUP BY 1")
def q_07(spark, d):
    issues = _plan_issues(spark, d).where("severity != 'conflict'").withColumn("resolved", F.lit(False))
    return ingestion.status_after_load(issues, T.staged(spark, d).select("batch_id").distinct()).select("batch_id", "n_unresolved", "status")


_LOADED = f"""{_PLAN_ISSUES}, safe AS (SELECT DISTINCT batch_id AS batch_key FROM b WHERE batch_id NOT IN (1, 3)), ids AS (SELECT batch_key, row_number() OVER (ORDER BY sha256(CAST(batch_key AS VARCHAR))) AS batch_id FROM safe),
st AS (SELECT i.batch_id, b.mls_number, b.address, CAST(b.sold_price + CASE WHEN _ord % 97 = 0 THEN 1000 ELSE 0 END AS DECIMAL(12,2)) AS sold_price, row_number() OVER (ORDER BY i.batch_id, b.mls_number) AS id FROM b JOIN ids i ON b.batch_id = i.batch_key)"""


def _loaded(spark, d):
    """The tables after the safe batches are loaded into an empty store."""
    v = T.staged(spark, d).withColumnRenamed("batch_id", "batch_key")
    plan = v.groupBy("batch_key").agg(F.count(F.lit(1)).alias("accepted_count"))
    plan = plan.withColumns({"batch_fingerprint": F.sha2(F.col("batch_key").cast("string"), 256), "safe_to_write": ~F.col("batch_key").isin(1, 3)})
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    loading.load_batches(store, plan, v, _plan_issues(spark, d).withColumnRenamed("batch_id", "batch_key"), authorized=True)
    return store


@query("cst_02_all_rules", f"""WITH {SALES}, r AS (SELECT 'check import_batches.status' AS rule, count(*) AS n FROM sales WHERE _ord % 31 = 0 UNION ALL SELECT 'check staging_sales.validation_status', count(*) FROM sales WHERE _ord % 37 = 0
 UNION ALL SELECT 'check import_issues.severity', count(*) FROM sales WHERE _ord % 41 = 0 UNION ALL SELECT 'check canonical_sales.data_quality_status', count(*) FROM sales WHERE _ord % 43 = 0
 UNION ALL SELECT 'unique import_batches(batch_uuid)', count(*) FROM (SELECT 1 FROM sales GROUP BY CASE WHEN _ord % 47 = 0 THEN -1 ELSE _ord END HAVING count(*) > 1) UNION ALL SELECT 'unique import_batches(batch_fingerprint)', count(*) FROM (SELECT 1 FROM sales WHERE _ord % 53 <> 0 GROUP BY _ord - _ord % 2 HAVING count(*) > 1)
 UNION ALL SELECT 'unique staging_sales(batch_id, mls_number)', count(*) FROM (SELECT 1 FROM sales GROUP BY _ord % 5, substr(mls_number, 1, 8) HAVING count(*) > 1) UNION ALL SELECT 'unique canonical_sales(mls_number)', count(*) FROM (SELECT 1 FROM sales GROUP BY substr(mls_number, 1, 8) HAVING count(*) > 1)
 UNION ALL SELECT 'reference staging_sales.batch_id', count(*) FROM sales WHERE _ord % 5 NOT IN (SELECT _ord FROM sales) UNION ALL SELECT 'reference import_issues.batch_id', count(*) FROM sales WHERE _ord % 7 NOT IN (SELECT _ord FROM sales) UNION ALL SELECT 'reference canonical_sales.source_batch_id', count(*) FROM sales WHERE _ord % 9 NOT IN (SELECT _ord FROM sales))
SELECT rule, n FROM r WHERE n > 0""")
def cst_02_all(spark, d):
    k, v = F.col("_ord"), T.sales(spark, d)
    states = lambda n, good: F.when(k % n == 0, "odd").when(k % n != 1, good)  # noqa: E731  nulls pass a check
    short = F.substring("mls_number", 1, 8).alias("mls_number")
    tables = {
        "import_batches": v.select(k.alias("id"), states(31, "staged").alias("status"), F.when(k % 47 == 0, -1).otherwise(k).alias("batch_uuid"), F.when(k % 53 != 0, k - k % 2).alias("batch_fingerprint")),
        "staging_sales": v.select((k % 5).alias("batch_id"), short, states(37, "accepted").alias("validation_status")),
        "import_issues": v.select((k % 7).alias("batch_id"), states(41, "warning").alias("severity")),
        "canonical_sales": v.select((k % 9).alias("source_batch_id"), short, states(43, "approved").alias("data_quality_status")),
    }
    return storage.violations(tables)


@query("snk_04_staged_rows_with_ids", f"WITH {_LOADED} SELECT id, batch_id, mls_number, address, sold_price FROM st")
def snk_04(spark, d):
    return _loaded(spark, d).read("staging_sales").select("id", "batch_id", "mls_number", "address", "sold_price")


@query("jn_07_issues_with_staging_ids", f"WITH {_LOADED} SELECT i.batch_id, x.mls_number, x.severity, x.reason_code, x.field_name, st.id AS staging_sale_id FROM issues x JOIN ids i ON x.batch_id = i.batch_key LEFT JOIN st ON st.batch_id = i.batch_id AND st.mls_number = x.mls_number")
def jn_07(spark, d):
    return _loaded(spark, d).read("import_issues").select("batch_id", "mls_number", "severity", "reason_code", "field_name", "staging_sale_id")


@query("q_07_load_in_one_commit", f"WITH {_LOADED}, r AS (SELECT DISTINCT batch_id AS batch_key FROM b) SELECT batch_key, CASE WHEN i.batch_id IS NULL THEN 'refused' WHEN batch_key IN (SELECT batch_id FROM issues WHERE severity <> 'conflict') THEN 'review_required' ELSE 'staged' END AS status, i.batch_id, CASE WHEN i.batch_id IS NULL THEN 0 ELSE (SELECT count(*) FROM st WHERE st.batch_id = i.batch_id) END AS staged_rows FROM r LEFT JOIN ids i USING (batch_key)")
def q_07_load(spark, d):
    store = _loaded(spark, d)
    x = T.staged(spark, d).select(F.col("batch_id").alias("batch_key"), F.sha2(F.col("batch_id").cast("string"), 256).alias("batch_fingerprint")).distinct()
    rows = store.read("staging_sales").groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))
    out = x.join(store.read("import_batches").select("batch_fingerprint", F.col("id").alias("batch_id"), "status"), "batch_fingerprint", "left").join(rows, "batch_id", "left")
    return out.select("batch_key", F.coalesce("status", F.lit("refused")).alias("status"), "batch_id", F.coalesce("n", F.lit(0)).alias("staged_rows"))


@query("hsh_03_file_digests")
def hsh_03(spark, d):
    return loading.file_digests(spark, f"{d}/orders.parquet", f"{d}/customer.parquet")


@query("prj_02_stored_columns", f"WITH {SALES} SELECT mls_number, sha256(mls_number) AS record_fingerprint, address, sold_price, sold_date, living_area_sqft FROM sales")
def prj_02(spark, d):
    rows = T.sales(spark, d).withColumns({"record_fingerprint": F.sha2("mls_number", 256), "widened": F.lit("a column that no table has")})
    out = storage.stored_rows(rows, "canonical_sales")
    return out.select("mls_number", "record_fingerprint", "address", "sold_price", "sold_date", "living_area_sqft")


@query("agg_18_issue_counts", f"WITH {_PLAN_ISSUES} SELECT batch_id, severity, count(*) AS n FROM issues GROUP BY 1, 2")
def agg_18(spark, d):
    return storage.issue_counts(_plan_issues(spark, d).withColumn("resolved", F.lit(None).cast("boolean")))


@query("cst_01_violations", f"WITH {SALES} SELECT 'check canonical_sales.data_quality_status' AS rule, count(*) AS n FROM sales WHERE _ord % 53 = 0 AND _ord % 59 <> 0 UNION ALL SELECT 'unique canonical_sales(mls_number)', count(*) FROM sales WHERE _ord % 59 = 0 UNION ALL SELECT 'reference canonical_sales.source_batch_id', count(*) FROM (SELECT _ord FROM sales UNION ALL SELECT _ord FROM sales WHERE _ord % 59 = 0) WHERE _ord % 9 = 8")
def cst_01(spark, d):
    v = T.sales(spark, d)
    v = v.unionByName(v.where("_ord % 59 = 0").withColumn("data_quality_status", F.lit("approved"))).withColumn("source_batch_id", F.col("_ord") % 9)
    v = v.withColumn("data_quality_status", F.when((F.col("_ord") % 53 == 0) & (F.col("_ord") % 59 != 0), "odd").otherwise("approved"))
    return storage.violations({"canonical_sales": v, "import_batches": spark.range(8).withColumn("status", F.lit("staged"))})


@query("prj_05_coerced", f"WITH {SALES} SELECT mls_number, CASE WHEN _ord % 5 <> 0 THEN dom END AS dom, CASE WHEN _ord % 7 <> 0 THEN list_price END AS list_price, CASE WHEN _ord % 11 <> 0 THEN sold_date END AS sold_date, style FROM sales")
def prj_05(spark, d):
    k = F.col("_ord")
    v = T.sales(spark, d).select(F.concat(F.lit(" "), "mls_number").alias("mls_number"), F.when(k % 5 == 0, "n/a").when(k % 5 == 1, F.concat(F.col("dom").cast("string"), F.lit(".0"))).otherwise(F.col("dom").cast("string")).alias("dom"), F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("$"), F.format_number("list_price", 2))).alias("list_price"), F.when(k % 11 == 0, "1998-02-31").otherwise(F.col("sold_date").cast("string")).alias("sold_date"), F.coalesce("style", F.lit("  ")).alias("style"))
    return ingestion.coerced(v, ints=("dom",), decimals=("list_price",), dates=("sold_date",))


# -- listings in free text ------------------------------------------------------------------------------------------
_NAMES, _ALIASES, _SUFFIXES = ("Oak Park", "Oak Park North", "River Bend"), {"obend": "River Bend"}, {"cres": "Crescent Town"}
_KIND = "CASE _ord % 4 WHEN 0 THEN 'Townhouse' WHEN 1 THEN 'Condo' ELSE 'Single Family Detached' END"


def _text(spark, d, parts):
    """(path, text): a text for each sale, its lines put together from expressions."""
    return T.sales(spark, d).select(F.col("mls_number").alias("path"), F.concat_ws("\n", *[F.expr(x) for x in parts]).alias("text"), "_ord")


_FLAT = ("concat(1 + _ord % 999, ' Elm St')", "concat('MLS#: ', substr(mls_number, 2))", "concat('DOM: ', dom)", "concat(1000 + _ord % 900, ' SF')", "concat('List Price: $', format_number(floor(list_price), 0))", "CASE WHEN _ord % 6 <> 0 THEN concat('Sold Price: $', format_number(floor(sold_price), 0)) END", "concat(1 + _ord % 6, ' BR ', full_bathrooms, '.5 Bath')", "'Parking: Double Detached'",
         "CASE _ord % 3 WHEN 0 THEN 'Basement: full height' WHEN 1 THEN 'Basement: crawl' END", "CASE WHEN _ord % 2 = 0 THEN 'Bungalow in River Bend' ELSE 'Cabin' END", f"concat('Property Type: ', {_KIND})", "concat(1 + _ord % 999, ' Fir Crescent')", "'no more'")


@query("str_16_text_listings", f"""WITH {SALES}, x AS (SELECT *, CAST(floor(list_price) AS DOUBLE) AS lp, CASE WHEN _ord % 6 <> 0 THEN CAST(floor(sold_price) AS DOUBLE) ELSE 0.0::DOUBLE END AS sp, {_KIND} AS kind FROM sales)
SELECT mls_number AS path, 0 AS position, substr(mls_number, 2) AS mls_number, CASE WHEN _ord % 2 = 0 THEN 'River Bend' ELSE 'Loose Area' END AS neighborhood, CAST(1 + _ord % 999 AS VARCHAR) || ' Elm St' AS address, lp AS list_price, sp AS sold_price, {rdp('sp / lp', 2)} AS sell_list_ratio, dom, CAST(1 + _ord % 6 AS INTEGER) AS bedrooms, full_bathrooms + 0.5::DOUBLE AS bathrooms, 'double detached' AS garage_type,
 CASE _ord % 3 WHEN 0 THEN 'Full' WHEN 1 THEN 'Crawl Space' ELSE 'Unknown' END AS basement, kind AS house_type, CASE WHEN _ord % 2 = 0 THEN 'Bungalow' ELSE 'Cabin' END AS style, kind AS type, CAST(1000 + _ord % 900 AS INTEGER) AS sqft FROM x
UNION ALL SELECT mls_number, 1, substr(md5(CAST(1 + _ord % 999 AS VARCHAR) || ' Fir Crescent'), 1, 10), 'Crescent Town', CAST(1 + _ord % 999 AS VARCHAR) || ' Fir Crescent', 0.0, 0.0, 0, 0, 0, 1.0, 'none', 'Unknown', 'Single Family Detached', 'Other', 'Other', 1200 FROM x""")
def str_16(spark, d):
    return listings.text_listings(_text(spark, d, _FLAT), _NAMES, _SUFFIXES).drop("lot_size", "mls_year_hint")


_SIDE = ("concat('MLS® # ', mls_number)", "'Where -'", "concat(1 + _ord % 999, ' Elm Street')", "'Sale $500 of'", "concat('$', format_number(40000 + _ord, 0), ' and $', format_number(50000 + _ord, 0))", "concat('BDA: 2 TBD: ', _ord % 5)", "concat('FB: ', full_bathrooms, ' HB: ', half_bathrooms)", "concat('DOM ', 1 + dom, ' seen ', 1 + dom, ' of 175:')", "CASE _ord % 4 WHEN 0 THEN 'crawl' WHEN 1 THEN 'Unfinished bedroom' WHEN 2 THEN 'partial full' END",
         "concat('Built: ', year_built)", "'garage attached, double'", "concat(900 + _ord % 99, ' sqft Lot Size: 50 x 100:')", "CASE _ord % 3 WHEN 0 THEN 'near Oak Park North' WHEN 1 THEN 'OBend condo' ELSE 'Split-Level' END")


@query("str_15_side_by_side", f"""WITH {SALES}, x AS (SELECT *, 40000.0::DOUBLE + _ord AS lp, 50000.0::DOUBLE + _ord AS sp FROM sales) SELECT mls_number AS path, mls_number, CAST(substr(mls_number, 1, 4) AS INTEGER) AS mls_year_hint, CAST(1 + _ord % 999 AS VARCHAR) || ' Elm Street' AS address, CASE _ord % 3 WHEN 0 THEN 'Oak Park North' WHEN 1 THEN 'River Bend' ELSE 'Loose Area' END AS neighborhood, lp AS list_price, sp AS sold_price, {rdp('sp / lp', 2)} AS sell_list_ratio,
 CAST(CASE WHEN _ord % 5 > 0 THEN _ord % 5 ELSE 2 END AS INTEGER) AS bedrooms, full_bathrooms + 0.5::DOUBLE * half_bathrooms AS bathrooms, 1 + dom AS dom_days, CASE _ord % 4 WHEN 0 THEN 'Crawl Space' WHEN 1 THEN 'Unfinished' WHEN 2 THEN 'Partial' ELSE 'None' END AS basement_type, 'Attached, Double' AS garage_type, year_built AS built_year, CASE WHEN _ord % 3 = 1 THEN 'Condo' ELSE 'Single Family Detached' END AS house_type, CASE WHEN _ord % 3 = 2 THEN 'Split-Level' END AS style, CAST(900 + _ord % 99 AS INTEGER) AS sqft, CAST(464.52 AS DECIMAL(18,2)) AS lot_size FROM x""")
def str_15(spark, d):
    return listings.side_by_side(_text(spark, d, _SIDE).withColumn("page_number", F.lit(0)), 2026, _ALIASES, _NAMES).drop("page_number", "position")


_MISSING = ("concat(1 + _ord % 999, ' Elm St Winnipeg R3T 3L2')", "concat('MLS no ', mls_number)", "concat('List Price: $', format_number(floor(list_price), 0))", "concat('Sell Price: $', format_number(floor(sold_price), 0))", "concat('DOM: ', dom)", "concat('Yr Built/Age: ', year_built)", "concat('Liv Area: 99.5 M2 / ', format_number(1000 + _ord % 900, 0), ' SF')", "'Parking: Single Pad '", "concat('Type: ', property_type)", "concat('BDA: ', 1 + _ord % 6)", "concat('Baths: ', full_bathrooms, '/H', half_bathrooms)", "concat('Nghbrhd: ', neighbourhood)", "'77 Oak Rd Winnipeg R2C1A1 only'")


def _missing(spark, d):
    return listings.missing_listings(_text(spark, d, _MISSING))


_MISSED = f"""{SALES}, miss AS (SELECT mls_number AS path, 0 AS position, mls_number, CAST(1 + _ord % 999 AS VARCHAR) || ' Elm St Winnipeg' AS address, CAST(floor(list_price) AS INTEGER) AS list_price, CAST(floor(sold_price) AS INTEGER) AS sold_price, property_type AS house_type, CAST(1 + _ord % 6 AS INTEGER) AS bedrooms, full_bathrooms + 0.5::DOUBLE * half_bathrooms AS bathrooms, dom, year_built AS built_year, 'single pad' AS garage_type, CAST(1000 + _ord % 900 AS INTEGER) AS sqft, neighbourhood AS neighborhood FROM sales
 UNION ALL SELECT mls_number, 1, NULL, '77 Oak Rd Winnipeg', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM sales)"""


@query("str_17_missing_listings", f"WITH {_MISSED} SELECT * FROM miss")
def str_17(spark, d):
    return _missing(spark, d).drop("mls_year_hint", "original_price", "region")


@query("q_15_missing_merge", f"WITH {_MISSED} SELECT mls_number, list_price FROM miss WHERE mls_number IS NOT NULL UNION ALL SELECT mls_number, list_price FROM miss WHERE mls_number IS NULL")
def q_15(spark, d):
    new = _missing(spark, d).select("mls_number", "list_price", F.lit(1).alias("_ord"))
    old = new.where("mls_number like '%7'").withColumns({"list_price": F.lit(0), "_ord": F.lit(0), "mls_number": F.concat(F.lit("#"), "mls_number")})
    return market.dedupe_valid_mls(old.unionByName(new)).drop("_ord")


@query("q_13_final_merge", f"WITH {SALES}, x AS (SELECT address, list_price, 0 AS f, _ord FROM sales WHERE _ord % 2 = 0 UNION ALL SELECT address, sold_price, 1, _ord FROM sales WHERE _ord % 3 = 0) SELECT address, max_by(list_price, (f, _ord)) AS list_price FROM x GROUP BY 1")
def q_13(spark, d):
    v = T.sales(spark, d)
    return listings.merge_sales(("address", "list_price"), v.where("_ord % 2 = 0"), v.where("_ord % 3 = 0").withColumn("list_price", F.col("sold_price")))


@query("jn_12_fuzzy_place")
def jn_12(spark, d):
    words = F.concat(F.lit("in the "), F.when(F.col("_ord") % 3 == 0, "oka park nroth").when(F.col("_ord") % 3 == 1, "river bnd").otherwise("old town"), F.lit(" of "), (F.col("_ord") % 50).cast("string"))
    return listings.place_by_likeness(T.sales(spark, d).select(words.alias("text")), "text", _NAMES)


# -- small operators, models ----------------------------------------------------------------------------------------
_HOOD = "CASE _ord % 5 WHEN 0 THEN 'Tuxedo' WHEN 1 THEN 'Sage Creek' WHEN 2 THEN 'Maples' WHEN 3 THEN NULL ELSE 'Elsewhere' END"


@query("scl_13_suggested_premium", f"WITH {SALES} SELECT mls_number, CASE WHEN dom > 3 THEN 0.0::DOUBLE ELSE CASE _ord % 5 WHEN 0 THEN 9.0::DOUBLE WHEN 1 THEN 6.5::DOUBLE WHEN 2 THEN 5.5::DOUBLE ELSE 5.0::DOUBLE END END AS premium FROM sales")
def scl_13(spark, d):
    return T.sales(spark, d).select("mls_number", market.suggested_premium(F.expr(_HOOD), F.col("dom") <= 3).alias("premium"))


@query("scl_14_square_metres", f"WITH {SALES} SELECT mls_number, CAST(CAST(living_area_sqft AS DECIMAL(18,6)) * 0.092903 AS DECIMAL(18,2)) AS m2 FROM sales")
def scl_14(spark, d):
    return T.sales(spark, d).select("mls_number", S.square_metres("living_area_sqft").alias("m2"))


@query("str_04_split_area", f"WITH {SALES} SELECT mls_number, CASE WHEN _ord % 3 <> 2 THEN CAST(_ord % 40 AS VARCHAR) || CASE WHEN _ord % 3 = 0 THEN 'B' ELSE '' END END AS area, address FROM sales")
def str_04(spark, d):
    k = F.col("_ord")
    raw = F.when(k % 3 == 2, F.concat(F.lit("x-"), "address")).otherwise(F.concat(F.lit(" "), (k % 40).cast("string"), F.when(k % 3 == 0, "B").otherwise(""), F.lit("  "), "address"))
    area, address = S.split_area(raw)
    return T.sales(spark, d).select("mls_number", area.alias("area"), F.regexp_replace(address, "^x-", "").alias("address"))


@query("hsh_04_surrogate_mls", f"WITH {SALES} SELECT _ord, substr(md5(address), 1, 10) AS surrogate FROM sales")
def hsh_04(spark, d):
    return T.sales(spark, d).select("_ord", S.surrogate_mls("address").alias("surrogate"))


@query("agg_27_modal_dom", f"WITH {SALES}, c AS (SELECT area_code, dom, count(*) AS n, min(_ord) AS f FROM sales WHERE area_code IS NOT NULL GROUP BY 1, 2) SELECT area_code, dom, n FROM c QUALIFY row_number() OVER (PARTITION BY area_code ORDER BY n DESC, f) = 1")
def agg_27(spark, d):
    return market.modal(T.sales(spark, d).where("area_code is not null"), "area_code", "dom")


@query("flt_11_listing_clean", f"WITH {SALES}, x AS (SELECT mls_number, address, list_price, _ord FROM sales UNION ALL SELECT mls_number, address, CASE WHEN _ord % 10 = 0 THEN 0 ELSE list_price + 1 END, _ord + 1000000 FROM sales WHERE _ord % 5 = 0) SELECT mls_number, CAST(max_by(list_price, _ord) AS DECIMAL(12,2)) AS list_price FROM x GROUP BY mls_number, address HAVING max_by(list_price, _ord) > 0")
def flt_11(spark, d):
    v = T.sales(spark, d).select("mls_number", "address", "list_price", "_ord")
    again = v.where("_ord % 5 = 0").select("mls_number", "address", F.when(F.col("_ord") % 10 == 0, 0).otherwise(F.col("list_price") + 1).cast("decimal(12,2)").alias("list_price"), (F.col("_ord") + 1_000_000).alias("_ord"))
    return market.keep_last_listing(v.unionByName(again)).select("mls_number", "list_price")


@query("win_08_aligned", f"WITH {SALES}, a AS (SELECT _ord % 40 AS page, address, row_number() OVER (PARTITION BY _ord % 40 ORDER BY _ord) AS i FROM sales), b AS (SELECT _ord % 40 AS page, mls_number, row_number() OVER (PARTITION BY _ord % 40 ORDER BY _ord) AS i FROM sales WHERE _ord % 3 > 0) SELECT page, CAST(i AS INTEGER) AS position, address, mls_number FROM a JOIN b USING (page, i)")
def win_08(spark, d):
    v = T.sales(spark, d).withColumn("page", F.col("_ord") % 40)
    return market.aligned(v.select("page", "address", "_ord"), v.where("_ord % 3 > 0").select("page", "mls_number", "_ord"))


@query("srt_06_premium_order", f"WITH {PREMIUM} SELECT neighborhood, premium_pct, CAST(row_number() OVER (ORDER BY premium_pct DESC, neighborhood) AS INTEGER) AS position FROM premium")
def srt_06(spark, d):
    from pyspark.sql import Window

    x = market.multi_offer_premium(T.housing(spark, d))
    return x.select("neighborhood", "premium_pct", F.row_number().over(Window.orderBy(F.desc("premium_pct"), "neighborhood")).alias("position"))  # a row per neighbourhood


@query("prj_12_served_features", f"WITH {HOUSING} SELECT h.mls_number, CASE WHEN h.neighborhood IS NULL THEN 0 ELSE n END AS comp_count_in_neighborhood, {rdp('CAST(list_price AS DOUBLE) / greatest(sqft, 1)', 2)} AS price_per_sqft, 0 AS price_diff, 0.5::DOUBLE AS realtor_logic FROM housing h LEFT JOIN (SELECT neighborhood, count(*) AS n FROM housing GROUP BY 1) c ON h.neighborhood = c.neighborhood")
def prj_12(spark, d):
    x = models.served_features(T.housing(spark, d))
    return x.select("mls_number", F.col("comp_count_in_neighborhood").cast("long").alias("comp_count_in_neighborhood"), S.rdp("price_per_sqft", 2).alias("price_per_sqft"), "price_diff", F.col("realtor_logic").cast("double").alias("realtor_logic"))


@query("ml_05_stratified_split", f"WITH {SALES}, e AS (SELECT quantile_cont(CAST(sold_price AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS q FROM sales) SELECT CAST(len(list_filter(q, lambda x: x < sold_price)) AS INTEGER) AS bin, count(*) AS n, true AS near FROM sales, e GROUP BY 1")
def ml_05(spark, d):
    x = models.stratified_split(T.sales(spark, d)).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("split") == "test").cast("int")).alias("t"))
    return x.select("bin", "n", (F.abs(F.col("t") / F.col("n") - 0.2) < 0.1).alias("near"))


@query("ml_02_model_comparison")
def ml_02(spark, d):
    """Ridge, forest and boosted trees beside the baselines; figures of fitted models have no SQL."""
    return models.compare(_split(spark, d), trees=20, rounds=20)


@query("ml_03_extra_trees")
def ml_03(spark, d):
    """Extremely randomised trees on the test rows; fitted models have no SQL."""
    return market.regression_metrics(models.tree_predictions(_split(spark, d), "extra_trees", trees=8, depth=7), "model")


@query("ml_04_leafwise_boosting")
def ml_04(spark, d):
    return market.regression_metrics(models.tree_predictions(_split(spark, d), "leafwise_boosting", rounds=8, leaves=15, rate=0.4, patience=3), "model")


@query("agg_26_models_by_error", f"SELECT model, mae, CAST(row_number() OVER (ORDER BY mae, model) AS INTEGER) AS rank FROM ({ORACLE_SQL['q_11_benchmark']})")
def agg_26(spark, d):
    return market.best_model(market.benchmark(_split(spark, d))).select("model", "mae", F.col("rank").cast("int").alias("rank"))


@query("snk_12_benchmark_files", f"SELECT model, CAST(n AS VARCHAR) AS n, CAST(CAST(mae AS DECIMAL(18,2)) AS VARCHAR) AS mae, CAST(CAST(medae AS DECIMAL(18,2)) AS VARCHAR) AS medae FROM ({ORACLE_SQL['q_11_benchmark']})")
def snk_12(spark, d):
    folder = _fresh(spark)
    reports.write_benchmark(_split(spark, d), folder)
    return T.read_csv(spark, f"{folder}/metrics").select("model", "n", "mae", "medae")


# -- sources and sinks: what is written from the sales is read back --------------------------------------------------
def _fresh(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


_ROW = "mls_number, address, neighbourhood, CAST(sold_price AS VARCHAR) AS sold_price, CAST(sold_date AS VARCHAR) AS sold_date, style"


@query("src_09_csv_scan", f"WITH {SALES} SELECT {_ROW}, 'a \"quoted\", word' || chr(10) || 'line' AS note FROM sales")
def src_09(spark, d):
    folder = _fresh(spark)
    v = T.sales(spark, d).select("mls_number", "address", "neighbourhood", "sold_price", "sold_date", "style", F.lit('a "quoted", word\nline').alias("note"))
    v.write.csv(folder, header=True, escape='"', emptyValue="")
    return T.read_csv(spark, folder)


@query("src_10_json_scan", f"WITH {SALES} SELECT mls_number, address, neighbourhood, CAST(living_area_sqft AS BIGINT) AS living_area_sqft FROM sales")
def src_10(spark, d):
    folder = _fresh(spark)
    v = T.sales(spark, d).select("mls_number", "address", "neighbourhood", "living_area_sqft", (F.col("_ord") % 64).alias("k"))
    lists = v.groupBy("k").agg(F.to_json(F.collect_list(F.struct("mls_number", "address", "neighbourhood", "living_area_sqft"))).alias("value"))
    lists.select("value").write.option("maxRecordsPerFile", 1).text(folder)
    return T.read_json(spark, folder).select("mls_number", "address", "neighbourhood", "living_area_sqft")


@query("src_12_text_pages", f"WITH {SALES} SELECT CAST(row_number() OVER (PARTITION BY _ord % 64 ORDER BY mls_number) AS INTEGER) AS page_number, mls_number || ' ' || address AS text FROM sales")
def src_12(spark, d):
    """Text files of a folder, told by their extension, cut into pages; a file beside them that is no text is not read."""
    folder = _fresh(spark)
    v = T.sales(spark, d).select((F.col("_ord") % 64).alias("k"), F.concat_ws(" ", "mls_number", "address").alias("t"))
    v.groupBy("k").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list("t")), lambda t: F.concat(F.lit("Page "), t, F.lit("\n")))).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(folder)
    v.limit(10).write.mode("append").csv(folder)
    return T.read_pages(spark, folder).select("page_number", F.regexp_replace("text", r"\s+$", "").alias("text"))


@query("snk_10_append_once", f"WITH {SALES} SELECT mls_number, sold_price FROM sales")
def snk_10(spark, d):
    store, v = Store(spark, _fresh(spark)), T.sales(spark, d).select("mls_number", "sold_price", "_ord")
    for rows in (v.where("_ord % 3 = 0"), v, v.where("_ord % 2 = 0")):
        store.append_once(rows.drop("_ord"), "sales", "mls_number")
    return store.read("sales")


@query("jn_06_known_batches", f"WITH {_LOADED} SELECT batch_key FROM safe")
def jn_06(spark, d):
    plan = T.staged(spark, d).select(F.col("batch_id").alias("batch_key"), F.sha2(F.col("batch_id").cast("string"), 256).alias("batch_fingerprint")).distinct()
    return loading.known_fingerprints(_loaded(spark, d), plan).select("batch_key")


@query("q_03_case_notes", f"WITH {CASES} SELECT mls_number, concat_ws('|', CASE WHEN tier_widened THEN 'geographic_or_temporal_widening' END, CASE WHEN extreme_ppsf_excluded THEN 'extreme_ppsf_excluded' END) AS warnings, concat_ws('|', CASE WHEN bedrooms_total IS NULL THEN 'bedrooms_total' END, CASE WHEN style IS NULL THEN 'style' END, 'garage_type', CASE WHEN basement_type IS NULL THEN 'basement_type' END) AS missing FROM cases JOIN (SELECT mls_number, bedrooms_total, style, basement_type FROM cand) USING (mls_number)")
def q_03_notes(spark, d):
    return backtest.cases(T.sales(spark, d)).select("mls_number", F.array_join("warnings", "|").alias("warnings"), F.array_join("missing_subject_fields", "|").alias("missing"))


@query("prj_16_legacy_fill", f"""WITH {SALES}, x AS (SELECT mls_number, neighbourhood AS neighborhood, repeat(address, 20) AS address, CASE _ord % 5 WHEN 0 THEN NULL WHEN 1 THEN 'two' ELSE CAST(bedrooms_total AS VARCHAR) || '.7' END AS bedrooms, CASE WHEN _ord % 7 <> 0 THEN CAST(full_bathrooms AS DOUBLE) END AS bathrooms, sold_price, sold_date FROM sales)
SELECT mls_number, coalesce(neighborhood, 'none') AS neighborhood, substr(address, 1, 255) AS address, CASE WHEN bedrooms IS NULL THEN 0 WHEN bedrooms = 'two' THEN 0 ELSE CAST(substr(bedrooms, 1, 1) AS BIGINT) END AS bedrooms, coalesce(bathrooms, 1.0::DOUBLE) AS bathrooms, CAST(floor(sold_price) AS BIGINT) AS sold_price, 1.0::DOUBLE AS sell_list_ratio, 'Unknown' AS season, CASE WHEN month(sold_date) <> 5 THEN sold_date END AS listing_date FROM x""")
def prj_16(spark, d):
    k = F.col("_ord")
    bedrooms = F.when(k % 5 == 0, None).when(k % 5 == 1, "two").otherwise(F.concat(F.col("bedrooms_total").cast("string"), F.lit(".7")))
    x = T.sales(spark, d).select("mls_number", F.col("neighbourhood").alias("neighborhood"), F.repeat("address", 20).alias("address"), bedrooms.alias("bedrooms"), F.when(k % 7 != 0, F.col("full_bathrooms").cast("double")).alias("bathrooms"), "sold_price", F.when(F.month("sold_date") != 5, F.col("sold_date").cast("string")).alias("listing_date"))
    return market.legacy_filled(x).select("mls_number", "neighborhood", "address", "bedrooms", "bathrooms", "sold_price", "sell_list_ratio", "season", "listing_date")


@query("src_14_synthetic_sales")
def src_14(spark, d):
    return T.synthetic_sales(spark, 10_000)
