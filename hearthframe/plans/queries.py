"""Registered queries: each applies an operator to the domain views; the SQL beside it says the same for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.shared import written
from ..operators import backtest, comparables, ingestion, market, quantiles
from ..sources import tables as T

SALES = """sales AS (SELECT '20' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') AS mls_number,
 CASE WHEN o_custkey % 10 <> 0 THEN '012R' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS linc_number,
 CAST(1 + o_custkey % 999 AS VARCHAR) || ' ' || n_name || ' St' AS address,
 CASE WHEN o_orderkey % 23 <> 0 THEN r_name END AS area_code, CASE WHEN o_orderkey % 23 <> 0 THEN n_name END AS neighbourhood,
 CAST(o_totalprice AS DECIMAL(12,2)) AS sold_price,
 CAST(CAST(o_totalprice AS DECIMAL(12,2)) * CAST(90 + o_orderkey % 21 AS DECIMAL(5,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(12,2)) AS list_price,
 CAST(o_orderdate AS DATE) AS sold_date, CAST(o_orderkey % 30 AS INTEGER) AS dom, c_mktsegment AS property_type,
 CASE WHEN o_orderkey % 13 <> 0 THEN o_orderpriority END AS style, CAST(1900 + o_custkey % 97 AS INTEGER) AS year_built,
 CAST(q * 10 AS INTEGER) AS living_area_sqft, CASE WHEN o_orderkey % 17 <> 0 THEN CAST(1 + o_orderkey % 6 AS INTEGER) END AS bedrooms_total,
 CAST(1 + o_custkey % 3 AS INTEGER) AS full_bathrooms, CAST(o_orderkey % 2 AS INTEGER) AS half_bathrooms,
 CASE o_orderkey % 3 WHEN 0 THEN 'Full' WHEN 1 THEN 'Crawl' END AS basement_type, CAST(NULL AS VARCHAR) AS garage_type,
 CASE WHEN o_orderkey % 29 = 0 THEN 'flagged' ELSE 'approved' END AS data_quality_status, o_orderkey AS _ord
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
 LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey)"""

HOUSING = (
    SALES
    + """, housing AS (SELECT mls_number, address, neighbourhood AS neighborhood, area_code AS region, property_type AS house_type, living_area_sqft AS sqft, year_built AS built_year, dom AS dom_days, bedrooms_total AS bedrooms,
 CAST(full_bathrooms + half_bathrooms * 0.5 AS DOUBLE) AS bathrooms, style, basement_type, garage_type,
 CASE WHEN month(sold_date) IN (12,1,2) THEN 'Winter' WHEN month(sold_date) IN (3,4,5) THEN 'Spring' WHEN month(sold_date) IN (6,7,8) THEN 'Summer' ELSE 'Fall' END AS season,
 list_price, sold_price, CASE WHEN list_price <> 0 THEN CAST(sold_price AS DOUBLE) / CAST(list_price AS DOUBLE) END AS sell_list_ratio, sold_date, _ord FROM sales)"""
)


def rdp(x: str, n: int) -> str:
    return f"CAST(CAST({x} AS DECIMAL(18,6)) AS DECIMAL(18,{n}))"


def _fade(x: str, zero: float) -> str:
    return f"coalesce(greatest(0.0::DOUBLE, 1.0::DOUBLE - ({x}) / {zero}::DOUBLE), 0.0::DOUBLE)"


_BATH = lambda p: f"({p}.full_bathrooms + {p}.half_bathrooms * 0.5::DOUBLE)"
_SIM = " + ".join(
    f"{w}::DOUBLE * ({x})"
    for w, x in (
        (25, "CASE WHEN c.neighbourhood = s.neighbourhood THEN 1.0::DOUBLE WHEN c.area_code = s.area_code THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END"), (25, _fade("abs(c.living_area_sqft - s.living_area_sqft) / CAST(s.living_area_sqft AS DOUBLE)", 0.5)),
        (20, _fade("date_diff('day', c.sold_date, s.sold_date)", 730)), (8, _fade("abs(c.bedrooms_total - s.bedrooms_total)", 3)), (8, _fade(f"abs({_BATH('c')} - {_BATH('s')})", 3)),
        (6, _fade("abs((year(s.sold_date) - s.year_built) - (year(c.sold_date) - c.year_built))", 50)), (4, "CASE WHEN c.style = s.style THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"), (2, "0.0::DOUBLE"), (2, "CASE WHEN c.basement_type = s.basement_type THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"),
    )
)
_TIER = lambda i, geo, days: f"""SELECT {i} AS tier_index, s.mls_number AS s_mls_number, c.mls_number AS c_mls_number, c.sold_date AS c_sold_date, c.sold_price AS c_sold_price, c.living_area_sqft AS c_area, s.living_area_sqft AS s_area,
 {rdp("0.0::DOUBLE + " + _SIM, 2)} AS similarity, {rdp("((c.bedrooms_total IS NOT NULL)::INT + (c.year_built IS NOT NULL)::INT + (c.style IS NOT NULL)::INT + (c.garage_type IS NOT NULL)::INT + (c.basement_type IS NOT NULL)::INT + 1) / 6.0::DOUBLE", 4)} AS data_coverage,
 date_diff('day', c.sold_date, s.sold_date) AS age_days, {rdp("(c.living_area_sqft - s.living_area_sqft) / CAST(s.living_area_sqft AS DOUBLE) * 100", 1)} AS size_diff_pct
 FROM subj s JOIN cand c ON s.property_type = c.property_type AND s.{geo} = c.{geo} AND c.sold_date <= s.sold_date AND c.sold_date >= s.sold_date - {days} AND c.mls_number <> s.mls_number AND c.living_area_sqft > 0 AND c.sold_price > 0"""  # noqa: E731
COMPS = (
    SALES
    + f""", cand AS (SELECT * FROM sales WHERE data_quality_status = 'approved'),
subj AS (SELECT * FROM cand WHERE living_area_sqft > 0 AND sold_price > 0 AND (area_code IS NOT NULL OR neighbourhood IS NOT NULL) AND NOT (year_built > year(sold_date))),
pairs AS ({_TIER(0, "neighbourhood", 365)} UNION ALL {_TIER(1, "area_code", 365)} UNION ALL {_TIER(2, "area_code", 730)}),
cnt AS (SELECT s_mls_number, tier_index, count(*) AS n FROM pairs GROUP BY ALL),
won AS (SELECT s_mls_number, min(tier_index) FILTER (n >= 3) AS w FROM cnt GROUP BY ALL),
srch AS (SELECT x.*, coalesce(n, 0) AS candidate_count FROM (SELECT mls_number AS s_mls_number, coalesce(w, CASE WHEN area_code IS NOT NULL THEN 2 ELSE 0 END) AS tier_index FROM subj LEFT JOIN won ON mls_number = s_mls_number) x LEFT JOIN cnt USING (s_mls_number, tier_index)),
ranked AS (SELECT p.*, candidate_count, row_number() OVER (PARTITION BY s_mls_number ORDER BY similarity DESC, c_sold_date DESC, c_mls_number) AS rk FROM pairs p JOIN srch USING (s_mls_number, tier_index)),
comps AS (SELECT *, ['tier1_neighbourhood_365','tier2_area_365','tier3_area_730'][tier_index + 1] AS tier, tier_index > 0 AS tier_widened FROM ranked WHERE rk <= 10)"""
)
_MID = "rp = floor((n + 1) / 2) OR rp = floor((n + 2) / 2)"
VALUED = (
    COMPS
    + f""", u0 AS (SELECT *, CAST(c_sold_price AS DOUBLE) / CAST(c_area AS DOUBLE) AS ppsf, CAST(c_sold_price AS DOUBLE) * s_area / CAST(c_area AS DOUBLE) AS sn, CAST(c_sold_price AS DOUBLE) AS direct, CAST(similarity AS DOUBLE) AS sim FROM comps WHERE candidate_count >= 3),
u1 AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY s_mls_number ORDER BY ppsf, c_mls_number) AS rp, row_number() OVER (PARTITION BY s_mls_number ORDER BY sim, c_mls_number) AS rs, row_number() OVER (PARTITION BY s_mls_number ORDER BY abs(size_diff_pct), c_mls_number) AS rd FROM u0 WINDOW w AS (PARTITION BY s_mls_number)),
u2 AS (SELECT *, (min(CASE WHEN {_MID} THEN ppsf END) OVER w + max(CASE WHEN {_MID} THEN ppsf END) OVER w) / 2 AS med_ppsf, (min(CASE WHEN {_MID.replace("rp", "rs")} THEN sim END) OVER w + max(CASE WHEN {_MID.replace("rp", "rs")} THEN sim END) OVER w) / 2 AS med_sim FROM u1 WINDOW w AS (PARTITION BY s_mls_number)),
u3 AS (SELECT *, ppsf >= med_ppsf * 0.2::DOUBLE AND ppsf <= med_ppsf * 5.0::DOUBLE AS ok FROM u2), u4 AS (SELECT *, sum(ok::INT) OVER (PARTITION BY s_mls_number) AS n_ok FROM u3),
u5 AS (SELECT *, ok OR n_ok < 3 AS used, CASE WHEN ok OR n_ok < 3 THEN similarity ELSE 0 END AS w FROM u4),
u6 AS (SELECT *, sum(w) OVER (PARTITION BY s_mls_number) AS total, {", ".join(f"CASE WHEN used THEN sum(w) OVER (PARTITION BY s_mls_number ORDER BY {v}, c_mls_number ROWS UNBOUNDED PRECEDING) END AS {v}_cum" for v in ("sn", "direct", "ppsf"))} FROM u5),
v0 AS (SELECT s_mls_number AS mls_number, any_value(tier) AS tier, any_value(tier_widened) AS tier_widened, any_value(candidate_count) AS candidate_count, count(*) AS n_comps,
 {", ".join(f"CAST(floor(min(CASE WHEN sn_cum * {b} >= total * {a} THEN sn END) / 500.0::DOUBLE + 0.5::DOUBLE) * 500 AS BIGINT) AS {n}" for n, a, b in (("indicated_value", 1, 2), ("range_low", 1, 4), ("range_high", 3, 4)))},
 {rdp("min(CASE WHEN direct_cum * 2 >= total THEN direct END)", 2)} AS direct_median, {rdp("min(CASE WHEN ppsf_cum * 2 >= total THEN ppsf END)", 2)} AS median_ppsf, {rdp("any_value(med_sim)", 2)} AS median_similarity, any_value(med_sim) AS sim_raw, sum(data_coverage) AS cov, any_value(n_ok) < count(*) AS extreme_ppsf_excluded,
 min(c_sold_date) AS first_sold, max(c_sold_date) AS last_sold, max(CASE WHEN rd = floor(n / 2) + 1 THEN abs(size_diff_pct) > 25 END) AS size_mismatch, {rdp("CAST(sum(data_coverage) AS DOUBLE) / count(*)", 4)} AS mean_coverage FROM u6 GROUP BY s_mls_number),
v1 AS (SELECT *, CASE WHEN indicated_value > 0 THEN {rdp("(range_high - range_low) / CAST(indicated_value AS DOUBLE)", 4)} ELSE 0 END AS price_spread FROM v0),
valued AS (SELECT *, CASE WHEN n_comps >= 7 AND sim_raw >= 75 AND cov >= 0.75 * n_comps AND price_spread <= 0.20 AND NOT tier_widened THEN 'high' WHEN n_comps >= 4 AND sim_raw >= 60 AND cov >= 0.50 * n_comps AND price_spread <= 0.35 THEN 'medium' ELSE 'low' END AS confidence FROM v1)"""
)
CASES = (
    VALUED
    + f""", cases AS (SELECT *, CASE WHEN price_spread > 0.35 THEN 'WIDE_PRICE_SPREAD' WHEN size_mismatch THEN 'SIZE_MISMATCH' WHEN tier_widened THEN 'GEOGRAPHIC_WIDENING' WHEN median_similarity < 60 THEN 'LOW_SIMILARITY' WHEN mean_coverage < 0.50 THEN 'LOW_DATA_COVERAGE' WHEN percentage_error > 0.25 THEN 'PROPERTY_OUTLIER' ELSE 'UNKNOWN' END AS failure_category FROM
 (SELECT valued.*, sold_date, sold_price, property_type, area_code, neighbourhood, CAST(abs(indicated_value - sold_price) AS DECIMAL(12,2)) AS absolute_error, {rdp("CAST(CAST(abs(indicated_value - sold_price) AS DECIMAL(12,2)) AS DOUBLE) / CAST(sold_price AS DOUBLE)", 6)} AS percentage_error FROM valued JOIN cand USING (mls_number)))"""
)
_METRICS = f"""CAST(count(*) AS BIGINT) AS n, {rdp("CAST(sum(absolute_error) AS DOUBLE) / count(*)", 2)} AS mae, {rdp("quantile_cont(CAST(absolute_error AS DOUBLE), 0.5)", 2)} AS median_error, {rdp("sqrt(CAST(sum(CAST(absolute_error AS DECIMAL(18,2)) * CAST(absolute_error AS DECIMAL(18,2))) AS DOUBLE) / count(*))", 2)} AS rmse,
 {rdp("CAST(sum(percentage_error) AS DOUBLE) / count(*) * 100", 2)} AS mape, {rdp("quantile_cont(CAST(percentage_error AS DOUBLE), 0.5) * 100", 2)} AS median_ape, {", ".join(rdp(f"sum((percentage_error <= {t})::INT) * 100.0::DOUBLE / count(*)", 2) + f" AS within_{t[2:]}" for t in ("0.05", "0.10", "0.15", "0.20"))}"""
_bucket = lambda x, bs, top: "CASE " + " ".join(f"WHEN {x} < {b} THEN '{n}'" for b, n in bs) + f" ELSE '{top}' END"
_KEYS = {
    "tier": "tier", "confidence": "confidence", "property_type": "property_type", "area_code": "area_code", "neighbourhood": "neighbourhood", "comp_count": _bucket("n_comps", [(4, "3"), (6, "4-5"), (8, "6-7")], "8-10"),
    "similarity": _bucket("median_similarity", [(50, "<50"), (60, "50-59.99"), (70, "60-69.99"), (80, "70-79.99")], "80+"), "coverage": _bucket("mean_coverage", [(0.25, "<0.25"), (0.5, "0.25-0.49"), (0.75, "0.50-0.74")], "0.75+"), "sold_month": "strftime(sold_date, '%Y-%m')",
}

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _searched(spark: SparkSession, d: str):
    approved = written(T.sales(spark, d).where("data_quality_status = 'approved'").select(*comparables.SEARCHED, F.monotonically_increasing_id().alias("row")))
    return comparables.find_comparables(comparables.as_subjects(approved), comparables.as_candidates(approved))


# -- scans, filters, joins, windows ---------------------------------------------------------------------------------
PLAIN = [c for c in "mls_number linc_number address area_code neighbourhood sold_price list_price sold_date dom property_type style year_built living_area_sqft bedrooms_total data_quality_status".split()]


@query("src_01_canonical_scan", f"WITH {SALES} SELECT {', '.join(PLAIN)} FROM sales WHERE data_quality_status = 'approved' AND sold_date >= DATE '1997-01-01' AND sold_date <= DATE '1998-12-31' AND property_type = 'BUILDING' ORDER BY sold_date DESC, mls_number LIMIT 200")
def src_01(spark: SparkSession, d: str) -> DataFrame:
    return T.query_canonical(T.sales(spark, d), sold_start="1997-01-01", sold_end="1998-12-31", property_type="BUILDING", limit=200).select(*PLAIN)


@query("src_02_quality_counts", f"WITH {SALES} SELECT data_quality_status, count(*) AS n FROM sales WHERE data_quality_status IN ('approved', 'flagged') GROUP BY ALL")
def src_02(spark, d):
    return T.query_canonical(T.sales(spark, d), min_quality="flagged").groupBy("data_quality_status").agg(F.count(F.lit(1)).alias("n"))


@query("flt_04_subject_eligibility", f"WITH {SALES} SELECT reason_code, count(*) AS n FROM (SELECT CASE WHEN coalesce(living_area_sqft, 0) <= 0 THEN 'INVALID_LIVING_AREA' WHEN area_code IS NULL AND neighbourhood IS NULL THEN 'MISSING_GEOGRAPHY' WHEN year_built > year(sold_date) THEN 'ENGINE_ERROR' ELSE 'eligible' END AS reason_code FROM sales WHERE data_quality_status = 'approved') GROUP BY ALL")
def flt_04(spark, d):
    rows = T.sales(spark, d).where("data_quality_status = 'approved'")
    return rows.groupBy(F.coalesce(comparables.skip_reason(), F.lit("eligible")).alias("reason_code")).agg(F.count(F.lit(1)).alias("n"))


@query("flt_01_candidate_eligibility", f"""WITH {SALES} SELECT reason_code, count(*) AS n FROM (SELECT CASE WHEN c.data_quality_status <> 'approved' THEN 'not_approved' WHEN c.mls_number = s.mls_number THEN 'subject_self' WHEN c.property_type <> s.property_type THEN 'property_type_mismatch' WHEN c.sold_price <= 0 THEN 'non_positive_price'
 WHEN c.sold_date > s.sold_date THEN 'future_sale' WHEN c.sold_date < s.sold_date - 365 THEN 'outside_lookback' WHEN coalesce(c.living_area_sqft, 0) <= 0 THEN 'missing_size' WHEN NOT (coalesce(s.neighbourhood = c.neighbourhood, false) OR coalesce(s.area_code = c.area_code, false)) THEN 'no_geographic_match' ELSE 'eligible' END AS reason_code
 FROM sales s JOIN sales c ON s.address = c.address) GROUP BY ALL""")
def flt_01(spark, d):
    v = T.sales(spark, d)
    s = v.withColumn("valuation_date", F.col("sold_date")).select(*[F.col(c).alias(f"s_{c}") for c in [*v.columns, "valuation_date"]])
    met = s.join(comparables.as_candidates(v), F.col("s_address") == F.col("c_address"))
    return met.groupBy(comparables.eligibility(F.lit(365)).alias("reason_code")).agg(F.count(F.lit(1)).alias("n"))


@query("jn_02_tier_counts", f"WITH {COMPS} SELECT tier_index, count(*) AS n_subjects, CAST(sum(candidate_count) AS BIGINT) AS n_candidates FROM srch GROUP BY ALL")
def jn_02(spark, d):
    searches, _ = _searched(spark, d)
    return searches.groupBy("tier_index").agg(F.count(F.lit(1)).alias("n_subjects"), F.sum("candidate_count").alias("n_candidates"))


@query("q_01_find_comparables", f"WITH {COMPS} SELECT s_mls_number, rk, c_mls_number, similarity, data_coverage, age_days, size_diff_pct, tier, tier_widened, candidate_count FROM comps")
def q_01(spark, d):
    _, comps = _searched(spark, d)
    return comps.select("s_mls_number", F.col("rk").cast("long").alias("rk"), "c_mls_number", "similarity", "data_coverage", F.col("age_days").cast("long").alias("age_days"), "size_diff_pct", "tier", "tier_widened", "candidate_count")


@query("q_02_tier_cascade", f"WITH {COMPS} SELECT s_mls_number, tier_index, candidate_count FROM srch")
def q_02(spark, d):
    return _searched(spark, d)[0].select("s_mls_number", "tier_index", "candidate_count")


_VAL = "mls_number tier tier_widened candidate_count n_comps indicated_value range_low range_high direct_median median_ppsf median_similarity extreme_ppsf_excluded first_sold last_sold size_mismatch mean_coverage price_spread confidence"


@query("scl_07_price_indicators", f"WITH {VALUED} SELECT {_VAL.replace(' ', ', ')} FROM valued")
def scl_07(spark, d):
    searches, comps = _searched(spark, d)
    return comparables.value_subjects(comps, subjects=searches.count()).withColumnRenamed("s_mls_number", "mls_number").select(*_VAL.split())


@query("q_03_backtest_cases", f"WITH {CASES} SELECT mls_number, indicated_value, sold_price, absolute_error, percentage_error, confidence, failure_category FROM cases")
def q_03(spark, d):
    return backtest.cases(T.sales(spark, d)).select("mls_number", "indicated_value", "sold_price", "absolute_error", "percentage_error", "confidence", "failure_category")


@query("agg_08_overall_metrics", f"WITH {CASES} SELECT {_METRICS} FROM cases")
def agg_08(spark, d):
    return backtest.metrics(backtest.cases(T.sales(spark, d)))


@query("agg_09_error_distribution", f"WITH {CASES}, e AS (SELECT CAST(absolute_error AS DOUBLE) AS x FROM cases) SELECT {rdp('min(x)', 2)} AS min, {', '.join(rdp(f'quantile_cont(x, {q})', 2) + f' AS {n}' for n, q in (('p25', 0.25), ('median', 0.5), ('p75', 0.75), ('p90', 0.9), ('p95', 0.95)))}, {rdp('max(x)', 2)} AS max FROM e")
def agg_09(spark, d):
    return backtest.distribution(backtest.cases(T.sales(spark, d)))


@query("agg_11_grouped_metrics", f"WITH {CASES}, g AS ({' UNION ALL '.join(f'''SELECT '{k}' AS dimension, coalesce({v}, '<none>') AS key, absolute_error, percentage_error FROM cases''' for k, v in _KEYS.items())}) SELECT dimension, key, {_METRICS}, count(*) >= 3 AS stable FROM g GROUP BY dimension, key")
def agg_11(spark, d):
    return backtest.grouped_metrics(backtest.cases(T.sales(spark, d)))


@query("agg_12_skips", f"WITH {CASES} SELECT CASE WHEN coalesce(living_area_sqft, 0) <= 0 THEN 'INVALID_LIVING_AREA' WHEN area_code IS NULL AND neighbourhood IS NULL THEN 'MISSING_GEOGRAPHY' WHEN year_built > year(sold_date) THEN 'ENGINE_ERROR' ELSE 'INSUFFICIENT_COMPARABLES' END AS reason_code, count(*) AS n FROM cand WHERE mls_number NOT IN (SELECT mls_number FROM cases) GROUP BY ALL")
def agg_12(spark, d):
    v = T.sales(spark, d)
    return backtest.skips(v, backtest.cases(v))


@query("q_04_backtest_coverage", f"WITH {CASES} SELECT total, eligible, valued, {rdp('CAST(valued AS DOUBLE) / CAST(eligible AS DOUBLE)', 4)} AS coverage FROM (SELECT count(*) AS total, CAST(sum((living_area_sqft > 0 AND (area_code IS NOT NULL OR neighbourhood IS NOT NULL))::INT) AS BIGINT) AS eligible FROM cand), (SELECT count(*) AS valued FROM cases)")
def q_04(spark, d):
    v = T.sales(spark, d)
    return backtest.coverage(v, backtest.cases(v))


@query("srt_02_worst_errors", f"WITH {CASES}, t AS (SELECT * FROM cases ORDER BY absolute_error DESC, mls_number LIMIT 15) SELECT CAST(row_number() OVER (ORDER BY absolute_error DESC, mls_number) AS INTEGER) AS failure_index, repeat('*', length(mls_number) - 3) || right(mls_number, 3) AS masked_mls, absolute_error, percentage_error, failure_category FROM t")
def srt_02(spark, d):
    return backtest.worst(backtest.cases(T.sales(spark, d)))


# -- ingestion and storage ------------------------------------------------------------------------------------------
_K = "regexp_replace(lower({}), '[^a-z0-9]+', '', 'g')"
_W = "trim(regexp_replace(lower(coalesce({}, '')), '[,\\s]+', ' ', 'g'))"
_of = lambda x: ", ".join(f"{v} AS {n}" for n, v in x.items())
_say = lambda c: f"'single=' || CAST(s.{c} AS VARCHAR) || ' full=' || CAST(f.{c} AS VARCHAR)"
_when = lambda test, said: f"CASE WHEN {test} THEN {said} END"
_list = lambda xs: f"list_filter([{', '.join(xs)}], lambda x: x IS NOT NULL)"
_MAYBE = lambda c: f"coalesce(nullif(f.{c}, ''), s.{c}) AS {c}"
_BLOCKS = "['DUPLICATE_MLS','SOLD_DATE_CONFLICT','SOLD_PRICE_CONFLICT','MISSING_REQUIRED_FIELD','INVALID_PRICE','INVALID_DATE','FUTURE_SOLD_DATE']"
RECON = (
    SALES
    + f""", single AS (SELECT * FROM (SELECT {_of(T.SINGLE_LINE)} FROM sales WHERE _ord % 50 <> 1) WHERE mls_number IS NOT NULL), fulls AS (SELECT {_of(T.CLIENT_FULL)} FROM sales WHERE _ord % 50 <> 2),
rec AS (SELECT coalesce(s.mls_number, f.mls_number) AS mls_number, coalesce(f.sold_date, s.sold_date) AS sold_date, coalesce(f.sold_price, s.sold_price) AS sold_price, coalesce(f.list_price, s.list_price) AS list_price, {", ".join(map(_MAYBE, ("address", "area_code", "property_type", "style")))}, coalesce(f.dom, s.dom) AS dom, f.linc_number,
 coalesce(f.year_built, s.year_built) AS year_built, coalesce(f.living_area_sqft, s.living_area_sqft) AS living_area_sqft, f.bedrooms_total, s.mls_number IS NOT NULL AS has_s, f.mls_number IS NOT NULL AS has_f,
 {_list([
     _when("f.mls_number IS NULL", "'MISSING_CLIENT_FULL_RECORD||'"), _when("s.mls_number IS NULL", "'MISSING_SINGLE_LINE_RECORD||'"), _when("s._ord % 50 = 5", "'DUPLICATE_MLS||MLS appears more than once in a source report'"),
     _when("s.sold_date <> f.sold_date", "'SOLD_DATE_CONFLICT|sold_date|' || " + _say("sold_date")), _when("s.sold_price <> f.sold_price", "'SOLD_PRICE_CONFLICT|sold_price|' || " + _say("sold_price")), _when("s.list_price <> f.list_price", "'LIST_PRICE_CONFLICT|list_price|' || " + _say("list_price")),
     _when(f"s.address <> '' AND f.address <> '' AND NOT contains({_W.format('s.address')}, {_W.format('f.address')}) AND NOT contains({_W.format('f.address')}, {_W.format('s.address')})", "'ADDRESS_CONFLICT|address|single=' || chr(39) || s.address || chr(39) || ' full=' || chr(39) || f.address || chr(39)"),
 ])} AS issues0 FROM single s FULL JOIN fulls f ON s.mls_number = f.mls_number),
val AS (SELECT *, list_concat(issues0, {_list([
     *[_when(f"coalesce(CAST({c} AS VARCHAR), '') = ''", f"'MISSING_REQUIRED_FIELD|{c}|'") for c in ("sold_price", "sold_date", "property_type")], _when("coalesce(address, '') = '' AND coalesce(linc_number, '') = ''", "'MISSING_REQUIRED_FIELD|address_or_linc|'"),
     _when("sold_date > DATE '2001-06-30'", "'FUTURE_SOLD_DATE|sold_date|' || CAST(sold_date AS VARCHAR)"), *[_when(f"{c} < 1 OR {c} > 50000000", f"'INVALID_PRICE|{c}|' || CAST({c} AS VARCHAR)") for c in ("sold_price", "list_price")],
     _when("living_area_sqft < 100 OR living_area_sqft > 30000", "'OUT_OF_RANGE|living_area_sqft|' || CAST(living_area_sqft AS VARCHAR)"), _when("year_built < 1850 OR year_built > 2100", "'OUT_OF_RANGE|year_built|' || CAST(year_built AS VARCHAR)"), _when("bedrooms_total > 20", "'OUT_OF_RANGE|bedrooms_total|'"),
 ])}) AS told FROM rec),
acc AS (SELECT * EXCLUDE (issues), issues, CASE WHEN list_has_any(issues, {_BLOCKS}) THEN 'rejected' ELSE 'accepted' END AS status FROM (SELECT *, list_transform(told, lambda x: string_split(x, '|')[1]) AS issues FROM val))"""
)
_told = lambda: F.array_join(F.transform("issues", lambda i: F.concat_ws("|", i["code"], i["field"], i["detail"])), ";")  # noqa: E731  needs a session
_REC = "mls_number sold_date sold_price list_price address area_code linc_number property_type style dom year_built living_area_sqft bedrooms_total"


def _validated(spark, d):
    return ingestion.validate(ingestion.reconcile(*T.two_reports(spark, d)), "2001-06-30")


@query("jn_03_reconcile", f"WITH {RECON} SELECT {_REC.replace(' ', ', ')}, array_to_string(issues0, ';') AS issues, CAST(year(sold_date) AS INTEGER) AS sale_year, CAST(month(sold_date) AS INTEGER) AS sale_month, CAST(substr(mls_number, 1, 4) AS INTEGER) AS mls_year_hint FROM rec")
def jn_03(spark, d):
    x = ingestion.reconcile(*T.two_reports(spark, d))
    return x.select(*_REC.split(), _told().alias("issues"), "sale_year", "sale_month", "mls_year_hint")


@query("flt_07_validate", f"WITH {RECON} SELECT mls_number, array_to_string(told, ';') AS issues, status FROM acc")
def flt_07(spark, d):
    return _validated(spark, d).select("mls_number", _told().alias("issues"), "status")


@query("agg_17_batch_summary", f"""WITH {RECON}, t AS (SELECT CAST(sum((has_s AND has_f)::INT) AS BIGINT) AS matched, CAST(sum((NOT has_f)::INT) AS BIGINT) AS single_only, CAST(sum((NOT has_s)::INT) AS BIGINT) AS full_only, CAST(sum((status = 'accepted')::INT) AS BIGINT) AS accepted, CAST(sum((status = 'rejected')::INT) AS BIGINT) AS rejected, CAST(sum(list_contains(issues, 'DUPLICATE_MLS')::INT) AS BIGINT) AS duplicates,
 CAST(sum(list_has_any(issues, ['SOLD_DATE_CONFLICT', 'SOLD_PRICE_CONFLICT'])::INT) AS BIGINT) AS conflicts, min(sold_date) AS first_sold, max(sold_date) AS last_sold, count(DISTINCT area_code) AS n_areas, sum(has_f::INT) AS f FROM acc)
SELECT matched, single_only, full_only, accepted, rejected, duplicates, conflicts, first_sold, last_sold, n_areas, {rdp("CAST(matched AS DOUBLE) / greatest(f, 1)", 4)} AS match_rate, single_only > 0 OR full_only > 0 OR duplicates > 0 OR conflicts > 0 OR matched < f AS critical_failed FROM t""")
def agg_17(spark, d):
    return ingestion.batch_summary(_validated(spark, d))


@query("prj_06_issue_rows", f"WITH {RECON} SELECT mls_number, x[1] AS reason_code, x[2] AS field_name, x[3] AS message, CASE WHEN x[1] IN ('DUPLICATE_MLS','SOLD_DATE_CONFLICT','SOLD_PRICE_CONFLICT') THEN 'conflict' WHEN x[1] IN ('MISSING_REQUIRED_FIELD','INVALID_PRICE','INVALID_DATE','FUTURE_SOLD_DATE') THEN 'rejected' ELSE 'warning' END AS severity FROM (SELECT mls_number, string_split(unnest(told), '|') AS x FROM acc)")
def prj_06(spark, d):
    return ingestion.issue_rows(_validated(spark, d))


_ESC = r"""'"' || array_to_string(list_transform(string_split({}, ''), lambda c: CASE WHEN c = '"' THEN '\"' WHEN c = '\' THEN '\\' WHEN unicode(c) > 126 THEN printf('\u%04x', unicode(c)) ELSE c END), '') || '"'"""


def _json_sha(parts: dict[str, str]) -> str:
    return "sha256('{' || " + " || ',' || ".join(f"'\"{k}\":' || " + _ESC.format(f"trim(coalesce({v}, ''))") for k, v in sorted(parts.items())) + " || '}')"


def _fp(price: str = "sold_price", address: str = "address") -> str:
    key = lambda x: _K.format(f"coalesce({x}, '')")
    pid = f"CASE WHEN {key('linc_number')} <> '' THEN 'linc:' || {key('linc_number')} WHEN {key(address)} <> '' THEN 'addr:' || {key(address)} || '|' END"
    return _json_sha({"address": address, "linc_number": "linc_number", "list_price": "CAST(list_price AS VARCHAR)", "mls_number": "mls_number", "normalized_property_id": pid, "postal_code": "NULL", "sold_date": "CAST(sold_date AS VARCHAR)", "sold_price": f"CAST({price} AS VARCHAR)"})


_ODD = {"linc_number": "CASE WHEN _ord % 37 = 0 THEN '---' ELSE linc_number END", "address": "CASE _ord % 41 WHEN 0 THEN concat(address, ' \"Café\" ') WHEN 1 THEN '' WHEN 2 THEN concat('  漢 ', address) ELSE address END"}


@query("hsh_01_record_fingerprint", f"WITH {SALES}, x AS (SELECT * REPLACE ({_of(_ODD)}) FROM sales) SELECT mls_number, {_fp()} AS record_fingerprint FROM x")
def hsh_01(spark, d):
    view = T.sales(spark, d)
    odd = view.selectExpr(*[f"{_ODD.get(c, c)} AS {c}" for c in view.columns])
    return T.fingerprinted(odd).select("mls_number", "record_fingerprint")


def _promotion(spark, d):
    canonical = T.fingerprinted(T.sales(spark, d).where("_ord % 4 < 2 and _ord % 3 = 0"))
    staged = T.staged(spark, d)
    batches = staged.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n")).select("batch_id", F.when(F.col("batch_id") == 5, "review_required").otherwise("staged").alias("status"), (F.col("n") + (F.col("batch_id") == 4).cast("int")).alias("accepted_count"))
    issues = spark.range(1).select(F.explode(F.expr("array(named_struct('batch_id', 6, 'severity', 'conflict', 'resolved', false), named_struct('batch_id', 7, 'severity', 'rejection', 'resolved', false), named_struct('batch_id', 2, 'severity', 'conflict', 'resolved', true), named_struct('batch_id', 3, 'severity', 'warning', 'resolved', false))")).alias("i")).select("i.*")
    plan = ingestion.promotion(staged, canonical)
    return plan, canonical, batches, ingestion.promotion_gate(plan, batches, issues)


PROMO = (
    SALES
    + f""", st AS (SELECT *, CAST(CASE WHEN _ord % 4 < 2 THEN _ord % 4 ELSE 2 + _ord % 6 END AS INTEGER) AS batch_id, CAST(CASE WHEN _ord % 97 = 0 THEN sold_price + 1000 ELSE sold_price END AS DECIMAL(12,2)) AS price FROM sales),
plan AS (SELECT *, CASE WHEN NOT (_ord % 4 < 2 AND _ord % 3 = 0) THEN 'insert' WHEN {_fp("price")} = {_fp()} THEN 'skip' ELSE 'conflict' END AS action FROM st),
gate AS (SELECT *, blocked_by IS NULL AS promotable FROM (SELECT batch_id, {", ".join(f"CAST(sum((action = '{a}')::INT) AS BIGINT) AS n_{a}" for a in ("insert", "skip", "conflict"))}, count(*) AS staged, CASE batch_id WHEN 5 THEN 'status' WHEN 6 THEN 'unresolved conflicts' WHEN 7 THEN 'unresolved rejections' WHEN 4 THEN 'accepted_count' ELSE CASE WHEN sum((action = 'conflict')::INT) > 0 THEN 'canonical conflict' END END AS blocked_by FROM plan GROUP BY batch_id))"""
)


@query("jn_05_promotion_actions", f"WITH {PROMO} SELECT mls_number, batch_id, action FROM plan")
def jn_05(spark, d):
    return _promotion(spark, d)[0].select("mls_number", "batch_id", "action")


@query("cst_05_promotion_gate", f"WITH {PROMO} SELECT * FROM gate")
def cst_05(spark, d):
    return _promotion(spark, d)[3]


@query("q_08_promote", f"WITH {PROMO} SELECT mls_number, sold_price FROM sales WHERE _ord % 4 < 2 AND _ord % 3 = 0 UNION ALL SELECT mls_number, price FROM plan JOIN gate USING (batch_id) WHERE promotable AND action = 'insert'")
def q_08(spark, d):
    plan, canonical, _, gate = _promotion(spark, d)
    return ingestion.promote(plan, canonical, gate).select("mls_number", "sold_price")


@query("snk_06_status_after_promotion", f"WITH {PROMO} SELECT batch_id, CASE WHEN promotable THEN 'approved' WHEN batch_id = 5 THEN 'review_required' ELSE 'staged' END AS status, CAST(NULL AS VARCHAR) AS mls_number, CAST(NULL AS VARCHAR) AS reason_code FROM gate UNION ALL SELECT batch_id, NULL, mls_number, 'CANONICAL_FINGERPRINT_CONFLICT' FROM plan JOIN gate USING (batch_id) WHERE blocked_by = 'canonical conflict' AND action = 'conflict'")
def snk_06(spark, d):
    plan, _, batches, gate = _promotion(spark, d)
    after, told = ingestion.promotion_outcome(plan, batches, gate)
    none = F.lit(None).cast("string")
    return after.select("batch_id", "status", none.alias("mls_number"), none.alias("reason_code")).unionByName(told.select("batch_id", none.alias("status"), "mls_number", "reason_code"))


@query("cst_02_violations", f"WITH {SALES} SELECT 'unique_mls_number' AS rule, count(*) AS n FROM (SELECT mls_number FROM (SELECT * FROM sales UNION ALL SELECT * FROM sales WHERE _ord % 50 = 5) GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0")
def cst_02(spark, d):
    v = T.sales(spark, d)
    return ingestion.violations(v.unionByName(v.where("_ord % 50 = 5")))


# -- features, splits, market ---------------------------------------------------------------------------------------
_GARAGE = "CASE WHEN _ord % 7 <> 0 THEN 'Double' END"


@query("q_09_training_features", f"""WITH {HOUSING}, x AS (SELECT * REPLACE ({_GARAGE} AS garage_type), CASE WHEN built_year IS NOT NULL THEN CAST(greatest(0, year(sold_date) - built_year) AS INTEGER) END AS age, sold_price - list_price AS price_diff, CAST(sold_price - list_price AS DOUBLE) / CAST(list_price AS DOUBLE) AS over, CAST(sold_price AS DOUBLE) / sqft AS ppsf FROM housing WHERE bathrooms > 0 AND bedrooms > 0 AND sqft >= 500 AND list_price > 0 AND sold_price > 0 AND dom_days >= 0 AND sold_date IS NOT NULL),
h AS (SELECT neighborhood, median(ppsf) AS med, count(*) AS cc, CAST(sum(CAST(ppsf AS DECIMAL(18,6))) AS DOUBLE) / count(*) AS mean FROM x WHERE neighborhood IS NOT NULL GROUP BY 1), g AS (SELECT quantile_cont(CAST(list_price AS DOUBLE), 0.99) AS cl, quantile_cont(CAST(sold_price AS DOUBLE), 0.99) AS cs, max(sold_date) AS last, max(ppsf) AS top, median(ppsf) AS city FROM x),
y AS (SELECT *, least(CAST(list_price AS DOUBLE), cl) AS lp, CAST(dom_days <= 3 AS INTEGER) AS mo, CAST(dom_days > 11 AS INTEGER) AS nmo, CAST(least(CAST(list_price AS DOUBLE), cl) < med * sqft * 0.95::DOUBLE AND dom_days <= 3 AS INTEGER) AS up, 1 - mean / top AS hot FROM x JOIN h USING (neighborhood), g)
SELECT mls_number, bedrooms, bathrooms, sqft, age, price_diff, CAST(sold_date >= last - 90 AS INTEGER) AS recency_weight, greatest(mo, up) AS likely_multi_offer, mo AS is_multi_offer_by_dom, nmo AS is_not_multi_offer_by_dom, up AS is_underpriced_for_bidding, cc AS comp_count_in_neighborhood, house_type, garage_type, season, neighborhood, style,
 {rdp("lp", 2)} AS list_price, {rdp("over", 4)} AS over_asking_pct, {rdp("ppsf", 2)} AS price_per_sqft, {rdp("hot", 3)} AS neighborhood_hotness, {rdp("med / city", 3)} AS neighborhood_ppsf_premium, {rdp("least(CAST(sold_price AS DOUBLE), cs)", 2)} AS sold_price,
 {rdp("hot * 0.4::DOUBLE + greatest(mo, up) * 0.3::DOUBLE + (1 - age / 100.0::DOUBLE) * 0.3::DOUBLE", 3)} AS realtor_logic, {rdp("CASE season WHEN 'Spring' THEN 1.1::DOUBLE WHEN 'Summer' THEN 1.05::DOUBLE WHEN 'Winter' THEN 0.95::DOUBLE ELSE 1.0::DOUBLE END", 2)} AS season_boost, 0 AS is_hot_area
 FROM y WHERE age IS NOT NULL AND garage_type IS NOT NULL AND style IS NOT NULL AND house_type IS NOT NULL""")
def q_09(spark, d):
    return market.training_features(T.housing(spark, d).withColumn("garage_type", F.expr(_GARAGE)))


@query("prj_11_benchmark_rows", f"WITH {HOUSING} SELECT mls_number, CASE WHEN built_year IS NOT NULL THEN CAST(greatest(0, year(sold_date) - built_year) AS INTEGER) END AS age, CAST(month(sold_date) AS INTEGER) AS sold_month, CAST(NULL AS DOUBLE) AS lot_size, coalesce(neighborhood, 'Unknown') AS neighborhood, coalesce(style, 'Unknown') AS style, 'Unknown' AS garage_type, coalesce(basement_type, 'Unknown') AS basement_type FROM housing WHERE sold_price > 0 AND list_price > 0 AND sqft > 0")
def prj_11(spark, d):
    return market.benchmark_rows(T.housing(spark, d)).select("mls_number", "age", "sold_month", "lot_size", "neighborhood", "style", "garage_type", "basement_type")


SPLIT = (
    HOUSING
    + """, p0 AS (SELECT *, row_number() OVER (ORDER BY sold_date, mls_number) AS pos, count(*) OVER () AS n FROM (SELECT * REPLACE (coalesce(neighborhood, 'Unknown') AS neighborhood, coalesce(house_type, 'Unknown') AS house_type) FROM housing WHERE sqft > 0 AND sold_price > 0 AND list_price > 0)),
p1 AS (SELECT *, CASE WHEN pos <= floor(n * 0.70::DOUBLE) THEN 0 WHEN pos <= floor(n * (0.70::DOUBLE + 0.15::DOUBLE)) THEN 1 ELSE 2 END AS sp FROM p0),
split AS (SELECT *, ['train','val','test'][sp + 1] AS split FROM (SELECT *, min(sp) OVER (PARTITION BY address) AS f FROM p1) WHERE sp = f)"""
)
BASE = (
    SPLIT
    + """, tr AS (SELECT *, CAST(sold_price AS DOUBLE) / sqft AS ppsf FROM split WHERE split <> 'test'), w AS (SELECT median(CAST(sold_price AS DOUBLE)) AS ap, median(ppsf) AS aq FROM tr), hd AS (SELECT neighborhood, median(ppsf) AS hq FROM tr GROUP BY 1),
b AS (SELECT t.mls_number, t.neighborhood, t.house_type, t.sqft, CAST(t.sold_price AS DOUBLE) AS actual, ap AS baseline_global_median, coalesce(hq, aq) * t.sqft AS baseline_comparable_ppsf FROM split t LEFT JOIN hd ON t.neighborhood = hd.neighborhood, w WHERE t.split = 'test')"""
)
_D = lambda x: f"CAST(sum(CAST({x} AS DECIMAL(28,6))) AS DOUBLE)"
_E = "abs(predicted - actual)"


def _split(spark, d):
    return market.chronological_split(market.benchmark_rows(T.housing(spark, d)))


@query("q_10_chronological_split", f"WITH {SPLIT} SELECT mls_number, split FROM split")
def q_10(spark, d):
    return _split(spark, d).select("mls_number", "split")


@query("agg_22_baselines", f"WITH {BASE} SELECT mls_number, {rdp('actual', 2)} AS actual, {rdp('baseline_global_median', 2)} AS baseline_global_median, {rdp('baseline_comparable_ppsf', 2)} AS baseline_comparable_ppsf FROM b")
def agg_22(spark, d):
    return market.baselines(_split(spark, d)).select("mls_number", *[S.rdp(c, 2).alias(c) for c in ("actual", "baseline_global_median", "baseline_comparable_ppsf")])


@query("q_11_benchmark", f"WITH {BASE}, l AS (SELECT 'baseline_global_median' AS model, actual, baseline_global_median AS predicted FROM b UNION ALL SELECT 'baseline_comparable_ppsf', actual, baseline_comparable_ppsf FROM b) SELECT model, count(*) AS n, {rdp(_D(_E) + ' / count(*)', 2)} AS mae, {rdp(f'median({_E})', 2)} AS medae, {rdp(f'sqrt({_D(f'{_E} * {_E}')} / count(*))', 2)} AS rmse, {rdp(_D(_E + ' / actual') + ' / count(*) * 100', 2)} AS mape, {rdp(f'1 - {_D(f'{_E} * {_E}')} / ({_D('actual * actual')} - {_D('actual')} * {_D('actual')} / count(*))', 3)} AS r2 FROM l GROUP BY model")
def q_11(spark, d):
    return market.benchmark(_split(spark, d))


_PB = _bucket("actual", [(300000, "<300k"), (450000, "300-450k"), (600000, "450-600k"), (900000, "600-900k")], "900k+")
_SB = _bucket("sqft", [(900, "<900"), (1300, "900-1299"), (1800, "1300-1799"), (2500, "1800-2499")], "2500+")


@query("agg_24_segment_errors", f"WITH {BASE}, l AS ({' UNION ALL '.join(f'''SELECT '{k}' AS dimension, coalesce({v}, 'Unknown') AS key, actual, baseline_comparable_ppsf AS predicted FROM b''' for k, v in (('neighborhood', 'neighborhood'), ('house_type', 'house_type'), ('price_band', _PB), ('sqft_band', _SB)))}) SELECT dimension, key, count(*) AS n, {rdp(_D(_E) + ' / count(*)', 2)} AS mae, {rdp(f'median({_E})', 2)} AS medae, {rdp(_D(_E + ' / actual') + ' / count(*) * 100', 2)} AS mape FROM l GROUP BY dimension, key")
def agg_24(spark, d):
    return market.segment_errors(_split(spark, d))


PREMIUM = HOUSING + f""", pr AS (SELECT neighborhood, CAST(sum(sold_price) FILTER (m) AS DOUBLE) / count(*) FILTER (m) AS a, CAST(sum(sold_price) FILTER (NOT m) AS DOUBLE) / count(*) FILTER (NOT m) AS b FROM (SELECT *, dom_days <= 3 OR coalesce(sell_list_ratio >= 1.05::DOUBLE, false) AS m FROM housing WHERE neighborhood IS NOT NULL) GROUP BY 1),
premium AS (SELECT neighborhood, {rdp("a", 2)} AS multi_price, {rdp("b", 2)} AS ontime_price, {rdp("(a / b - 1) * 100", 1)} AS premium_pct FROM pr WHERE a IS NOT NULL AND b IS NOT NULL)"""


@query("q_12_multi_offer_premium", f"WITH {PREMIUM} SELECT * FROM premium")
def q_12(spark, d):
    return market.multi_offer_premium(T.housing(spark, d))


_BASEMENT = "CASE _ord % 6 WHEN 0 THEN 'None' WHEN 1 THEN 'Crawl Space' WHEN 2 THEN 'Full (Unfinished)' WHEN 3 THEN 'Full (Finished)' WHEN 4 THEN 'Walkout' END"


@query("prj_14_offer_price", f"WITH {PREMIUM}, o AS (SELECT mls_number, CASE WHEN dom_days <= 3 THEN least(greatest(coalesce(premium_pct, 5.0), 0), 30) ELSE 0 END AS p, list_price, {_BASEMENT} AS basement_type FROM housing LEFT JOIN premium USING (neighborhood)), q AS (SELECT mls_number, CAST(p AS DECIMAL(18,1)) AS premium_used, CAST(list_price AS DOUBLE) * (1 + CAST(p AS DOUBLE) / 100) + CASE basement_type WHEN 'None' THEN -45000 WHEN 'Crawl Space' THEN -45000 WHEN 'Full (Unfinished)' THEN -15000 WHEN 'Full (Finished)' THEN 25000 ELSE 0 END AS offer FROM o) SELECT mls_number, premium_used, {rdp('offer', 2)} AS offer, {rdp('greatest(5000.0::DOUBLE, least(abs(offer * 0.02::DOUBLE), 10000.0::DOUBLE))', 2)} AS buffer FROM q")
def prj_14(spark, d):
    h = T.housing(spark, d).withColumn("basement_type", F.expr(_BASEMENT))
    return market.offer_price(h, market.multi_offer_premium(h))


RENT = "SELECT mls_number, CASE WHEN _ord % 3 = 0 THEN 'condo' ELSE 'house' END AS property_type, sold_price AS price, living_area_sqft AS sqft, CAST(1500 + _ord % 900 AS DECIMAL(12,2)) AS rent, CASE WHEN _ord % 5 <> 0 THEN CAST(700 + _ord % 400 AS DECIMAL(12,2)) END AS mortgage, CASE WHEN _ord % 7 <> 0 THEN CAST(200 + _ord % 90 AS DECIMAL(12,2)) END AS tax_monthly, CAST(60 + _ord % 20 AS DECIMAL(12,2)) AS insurance, CASE WHEN _ord % 6 = 0 THEN CAST(300 AS DECIMAL(12,2)) END AS condo_fee FROM sales"
_RENTED = f"WITH {SALES}, r AS ({RENT}), e AS (SELECT mls_number, CASE WHEN sqft > 0 THEN {rdp('CAST(price AS DOUBLE) / sqft', 2)} END AS price_per_sqft, CAST(coalesce(mortgage, 0) + tax_monthly + insurance + CASE WHEN property_type = 'condo' THEN condo_fee ELSE 0 END AS DECIMAL(12,2)) AS expenses, rent FROM r), f AS (SELECT mls_number, price_per_sqft, expenses, CAST(rent - expenses AS DECIMAL(12,2)) AS net_monthly, CAST((rent - expenses) * 12 AS DECIMAL(14,2)) AS net_annual FROM e)"


def _rented(spark, d):
    k = F.col("_ord")
    dec = lambda c: c.cast("decimal(12,2)")
    v = T.sales(spark, d).select(
        "mls_number", F.when(k % 3 == 0, "condo").otherwise("house").alias("property_type"), F.col("sold_price").alias("price"), F.col("living_area_sqft").alias("sqft"), dec(k % 900 + 1500).alias("rent"), F.when(k % 5 != 0, dec(k % 400 + 700)).alias("mortgage"),
        F.when(k % 7 != 0, dec(k % 90 + 200)).alias("tax_monthly"), dec(k % 20 + 60).alias("insurance"), F.when(k % 6 == 0, dec(F.lit(300))).alias("condo_fee"),
    )
    return market.rental_income(v).select("mls_number", "price_per_sqft", "expenses", "net_monthly", "net_annual")


@query("prj_15_rental_income", f"{_RENTED} SELECT * FROM f")
def prj_15(spark, d):
    return _rented(spark, d)


@query("agg_25_best_rental", f"{_RENTED} SELECT * FROM f WHERE net_monthly IS NOT NULL ORDER BY net_monthly DESC, mls_number LIMIT 1")
def agg_25(spark, d):
    return _rented(spark, d).where("net_monthly is not null").orderBy(F.desc("net_monthly"), "mls_number").limit(1)


@query("ded_01_address_keep_last", f"WITH {SALES} SELECT address, max(_ord) AS last FROM sales GROUP BY address")
def ded_01(spark, d):
    return market.keep_last(T.sales(spark, d), "address").select("address", F.col("_ord").alias("last"))


_BAD = "CASE WHEN _ord % 11 = 0 THEN substr(mls_number, 1, 7) WHEN _ord % 13 = 0 THEN concat('No. ', mls_number) ELSE mls_number END"


@query("ded_03_valid_mls_keep_last", f"WITH {SALES}, x AS (SELECT {_BAD} AS mls_number, _ord FROM sales UNION ALL SELECT {_BAD}, _ord + 100000000 FROM sales WHERE _ord % 2 = 0) SELECT regexp_replace(mls_number, '\\D', '', 'g') AS mls_number, max(_ord) AS _ord FROM x WHERE length(regexp_replace(mls_number, '\\D', '', 'g')) = 9 GROUP BY 1 UNION ALL SELECT mls_number, _ord FROM x WHERE length(regexp_replace(mls_number, '\\D', '', 'g')) <> 9")
def ded_03(spark, d):
    v = T.sales(spark, d).selectExpr(f"{_BAD} AS mls_number", "_ord")
    return market.dedupe_valid_mls(v.unionByName(v.where("_ord % 2 = 0").withColumn("_ord", F.col("_ord") + 100_000_000)))


@query("snk_07_insert_new", f"WITH {SALES}, x AS (SELECT address, CASE WHEN _ord % 19 <> 0 THEN sold_date END AS listing_date, _ord FROM sales), t AS (SELECT * FROM x WHERE _ord % 3 = 0) SELECT address, listing_date, min(_ord) AS first FROM x WHERE listing_date IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t WHERE t.address = x.address AND t.listing_date = x.listing_date) GROUP BY 1, 2 UNION ALL SELECT address, listing_date, _ord FROM x WHERE listing_date IS NULL")
def snk_07(spark, d):
    x = T.sales(spark, d).select("address", F.when(F.col("_ord") % 19 != 0, F.col("sold_date")).alias("listing_date"), "_ord")
    return market.insert_new(x, x.where("_ord % 3 = 0")).select("address", "listing_date", F.col("_ord").alias("first"))


@query("set_02_key_sets", f"WITH {SALES}, s AS (SELECT {T.SINGLE_LINE['mls_number']} AS mls_number FROM sales WHERE _ord % 50 <> 1), f AS (SELECT mls_number FROM sales WHERE _ord % 50 <> 2) SELECT 'both' AS side, count(*) AS n FROM (SELECT * FROM s INTERSECT SELECT * FROM f) UNION ALL SELECT 'single_only', count(*) FROM (SELECT * FROM s EXCEPT SELECT * FROM f) UNION ALL SELECT 'full_only', count(*) FROM (SELECT * FROM f EXCEPT SELECT * FROM s) UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM s UNION SELECT * FROM f)")
def set_02(spark, d):
    s, f = (x.select("mls_number") for x in T.two_reports(spark, d))
    sides = {"both": s.intersect(f), "single_only": s.subtract(f), "full_only": f.subtract(s), "either": s.union(f).distinct()}
    parts = [x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("side"), "n") for k, x in sides.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# -- scalar functions and parsers -----------------------------------------------------------------------------------
@query("str_parsers", rf"""WITH {SALES}, x AS (SELECT _ord, CASE _ord % 4 WHEN 0 THEN 'MLS(R) # ' || mls_number WHEN 1 THEN 'N/A' WHEN 2 THEN 'No. ' || substr(mls_number, 1, 4) || '-' || substr(mls_number, 5) ELSE mls_number END AS raw, '$' || CAST(sold_price AS VARCHAR) AS money, 'Sold: ' || strftime(sold_date, '%m/%d/%Y') AS us FROM sales)
SELECT _ord, CASE WHEN regexp_matches(regexp_replace(raw, '\D', '', 'g'), '20\d{{7}}') THEN regexp_extract(regexp_replace(raw, '\D', '', 'g'), '20\d{{7}}') END AS mls, TRY_CAST(replace(money, '$', '') AS DECIMAL(12,2)) AS price, CAST(strptime(regexp_extract(us, '\d+/\d+/\d+'), '%m/%d/%Y') AS DATE) AS sold FROM x""")
def str_parsers(spark, d):
    m = F.col("mls_number")
    k = F.col("_ord") % 4
    raw = F.when(k == 0, F.concat(F.lit("MLS(R) # "), m)).when(k == 1, "N/A").when(k == 2, F.concat(F.lit("No. "), F.substring(m, 1, 4), F.lit("-"), F.expr("substr(mls_number, 5)"))).otherwise(m)
    x = T.sales(spark, d).select("_ord", raw.alias("raw"), F.concat(F.lit("$"), F.col("sold_price").cast("string")).alias("money"), F.concat(F.lit("Sold: "), F.date_format("sold_date", "MM/dd/yyyy")).alias("us"))
    return x.select("_ord", S.normalize_mls("raw").alias("mls"), S.money("money").alias("price"), S.us_date("us").alias("sold"))


@query("agg_29_pick_lists", f"WITH {SALES} SELECT 'neighbourhood' AS field, array_to_string(list_sort(list_distinct(list(neighbourhood))), '|') AS choices FROM sales UNION ALL SELECT 'property_type', array_to_string(list_sort(list_distinct(list(property_type))), '|') FROM sales")
def agg_29(spark, d):
    v = T.sales(spark, d)
    one = lambda c: v.agg(F.array_join(F.sort_array(F.collect_set(c)), "|").alias("choices")).select(F.lit(c).alias("field"), "choices")
    return one("neighbourhood").unionByName(one("property_type"))


@query("win_07_quintiles", f"WITH {SALES}, e AS (SELECT quantile_cont(CAST(sold_price AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS q FROM sales) SELECT CAST(CASE WHEN p <= q[1] THEN 0 WHEN p <= q[2] THEN 1 WHEN p <= q[3] THEN 2 WHEN p <= q[4] THEN 3 ELSE 4 END AS INTEGER) AS bin, count(*) AS n FROM (SELECT CAST(sold_price AS DOUBLE) AS p FROM sales), e GROUP BY 1")
def win_07(spark, d):
    v = written(T.sales(spark, d).select(F.col("sold_price").cast("double").alias("p")))
    e = quantiles.quantiles(v, {"p": F.col("p")}, (0.2, 0.4, 0.6, 0.8)).select(F.col("quantiles").alias("q"))
    x = v.crossJoin(F.broadcast(e))  # one row of edges
    return x.groupBy(F.size(F.filter("q", lambda c: c < F.col("p"))).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("str_08_visual_rows")
def str_08(spark, d):
    k = F.col("_ord")
    frags = T.sales(spark, d).select(F.lit("a").alias("file"), (k % 40).cast("int").alias("page_number"), (F.lit(700.0) - (k / 40).cast("int") % 50 * 12 + k % 3).cast("double").alias("y"), ((k / 2000).cast("int") * 30.0).alias("x0"), ((k / 2000).cast("int") * 30.0 + 25).alias("x1"), F.col("style").alias("text")).where("text is not null")
    return ingestion.visual_rows(frags)


