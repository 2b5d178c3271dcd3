"""Readers, and the domain views over the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import FINGERPRINT_FIELDS, fingerprint, property_id, season


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; a quote within a field is doubled; fields may hold line ends."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def read_pages(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(path, page_number, text): flat text files of a folder cut at "Page "."""
    whole = spark.read.text(path, wholetext=True, pathGlobFilter=pattern).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.select("path", F.posexplode(F.split("value", "Page ")).alias("page_number", "text")).where(F.trim("text") != "")


def query_canonical(sales: DataFrame, *, sold_start=None, sold_end=None, neighbourhood=None, area_code=None, property_type=None, exclude_mls=None, min_quality="approved", limit=None, undated=True) -> DataFrame:
    """The filtered canonical scan: every argument given is one more conjunct; latest sales first. undated=False leaves out sales without a date."""
    if min_quality not in ("approved", "flagged"):
        raise ValueError(f"unknown quality: {min_quality!r}")
    keep = [F.col("data_quality_status").isin(["approved", "flagged"] if min_quality == "flagged" else ["approved"])]
    if sold_start is not None:
        keep.append(F.col("sold_date") >= F.lit(sold_start).cast("date"))
    if sold_end is not None:
        keep.append(F.col("sold_date") <= F.lit(sold_end).cast("date"))
    for name, value in (("neighbourhood", neighbourhood), ("area_code", area_code), ("property_type", property_type)):
        if value is not None:
            keep.append(F.col(name) == value)
    if not undated:
        keep.append(F.col("sold_date").isNotNull())
    if exclude_mls is not None:
        keep.append(F.col("mls_number") != exclude_mls)
    out = sales.where(reduce(lambda a, b: a & b, keep)).orderBy(F.col("sold_date").desc_nulls_last(), "mls_number")
    return out.limit(limit) if limit is not None else out


def sales(spark: SparkSession, folder: str) -> DataFrame:
    """One sale per order, with the nulls that the analytics must survive."""
    t = lambda n: table(spark, folder, n)
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q"))
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    o = o.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).join(lines, "o_orderkey", "left")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    price = F.col("o_totalprice").cast("decimal(12,2)")
    unless = lambda n, x: F.when(k % n != 0, x)
    return o.select(
        F.concat(F.lit("20"), F.lpad(k.cast("string"), 7, "0")).alias("mls_number"),
        F.when(c % 10 != 0, F.concat(F.lit("012R"), F.lpad(c.cast("string"), 9, "0"))).alias("linc_number"),
        F.concat((c % 999 + 1).cast("string"), F.lit(" "), "n_name", F.lit(" St")).alias("address"),
        unless(23, F.col("r_name")).alias("area_code"), unless(23, F.col("n_name")).alias("neighbourhood"), price.alias("sold_price"),
        (price * (k % 21 + 90).cast("decimal(5,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(12,2)").alias("list_price"),
        F.col("o_orderdate").cast("date").alias("sold_date"), (k % 30).cast("int").alias("dom"), F.col("c_mktsegment").alias("property_type"),
        unless(13, F.col("o_orderpriority")).alias("style"), (c % 97 + 1900).cast("int").alias("year_built"), (F.col("q") * 10).cast("int").alias("living_area_sqft"),
        unless(17, (k % 6 + 1).cast("int")).alias("bedrooms_total"), (c % 3 + 1).cast("int").alias("full_bathrooms"), (k % 2).cast("int").alias("half_bathrooms"),
        F.when(k % 3 == 0, "Full").when(k % 3 == 1, "Crawl").alias("basement_type"), F.lit(None).cast("string").alias("garage_type"),
        F.when(k % 29 == 0, "flagged").otherwise("approved").alias("data_quality_status"), k.cast("long").alias("_ord"),
    )


def fingerprinted(view: DataFrame) -> DataFrame:
    """view with normalized_property_id and record_fingerprint; whole doubles count as integers."""
    kinds = dict(view.dtypes)
    text = lambda n: F.when(F.col(n) == F.floor(n), F.floor(n).cast("string")).otherwise(F.col(n).cast("string")) if kinds.get(n) in ("double", "float") else F.col(n)
    part = lambda n: F.col(n) if n in kinds else F.lit(None).cast("string")
    pid = view.withColumn("normalized_property_id", property_id(part("linc_number"), part("address"), part("postal_code")))
    return pid.withColumn("record_fingerprint", fingerprint({n: text(n) for n in FINGERPRINT_FIELDS if n in pid.columns}))


def staged(spark: SparkSession, folder: str) -> DataFrame:
    """Batches of sales to promote, some prices changed against the canonical ones."""
    k = F.col("_ord")
    view = sales(spark, folder).withColumn("batch_id", F.when(k % 4 < 2, k % 4).otherwise(k % 6 + 2).cast("int"))
    changed = F.when(F.col("_ord") % 97 == 0, (F.col("sold_price") + 1000).cast("decimal(12,2)")).otherwise(F.col("sold_price"))
    return fingerprinted(view.withColumn("sold_price", changed))


def synthetic_sales(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """n invented sales, the same for the same seed: all values follow from the row's number."""
    draw = lambda k, below: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(below))
    area, year = (draw(1, 2200) + 600).cast("int"), (draw(2, 120) + 1900).cast("int")
    listed = (area * 250 + draw(3, 100_000)).cast("decimal(12,2)")
    return spark.range(n).select(
        F.concat(F.lit("20"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("mls_number"), F.concat((draw(4, 999) + 1).cast("string"), F.lit(" Elm St")).alias("address"), area.alias("living_area_sqft"), year.alias("year_built"), (draw(5, 5) + 1).cast("int").alias("bedrooms_total"), (draw(6, 3) + 1).cast("int").alias("full_bathrooms"),
        listed.alias("list_price"), (listed * (draw(7, 21) + 90).cast("decimal(5,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(12,2)").alias("sold_price"), F.date_add(F.lit("2024-01-01").cast("date"), draw(8, 730).cast("int")).alias("sold_date"), draw(9, 30).cast("int").alias("dom"),
    )


#: The two reports of one batch as expressions over sales(), with gaps, conflicts, repeats and values that break rules.
SINGLE_LINE = {
    "mls_number": "CASE WHEN _ord % 211 <> 7 THEN mls_number END", "sold_date": "sold_date", "sold_price": "CASE WHEN _ord % 50 = 18 THEN CAST(0 AS DECIMAL(12,2)) ELSE sold_price END",
    "list_price": "CASE WHEN _ord % 50 = 9 THEN CAST(list_price + 5 AS DECIMAL(12,2)) WHEN _ord % 50 = 19 THEN CAST(60000000 AS DECIMAL(12,2)) ELSE list_price END",
    "address": "CASE _ord % 50 WHEN 6 THEN replace(address, ' ', ', ') WHEN 7 THEN concat('Unit 2 ', address) WHEN 8 THEN replace(address, ' ', '-') WHEN 17 THEN '' ELSE address END",
    "area_code": "area_code", "dom": "dom", "property_type": "CASE WHEN _ord % 50 = 11 THEN '' ELSE property_type END", "style": "style", "year_built": "year_built", "living_area_sqft": "living_area_sqft", "_ord": "_ord",
}
CLIENT_FULL = {
    "mls_number": "mls_number", "sold_date": "CASE WHEN _ord % 50 = 4 THEN CAST(sold_date + INTERVAL 1 DAY AS DATE) WHEN _ord % 50 = 20 THEN NULL ELSE sold_date END",
    "sold_price": "CASE WHEN _ord % 50 = 3 THEN CAST(sold_price + 1 AS DECIMAL(12,2)) WHEN _ord % 50 = 18 THEN CAST(0 AS DECIMAL(12,2)) WHEN _ord % 50 = 21 THEN NULL ELSE sold_price END",
    "list_price": "CASE WHEN _ord % 50 = 19 THEN CAST(60000000 AS DECIMAL(12,2)) ELSE list_price END", "address": "CASE WHEN _ord % 50 IN (17, 22) THEN '' ELSE address END", "area_code": "CASE WHEN _ord % 2 = 0 THEN area_code END",
    "linc_number": "CASE WHEN _ord % 50 <> 17 THEN linc_number END", "neighbourhood": "neighbourhood", "dom": "CASE WHEN _ord % 3 = 0 THEN dom END", "property_type": "CASE WHEN _ord % 50 IN (10, 11) THEN '' ELSE property_type END",
    "style": "CASE WHEN _ord % 50 = 16 THEN '' ELSE style END", "year_built": "CASE WHEN _ord % 50 = 12 THEN NULL WHEN _ord % 50 = 23 THEN 1700 ELSE year_built END",
    "living_area_sqft": "CASE WHEN _ord % 50 = 13 THEN 50 ELSE living_area_sqft END", "bedrooms_total": "CASE _ord % 50 WHEN 14 THEN 25 WHEN 15 THEN -1 ELSE bedrooms_total END", "_ord": "_ord",
}


def two_reports(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The single-line and the client-full report of one batch."""
    view = sales(spark, folder)
    single, full = (view.where(f"_ord % 50 <> {k}").selectExpr(*[f"{v} AS {n}" for n, v in x.items()]) for k, x in ((1, SINGLE_LINE), (2, CLIENT_FULL)))
    return single.unionByName(single.where("_ord % 50 = 5")), full


def housing(spark: SparkSession, folder: str) -> DataFrame:
    """The legacy table's shape."""
    v = sales(spark, folder)
    return v.select(
        "mls_number", "address", F.col("neighbourhood").alias("neighborhood"), F.col("area_code").alias("region"), F.col("property_type").alias("house_type"), F.col("living_area_sqft").alias("sqft"), F.col("year_built").alias("built_year"),
        F.col("dom").alias("dom_days"), F.col("bedrooms_total").alias("bedrooms"), (F.col("full_bathrooms") + F.col("half_bathrooms") * F.lit(0.5)).cast("double").alias("bathrooms"), "style", "basement_type", "garage_type",
        season(F.month("sold_date")).alias("season"), "list_price", "sold_price", F.try_divide(F.col("sold_price").cast("double"), F.col("list_price").cast("double")).alias("sell_list_ratio"), "sold_date", "_ord",
    )
