"""Labels of report pages: found once a page, not once a label."""

from pyspark.sql import functions as F

from hearthframe.operators import ingestion


def test_labels_are_parsed_once_a_page(spark):
    lines = ["Area: 1A", "DOM: 7", "Remarks: call 555", "Sell Price:", "$5,000", "no label", "DOM: 9", " Odd label : x: y", "Type:", "Style: Cabin"]
    out = spark.createDataFrame([(lines,)], "lines array<string>").select(ingestion.labels("lines").alias("kv"))
    assert out.first().kv == {"Area": "1A", "DOM": "9", "Sell Price": "$5,000", "Type": "", "Style": "Cabin"}
    # made again for each key, the pairs would be in the expression several times
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    assert out._jdf.queryExecution().optimizedPlan().toString().count(ingestion.LABEL) <= 4


def test_a_page_parses_its_labels_once_for_all_its_fields(spark):
    fragments = spark.createDataFrame([("f", 1, 700.0 - i, 40.0, 90.0, t) for i, t in enumerate(["MLS® #: 202612345", "\t List Price: $1,000 \n", "3 Elm St, Winnipeg R3T 3L2", "Sell Date: 01/02/2026"])], "file string, page_number int, y double, x0 double, x1 double, text string")
    out = ingestion.client_full_records(fragments)
    got = out.first()
    assert (got.mls_number, got.list_price, got.address, str(got.sold_date)) == ("202612345", 1000, "3 Elm St", "2026-01-02")
    assert out._jdf.queryExecution().optimizedPlan().toString().count(ingestion.LABEL) <= 4
