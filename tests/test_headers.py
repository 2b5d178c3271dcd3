"""Headers of table pages are told by header texts alone."""

from hearthframe.operators import ingestion


def test_only_header_texts_are_shuffled_to_tell_a_header(spark):
    head = [("f", 1, 0, 700.0, x, x + 9, t) for x, t in ((50.0, "MLS® #"), (110.0, "S"), (300.0, "List Price"), (420.0, "Date"), (500.0, "else"))]
    body = [("f", 1, 1, 680.0, x, x + 9, t) for x, t in ((53.0, "202612345"), (113.0, "S"), (303.0, "$5"))] + [("f", 2, 0, 700.0, 50.0, 59.0, "MLS® #")]
    rows = spark.createDataFrame(head + body, "file string, page_number int, row_number int, y double, x0 double, x1 double, text string")
    out = ingestion.header_rows(rows)
    assert [(x.page_number, x.header_y, [tuple(a) for a in x.anchors]) for x in out.collect()] == [(1, 700.0, [(50.0, "mls"), (110.0, "status"), (300.0, "list_price"), (420.0, "sold_date")])]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan and "INSET" in plan[plan.rindex("Aggregate") :] or " IN (" in plan[plan.rindex("Aggregate") :]
