"""Text parsers over many tasks, however small their pages are in bytes."""

from hearthframe.operators import listings


def test_few_bytes_of_pages_are_parsed_by_many_tasks(spark):
    texts = [f"MLS # 2026{i:05d}\nWhere -\n{i + 1} Elm Street\nprice $400,000 and $410,000\nBungalow" for i in range(40)]
    pages = spark.createDataFrame([(str(i), 0, t) for i, t in enumerate(texts)], "path string, page_number int, text string").coalesce(1)
    out = listings.side_by_side(pages, 2026, {}, ("Oak Park",))
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert {(x.mls_number, x.address, x.list_price, x.sold_price) for x in out.collect()} == {(f"2026{i:05d}", f"{i + 1} Elm Street", 400000.0, 410000.0) for i in range(40)}


def test_blocks_of_a_flat_text_are_cut_without_sorting_texts(spark):
    texts = [(str(i), f"{i + 1} Elm St\nList Price: $100,000\n3 BR\n{i + 2} Fir Crescent\n1200 SF\n5 BR") for i in range(40)]
    rows = spark.createDataFrame([*texts, ("none", "no address"), ("null", None)], "path string, text string").coalesce(1)
    out = listings.text_listings(rows, ("Oak Park",), {})
    # before, a window over paths shuffled and sorted each text once for each of its listings
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString() and out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    want = {(p, at, f"{int(p) + 1 + at} {'Fir Crescent' if at else 'Elm St'}", 5 if at else 3) for p, _ in texts for at in (0, 1)}
    assert {(x.path, x.position, x.address, x.bedrooms) for x in out.collect()} == want
