"""Two-report ingestion: fragments to rows, reconciliation, validation, batch summary; then fingerprinted promotion."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import address_words, batch_fingerprint, int_digits, normalize_mls, rdp, split_area, us_date

# Codes that reject a record or fail a batch, limits, and fields that a record needs.
CRITICAL = ("DUPLICATE_MLS", "SOLD_DATE_CONFLICT", "SOLD_PRICE_CONFLICT")
BLOCKING = (*CRITICAL, "MISSING_REQUIRED_FIELD", "INVALID_PRICE", "INVALID_DATE", "FUTURE_SOLD_DATE")
REQUIRED = ("mls_number", "sold_price", "sold_date", "property_type")
LEAST_PRICE, MOST_PRICE, LEAST_AREA, MOST_AREA, FIRST_YEAR, LAST_YEAR, MOST_BEDROOMS = 1, 50_000_000, 100, 30_000, 1850, 2100, 20
ISSUE = "struct<code:string,field:string,detail:string>"


def latest(rows: DataFrame, key: str, order: str = "_ord") -> DataFrame:
    """The last row of each key in source order."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("_last", last).where("_last = 1").drop("_last")


def issue(test: Column, code: str, field: str = "", detail: Column | None = None) -> Column:
    told = F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"), F.coalesce(detail if detail is not None else F.lit(""), F.lit("")).alias("detail"))
    return F.when(F.coalesce(test, F.lit(False)), told.cast(ISSUE))


def codes(issues: str = "issues") -> Column:
    return F.transform(issues, lambda x: x["code"])


def reconcile(single: DataFrame, full: DataFrame) -> DataFrame:
    """Full outer join of both reports by number; client-full wins shared fields, single-line fills them where they are
    null or empty; issues in their fixed order. Rows without a number have no part in it.

    Both: mls_number, _ord and any of the fields; a field that a report lacks counts as null.
    """
    both = ("address", "area_code", "list_price", "sold_price", "sold_date", "dom", "property_type", "style", "year_built", "living_area_sqft")
    own = [c for c in full.columns if c not in (*both, "mls_number", "_ord")]
    single, full = (x.where(F.coalesce(F.col("mls_number"), F.lit("")) != "") for x in (single, full))
    repeated = [x.groupBy("mls_number").count().where("count > 1").select("mls_number") for x in (single, full)]
    repeats = repeated[0].unionByName(repeated[1]).distinct().withColumn("_dup", F.lit(True))
    s, f = latest(single, "mls_number"), latest(full, "mls_number")
    s = s.select("mls_number", *[F.col(c).alias(f"s_{c}") for c in s.columns if c != "mls_number"], F.lit(True).alias("_s"))
    f = f.select("mls_number", *[F.col(c).alias(f"f_{c}") for c in f.columns if c != "mls_number"], F.lit(True).alias("_f"))
    x = s.join(f, "mls_number", "full_outer").join(repeats, "mls_number", "left")
    missing = lambda n: F.lit(None)
    side = lambda n: F.col(n) if n in x.columns else missing(n)
    differ = lambda c: side(f"s_{c}") != side(f"f_{c}")
    told = lambda c: F.concat(F.lit("single="), side(f"s_{c}").cast("string"), F.lit(" full="), side(f"f_{c}").cast("string"))
    a, b = address_words(side("s_address")), address_words(side("f_address"))
    apart = (side("s_address") != "") & (side("f_address") != "") & ~F.contains(a, b) & ~F.contains(b, a)
    quoted = F.concat(F.lit("single='"), side("s_address"), F.lit("' full='"), side("f_address"), F.lit("'"))
    issues = F.array_compact(
        F.array(
            issue(F.col("_f").isNull(), "MISSING_CLIENT_FULL_RECORD"), issue(F.col("_s").isNull(), "MISSING_SINGLE_LINE_RECORD"), issue(F.col("_dup"), "DUPLICATE_MLS", "", F.lit("MLS appears more than once in a source report")),
            issue(differ("sold_date"), "SOLD_DATE_CONFLICT", "sold_date", told("sold_date")), issue(differ("sold_price"), "SOLD_PRICE_CONFLICT", "sold_price", told("sold_price")),
            issue(differ("list_price"), "LIST_PRICE_CONFLICT", "list_price", told("list_price")), issue(apart, "ADDRESS_CONFLICT", "address", quoted),
        )
    )
    text = {n for n, t in [*single.dtypes, *full.dtypes] if t == "string"}
    known = lambda n: F.nullif(side(n), F.lit("")) if n[2:] in text else side(n)
    pick = [F.coalesce(known(f"f_{c}"), side(f"s_{c}")).alias(c) for c in both if f"s_{c}" in x.columns or f"f_{c}" in x.columns]
    out = x.select("mls_number", *pick, *[F.col(f"f_{c}").alias(c) for c in own], "_s", "_f", issues.alias("issues"))
    hint = F.when(F.col("mls_number").startswith("20"), F.substring("mls_number", 1, 4).try_cast("int"))
    return out.withColumns({"sale_year": F.year("sold_date"), "sale_month": F.month("sold_date"), "mls_year_hint": hint})


def validate(rows: DataFrame, today: str) -> DataFrame:
    """Rule violations, each with its field, appended to issues; status rejected if any code blocks, else accepted.

    Null and empty both count as missing.
    """
    col = lambda n: F.col(n) if n in rows.columns else F.lit(None)
    blank = lambda n: F.coalesce(col(n).cast("string"), F.lit("")) == ""
    outside = lambda n, low, high: (col(n) < low) | (col(n) > high)
    text = lambda n: col(n).cast("string")
    more = [issue(blank(n), "MISSING_REQUIRED_FIELD", n) for n in REQUIRED]
    more.append(issue(blank("address") & blank("linc_number"), "MISSING_REQUIRED_FIELD", "address_or_linc"))
    more.append(issue(col("sold_date") > F.lit(today).cast("date"), "FUTURE_SOLD_DATE", "sold_date", text("sold_date")))
    more += [issue(outside(n, LEAST_PRICE, MOST_PRICE), "INVALID_PRICE", n, text(n)) for n in ("sold_price", "list_price")]
    more.append(issue(outside("living_area_sqft", LEAST_AREA, MOST_AREA), "OUT_OF_RANGE", "living_area_sqft", text("living_area_sqft")))
    more.append(issue(outside("year_built", FIRST_YEAR, LAST_YEAR), "OUT_OF_RANGE", "year_built", text("year_built")))
    more.append(issue(col("bedrooms_total") > MOST_BEDROOMS, "OUT_OF_RANGE", "bedrooms_total"))
    out = rows.withColumn("issues", F.concat("issues", F.array_compact(F.array(*more))))
    return out.withColumn("status", F.when(F.arrays_overlap(codes(), F.array(*map(F.lit, BLOCKING))), "rejected").otherwise("accepted"))


def summary_counts() -> list[Column]:
    """The counts of a batch's records that one pass can make, as it writes them."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    both = F.col("_s").isNotNull() & F.col("_f").isNotNull()
    has = lambda *c: F.arrays_overlap(codes(), F.array(*map(F.lit, c)))
    return [
        n(both).alias("matched"), n(F.col("_f").isNull()).alias("single_only"), n(F.col("_s").isNull()).alias("full_only"), n(F.col("status") == "accepted").alias("accepted"), n(F.col("status") == "rejected").alias("rejected"), n(has("DUPLICATE_MLS")).alias("duplicates"),
        n(has("SOLD_DATE_CONFLICT", "SOLD_PRICE_CONFLICT")).alias("conflicts"), F.min("sold_date").alias("first_sold"), F.max("sold_date").alias("last_sold"), n(F.col("_f").isNotNull()).alias("_full"),
    ]


def batch_summary(rows: DataFrame) -> DataFrame:
    """One row of counts, match rate and whether the batch fails."""
    out = rows.agg(*summary_counts(), F.countDistinct("area_code").alias("n_areas"))
    rate = rdp(F.col("matched").cast("double") / F.greatest("_full", F.lit(1)), 4)
    return out.withColumn("match_rate", rate).withColumn("critical_failed", F.expr("single_only > 0 or full_only > 0 or duplicates > 0 or conflicts > 0 or match_rate < 1")).drop("_full")


def issue_rows(rows: DataFrame) -> DataFrame:
    """One row per issue of a record."""
    x = rows.select("mls_number", F.explode("issues").alias("i")).select("mls_number", F.col("i.code").alias("reason_code"), F.col("i.field").alias("field_name"), F.col("i.detail").alias("message"))
    return x.withColumn("severity", F.when(F.col("reason_code").isin(*CRITICAL), "conflict").when(F.col("reason_code").isin(*BLOCKING), "rejected").otherwise("warning"))


# -- report pages ---------------------------------------------------------------------------------------------------
# A page with fewer characters has no text layer; the header texts of the single-line report and their columns.
LEAST_PAGE_CHARS = 40
HEADERS = {
    "MLS® #": "mls", "MLS # ": "mls", "MLS #": "mls", "S": "status", "Ar Address": "address", "Address": "address", "List Price": "list_price", "Sold Price": "sold_price",
    "Date": "sold_date", "DOM": "dom", "Ty": "property_type", "Style": "style", "YrBt": "year_built", "SqFt": "living_area_sqft",
}
PRIVATE_LABELS = ("remarks", "dir/gps", "gds incl", "gds excl", "rnt eqp", "legal", "add lgl", "site influ", "features")
LABEL = r"^([A-Za-z][A-Za-z0-9 /®#.\-]*):\s*(.*)$"
PAGE = ("file", "page_number")


def cleaned_fragments(fragments: DataFrame) -> DataFrame:
    """(file, page_number, y, x0, x1, text): text stripped, blanks gone, places at one decimal."""
    text = F.btrim("text", F.lit(" \t\n\x0b\f\r"))
    return fragments.select(*PAGE, *[F.round(c, 1).alias(c) for c in ("y", "x0", "x1")], text.alias("text")).where("text != ''")


def visual_rows(fragments: DataFrame, tolerance: float = 2.5) -> DataFrame:
    """(file, page_number, row_number, y, x0, x1, text): fragments grouped to rows, from the top; a row holds what lies
    within tolerance of its first member. Order-dependent within a page, hence a function per page of a file."""

    def one(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["y", "x0"], ascending=[False, True], kind="stable")
        first, number, numbers = None, -1, []
        for y in page["y"]:
            if first is None or abs(first - y) > tolerance:
                first, number = y, number + 1
            numbers.append(number)
        return page.assign(row_number=numbers)[[*PAGE, "row_number", "y", "x0", "x1", "text"]]

    schema = "file string, page_number int, row_number int, y double, x0 double, x1 double, text string"
    return fragments.where(F.trim("text") != "").groupBy(*PAGE).applyInPandas(one, schema)


def header_rows(rows: DataFrame) -> DataFrame:
    """(file, page_number, header_y, anchors array<struct<x, column>>) of the first row of a page that has the table's header."""
    keys = F.create_map(*[F.lit(v) for kv in HEADERS.items() for v in kv])
    told = rows.where(F.col("text").isin(*HEADERS))  # nothing else tells a header, so no other text is shuffled for it
    x = told.groupBy(*PAGE, "row_number").agg(F.collect_set("text").alias("t"), F.collect_list(F.struct(F.col("x0").alias("x"), F.try_element_at(keys, F.col("text")).alias("column"))).alias("a"), F.max(F.when(F.col("text") == "MLS® #", F.col("y"))).alias("header_y"))
    x = x.where(F.forall(F.array(*map(F.lit, ("MLS® #", "List Price", "Date"))), lambda n: F.array_contains("t", n)))
    x = x.groupBy(*PAGE).agg(F.min_by(F.struct("a", "header_y"), "row_number").alias("h"))
    return x.select(*PAGE, F.col("h.header_y").alias("header_y"), F.array_sort(F.filter("h.a", lambda c: c["column"].isNotNull())).alias("anchors"))


def single_line_cells(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """(file, page_number, row_number, cells map): texts under the header go to the column of the nearest anchor, in order
    from the left; what stands left of the first anchor by more than 6 goes, and so do rows at or above the header."""
    x = rows.join(headers, list(PAGE))
    x = x.withColumn("top", F.max("y").over(Window.partitionBy(*PAGE, "row_number"))).where("top < header_y - 1 and x0 >= anchors[0].x - 6")
    nearest = F.array_min(F.transform("anchors", lambda a: F.struct(F.abs(a["x"] - F.col("x0")).alias("d"), a["x"].alias("x"), a["column"].alias("column"))))["column"]
    x = x.groupBy(*PAGE, "row_number", nearest.alias("column")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda p: p["text"]), " ").alias("value"))
    return x.groupBy(*PAGE, "row_number").agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("cells"))


def single_line_records(fragments: DataFrame) -> DataFrame:
    """The records of single-line pages; rows without a number are none."""
    rows = visual_rows(cleaned_fragments(fragments))
    cells = single_line_cells(rows, header_rows(rows))
    cell = lambda n: F.try_element_at("cells", F.lit(n))
    area, address = split_area(cell("address"))
    numbers = [int_digits(cell(n)).alias(n) for n in ("list_price", "sold_price", "dom", "year_built", "living_area_sqft")]
    out = cells.select(*PAGE, normalize_mls(cell("mls")).alias("mls_number"), cell("status").alias("status"), area.alias("area_code"), address.alias("address"), us_date(cell("sold_date")).alias("sold_date"), cell("property_type").alias("property_type"), cell("style").alias("style"), *numbers)
    return out.where("mls_number is not null")


def flat_pages(fragments: DataFrame) -> DataFrame:
    """(file, page_number, lines array<string>, n_chars) of each page in reading order: from the top, then from the left."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("y"), "x0", "text")))
    x = cleaned_fragments(fragments).groupBy(*PAGE).agg(order.alias("f"), F.sum(F.char_length("text")).alias("n_chars"))
    return x.select(*PAGE, F.transform("f", lambda p: p["text"]).alias("lines"), "n_chars")


def labels(lines: str) -> Column:
    """map<label, value> of 'Label: value' lines; a bare label takes the next line unless that is a label too. Private labels go; of a repeated label the last value counts."""
    is_label = lambda x: x.rlike(LABEL)
    at = F.transform(lines, lambda x, i: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_extract(x, LABEL, 2)).alias("v"), is_label(x).alias("is"), F.get(F.col(lines), i + 1).alias("next")))
    pairs = F.transform(F.filter(at, lambda p: p["is"]), lambda p: F.struct(p["k"].alias("k"), F.when((p["v"] == "") & p["next"].isNotNull() & ~is_label(p["next"]), F.trim(p["next"])).otherwise(p["v"]).alias("v")))
    pairs = F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*PRIVATE_LABELS))

    def last_ones(p: Column) -> Column:
        keys = F.array_distinct(F.transform(p, lambda x: x["k"]))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(p, lambda x: x["k"] == k), -1)["v"]))

    # an array of one, so that the pairs are made once a page and not once a key
    return F.get(F.transform(F.array(pairs), last_ones), F.lit(0))


def client_full_records(fragments: DataFrame) -> DataFrame:
    """The record of each client-full page with a text layer and a number; private labels never come out."""
    pages = flat_pages(fragments).where(F.col("n_chars") >= LEAST_PAGE_CHARS)
    # a generator's columns are made once, where plain ones would be made again at each of their many uses
    pages = pages.select("*", F.inline(F.array(F.struct(labels("lines").alias("kv"), F.array_join("lines", "\n").alias("flat")))))
    v = lambda n: F.try_element_at("kv", F.lit(n))
    part = lambda x, pattern, group=1: F.nullif(F.regexp_extract(x, pattern, group), F.lit(""))
    place = r"(?i)^(\d+[^,]*?),?\s+Winnipeg\s+(R\d[A-Z]\s?\d[A-Z]\d)"
    line = F.get(F.filter("lines", lambda x: x.rlike(place)), F.lit(0))
    linc = r"\b\d{3}[A-Z]\d{9}\b"
    feet = lambda n: part(v(n), r"/\s*([\d.]+)\s*F").try_cast("double")
    out = pages.select(
        *PAGE, F.coalesce(normalize_mls(v("MLS® #")), part("flat", r"20\d{7}", 0)).alias("mls_number"), F.coalesce(part(v("Linc #"), rf"^(?:{linc})$", 0), part("flat", linc, 0)).alias("linc_number"), F.trim(part(line, place)).alias("address"), F.replace(F.upper(part(line, place, 2)), F.lit("  "), F.lit(" ")).alias("postal_code"),
        v("Area").alias("area_code"), F.nullif(v("Nghbrhd"), F.lit("")).alias("neighbourhood"), v("Status").alias("status"), int_digits(v("List Price")).alias("list_price"), int_digits(v("Sell Price")).alias("sold_price"), us_date(v("Sell Date")).alias("sold_date"), int_digits(v("DOM")).alias("dom"),
        F.nullif(v("Type"), F.lit("")).alias("property_type"), F.nullif(v("Style"), F.lit("")).alias("style"), part(v("Yr Built/Age"), r"^(\d{4})").cast("int").alias("year_built"), F.replace(part(v("Liv Area"), r"([\d,]+)\s*SF"), F.lit(","), F.lit("")).try_cast("int").alias("living_area_sqft"),
        int_digits(v("BDA")).alias("bedrooms_above_grade"), int_digits(v("TBD")).alias("bedrooms_total"), part(v("Baths"), r"F(\d+)").cast("int").alias("full_bathrooms"), part(v("Baths"), r"H(\d+)").cast("int").alias("half_bathrooms"), F.nullif(v("Basement"), F.lit("")).alias("basement_type"),
        feet("Lot Front").alias("lot_front_ft"), feet("Lot Dpth").alias("lot_depth_ft"), F.replace(part(v("Gross Tax"), r"[\d,]+(?:\.\d+)?", 0), F.lit(","), F.lit("")).try_cast("double").alias("gross_tax"), int_digits(v("Tax Yr")).alias("tax_year"),
    )
    return out.where("mls_number is not null")


def page_diagnostics(fragments: DataFrame, records: DataFrame, report_type: str, headers: DataFrame | None = None) -> DataFrame:
    """(file, page_number, report_type, text_char_count, status, records_found, warning): thin pages need OCR and are not parsed."""
    pages = flat_pages(fragments).select(*PAGE, F.col("n_chars").alias("text_char_count"))
    found = records.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("records_found"))
    x = pages.join(found, list(PAGE), "left").withColumn("thin", F.col("text_char_count") < LEAST_PAGE_CHARS)
    x = x.join(headers.select(*PAGE, F.lit(True).alias("_h")), list(PAGE), "left") if headers is not None else x.withColumn("_h", F.col("records_found").isNotNull())
    lacking = "no table header found on page" if headers is not None else "no MLS number found on page"
    warning = F.when(F.col("thin"), "thin/empty text layer — flagged, not parsed").when(F.col("_h").isNull() | ~F.col("_h"), lacking)
    return x.select(*PAGE, F.lit(report_type).alias("report_type"), "text_char_count", F.when(F.col("thin"), "needs_ocr").otherwise("ok").alias("status"), F.when(F.col("thin"), 0).otherwise(F.coalesce("records_found", F.lit(0))).cast("long").alias("records_found"), warning.alias("warning"))


# -- load plans and promotion ---------------------------------------------------------------------------------------
# Contract versions that may be loaded.
CONTRACT_VERSIONS = ("wrreb-canonical/1.0",)
COUNTS = ("accepted", "rejected", "conflicts")


def load_refusals(manifests: DataFrame, accepted: DataFrame, rejected: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(batch_id, refusal) for each reason for which a batch may not be loaded.

    manifests: batch_id, contract_version, critical_reconciliation_failed, and the counts that it claims, accepted,
    rejected and conflicts. The others: rows of the batch's files by batch_id; accepted ones with mls_number, sold_date (as text).
    """
    real = [x.groupBy("batch_id").agg(F.count(F.lit(1)).alias(f"_{n}")) for n, x in zip(COUNTS, (accepted, rejected, conflicts), strict=True)]
    m = reduce(lambda a, b: a.join(b, "batch_id", "left"), real, manifests).fillna(0, [f"_{n}" for n in COUNTS])
    version = F.trim(F.coalesce("contract_version", F.lit("")))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    tests = [F.when(version == "", "missing or empty contract_version in summary.json").when(~version.isin(*CONTRACT_VERSIONS), F.concat(F.lit("unsupported contract_version: '"), "contract_version", F.lit("'")))]
    tests.append(F.when(F.col("critical_reconciliation_failed"), "critical_reconciliation_failed is true in summary.json"))
    tests += [F.when(~F.col(n).cast("long").eqNullSafe(F.col(f"_{n}")), F.concat(F.lit(f"summary.{n}="), text(n), F.lit(f" != {n}.csv rows="), F.col(f"_{n}").cast("string"))) for n in COUNTS]
    tests.append(F.when(F.col("_conflicts") > 0, F.concat(F.lit("batch has "), F.col("_conflicts").cast("string"), F.lit(" unresolved critical conflict(s)"))))
    told = m.select("batch_id", F.explode(F.array_compact(F.array(*tests))).alias("refusal"))
    number = F.trim(F.coalesce("mls_number", F.lit("")))
    twice = accepted.groupBy("batch_id", number.alias("n")).count().where("n != '' and count > 1")  # each repeat is a refusal
    twice = twice.select("batch_id", F.explode(F.array_repeat(F.concat(F.lit("duplicate MLS within batch: "), "n"), (F.col("count") - 1).cast("int"))).alias("refusal"))
    day = F.trim(F.coalesce("sold_date", F.lit("")))
    bad = accepted.where((day != "") & (~day.rlike(r"^\d{4}-\d{2}-\d{2}$") | day.try_cast("date").isNull()))
    bad = bad.select("batch_id", F.concat(F.lit("accepted row MLS "), F.when(number == "", "None").otherwise(number), F.lit(" has an invalid sold_date")).alias("refusal"))
    return told.unionByName(twice).unionByName(bad)


def load_plan(manifests: DataFrame, refusals: DataFrame) -> DataFrame:
    """manifests with batch_fingerprint and safe_to_write (no refusal)."""
    refused = refusals.select("batch_id").distinct().withColumn("_no", F.lit(True))
    out = manifests.withColumn("batch_fingerprint", batch_fingerprint("single_line_sha256", "client_full_sha256", "parser_version", F.coalesce("contract_version", F.lit(""))))
    return out.join(refused, "batch_id", "left").withColumn("safe_to_write", F.col("_no").isNull()).drop("_no")


def plan_issues(conflicts: DataFrame, warnings: DataFrame, rejected: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(batch_id, mls_number, severity, reason_code, field_name, source_page, message) of a batch's files, all text."""
    clean = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    none = F.lit(None).cast("string")

    def of(rows: DataFrame, severity: str, code: Column, mls=None, field=none, message=none, page=none) -> DataFrame:
        return rows.select("batch_id", (clean("mls_number") if mls is None else mls).alias("mls_number"), F.lit(severity).alias("severity"), code.alias("reason_code"), field.alias("field_name"), page.try_cast("int").alias("source_page"), message.alias("message"))

    parts = [of(x, n, F.coalesce(clean("code"), F.lit(n.upper())), field=clean("field"), message=clean("detail")) for n, x in (("conflict", conflicts), ("warning", warnings))]
    each = rejected.withColumn("_code", F.explode(F.split(F.coalesce(clean("issue_codes"), F.lit("REJECTED")), r"\|")))
    parts.append(of(each, "rejection", F.coalesce(F.nullif(F.col("_code"), F.lit("")), F.lit("REJECTED"))))
    parts.append(of(diagnostics.where(clean("status") == "needs_ocr"), "needs_ocr", F.lit("NEEDS_OCR"), mls=none, message=clean("report_type"), page=clean("page_number")))
    return reduce(DataFrame.unionByName, parts)


def coerced(rows: DataFrame, ints: tuple[str, ...] = (), decimals: tuple[str, ...] = (), dates: tuple[str, ...] = ()) -> DataFrame:
    """Text columns trimmed, empty ones null, and cast where named; what cannot be cast is null."""
    text = {n: F.nullif(F.trim(F.col(n)), F.lit("")) for n, t in rows.dtypes if t == "string"}
    number = lambda n: F.when(text[n].rlike("[.eE]"), text[n].try_cast("double").try_cast("int")).otherwise(text[n].try_cast("int"))
    kinds = {n: number(n) for n in ints} | {n: F.regexp_replace(text[n], "[,$]", "").try_cast("decimal(12,2)") for n in decimals} | {n: F.when(text[n].rlike(r"^\d{4}-\d{2}-\d{2}$"), text[n].try_cast("date")) for n in dates}
    return rows.withColumns(text | kinds)


def promotion(staged: DataFrame, canonical: DataFrame) -> DataFrame:
    """staged with action: insert, skip (same number and fingerprint) or conflict (same number, another fingerprint)."""
    known = canonical.select("mls_number", F.col("record_fingerprint").alias("_known"))
    action = F.when(F.col("_known").isNull(), "insert").when(F.col("_known") == F.col("record_fingerprint"), "skip").otherwise("conflict")
    return staged.join(known, "mls_number", "left").withColumn("action", action).drop("_known")


def promotion_gate(plan: DataFrame, batches: DataFrame, issues: DataFrame) -> DataFrame:
    """A row per batch of batches (batch_id, status, accepted_count): its counts and the first gate that stops it, or null.

    Gates in order: status is 'staged'; no unresolved conflict, then rejection, in issues (batch_id, severity, resolved);
    accepted_count equals the staged rows; no number twice; no canonical row of the same number with another fingerprint.
    """
    n = lambda a: F.sum((F.col("action") == a).cast("int")).cast("long").alias(f"n_{a}")
    counts = plan.groupBy("batch_id").agg(n("insert"), n("skip"), n("conflict"), F.count(F.lit(1)).alias("staged"), F.countDistinct("mls_number").alias("_d"))
    unresolved = lambda s: F.sum(((F.col("severity") == s) & ~F.coalesce("resolved", F.lit(False))).cast("int")).alias(f"_{s}")
    open_ = issues.groupBy("batch_id").agg(unresolved("conflict"), unresolved("rejection"))
    x = batches.join(counts, "batch_id", "left").join(open_, "batch_id", "left").fillna(0, ["n_insert", "n_skip", "n_conflict", "staged", "_d", "_conflict", "_rejection"])
    stop = (
        F.when(F.col("status") != "staged", "status").when(F.col("_conflict") > 0, "unresolved conflicts").when(F.col("_rejection") > 0, "unresolved rejections")
        .when(~F.col("accepted_count").cast("long").eqNullSafe(F.col("staged")), "accepted_count").when(F.col("_d") < F.col("staged"), "duplicate number").when(F.col("n_conflict") > 0, "canonical conflict")
    )
    return x.select("batch_id", "n_insert", "n_skip", "n_conflict", "staged", stop.alias("blocked_by"), stop.isNull().alias("promotable"))


def promote(plan: DataFrame, canonical: DataFrame, gate: DataFrame) -> DataFrame:
    """The canonical rows after promoting every batch that passes its gate; running it again changes nothing."""
    new = plan.where("action = 'insert'").join(gate.where("promotable").select("batch_id"), "batch_id", "left_semi").select(*canonical.columns)
    return canonical.unionByName(new)


def promotion_outcome(plan: DataFrame, batches: DataFrame, gate: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(batches with their status after it, approved where promoted; issues that it adds, one per canonical conflict)."""
    after = batches.join(gate.select("batch_id", "promotable"), "batch_id", "left").withColumn("status", F.when(F.col("promotable"), "approved").otherwise(F.col("status"))).drop("promotable")
    stopped = gate.where("blocked_by = 'canonical conflict'").select("batch_id")
    met = plan.where("action = 'conflict'").join(stopped, "batch_id", "left_semi")
    told = met.select("batch_id", "mls_number", F.lit("conflict").alias("severity"), F.lit("CANONICAL_FINGERPRINT_CONFLICT").alias("reason_code"), F.lit("record_fingerprint").alias("field_name"), F.lit("existing canonical sale differs from staged record").alias("message"))
    return after, told


def status_after_load(issues: DataFrame, batches: DataFrame) -> DataFrame:
    """batches as loaded: review_required if an issue of theirs is unresolved, else staged."""
    open_ = issues.where(~F.coalesce("resolved", F.lit(False))).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_unresolved"))
    x = batches.join(open_, "batch_id", "left").fillna(0, ["n_unresolved"])
    return x.withColumn("status", F.when(F.col("n_unresolved") > 0, "review_required").otherwise("staged"))


def violations(rows: DataFrame) -> DataFrame:
    """(rule, n) of broken constraints; empty if the rows are sound."""
    repeated = rows.groupBy("mls_number").count().where("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("unique_mls_number").alias("rule"), "n")
    status = rows.where(~F.coalesce(F.col("data_quality_status").isin("approved", "flagged", "rejected"), F.lit(False))).agg(F.count(F.lit(1)).alias("n")).select(F.lit("data_quality_status").alias("rule"), "n")
    return repeated.unionByName(status).where("n > 0")


