"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rdp(x, n: int) -> Column:
    """x at n decimal places by way of decimal(18, 6): doubles are never rounded directly, as engines differ there."""
    return col(x).cast("decimal(18,6)").cast(f"decimal(18,{n})")


def bucket(x, bounds: list[tuple[float, str]], above: str) -> Column:
    """The label of the first bound that x is under; above for the rest; null stays null."""
    out = F
    for bound, label in bounds:
        out = out.when(col(x) < bound, label)
    return F.when(col(x).isNull(), F.lit(None).cast("string")).otherwise(out.otherwise(above))


def price_band(x) -> Column:
    return bucket(x, [(300_000, "<300k"), (450_000, "300-450k"), (600_000, "450-600k"), (900_000, "600-900k")], "900k+")


def sqft_band(x) -> Column:
    return bucket(x, [(900, "<900"), (1300, "900-1299"), (1800, "1300-1799"), (2500, "1800-2499")], "2500+")


def comp_count_bucket(x) -> Column:
    return bucket(x, [(4, "3"), (6, "4-5"), (8, "6-7")], "8-10")


def similarity_bucket(x) -> Column:
    return bucket(x, [(50, "<50"), (60, "50-59.99"), (70, "60-69.99"), (80, "70-79.99")], "80+")


def coverage_bucket(x) -> Column:
    return bucket(x, [(0.25, "<0.25"), (0.5, "0.25-0.49"), (0.75, "0.50-0.74")], "0.75+")


def season(month) -> Column:
    m = col(month)
    return F.when(m.isin(12, 1, 2), "Winter").when(m.isin(3, 4, 5), "Spring").when(m.isin(6, 7, 8), "Summer").otherwise("Fall")


def baths(full, half) -> Column:
    """Full plus half of the halves; null only if both are."""
    return F.when(col(full).isNull() & col(half).isNull(), F.lit(None)).otherwise(F.coalesce(col(full), F.lit(0)) + F.coalesce(col(half), F.lit(0)) * F.lit(0.5).cast("double"))


def normalize_mls(x) -> Column:
    """The nine digits 20....... among the digits of x, or null."""
    return F.nullif(F.regexp_extract(F.regexp_replace(col(x), r"\D", ""), r"20\d{7}", 0), F.lit(""))


def mask_mls(x) -> Column:
    n = F.length(col(x))
    return F.when(n <= 3, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.repeat(F.lit("*"), n - 3), F.right(col(x), F.lit(3))))


def money(x) -> Column:
    return F.expr("try_cast(nullif(regexp_replace(%s, '[$, ]', ''), '') as decimal(12,2))" % x)


def us_date(x) -> Column:
    return F.try_to_timestamp(F.nullif(F.regexp_extract(col(x), r"\d{1,2}/\d{1,2}/\d{4}", 0), F.lit("")), F.lit("M/d/yyyy")).cast("date")


def address_key(x) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(col(x)), "[^a-z0-9]+", "")


def address_words(x) -> Column:
    """Lower case, commas as blanks, runs of white space as one blank; for containment tests."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(x), F.lit(""))), r"[,\s]+", " "))


def property_id(linc, address, postal) -> Column:
    """The title number if it has a letter or digit, else address and postal code; null if nothing is left of either."""
    key = lambda x: address_key(F.coalesce(col(x), F.lit("")))
    place = F.concat(F.lit("addr:"), key(address), F.lit("|"), key(postal))
    return F.when(key(linc) != "", F.concat(F.lit("linc:"), key(linc))).when(place != "addr:|", place)


def split_area(x) -> tuple[Column, Column]:
    """(area, address): a first word of digits and at most one letter is the area."""
    text = F.trim(col(x))
    area = F.nullif(F.regexp_extract(text, r"^(\d+[A-Z]?)\s+\S", 1), F.lit(""))
    return area, F.when(area.isNull(), F.nullif(text, F.lit(""))).otherwise(F.regexp_replace(text, r"^\S+\s+", ""))


def int_digits(x) -> Column:
    """All digits of x as one number, or null."""
    return F.regexp_replace(col(x), r"\D", "").try_cast("long")


def square_metres(square_feet) -> Column:
    return rdp(col(square_feet).cast("decimal(18,6)") * F.lit("0.092903").cast("decimal(10,6)"), 2)


def surrogate_mls(*parts) -> Column:
    """The first ten hexadecimal digits of the md5 of the parts, for listings without a number."""
    return F.substring(F.md5(F.concat(*[F.coalesce(col(x).cast("string"), F.lit("")) for x in parts])), 1, 10)


def json_text(x: Column) -> Column:
    """x as a JSON string in ASCII: quotes, backslashes and controls escaped, all beyond ASCII as escapes of UTF-16 units."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
    short = F.create_map(*[F.lit(v) for kv in {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}.items() for v in kv])

    def escaped(c: Column) -> Column:
        n, over = F.ascii(c), F.ascii(c) - F.lit(0x10000)
        pair = F.concat(unit(F.lit(0xD800) + F.shiftright(over, 10)), unit(F.lit(0xDC00) + over.bitwiseAND(0x3FF)))
        return F.coalesce(F.try_element_at(short, c), F.when(n > 0xFFFF, pair).when((n < 32) | (n > 126), unit(n)).otherwise(c))

    whole = F.array_join(F.transform(F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0)), escaped), "")
    return F.concat(F.lit('"'), F.when(x.rlike(r'^[ !#-\[\]-~]*\z'), x).otherwise(whole), F.lit('"'))


def json_sha256(fields: dict[str, Column]) -> Column:
    """sha256 of compact JSON with sorted keys; nulls are empty strings, text is stripped."""
    parts = []
    for i, name in enumerate(sorted(fields)):
        text = F.regexp_replace(F.coalesce(fields[name].cast("string"), F.lit("")), r"^\s+|\s+$", "")
        parts += [F.lit(("," if i else "{") + f'"{name}":'), json_text(text)]
    return F.sha2(F.concat(*parts, F.lit("}")), 256)


# The fields of a record fingerprint.
FINGERPRINT_FIELDS = ("mls_number", "linc_number", "normalized_property_id", "sold_date", "sold_price", "list_price", "address", "postal_code")


def fingerprint(fields: dict[str, Column]) -> Column:
    """A record's fingerprint; fields that are not given are null."""
    return json_sha256({n: fields.get(n, F.lit(None).cast("string")) for n in FINGERPRINT_FIELDS})


def batch_fingerprint(single_line_sha256, client_full_sha256, parser_version, contract_version) -> Column:
    names = ("single_line_sha256", "client_full_sha256", "parser_version", "contract_version")
    return json_sha256(dict(zip(names, map(col, (single_line_sha256, client_full_sha256, parser_version, contract_version)), strict=True)))
