"""Listings out of free text: keyword parsers as column expressions, and the three extractors that put them together.

Every parser takes a column of text (a page or a block of it) and gives a column; patterns are tried in a fixed order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import rdp, surrogate_mls

# Street words, known terms, keywords and their results, in the order in which they are tried.
STREETS = "Ave|Avenue|Street|St|Drive|Dr|Road|Rd|Boulevard|Blvd|Lane|Ln|Bay|Crescent|Cres|Place|Pl|Parkway|Way|Trail|Court|Ct"
_BY_LETTER = {a: [w[1:] for w in STREETS.split("|") if w[0] == a] for a in dict.fromkeys(w[0] for w in STREETS.split("|"))}
#: Words of one first letter are tried together, in their order, and only where such a letter stands.
ADDRESS = rf"(?i)\d{{1,5}}\s+[A-Za-z0-9 .,'\-]+(?=[{''.join(_BY_LETTER)}])(?:{'|'.join(f'{a}(?:{"|".join(rest)})' for a, rest in _BY_LETTER.items())})"
STYLES = ("Bungalow", "Two Storey", "One and a Half", "Split-Level", "Bi-Level", "Multi-Level", "Cabin", "Raised Bungalow", "Mobile", "Other")
TYPES = ("Single Family Detached", "Townhouse", "Condo", "Duplex", "Mobile", "Other")
GARAGES = {"attached": "Attached", "detached": "Detached", "double": "Double", "single": "Single", "pad": "Pad", "rear": "Rear Drive", "plug": "Plug-In", "carport": "Carport"}
LEAKAGE = ("bedroom", "bathroom", "electrical", "insulation", "kitchen", "furnace", "wood frame", "frame", "siding", "roof", "garage")
BASEMENTS = (("crawl",), "Crawl Space"), (("3/4", "three quarter"), "Three Quarter"), (("partial",), "Partial"), (("half",), "Half"), (("walkout",), "Walkout"), (("slab",), "Slab"), (("unfinished",), "Unfinished"), (("finished",), "Finished"), (("none",), "None"), (("full",), "Full")
BEDS, BATHS, LOT = r"BDA:\s*(\d+)\s*TBD:\s*(\d+)", r"FB:\s*(\d+)\s*HB:\s*(\d+)", r"(?i)Lot\s*Size[:\s]+(\d+)\s*[xX]\s*(\d+)"
YEARS = r"(?:OL\s*)?/\s*([12][09]\d{2})", r"(?i)(?:Year\s*)?Built[:\s]*([12][09]\d{2})"
PARKED = r"(?i)(attached|detached|double|single|pad|rear|plug|carport)[^\n]{0,50}"
REJECTED = (" list", " winnipeg", " regional")
LEAST_PRICE, LEAST_DOM, MOST_DOM, USUAL_DOM, BLOCK_CHARS, FUZZY_SCORE = 30_000, 1, 180, 14, 1500, 75


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """What the group matches first, or null if the pattern does not match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def number(text: Column, kind: str = "int") -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast(kind)


def bedrooms(text: Column) -> Column:
    total = found(text, BEDS, 2).cast("int")
    return F.when(text.rlike(BEDS), F.when(total != 0, total).otherwise(found(text, BEDS).cast("int"))).otherwise(found(text, r"(?i)(\d+)\s*(?:bed|bdrm|bdrms)").cast("int"))


def bathrooms(text: Column) -> Column:
    return F.when(text.rlike(BATHS), found(text, BATHS).cast("double") + F.lit(0.5) * found(text, BATHS, 2).cast("double")).otherwise(found(text, r"(?i)(\d+(\.\d+)?)\s*(?:bath|baths)").cast("double"))


def garage(text: Column) -> Column:
    """The kinds that occur in the text, sorted and joined; None if there are none."""
    kinds = F.array_compact(F.array(*[F.when(F.contains(F.lower(text), F.lit(k)), v) for k, v in GARAGES.items()]))
    return F.when(F.coalesce(F.size(kinds), F.lit(0)) > 0, F.array_join(F.array_sort(F.array_distinct(kinds)), ", ")).otherwise("None")


def year_built(text: Column, this_year: Column | int) -> Column:
    this_year = F.lit(this_year) if isinstance(this_year, int) else this_year
    age = found(text, r"(?i)Age[:\s]*([0-9]{1,3})").cast("int")
    stated = F.coalesce(*[found(text, p) for p in YEARS]).cast("int")
    return F.coalesce(stated, F.when(age < 150, this_year - age))


def without_leakage(low: Column) -> Column:
    """A text in lower case without the words that hold a kind of basement and tell none."""
    for word in LEAKAGE:
        low = F.replace(low, F.lit(word), F.lit(""))
    return low


def basement(text: Column) -> Column:
    return basement_of(without_leakage(F.lower(text)))


def basement_of(plain: Column) -> Column:
    """The kind of basement that a text without_leakage() tells."""
    out = F
    for words, name in BASEMENTS:
        test = F.lit(False)
        for word in words:
            test = test | F.contains(plain, F.lit(word))
        out = out.when(test, name)
    return out.otherwise("None")


def commonest(values: Column) -> Column:
    """The commonest element of an array, of equally common ones the first; null of an empty one."""
    counted = F.transform(F.array_distinct(values), lambda v, i: F.struct(F.size(F.filter(values, lambda x: x == v)).alias("n"), (-i).alias("at"), v.alias("v")))
    return F.array_max(counted)["v"]


def days_on_market(block: Column) -> Column:
    """The commonest number on lines that speak of days on market, else one near such words, else the middle number, else 14."""
    fits = lambda a: F.filter(F.transform(a, lambda x: x.cast("int")), lambda x: (x >= LEAST_DOM) & (x <= MOST_DOM))
    numbers = lambda x: F.regexp_extract_all(x, F.lit(r"\b\d{1,3}\b"), F.lit(0))
    ends = F.replace(F.replace(block, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))  # so that lines are cut at a single character, without a pattern
    lines = F.filter(F.split(ends, "\n"), lambda x: x.rlike(r"(?i)\b(dom|days on market)\b"))
    near = fits(F.regexp_extract_all(block, F.lit(r"(?i)(?:dom|days on market)[^\n]{0,40}?(\d{1,3})"), F.lit(1)))
    every = F.array_sort(fits(numbers(block)))
    return F.coalesce(commonest(fits(F.flatten(F.transform(lines, numbers)))), F.get(near, F.lit(0)), F.get(every, F.floor(F.size(every) / 2).cast("int")), F.lit(USUAL_DOM))


def prices(block: Column) -> Column:
    """All dollar amounts above 30,000, in order."""
    return F.filter(F.transform(F.regexp_extract_all(block, F.lit(r"\$([\d,]+)"), F.lit(1)), lambda x: number(x, "double")), lambda x: x > LEAST_PRICE)


def price_after(label: str, block: Column) -> Column:
    return F.coalesce(number(found(block, rf"(?i){label}\s*[:\-]?\s*\$([\d,]+)"), "double"), F.lit(0.0))


def known_terms(text: Column, terms: tuple[str, ...]) -> Column:
    """The terms that occur in the text, whatever their case, in their order, joined; Other if none does."""
    hits = F.array_compact(F.array(*[F.when(F.contains(F.lower(text), F.lit(t.lower())), t) for t in terms]))
    return F.when(F.size(hits) > 0, F.array_join(hits, ", ")).otherwise("Other")


def first_term(low: Column, terms: tuple[str, ...], default: str | None = None) -> Column:
    """The first term that occurs in a text in lower case."""
    return F.coalesce(*[F.when(F.contains(low, F.lit(t.lower())), t) for t in terms], F.lit(default))


def plain_words(*texts: Column) -> Column:
    """The texts in lower case, whatever is no letter, digit or underscore turned into one blank. Each is lowered alone, as those of ASCII alone are lowered sooner."""
    return F.regexp_replace(F.concat_ws(" ", *[F.lower(x) for x in texts]), r"\W+", " ")


def place_by_dictionary(text: Column, aliases: dict[str, str], names: tuple[str, ...]) -> Column:
    """The first alias's name, else the longest known name that stands in the text as words; null if none does."""
    as_words = lambda n: F.contains(text, F.lit(n.lower())) & text.rlike(rf"\b\Q{n.lower()}\E\b")
    hits = F.array_compact(F.array(*[F.when(as_words(n), F.struct(F.lit(len(n)).alias("n"), F.lit(-i).alias("at"), F.lit(n).alias("v"))) for i, n in enumerate(names)]))
    return F.coalesce(*[F.when(as_words(a), v) for a, v in aliases.items()], F.array_max(hits)["v"])


def _ratio(a: str, b: str) -> float:
    """100 * 2 * common / (len a + len b) of two strings' words in order, common being their longest common subsequence."""
    a, b = (" ".join(sorted(x.split())) for x in (a, b))
    where: dict[str, int] = {}
    for j, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << j
    full = row = (1 << len(b)) - 1
    for c in a:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return 200 * (len(b) - row.bit_count()) / max(1, len(a) + len(b))


def place_by_likeness(rows: DataFrame, text_col: str, names: tuple[str, ...], least: float = FUZZY_SCORE) -> DataFrame:
    """(text, place, score): of each distinct text the name that some 2 to 5 of its words are most like, if the score is above least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, scores = [], []
            for text in batch.column(0).to_pylist():
                words = text.split()
                grams = dict.fromkeys(" ".join(words[i : i + n]) for n in range(2, 6) for i in range(len(words) - n + 1))
                best = max(((_ratio(g, name.lower()), -k, -j) for k, g in enumerate(grams) for j, name in enumerate(names)), default=(0.0, 0, 0))
                places.append(names[-best[2]] if best[0] > least else None)
                scores.append(best[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.string()), pa.array(scores, pa.float64())], names=[text_col, "place", "score"])

    return rows.where(F.col(text_col).isNotNull()).select(text_col).distinct().mapInArrow(run, f"`{text_col}` string, place string, score double")


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, match>>: all matches, none empty, of a pattern with their starts, from 1.

    What the pattern matches must not depend on what stands before or after it: then a match starts where its characters first
    stand behind the last one, as the pattern would match there too, and the text is not searched by the pattern twice.
    """
    kind = "struct<at:int,found:array<struct<start:int,match:string>>>"

    def add(acc: Column, m: Column) -> Column:
        start = F.position(m, text, acc["at"])
        return F.struct((start + F.char_length(m)).alias("at"), F.concat(acc["found"], F.array(F.struct(start.alias("start"), m.alias("match")))).alias("found")).cast(kind)

    return F.aggregate(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.struct(F.lit(1).alias("at"), F.array().alias("found")).cast(kind), add, lambda acc: acc["found"])


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with row: their number, of which all of a row's listings are."""
    return rows.withColumn("row", F.monotonically_increasing_id()) if "row" not in rows.columns else rows


def spread(texts: DataFrame) -> DataFrame:
    """texts over as many tasks as a shuffle has; small in bytes, they would be few, while each row takes long."""
    session = texts.sparkSession
    return texts.repartition(max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism))


def side_by_side(pages: DataFrame, this_year: int, aliases: dict[str, str], names: tuple[str, ...]) -> DataFrame:
    """Listings of side-by-side pages (path, page_number, text): a block of 1,500 characters from each address on.

    Numbers stand above the addresses, so the i-th address takes the i-th number of the page; beyond them a surrogate and the
    commonest year of the page's numbers.
    """
    t = F.col("text")
    x = spread(pages).withColumn("_numbers", F.regexp_extract_all(F.array_join(F.regexp_extract_all(t, F.lit(r"MLS[^\n]*"), F.lit(0)), " "), F.lit(r"\b20\d{7}\b"), F.lit(0)))
    clean = lambda m: F.trim(F.regexp_replace(m, r"\s+", " "))
    listed = F.filter(F.transform(matches(t, ADDRESS), lambda m: F.struct(m["start"].alias("start"), clean(m["match"]).alias("address"))), lambda m: (m["address"] != "") & ~F.contains(m["address"], F.lit("Winnipeg Regional Real Estate Board")))
    x = x.select("path", "page_number", "text", "_numbers", F.posexplode(listed).alias("position", "_m")).withColumns({"address": F.col("_m.address"), "_start": F.col("_m.start")})
    near = F.substring(t, F.greatest(F.col("_start") - 300, F.lit(1)), F.least(F.col("_start") - 1, F.lit(300)) + 1200)
    # a generator's columns are made once, where plain ones would be made again at each of their many uses
    once = lambda x, **columns: x.select("*", F.inline(F.array(F.struct(*[v.alias(n) for n, v in columns.items()]))))
    x = once(x, block=F.substring(t, F.col("_start"), F.lit(BLOCK_CHARS)), _near=near, _own=F.get("_numbers", F.col("position")))
    b = F.col("block")
    x = once(x, _low=F.lower(b))
    # what a pattern matches, empty if it does not
    said = {f"_{n}": F.regexp_extract(b, p, i) for n, p, i in (("beds", BEDS, 0), ("baths", BATHS, 0), ("parked", PARKED, 0), ("lot", LOT, 0), ("sqft", r"(?i)([\d,]{3,5})\s*(?:sqft|sf|sq ft)", 1), ("year0", YEARS[0], 1))}
    x = once(x, _prices=prices(b), _words=plain_words(F.col("address"), F.col("_low"), t), _plain=without_leakage(F.col("_low")), **said)
    x = once(x, _year1=F.when(F.col("_year0") == "", F.regexp_extract(b, YEARS[1], 1)).otherwise(""), _dom=days_on_market(F.col("_near")), _place=place_by_dictionary(F.col("_words"), aliases, names))
    p, low, parked = F.col("_prices"), F.col("_low"), F.col("_parked")
    either = lambda said, parse: F.when(F.col(said) != "", parse(F.col(said))).otherwise(parse(b))
    year = commonest(F.transform("_numbers", lambda m: F.substring(m, 1, 4).cast("int")))
    built = F.when(F.col("_year0") != "", F.col("_year0").cast("int")).when(F.col("_year1") != "", F.col("_year1").cast("int")).otherwise(year_built(b, this_year))
    list_price, sold_price = F.get(p, F.lit(0)), F.get(p, F.lit(1))
    return x.select(
        "path", "page_number", "position", F.coalesce("_own", surrogate_mls("address")).alias("mls_number"), F.when(F.col("_own").isNotNull(), F.substring("_own", 1, 4).cast("int")).otherwise(year).alias("mls_year_hint"), "address", F.coalesce("_place", F.lit("Loose Area")).alias("neighborhood"),
        list_price.alias("list_price"), sold_price.alias("sold_price"), rdp(sold_price / list_price, 2).alias("sell_list_ratio"), either("_beds", bedrooms).alias("bedrooms"), either("_baths", bathrooms).alias("bathrooms"), F.col("_dom").alias("dom_days"), basement_of(F.col("_plain")).alias("basement_type"),
        F.when(parked != "", garage(parked)).otherwise("None").alias("garage_type"), built.alias("built_year"), first_term(low, TYPES, "Single Family Detached").alias("house_type"), first_term(low, STYLES).alias("style"), number(F.when(F.col("_sqft") != "", F.col("_sqft"))).alias("sqft"),
        rdp(found(F.col("_lot"), LOT).cast("double") * found(F.col("_lot"), LOT, 2).cast("double") * 0.092903, 2).alias("lot_size"),
    )


def text_listings(texts: DataFrame, names: tuple[str, ...], suffixes: dict[str, str]) -> DataFrame:
    """Listings of flat texts (path, text): each block lasts from its address to the next one; rejected lines are none."""
    t = F.col("text")

    def block(a: Column, m: Column, i: Column) -> Column:
        long = F.coalesce(F.get(a, i + 1)["start"], F.char_length(t) + 1) - m["start"]
        return F.struct(F.substring(t, m["start"], long).alias("block"), F.trim(F.regexp_replace(m["match"], r"\s+", " ")).alias("address"))

    # an array of one, so that the matches of a text are found once; what an explode puts out is not made again at each use
    blocks = F.get(F.transform(F.array(matches(t, ADDRESS)), lambda a: F.transform(a, lambda m, i: block(a, m, i))), F.lit(0))
    x = spread(texts.select("path", "text")).select("path", F.posexplode(blocks).alias("position", "_m")).select("path", "position", "_m.block", "_m.address")
    low = F.lower("address")
    for word in REJECTED:
        x = x.where(~F.contains(low, F.lit(word)))
    b = F.col("block")
    named = [F.when(F.contains(F.lower(b), F.lit(n.lower())) | F.contains(low, F.lit(n.lower())), n) for n in names] + [F.when(F.contains(low, F.lit(s)), v) for s, v in suffixes.items()]
    own = found(b, r"MLS[®R#:\s]*?(\d{8})")
    kind, raw = known_terms(b, TYPES), found(b, r"(?i)Basement\s*[:\-]?\s*([A-Za-z0-9 /]+)")
    kind = F.when(F.contains(kind, F.lit(",")), F.regexp_replace(kind, r", Other$", "")).otherwise(kind)
    low_raw = F.lower(F.trim(raw))
    floor = F.when(raw.isNull(), "Unknown")
    for word, name in (("none", "No Basement"), ("crawl", "Crawl Space"), ("3/4", "Three-Quarter"), ("full", "Full")):
        floor = floor.when(F.contains(low_raw, F.lit(word)), name)
    parked = found(b, r"(?is)Parking.{0,100}?((Detached|Attached|Pad|Plug-In|Rear|Carport|Drive Access|Parking Pad|Single|Double)[^\n]*)")
    list_price, sold_price = price_after("List Price", b), price_after("Sold Price", b)
    number_ = F.coalesce(own, surrogate_mls("address"))
    return x.select(
        "path", "position", number_.alias("mls_number"), F.when(number_.rlike(r"^20\d{7}$"), F.substring(number_, 1, 4).cast("int")).alias("mls_year_hint"), F.coalesce(*named, F.lit("Loose Area")).alias("neighborhood"), "address", list_price.alias("list_price"), sold_price.alias("sold_price"),
        F.when(list_price > 0, rdp(sold_price / list_price, 2)).otherwise(F.lit(0).cast("decimal(18,2)")).alias("sell_list_ratio"), F.coalesce(found(b, r"(?i)DOM\s*[:\-]?\s*(\d+)").try_cast("int"), F.lit(0)).alias("dom"), F.coalesce(found(b, r"(?i)(\d+)\s*BR").try_cast("int"), F.lit(0)).alias("bedrooms"),
        F.coalesce(found(b, r"(?i)(\d+(?:\.\d+)?)\s*Bath").cast("double"), F.lit(1.0)).alias("bathrooms"), F.coalesce(F.trim(F.replace(F.lower(parked), F.lit("\n"), F.lit(", "))), F.lit("none")).alias("garage_type"), floor.otherwise(F.initcap(F.trim(raw))).alias("basement"),
        F.coalesce(F.trim(found(b, r"(?i)Property Type\s*:?.*?(Single Family Detached|Townhouse|Bungalow|Duplex|Condo|Mobile|Other)")), F.lit("Single Family Detached")).alias("house_type"), known_terms(b, STYLES).alias("style"), kind.alias("type"),
        F.coalesce(found(b, r"(\d{3,5})\s+SF").cast("int"), F.lit(1200)).alias("sqft"), F.coalesce(found(b, r"(\d+\.\d+)\s*M2").cast("double"), F.lit(0.0)).alias("lot_size"),
    )


def missing_listings(texts: DataFrame) -> DataFrame:
    """Listings of texts (path, text) in which each begins with an address line that ends in a postal code."""
    # from the start of a line, as the bare pattern would also part a house number between its digits
    parts = F.filter(F.split("text", r"(?m)(?=^\d+\s+.+?\s+Winnipeg\s+R\d[A-Z]\s?\d[A-Z]\d)"), lambda x: F.trim(x) != "")
    x = texts.select("path", F.posexplode(parts).alias("position", "r"))
    r, baths = F.col("r"), r"Baths:.*?(\d)\s*/?H?(\d)?"
    place, price = F.trim(found(r, r"Nghbrhd:\s*(.+)")), number(found(r, r"List Price:\s*\$([\d,]+)"))
    own = found(r, r"(?s)MLS.*?(20\d{7})")
    half = F.nullif(found(r, baths, 2), F.lit(""))
    return x.select(
        "path", "position", own.alias("mls_number"), F.substring(own, 1, 4).cast("int").alias("mls_year_hint"), F.concat(F.trim(found(r, r"^(\d+\s.+?)\s+Winnipeg")), F.lit(" Winnipeg")).alias("address"), price.alias("list_price"), price.alias("original_price"), number(found(r, r"Sell\s*Price:\s*\$([\d,]+)")).alias("sold_price"),
        found(r, r"Type:\s*(\w+)").alias("house_type"), found(r, r"BDA:\s*(\d+)").cast("int").alias("bedrooms"), (found(r, baths).cast("double") + F.coalesce(half.cast("double"), F.lit(0.0)) * 0.5).alias("bathrooms"), found(r, r"DOM:\s*(\d+)").cast("int").alias("dom"),
        found(r, r"Yr Built.*?:\s*(\d{4})").cast("int").alias("built_year"), F.lower(F.trim(found(r, r"Parking:\s*(.+)"))).alias("garage_type"), number(found(r, r"Liv Area:\s*[\d.,]+\s*M2.*?(\d[\d,]+)\s*SF")).alias("sqft"), place.alias("neighborhood"), place.alias("region"),
    )


def merge_sales(columns: tuple[str, ...], *frames: DataFrame, order: str = "_ord") -> DataFrame:
    """The frames one below the other, the last row of each address; a frame that lacks a column is refused."""
    for frame in frames:
        if lacking := [c for c in columns if c not in frame.columns]:
            raise ValueError(f"missing expected columns: {lacking}")
    rows = None
    for i, frame in enumerate(frames):
        part = frame.select(*columns, F.struct(F.lit(i).alias("i"), F.col(order).alias("o")).alias("_at"))
        rows = part if rows is None else rows.unionByName(part)
    last = F.row_number().over(Window.partitionBy("address").orderBy(F.desc("_at")))
    return rows.withColumn("_rn", last).where("_rn = 1").select(*columns)
