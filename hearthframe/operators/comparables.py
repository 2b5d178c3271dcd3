"""Comparable sales: tiered range joins, weighted similarity, top-k per subject, weighted quantiles, confidence.

All subjects are searched by one plan. How many candidates a tier has is told by sums over days, without pairs; then
each subject is joined in the tier that serves it alone. A tier's join is on property type, geography and a bin of
dates as wide as the lookback (a candidate stands in its own bin and the next), so the range condition never makes a
group longer than two lookbacks. Subjects with many candidates are not scored with all of them, and no pairs of theirs are
sorted: cells of subjects and candidates meet in a task (nearest.py), which leaves out the sizes and dates that cannot hold a
better one than the last one kept, and returns the best only, with all their columns.
"""

from __future__ import annotations

import math
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.scalars import baths, rdp
from ..functions.shared import BROADCAST_ROWS, small_side, written
from . import nearest

# Tiers (name, geography, days), least usable and most returned comparables, weights of the subscores.
TIERS = (("tier1_neighbourhood_365", "neighbourhood", 365), ("tier2_area_365", "area_code", 365), ("tier3_area_730", "area_code", 730))
MIN_USABLE, MAX_RETURNED = 3, 10
WEIGHTS = {"geography": 25, "living_area": 25, "recency": 20, "bedrooms": 8, "bathrooms": 8, "year_built": 6, "style": 4, "garage": 2, "basement": 2}

#: The columns of a sale that a search reads.
SEARCHED = (
    "mls_number", "sold_date", "sold_price", "living_area_sqft", "property_type", "neighbourhood", "area_code", "bedrooms_total", "full_bathrooms", "half_bathrooms", "year_built", "style", "garage_type",
    "basement_type", "data_quality_status",
)
#: Candidates up to which a subject is joined with all of them, candidates of a cell that serve as probes, ratio of neighbouring bins of sizes.
FEW_CANDIDATES, PROBES, SIZE_STEP = 50, 48, 1.25
#: Subjects and candidates, about, that a task holds of a cell at once.
CELL_SUBJECTS, CELL_CANDIDATES = 20_000, 200_000
#: Comparables, about, that a task sorts for their subjects' values.
VALUED_AT_ONCE = 200_000
#: The subscores that place, size and date tell, and more than half a unit of the last decimal of a similarity.
BOUNDING, ROUNDING = ("geography", "living_area", "recency"), 0.01


def skip_reason() -> Column:
    """The first reason for which a sale cannot be a subject, in the fixed order; ENGINE_ERROR if it is no valid one."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    counts = [F.coalesce(F.col(c), F.lit(0)) < 0 for c in ("bedrooms_total", "full_bathrooms", "half_bathrooms")]
    invalid = F.coalesce((F.col("year_built") < 1800) | (F.col("year_built") > F.year("sold_date")), F.lit(False)) | counts[0] | counts[1] | counts[2]
    return (
        F.when(blank("mls_number"), "MISSING_MLS")
        .when(F.col("sold_date").isNull(), "MISSING_SOLD_DATE")
        .when(F.coalesce(F.col("sold_price"), F.lit(0)) <= 0, "INVALID_SOLD_PRICE")
        .when(F.coalesce(F.col("living_area_sqft"), F.lit(0)) <= 0, "INVALID_LIVING_AREA")
        .when(blank("property_type"), "MISSING_PROPERTY_TYPE")
        .when(blank("area_code") & blank("neighbourhood"), "MISSING_GEOGRAPHY")
        .when(invalid, "ENGINE_ERROR")
    )


def eligibility(days: Column) -> Column:
    """Why candidate c_* may not serve subject s_*, the first of ten tests that fails; 'eligible' if none."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    same = lambda n: F.coalesce(F.col(f"s_{n}") == F.col(f"c_{n}"), F.lit(False))
    return (
        F.when(F.coalesce(F.col("c_data_quality_status"), F.lit("")) != "approved", "not_approved")
        .when(blank("c_mls_number"), "missing_mls")
        .when(F.col("c_mls_number") == F.col("s_mls_number"), "subject_self")
        .when(~same("property_type"), "property_type_mismatch")
        .when(F.coalesce(F.col("c_sold_price"), F.lit(0)) <= 0, "non_positive_price")
        .when(F.col("c_sold_date").isNull(), "missing_sold_date")
        .when(F.col("c_sold_date") > F.col("s_valuation_date"), "future_sale")
        .when(F.col("c_sold_date") < F.date_sub(F.col("s_valuation_date"), days), "outside_lookback")
        .when(F.coalesce(F.col("c_living_area_sqft"), F.lit(0)) <= 0, "missing_size")
        .when(~(same("neighbourhood") | same("area_code")), "no_geographic_match")
        .otherwise("eligible")
    )


def subscores() -> dict[str, Column]:
    """The nine subscores of candidate c_* for subject s_*, each 0 to 1; a null on either side gives 0."""
    fade = lambda x, zero: F.coalesce(F.greatest(F.lit(0.0), F.lit(1.0) - x / F.lit(float(zero))), F.lit(0.0))
    gap = lambda n: F.abs(F.col(f"c_{n}") - F.col(f"s_{n}"))
    exact = lambda n: F.when(F.col(f"c_{n}") == F.col(f"s_{n}"), 1.0).otherwise(0.0)
    b = F.abs(baths("c_full_bathrooms", "c_half_bathrooms") - baths("s_full_bathrooms", "s_half_bathrooms"))
    ages = F.abs((F.year("s_valuation_date") - F.col("s_year_built")) - (F.year("c_sold_date") - F.col("c_year_built")))
    return {
        "geography": F.when(F.col("c_neighbourhood") == F.col("s_neighbourhood"), 1.0).when(F.col("c_area_code") == F.col("s_area_code"), 0.5).otherwise(0.0),
        "living_area": fade(gap("living_area_sqft") / F.col("s_living_area_sqft").cast("double"), 0.5),
        "recency": fade(F.datediff("s_valuation_date", "c_sold_date"), 730),
        "bedrooms": fade(gap("bedrooms_total"), 3),
        "bathrooms": fade(b, 3),
        "year_built": fade(ages, 50),
        "style": exact("style"),
        "garage": exact("garage_type"),
        "basement": exact("basement_type"),
    }


def similarity() -> Column:
    s = subscores()
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + F.lit(float(weight)) * s[name]
    return rdp(total, 2)


def coverage(prefix: str = "c_") -> Column:
    """Share of the six optional dimensions that are known."""
    known = [F.col(prefix + n).isNotNull() for n in ("bedrooms_total", "year_built", "style", "garage_type", "basement_type")]
    known.append(F.col(f"{prefix}full_bathrooms").isNotNull() | F.col(f"{prefix}half_bathrooms").isNotNull())
    return rdp(sum((k.cast("int") for k in known), F.lit(0)) / F.lit(6.0), 4)


def differences() -> dict[str, Column]:
    """How candidate c_* differs from subject s_*; null where either side is."""
    size = (F.col("c_living_area_sqft") - F.col("s_living_area_sqft")) / F.col("s_living_area_sqft").cast("double") * 100
    apart = baths("c_full_bathrooms", "c_half_bathrooms") - baths("s_full_bathrooms", "s_half_bathrooms")
    return {
        "size_diff_pct": rdp(size, 1),
        "same_neighbourhood": F.coalesce((F.col("s_neighbourhood") != "") & (F.col("s_neighbourhood") == F.col("c_neighbourhood")), F.lit(False)),
        "age_days": F.datediff("s_valuation_date", "c_sold_date"),
        "bedrooms_diff": F.col("c_bedrooms_total") - F.col("s_bedrooms_total"),
        "bathrooms_diff": apart.cast("decimal(10,1)"),
        "year_built_diff": F.col("c_year_built") - F.col("s_year_built"),
    }


def reasons(detail: str = "detail") -> Column:
    """array<string>: what makes a comparable one, for people."""
    d = lambda n: F.col(f"{detail}.{n}")
    place = F.when(d("same_neighbourhood"), "same neighbourhood").when(d("same_area"), "same area code (different/unknown neighbourhood)")
    signed = lambda x, fmt: F.format_string(fmt, x)
    said = [place, F.concat(F.lit("living area "), signed(d("size_diff_pct").cast("double"), "%+.1f"), F.lit("% vs subject")), F.concat(F.lit("sold "), d("age_days").cast("string"), F.lit(" days before valuation date"))]
    said += [F.when(d("bedrooms_diff").isNotNull(), F.concat(F.lit("bedrooms "), signed(d("bedrooms_diff"), "%+d"))), F.when(d("bathrooms_diff").isNotNull(), F.concat(F.lit("bathrooms "), signed(d("bathrooms_diff").cast("double"), "%+.1f")))]
    return F.array_compact(F.array(*said))


def comparable_warnings(detail: str = "detail", coverage_: str = "data_coverage") -> Column:
    low = F.when(F.col(coverage_) < 0.5, "low_data_coverage")
    return F.array_compact(F.array(low, F.when(F.abs(F.col(f"{detail}.size_diff_pct")) >= 30, "large_size_difference"), F.when(F.col(f"{detail}.age_days") > 365, "older_than_one_year")))


def day_of(date) -> Column:
    return F.datediff(date, F.lit("1970-01-01").cast("date"))


def usable_candidates(candidates: DataFrame) -> DataFrame:
    """Approved candidates with number, date, price and size, a c_row of their own, and for each geography c_until_<geography>.

    A number that repeats within a type and place counts once for a subject, with the latest sale that is not after
    the valuation date; so a sale serves until the next one's date. Of sales of one day the last by their other columns serves.
    Only sales whose number repeats are shuffled for that, unless the repeated numbers are too many to broadcast.
    """
    ok = candidates.where("c_data_quality_status = 'approved' and coalesce(c_mls_number, '') != '' and c_sold_date is not null and c_sold_price > 0 and c_living_area_sqft > 0")
    if "c_row" not in ok.columns:
        ok = written(ok.withColumn("c_row", F.monotonically_increasing_id()))
    ties = [c for c in candidates.columns if c not in ("c_mls_number", "c_sold_date", "c_row")]
    until = {f"c_until_{g}": F.lead("c_sold_date").over(Window.partitionBy("c_mls_number", "c_property_type", f"c_{g}").orderBy("c_sold_date", *ties)) for g in ("neighbourhood", "area_code")}
    again = written(ok.groupBy("c_mls_number").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("c_mls_number"))
    if again.count() > BROADCAST_ROWS:
        return written(ok.withColumns(until))
    ends = ok.join(F.broadcast(again), "c_mls_number").withColumns(until).select("c_row", *until)
    ends = written(ends.where(" or ".join(f"{n} is not null" for n in until)))
    return ok.join(small_side(ends, ends.count()), "c_row", "left")


def _serves(geography: str, days: int) -> Column:
    """Whether candidate c_*'s sale is within the lookback of s_valuation_date and the latest one of its number."""
    until = F.col(f"c_until_{geography}")
    return (F.col("c_sold_date") <= F.col("s_valuation_date")) & (F.col("c_sold_date") >= F.date_sub("s_valuation_date", days)) & (until.isNull() | (until > F.col("s_valuation_date")))


def tier_count(subjects: DataFrame, candidates: DataFrame, geography: str, days: int) -> DataFrame:
    """(s_property_type, s_<geography>, s_valuation_date, n): numbers among the usable candidates of the tier, the subject's own included.

    A sale enters on its day and leaves when the lookback ends or its number is sold again: n is the running sum, over one
    row per type, place and day.
    """
    by = [F.col("c_property_type").alias("kind"), F.col(f"c_{geography}").alias("place")]
    enters = day_of("c_sold_date")
    leaves = F.least(enters + days + 1, day_of(f"c_until_{geography}"))  # least() passes over nulls
    at = F.explode(F.array(F.struct(enters.alias("day"), F.lit(1).alias("n")), F.struct(leaves.alias("day"), F.lit(-1).alias("n"))))
    moves = candidates.where(F.col(f"c_{geography}") != "").select(*by, at.alias("x")).select("kind", "place", "x.day", "x.n", F.lit(False).alias("asked"))
    asked = subjects.where(F.col(f"s_{geography}") != "").select(F.col("s_property_type").alias("kind"), F.col(f"s_{geography}").alias("place"), day_of("s_valuation_date").alias("day"), F.lit(0).alias("n"), F.lit(True).alias("asked"))
    daily = moves.unionByName(asked).groupBy("kind", "place", "day").agg(F.sum("n").alias("n"), F.max("asked").alias("asked"))
    running = daily.withColumn("n", F.sum("n").over(Window.partitionBy("kind", "place").orderBy("day"))).where("asked")
    date = F.date_add(F.lit("1970-01-01").cast("date"), F.col("day"))
    return running.select(F.col("kind").alias("s_property_type"), F.col("place").alias(f"s_{geography}"), date.alias("s_valuation_date"), "n")


def _dated(subjects: DataFrame, candidates: DataFrame, geography: str, days: int) -> tuple[DataFrame, DataFrame, Column]:
    """Subjects and candidates with a bin of dates, and the condition under which they meet in a tier."""
    bin_of = lambda d: F.floor(day_of(d) / F.lit(days))
    s = subjects.where(F.col(f"s_{geography}") != "").withColumn("_bin", bin_of("s_valuation_date"))
    c = candidates.where(F.col(f"c_{geography}") != "").withColumn("_c_bin", F.explode(F.array(bin_of("c_sold_date"), bin_of("c_sold_date") + 1)))
    on = (F.col("_bin") == F.col("_c_bin")) & (F.col("s_property_type") == F.col("c_property_type")) & (F.col(f"s_{geography}") == F.col(f"c_{geography}"))
    return s, c, on & _serves(geography, days) & ~F.col("c_mls_number").eqNullSafe(F.col("s_mls_number"))


def tier_pairs(subjects: DataFrame, candidates: DataFrame, geography: str, days: int) -> DataFrame:
    """Eligible pairs of one tier, scored; subjects are s_*, candidates, of usable_candidates(), c_*."""
    s, c, on = _dated(subjects, candidates, geography, days)
    return s.join(c, on).withColumn("similarity", similarity())


def size_bin(area) -> Column:
    return F.floor(F.log(area) / F.lit(math.log(SIZE_STEP))).cast("int")


def _in_bins(s: DataFrame, c: DataFrame, on: Column) -> DataFrame:
    """The scored pairs of subjects s, of the size bins _sizes, with candidates c that can reach _least, if that is not null."""
    promised = reduce(lambda a, b: a + b, [F.lit(float(WEIGHTS[n])) * subscores()[n] for n in BOUNDING]) + float(sum(w for n, w in WEIGHTS.items() if n not in BOUNDING))
    reaches = F.coalesce(promised >= F.col("_least") - ROUNDING, F.lit(True))
    return s.withColumn("_size", F.explode("_sizes")).join(c, on & (F.col("_size") == F.col("_c_size")) & reaches).withColumn("similarity", similarity())


def bounded_pairs(subjects: DataFrame, candidates: DataFrame, geography: str, days: int, k: int) -> DataFrame:
    """The pairs of tier_pairs(), scored, that may be among a subject's k best, with the subject's bins of date and size; none of these is missing.

    subjects have a column s_row that tells them apart.
    """
    s, c, on = _dated(subjects, candidates, geography, days)
    c = c.withColumn("_c_size", size_bin("c_living_area_sqft"))
    keys = ["_bin", "_size", "s_property_type", f"s_{geography}"]
    nth = F.row_number().over(Window.partitionBy("_c_bin", "_c_size", "c_property_type", f"c_{geography}").orderBy(F.xxhash64("c_row")))
    probes = c.withColumn("_nth", nth).where(F.col("_nth") <= PROBES).drop("_nth")
    own = s.withColumns({"_sizes": F.array(size_bin("s_living_area_sqft")), "_least": F.lit(None).cast("decimal(18,2)")})
    # a subject's probes stand in one partition of this join, and are twice PROBES at most
    least = _in_bins(own, probes, on).groupBy("s_row", *keys).agg(F.get(F.sort_array(F.collect_list("similarity"), asc=False), F.lit(k - 1)).alias("_least"))
    s = s.join(written(least.select("s_row", "_least")), "s_row", "left")
    ends = candidates.agg(F.min("c_living_area_sqft").alias("low"), F.max("c_living_area_sqft").alias("high")).first()
    if ends.low is None:
        return _in_bins(s.withColumn("_sizes", F.array().cast("array<int>")), c, on)
    fade = 0.5 * (100 - F.col("_least").cast("double") + ROUNDING) / WEIGHTS["living_area"]  # the relative difference of size that costs all that may be lost
    free = F.coalesce(fade >= 0.5, F.lit(True))  # beyond half the size nothing more is lost
    low, high = F.lit(float(ends.low)), F.lit(float(ends.high))
    first = F.when(free, low).otherwise(F.greatest(low, F.col("s_living_area_sqft") * (1 - fade) * (1 - 1e-9)))
    last = F.when(free, high).otherwise(F.least(high, F.col("s_living_area_sqft") * (1 + fade) * (1 + 1e-9)))
    sizes = F.when(first <= last, F.sequence(size_bin(first), size_bin(last))).otherwise(F.array().cast("array<int>"))
    return _in_bins(s.withColumn("_sizes", sizes), c, on)


#: What a ranked comparable keeps of its subject and of its sale.
KEPT_S = (
    "s_row", "s_mls_number", "s_valuation_date", "s_living_area_sqft", "s_neighbourhood", "s_area_code", "s_bedrooms_total", "s_full_bathrooms", "s_half_bathrooms", "s_year_built", "s_style", "s_garage_type", "s_basement_type",
    "tier_index", "tier", "tier_widened", "candidate_count",
)
KEPT_C = ("c_row", *(f"c_{c}" for c in SEARCHED if c not in ("property_type", "data_quality_status")))


def best_of_cells(subjects: DataFrame, candidates: DataFrame, geography: str, days: int, k: int) -> DataFrame:
    """The k best of tier_pairs() of each subject, with KEPT_S and KEPT_C, similarity and rk; no pair leaves the task that scores it.

    A cell is a type, place and bin of dates. One of many subjects is cut by subjects, one of many candidates also by candidates, and
    what the parts return is ranked again.
    """
    s, c, _ = _dated(subjects, candidates, geography, days)
    keys = ["_kind", "_place", "_bin"]
    s = s.withColumns({"_kind": F.col("s_property_type"), "_place": F.col(f"s_{geography}")})
    c = c.withColumns({"_kind": F.col("c_property_type"), "_place": F.col(f"c_{geography}")}).withColumnRenamed("_c_bin", "_bin")
    parts = lambda n: F.ceil(F.col("count") / F.lit(n)).cast("int")
    cut = s.groupBy(*keys).count().withColumn("_s_parts", parts(CELL_SUBJECTS)).drop("count").join(c.groupBy(*keys).count().withColumn("_c_parts", parts(CELL_CANDIDATES)).drop("count"), keys)
    cut = written(cut.withColumn("_cell", F.monotonically_increasing_id()))
    again = not cut.where("_c_parts > 1").isEmpty()
    cut = small_side(cut, cut.count())  # else both sides would be shuffled for it, and then once more
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda row, n: F.pmod(F.xxhash64(row), F.col(n)).cast("int")
    s = s.join(cut, keys).withColumn("_s_part", one("s_row", "_s_parts")).withColumn("_c_part", each("_c_parts"))
    c = c.join(cut, keys).withColumn("_c_part", one("c_row", "_c_parts")).withColumn("_s_part", each("_s_parts"))
    by = ["_cell", "_s_part", "_c_part"]
    s = s.select(*by, *KEPT_S)
    c = c.select(*by, *KEPT_C, F.col(f"c_until_{geography}").alias("_until"))
    names = {"style": "style", "garage": "garage_type", "basement": "basement_type", "neighbourhood": "neighbourhood", "area": "area_code", "number": "mls_number"}
    schema = StructType([*s.select(*KEPT_S).schema.fields, *c.select(*KEPT_C).schema.fields, *StructType.fromDDL("_hundredths long, rk int").fields])
    find, made = nearest.search(WEIGHTS, days, k), to_arrow_schema(schema)

    def compared(t: pa.Table, p: str, at: str) -> pa.Table:
        number = lambda n: pc.cast(t[f"{p}_{n}"], pa.float64())
        day = lambda n: pc.cast(pc.cast(t[n], pa.int32()), pa.float64())
        full, half = number("full_bathrooms"), number("half_bathrooms")
        bathrooms = pc.if_else(pc.and_(pc.is_null(full), pc.is_null(half)), None, pc.add(pc.fill_null(full, 0.0), pc.multiply(pc.fill_null(half, 0.0), 0.5)))
        told = {"_day": day(at), "_size": number("living_area_sqft"), "_beds": number("bedrooms_total"), "_baths": bathrooms, "_age": pc.subtract(pc.cast(pc.year(t[at]), pa.float64()), number("year_built"))}
        told |= {"_until": day("_until")} if "_until" in t.column_names else {}
        return pa.table(told | {x: t[f"{p}_{n}"] for x, n in names.items()})

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        i, j, points, rk = find(compared(left, "s", "s_valuation_date"), compared(right, "c", "c_sold_date"))
        columns = [left[n].take(pa.array(i)) for n in KEPT_S] + [right[n].take(pa.array(j)) for n in KEPT_C] + [pa.array(points), pa.array(rk)]
        return pa.table([x.cast(f.type) for x, f in zip(columns, made, strict=True)], schema=made)

    found = s.groupBy(*by).cogroup(c.groupBy(*by)).applyInArrow(run, schema)
    if again:
        nth = F.row_number().over(Window.partitionBy("s_row").orderBy(F.desc("_hundredths"), F.desc("c_sold_date"), "c_mls_number"))
        found = found.withColumn("rk", nth).where(F.col("rk") <= k)
    return found.withColumn("similarity", (F.col("_hundredths") * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(18,2)")).drop("_hundredths")


def as_subjects(sales: DataFrame) -> DataFrame:
    """Sales that can be valued at their own sale date, as s_*."""
    ok = sales.where(skip_reason().isNull()).withColumn("valuation_date", F.col("sold_date"))
    return ok.select(*[F.col(c).alias(f"s_{c}") for c in ok.columns if not c.startswith("_")])


def as_candidates(sales: DataFrame) -> DataFrame:
    return sales.select(*[F.col(c).alias(f"c_{c}") for c in sales.columns if not c.startswith("_")])


def choose_tiers(subjects: DataFrame, candidates: DataFrame, min_usable: int = MIN_USABLE) -> DataFrame:
    """subjects, told apart by s_row, with tier_index, tier, tier_widened and candidate_count: the first applicable tier with min_usable candidates serves, else the last applicable one."""
    place = [f"s_{geography}" for _, geography, _ in TIERS]
    there = lambda i: F.coalesce(F.col(place[i]) != "", F.lit(False)).cast("int")
    asked = subjects.select("s_row", "s_mls_number", "s_valuation_date", "s_property_type", "s_neighbourhood", "s_area_code")
    sold = candidates.select("c_mls_number", "c_sold_date", "c_property_type", "c_neighbourhood", "c_area_code", "c_until_neighbourhood", "c_until_area_code")
    met = asked.join(sold, (F.col("c_mls_number") == F.col("s_mls_number")) & (F.col("c_property_type") == F.col("s_property_type")), "left")
    counted = [F.max(F.coalesce((F.col(f"c_{g}") == F.col(f"s_{g}")) & _serves(g, days), F.lit(False)).cast("int")).alias(f"_own{i}") for i, (_, g, days) in enumerate(TIERS)]
    most = [F.max(there(i)).alias(f"_there{i}") for i in range(len(TIERS))]
    # most subjects serve as candidates wherever they have a place; only the others are written
    odd = written(met.groupBy("s_row").agg(*counted, *most).where(" or ".join(f"_own{i} != _there{i}" for i in range(len(TIERS)))).select("s_row", *[f"_own{i}" for i in range(len(TIERS))]))
    sizes = [odd.count()]
    x = subjects.join(small_side(odd, sizes[0]), "s_row", "left")
    for i, (_, geography, days) in enumerate(TIERS):
        keys = ["s_property_type", place[i], "s_valuation_date"]
        daily = written(tier_count(subjects, candidates, geography, days).withColumnRenamed("n", f"_n{i}"))
        sizes.append(daily.count())
        x = x.join(small_side(daily, sizes[-1]), keys, "left")
        x = x.withColumn(f"_n{i}", F.coalesce(f"_n{i}", F.lit(0)) - F.coalesce(f"_own{i}", there(i)))
    applies = [F.coalesce(F.col(f"s_{geography}") != "", F.lit(False)) for _, geography, _ in TIERS]
    serves, last, first = F.lit(None), F.lit(None), F.lit(None)
    for i in reversed(range(len(TIERS))):
        serves = F.when(applies[i] & (F.col(f"_n{i}") >= min_usable), i).otherwise(serves)
        first = F.when(applies[i], i).otherwise(first)
    for i in range(len(TIERS)):
        last = F.when(applies[i], i).otherwise(last)
    x = x.withColumns({"tier_index": F.coalesce(serves, last).cast("int"), "_first": first})
    count = F.get(F.array(*[F.col(f"_n{i}") for i in range(len(TIERS))]), F.col("tier_index"))
    name = F.get(F.array(*[F.lit(t[0]) for t in TIERS]), F.col("tier_index"))
    x = x.withColumns({"tier": name, "tier_widened": F.col("tier_index") > F.col("_first"), "candidate_count": count.cast("long")}).select(*subjects.columns, "tier_index", "tier", "tier_widened", "candidate_count")
    return x if max(sizes) <= BROADCAST_ROWS else written(x)  # joins with small tables are made again sooner than written


def find_comparables(subjects: DataFrame, candidates: DataFrame, min_usable: int = MIN_USABLE, max_returned: int = MAX_RETURNED) -> tuple[DataFrame, DataFrame]:
    """(searches, comps): a row per subject with its tier, whether it was widened and its candidate count; and its ranked comparables.

    Rank: similarity, then later sale, then number. Both have s_row, which tells subjects apart that share a number. Pairs of subjects with
    few candidates are ranked where a tier's join puts them, as narrow rows; the others come ranked from their cells. What each tier reads is a
    table already written, joined with small ones; subjects and candidates of a table that has a column `row` are not written again.
    """
    candidates = usable_candidates(candidates.select(*[f"c_{c}" for c in SEARCHED], *[c for c in candidates.columns if c == "c_row"]))
    if "s_row" not in subjects.columns:
        subjects = written(subjects.withColumn("s_row", F.monotonically_increasing_id()))
    chosen = choose_tiers(subjects, candidates, min_usable).withColumn("_many", F.col("candidate_count") > FEW_CANDIDATES)
    order = [F.desc("similarity"), F.desc("c_sold_date"), "c_mls_number"]
    narrow = ["s_row", "c_row", "c_mls_number", "c_sold_date", "similarity"]
    best = [chosen.limit(0).select(*KEPT_S).crossJoin(candidates.limit(0).select(*KEPT_C)).select("*", F.lit(0).alias("rk"), F.lit(0).cast("decimal(18,2)").alias("similarity"))]
    for i, many, n in sorted(map(tuple, chosen.where("candidate_count > 0").groupBy("tier_index", "_many").count().collect())):  # twice the tiers at most
        _, geography, days = TIERS[i]
        asked = chosen.where((F.col("tier_index") == i) & (F.col("_many") == many)).drop("_many")
        if many:
            best.append(best_of_cells(asked, candidates, geography, days, max_returned))
            continue
        small = n * max_returned <= BROADCAST_ROWS
        asked = F.broadcast(written(asked.select(*KEPT_S, "s_property_type"))) if small else asked
        keys = ["s_row", "_bin", "s_property_type", f"s_{geography}"]  # the subject first, as it parts the sorted rows soonest
        pairs = tier_pairs(asked, candidates, geography, days).select(*keys, *narrow[1:])
        top = pairs.withColumn("rk", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rk") <= max_returned).select("s_row", "c_row", "similarity", "rk")
        best.append(candidates.select(*KEPT_C).join(F.broadcast(top) if small else top, "c_row").join(asked.select(*KEPT_S), "s_row"))
    comps = reduce(DataFrame.unionByName, best[1:] or best)
    scores = subscores()
    components = F.struct(*[rdp(v, 4).alias(n) for n, v in scores.items()])
    weighted = F.struct(*[rdp(F.lit(float(WEIGHTS[n])) * v, 2).alias(n) for n, v in scores.items()])
    same_area = F.coalesce((F.col("c_area_code") != "") & (F.col("c_area_code") == F.col("s_area_code")), F.lit(False))
    detail = F.struct(*[v.alias(n) for n, v in differences().items()], same_area.alias("same_area"))
    comps = comps.withColumns({"data_coverage": coverage(), "detail": detail, "components": components, "weighted": weighted})
    comps = comps.select("s_row", "s_mls_number", "s_valuation_date", "c_mls_number", "c_sold_date", "c_sold_price", "c_living_area_sqft", "s_living_area_sqft", "similarity", "data_coverage", "components", "weighted", "detail", "rk", "detail.age_days", "detail.size_diff_pct", "tier_index", "tier", "tier_widened", "candidate_count")
    return chosen.select("s_row", "s_mls_number", "s_valuation_date", "tier_index", "tier", "tier_widened", "candidate_count"), comps


def weighted_quantile(value: str, numerator: int, denominator: int, by: Window) -> Column:
    """Aggregate input: value where the running weight (over by, in its order) has reached the share; take its min."""
    return F.when(F.col(f"_{value}_cum") * denominator >= F.col("_total") * numerator, F.col(value))


def nearest_500(x) -> Column:
    return F.floor(x / F.lit(500.0) + F.lit(0.5)) * 500


def value_subjects(comps: DataFrame, min_usable: int = MIN_USABLE, subjects: int | None = None) -> DataFrame:
    """The price indicators, statistics and confidence of each subject with enough comparables.

    subjects: how many there are, about; if told, a task holds so few comparables that none of its sorts spills.
    """
    by = Window.partitionBy("s_row")
    x = comps.where(F.col("candidate_count") >= min_usable)
    if subjects is not None:
        x = x.repartition(max(x.sparkSession.sparkContext.defaultParallelism, -(-subjects * MAX_RETURNED // VALUED_AT_ONCE)), "s_row")
    price, area = F.col("c_sold_price").cast("double"), F.col("c_living_area_sqft").cast("double")
    x = x.withColumns({"ppsf": price / area, "sn": price * F.col("s_living_area_sqft") / area, "direct": price, "sim": F.col("similarity").cast("double")})
    x = x.withColumns({"_n": F.count(F.lit(1)).over(by), "_rp": F.row_number().over(by.orderBy("ppsf", "c_mls_number")), "_rs": F.row_number().over(by.orderBy("sim", "c_mls_number")), "_rd": F.row_number().over(by.orderBy(F.abs("size_diff_pct"), "c_mls_number"))})
    middle = lambda r: F.col(r).isin(0) | (F.col(r) == F.floor((F.col("_n") + 1) / 2)) | (F.col(r) == F.floor((F.col("_n") + 2) / 2))
    pick = lambda r, v: (F.min(F.when(middle(r), F.col(v))).over(by) + F.max(F.when(middle(r), F.col(v))).over(by)) / 2
    x = x.withColumns({"_med_ppsf": pick("_rp", "ppsf"), "_med_sim": pick("_rs", "sim")})
    x = x.withColumn("_ok", (F.col("ppsf") >= F.col("_med_ppsf") * 0.2) & (F.col("ppsf") <= F.col("_med_ppsf") * 5.0))
    x = x.withColumn("_n_ok", F.sum(F.col("_ok").cast("int")).over(by)).withColumn("_use", F.col("_ok") | (F.col("_n_ok") < min_usable))
    raw = F.when(F.col("_use"), F.col("similarity")).otherwise(F.lit(0).cast("decimal(18,2)"))
    x = x.withColumn("_zero", F.sum(raw).over(by) == 0).withColumn("_w", F.when(F.col("_use") & F.col("_zero"), F.lit(1).cast("decimal(18,2)")).otherwise(raw)).withColumn("_total", F.sum("_w").over(by))
    for v in ("sn", "direct", "ppsf"):
        x = x.withColumn(f"_{v}_cum", F.when(F.col("_use"), F.sum("_w").over(by.orderBy(v, "c_mls_number").rowsBetween(Window.unboundedPreceding, 0))))
    q = lambda v, a, b: F.min(weighted_quantile(v, a, b, by))
    out = x.groupBy("s_row").agg(
        F.first("s_mls_number").alias("s_mls_number"),
        F.first("tier").alias("tier"), F.first("tier_widened").alias("tier_widened"), F.first("candidate_count").alias("candidate_count"), F.count(F.lit(1)).alias("n_comps"),
        nearest_500(q("sn", 1, 2)).cast("long").alias("indicated_value"), nearest_500(q("sn", 1, 4)).cast("long").alias("range_low"), nearest_500(q("sn", 3, 4)).cast("long").alias("range_high"),
        rdp(q("direct", 1, 2), 2).alias("direct_median"), rdp(q("ppsf", 1, 2), 2).alias("median_ppsf"), F.first("_med_sim").alias("_sim"), F.sum("data_coverage").alias("_cov"),
        (F.first("_n_ok") < F.count(F.lit(1))).alias("extreme_ppsf_excluded"), F.min("c_sold_date").alias("first_sold"), F.max("c_sold_date").alias("last_sold"),
        F.max(F.when(F.col("_rd") == F.floor(F.col("_n") / 2) + 1, F.abs("size_diff_pct") > 25)).alias("size_mismatch"),
    )
    out = out.withColumns({"median_similarity": rdp("_sim", 2), "mean_coverage": rdp(F.col("_cov").cast("double") / F.col("n_comps"), 4), "price_spread": F.when(F.col("indicated_value") > 0, rdp((F.col("range_high") - F.col("range_low")) / F.col("indicated_value").cast("double"), 4)).otherwise(F.lit(0).cast("decimal(18,4)"))})

    def at_least(n: int, sim: int, cov: float, spread: float) -> Column:
        return (F.col("n_comps") >= n) & (F.col("_sim") >= sim) & (F.col("_cov") >= F.lit(str(cov)).cast("decimal(4,2)") * F.col("n_comps")) & (F.col("price_spread") <= F.lit(str(spread)).cast("decimal(4,2)"))

    confidence = F.when(at_least(7, 75, 0.75, 0.20) & ~F.col("tier_widened"), "high").when(at_least(4, 60, 0.5, 0.35), "medium").otherwise("low")
    return out.withColumn("confidence", confidence).drop("_cov", "_sim")


def search_results(searches: DataFrame, comps: DataFrame, min_usable: int = MIN_USABLE) -> DataFrame:
    """A row per subject, valued or not: status, confidence with reasons, warnings, and the price indicators.

    A subject with fewer than min_usable candidates is insufficient_data, without an estimate.
    """
    valued = value_subjects(comps, min_usable, searches.count()).drop("s_mls_number", "tier", "tier_widened", "candidate_count")
    x = searches.join(valued, "s_row", "left").withColumn("status", F.when(F.col("candidate_count") < min_usable, "insufficient_data").otherwise("ok"))
    short = F.col("status") == "insufficient_data"
    few = F.concat(F.lit("only "), F.col("candidate_count").cast("string"), F.lit(f" usable comparables (minimum {min_usable})"))
    number = lambda c, n: rdp(c, n).cast("string")
    why = [F.concat(F.col("n_comps").cast("string"), F.lit(" comparables")), F.concat(F.lit("median similarity "), number("median_similarity", 1)), F.concat(F.lit("mean coverage "), number("mean_coverage", 2)), F.concat(F.lit("price spread "), number("price_spread", 2))]
    why.append(F.when(F.col("tier_widened"), "geography widened beyond neighbourhood").otherwise("no geographic widening"))
    said = [F.when(F.col("tier_widened"), "geographic_or_temporal_widening"), F.when(short, "insufficient_data"), F.when(F.col("extreme_ppsf_excluded"), "extreme_ppsf_excluded")]
    return x.withColumns(
        {"confidence": F.when(short, "insufficient").otherwise(F.col("confidence")), "confidence_reasons": F.when(short, F.array(few)).otherwise(F.array(*why)), "warnings": F.array_compact(F.array(*said))}
    )
