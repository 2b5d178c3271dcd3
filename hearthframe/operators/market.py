"""Features, chronological splits, baselines and market calculators over the legacy-shaped housing rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import price_band, rdp, sqft_band
from ..functions.shared import written
from .quantiles import beside, quantile_columns

# Fixed values.
SEASON_BOOST = {"Spring": 1.1, "Summer": 1.05, "Fall": 1.0, "Winter": 0.95}
BASEMENT = {"None": -45000, "Crawl Space": -45000, "Full (Unfinished)": -15000, "Full (Finished)": 25000, "Walkout": 0}
HOT_AREAS = (
    "Bridgwater", "Prairie Pointe", "Whyte Ridge", "East Transcona", "River Heights", "St. Vital", "Tuxedo", "North Kildonan", "Osborne Village", "Fort Richmond",
    "Bridgwater Trails", "Bridgwater Lakes", "Bridgwater Forest", "Bridgwater Centre",
)
DEFAULT_PREMIUM = 5.0
PREMIUMS = {
    "Bridgwater Trails": 8.0, "Bridgwater Lakes": 7.5, "Bridgwater Forest": 7.5, "Bridgwater Centre": 7.5,
    "Tuxedo": 9.0, "Old Tuxedo": 9.0, "Crescentwood": 8.0, "Crescent Park": 8.0,
    "Osborne Village": 8.5, "River-Osborne": 8.0, "West Wolseley": 7.5,
    "Waverley Heights": 7.0, "Waverley West B": 7.0, "Fort Richmond": 7.0, "Linden Woods": 8.0,
    "River Heights": 6.5, "North River Heights": 6.5, "Sage Creek": 6.5,
    "Richmond West": 6.5, "Grant Park": 6.0, "Jameswood": 6.0,
    "Kensington": 6.0, "King Edward": 6.0, "University": 6.0,
    "Central River Heights": 6.5, "Exchange District": 6.0, "Prairie Pointe": 6.0,
    "Charleswood": 5.5, "St. Vital": 5.5, "St. Norbert": 5.5,
    "Amber Trails": 5.5, "Garden City": 5.5, "Maples": 5.5,
    "Westwood": 5.5, "Elm Park": 5.5,
}
#: Columns whose nulls are a group of their own in the benchmark.
CATEGORIES = ("neighborhood", "house_type", "style", "garage_type", "season", "region", "basement_type")

# What the legacy table holds where a source has nothing, texts, whole numbers and fractions, and the most characters of a text.
LEGACY_TEXTS = {"mls_number": "none", "neighborhood": "none", "region": "none", "house_type": "none", "garage_type": "none", "address": "none", "basement_type": "none", "season": "Unknown", "style": "none", "type": "none"}
LEGACY_WHOLE = {"bedrooms": 0, "sqft": 0, "built_year": 0, "age": 0, "dom_days": 0, "list_price": 0, "sold_price": 0}
LEGACY_FRACTIONS = {"bathrooms": 1.0, "lot_size": 0.0, "latitude": 0.0, "longitude": 0.0, "sell_list_ratio": 1.0}
LEGACY_MOST_CHARS = 255


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(v) for kv in values.items() for v in kv])


def training_features(rows: DataFrame) -> DataFrame:
    """The training frame: filters, caps at the 99th percentile, statistics by neighbourhood, composite logic.

    A row without a neighbourhood counts for the caps, the city's figures and the last date, and leaves at the end, as every
    row with a null among the features does.
    """
    x = rows.where("bathrooms > 0 and bedrooms > 0 and sqft >= 500 and list_price > 0 and sold_price > 0 and dom_days >= 0 and sold_date is not null")
    d = lambda c: F.col(c).cast("double")
    x = x.withColumns({"age": F.greatest(F.lit(0), F.year("sold_date") - F.col("built_year")), "price_diff": F.col("sold_price") - F.col("list_price"), "price_per_sqft": d("sold_price") / F.col("sqft")})
    x = x.withColumns({"age": F.when(F.col("built_year").isNotNull(), F.col("age")), "over_asking_pct": d("price_diff") / d("list_price")})
    narrow = written(x.select("neighborhood", "sold_date", "price_per_sqft", d("list_price").alias("list"), d("sold_price").alias("sold")))
    whole = beside(narrow.agg(F.max("sold_date").alias("last"), F.max("price_per_sqft").alias("max_ppsf")), quantile_columns(narrow, {"list": F.col("list"), "sold": F.col("sold")}, {"cap": 0.99}))
    whole = beside(whole, quantile_columns(narrow, {"ppsf": F.col("price_per_sqft")}, {"mid": 0.5}))
    whole = whole.select("last", "max_ppsf", F.col("list_cap").alias("cap_list"), F.col("sold_cap").alias("cap_sold"), F.col("ppsf_mid").alias("city_ppsf"))
    known = narrow.where("neighborhood is not null")
    hood = known.groupBy("neighborhood").agg(F.count(F.lit(1)).alias("comp_count_in_neighborhood"), F.sum(F.col("price_per_sqft").cast("decimal(18,6)")).alias("_sum"))
    hood = beside(hood, quantile_columns(known, {"hood": F.col("price_per_sqft")}, {"ppsf": 0.5}, "neighborhood"), "neighborhood")
    x = x.join(hood, "neighborhood").crossJoin(F.broadcast(whole))  # one row of the whole; rows without a neighbourhood leave
    one = lambda c: c.cast("int")
    x = x.withColumns({"capped_list": F.least(d("list_price"), "cap_list"), "capped_sold": F.least(d("sold_price"), "cap_sold"), "recency_weight": one(F.col("sold_date") >= F.date_sub("last", 90)), "is_multi_offer_by_dom": one(F.col("dom_days") <= 3), "is_not_multi_offer_by_dom": one(F.col("dom_days") > 11)})
    x = x.withColumn("is_underpriced_for_bidding", one((F.col("capped_list") < F.col("hood_ppsf") * F.col("sqft") * F.lit(0.95)) & (F.col("is_multi_offer_by_dom") == 1)))
    x = x.withColumns({"likely_multi_offer": F.greatest("is_multi_offer_by_dom", "is_underpriced_for_bidding"), "hotness": 1 - F.col("_sum").cast("double") / F.col("comp_count_in_neighborhood") / F.col("max_ppsf")})
    logic = F.col("hotness") * 0.4 + F.col("likely_multi_offer") * 0.3 + (1 - F.col("age") / 100.0) * 0.3
    plain = ["mls_number", "bedrooms", "bathrooms", "sqft", "age", "price_diff", "recency_weight", "likely_multi_offer", "is_multi_offer_by_dom", "is_not_multi_offer_by_dom", "is_underpriced_for_bidding", "comp_count_in_neighborhood", "house_type", "garage_type", "season", "neighborhood", "style"]
    made = {"list_price": ("capped_list", 2), "over_asking_pct": ("over_asking_pct", 4), "price_per_sqft": ("price_per_sqft", 2), "neighborhood_hotness": ("hotness", 3), "neighborhood_ppsf_premium": (F.col("hood_ppsf") / F.col("city_ppsf"), 3), "sold_price": ("capped_sold", 2)}
    boost = F.coalesce(F.try_element_at(literal_map(SEASON_BOOST), "season"), F.lit(1.0))
    out = x.select(*plain, *[rdp(c, n).alias(name) for name, (c, n) in made.items()], rdp(logic, 3).alias("realtor_logic"), rdp(boost, 2).alias("season_boost"), one(F.col("neighborhood").isin(*HOT_AREAS)).alias("is_hot_area"))
    return out.dropna(subset=[c for c in out.columns if c != "mls_number"])


def benchmark_rows(rows: DataFrame) -> DataFrame:
    """Rows that the benchmark may use: positive prices and size and a date; age, month of sale, a null lot size where there is none, Unknown for null categories."""
    x = rows.where("sold_price > 0 and list_price > 0 and sqft > 0 and sold_date is not null")
    x = x.withColumns({"age": F.when(F.col("built_year").isNotNull(), F.greatest(F.lit(0), F.year("sold_date") - F.col("built_year"))), "sold_month": F.month("sold_date")})
    if "lot_size" not in rows.columns:
        x = x.withColumn("lot_size", F.lit(None).cast("double"))
    return x.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("Unknown")) for c in CATEGORIES if c in rows.columns})


def chronological_split(rows: DataFrame, train: float = 0.70, val: float = 0.15) -> DataFrame:
    """rows with split: by position in (sold_date, number) order; an address of an earlier split leaves a later one.

    Positions come from counts by day and ranks within the day, so no window spans the table.
    """
    days = rows.groupBy("sold_date").agg(F.count(F.lit(1)).alias("_n"))
    before = days.select("sold_date", (F.sum("_n").over(Window.orderBy("sold_date")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("_all"))
    x = rows.join(before, "sold_date").withColumn("_at", F.col("_before") + F.row_number().over(Window.partitionBy("sold_date").orderBy("mls_number")))
    a, b = F.floor(F.col("_all") * train), F.floor(F.col("_all") * (train + val))
    x = x.withColumn("split", F.when(F.col("_at") <= a, 0).when(F.col("_at") <= b, 1).otherwise(2))
    first = x.groupBy("address").agg(F.min("split").alias("_first"))
    x = x.join(first, x.address.eqNullSafe(first.address)).drop(first.address).where("split = _first")
    return x.withColumn("split", F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), F.col("split") + 1)).drop("_before", "_all", "_at", "_first")


def baselines(split: DataFrame) -> DataFrame:
    """Test rows with the predictions of both baselines, learnt on the training and validation rows alone; of benchmark_rows(), so that no neighbourhood is null."""
    split = written(split.select("mls_number", "neighborhood", "house_type", "sqft", "sold_price", "split"))
    train = split.where("split != 'test'").select("neighborhood", F.col("sold_price").cast("double").alias("price"), (F.col("sold_price").cast("double") / F.col("sqft")).alias("ppsf"))
    whole = quantile_columns(train, {"price": F.col("price"), "ppsf": F.col("ppsf")}, {"all": 0.5}).select(F.col("price_all").alias("all_price"), F.col("ppsf_all").alias("all_ppsf"))
    hood = quantile_columns(train, {"hood": F.col("ppsf")}, {"ppsf": 0.5}, "neighborhood")
    test = split.where("split = 'test'").join(hood, "neighborhood", "left").crossJoin(F.broadcast(whole))  # one row of the whole
    return test.select("mls_number", "neighborhood", "house_type", "sqft", F.col("sold_price").cast("double").alias("actual"), F.col("all_price").alias("baseline_global_median"), (F.coalesce("hood_ppsf", "all_ppsf") * F.col("sqft")).alias("baseline_comparable_ppsf"))


def regression_metrics(rows: DataFrame, *by: str) -> DataFrame:
    """n, mae, medae, rmse, mape and r2 of (actual, predicted); sums in decimals, so that order does not matter."""
    rows = written(rows.select("actual", "predicted", *by))
    e = F.abs(F.col("predicted") - F.col("actual"))
    dec = lambda c: F.sum(c.cast("decimal(28,6)")).cast("double")
    n = F.count(F.lit(1))
    sse, sy, syy = dec(e * e), dec(F.col("actual")), dec(F.col("actual") * F.col("actual"))
    out = rows.groupBy(*by).agg(n.alias("n"), rdp(dec(e) / n, 2).alias("mae"), rdp(F.sqrt(sse / n), 2).alias("rmse"), rdp(dec(F.when(F.col("actual") > 0, e / F.col("actual"))) / F.count(F.when(F.col("actual") > 0, 1)) * 100, 2).alias("mape"), F.when(n > 1, rdp(1 - sse / (syy - sy * sy / n), 3)).alias("r2"))
    out = beside(out, quantile_columns(rows, {"e": e}, {"median": 0.5}, *by), *by)
    return out.select(*by, "n", "mae", rdp("e_median", 2).alias("medae"), "rmse", "mape", "r2")


def benchmark(split: DataFrame) -> DataFrame:
    """Both baselines' metrics on the test rows."""
    p = baselines(split)
    long = p.select("actual", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("predicted")) for m in ("baseline_global_median", "baseline_comparable_ppsf")])).alias("m")).select("actual", "m.*")
    return regression_metrics(long, "model")


def segment_errors(split: DataFrame) -> DataFrame:
    """The comparable baseline's error by four dimensions in one pass."""
    p = baselines(split).withColumn("predicted", F.col("baseline_comparable_ppsf"))
    keys = {"neighborhood": F.col("neighborhood"), "house_type": F.col("house_type"), "price_band": price_band("actual"), "sqft_band": sqft_band("sqft")}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), F.coalesce(v, F.lit("Unknown")).alias("key")) for k, v in keys.items()]))
    out = regression_metrics(p.select("actual", "predicted", each.alias("g")).select("actual", "predicted", "g.*"), "dimension", "key")
    return out.select("dimension", "key", "n", "mae", "medae", "mape")


def multi_offer_premium(rows: DataFrame) -> DataFrame:
    """Mean price of multi-offer sales over that of the others, by neighbourhood, in per cent; both kinds must occur."""
    x = rows.where("neighborhood is not null and sold_price is not null and list_price is not null and dom_days is not null")
    multi = (F.col("dom_days") <= 3) | F.coalesce(F.col("sell_list_ratio") >= 1.05, F.lit(False))
    mean = lambda c: F.sum(F.when(c, F.col("sold_price"))).cast("double") / F.count(F.when(c, 1))
    out = x.groupBy("neighborhood").agg(mean(multi).alias("a"), mean(~multi).alias("b")).where("a is not null and b is not null")
    return out.select("neighborhood", rdp("a", 2).alias("multi_price"), rdp("b", 2).alias("ontime_price"), rdp((F.col("a") / F.col("b") - 1) * 100, 1).alias("premium_pct"))


def suggested_premium(neighborhood, multi_offer: Column) -> Column:
    """The premium in per cent suggested for a neighbourhood: 0 unless several offers are likely, 5 for unknown ones."""
    return F.when(~F.coalesce(multi_offer, F.lit(False)), 0.0).otherwise(F.coalesce(F.try_element_at(literal_map(PREMIUMS), F.coalesce(neighborhood, F.lit(""))), F.lit(DEFAULT_PREMIUM)))


def basement_adjustment(basement) -> Column:
    """Dollars for a basement type; 0 for unknown ones and null."""
    return F.coalesce(F.try_element_at(literal_map(BASEMENT), F.coalesce(basement, F.lit(""))), F.lit(0))


def offer_price(rows: DataFrame, premium: DataFrame) -> DataFrame:
    """Offer from a predicted price (here the list price): premium if several offers are likely, basement adjustment, buffer."""
    x = rows.join(premium.select("neighborhood", "premium_pct"), "neighborhood", "left")
    dec = lambda v: F.lit(v).cast("decimal(18,1)")
    p = F.when(F.col("dom_days") <= 3, F.least(F.greatest(F.coalesce("premium_pct", dec(5)), dec(0)), dec(30))).otherwise(dec(0))
    offer = F.col("list_price").cast("double") * (1 + p.cast("double") / 100) + basement_adjustment(F.col("basement_type"))
    x = x.select("mls_number", p.alias("premium_used"), offer.alias("_offer"))
    return x.select("mls_number", "premium_used", rdp("_offer", 2).alias("offer"), rdp(F.greatest(F.lit(5000.0), F.least(F.abs(F.col("_offer") * 0.02), F.lit(10000.0))), 2).alias("buffer"))


def rental_income(rows: DataFrame) -> DataFrame:
    """(.., price_per_sqft, expenses, net_monthly, net_annual) from (property_type, price, sqft, rent, mortgage, tax_monthly, insurance, condo_fee): tax and insurance are needed, a condo's fee too."""
    fee = F.when(F.col("property_type") == "condo", F.col("condo_fee")).otherwise(F.lit(0).cast("decimal(12,2)"))
    expenses = F.coalesce("mortgage", F.lit(0).cast("decimal(12,2)")) + F.col("tax_monthly") + F.col("insurance") + fee
    x = rows.withColumns({"price_per_sqft": F.when(F.col("sqft") > 0, rdp(F.col("price").cast("double") / F.col("sqft"), 2)), "expenses": expenses.cast("decimal(12,2)")})
    return x.withColumn("net_monthly", (F.col("rent") - F.col("expenses")).cast("decimal(12,2)")).withColumn("net_annual", (F.col("net_monthly") * 12).cast("decimal(14,2)"))


def legacy_filled(rows: DataFrame) -> DataFrame:
    """rows in the shape of the legacy table: columns that are missing or null take their default, numbers that cannot be read are 0, whole
    ones lose their fraction, texts are cut to 255 characters. A listing date that is missing stays null, as none may be invented."""
    have = lambda c: F.col(c) if c in rows.columns else F.lit(None)
    text = {c: F.coalesce(F.substring(have(c).cast("string"), 1, LEGACY_MOST_CHARS), F.lit(v)) for c, v in LEGACY_TEXTS.items()}
    read = lambda c, v: F.when(have(c).isNull(), F.lit(float(v))).otherwise(F.coalesce(have(c).cast("string").try_cast("double"), F.lit(0.0)))
    whole = {c: read(c, v).cast("long") for c, v in LEGACY_WHOLE.items()}
    fractions = {c: read(c, v) for c, v in LEGACY_FRACTIONS.items()}
    made = text | whole | fractions | {"listing_date": have("listing_date").try_cast("date")}
    return rows.select(*[c for c in rows.columns if c not in made], *[v.alias(c) for c, v in made.items()])


def keep_last(rows: DataFrame, *keys: str, order: str = "_ord") -> DataFrame:
    """The last row of each key; nulls of a key are one group."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("_rn", last).where("_rn = 1").drop("_rn")


def dedupe_valid_mls(rows: DataFrame) -> DataFrame:
    """The last row of each number that has nine digits, as digits alone, and every row whose number has not."""
    digits = F.regexp_replace("mls_number", r"\D", "")
    valid = F.coalesce(F.length(digits) == 9, F.lit(False))
    return keep_last(rows.where(valid).withColumn("mls_number", digits), "mls_number").unionByName(rows.where(~valid))


def insert_new(rows: DataFrame, target: DataFrame, order: str = "_ord") -> DataFrame:
    """rows to insert where (address, listing_date) is unique and a conflict does nothing: the first of each key that is not in target; a null makes a key unlike any other."""
    known = rows.where("address is not null and listing_date is not null")
    fresh = known.join(target.select("address", "listing_date"), ["address", "listing_date"], "left_anti")
    first = fresh.withColumn("_rn", F.row_number().over(Window.partitionBy("address", "listing_date").orderBy(order))).where("_rn = 1").drop("_rn")
    return first.unionByName(rows.where("address is null or listing_date is null"))


def keep_last_listing(rows: DataFrame, order: str = "_ord") -> DataFrame:
    """Rows with a positive list price, the last of each (mls_number, address)."""
    return keep_last(rows, "mls_number", "address", order=order).where("list_price > 0")


def best_model(metrics: DataFrame) -> DataFrame:
    """The models by mean absolute error, the best first, with their rank."""
    return metrics.withColumn("rank", F.row_number().over(Window.orderBy("mae", "model")))  # a row per model


def modal(rows: DataFrame, key: str, value: str, order: str = "_ord") -> DataFrame:
    """(key, value, n): the commonest value of each key that is not null; of equally common ones the first seen."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    best = F.max_by(F.struct(value, "n"), F.struct(F.col("n"), -F.col("_first")))
    return counts.groupBy(key).agg(best.alias("_b")).select(key, "_b.*")


def aligned(left: DataFrame, right: DataFrame, key: str = "page", order: str = "_ord") -> DataFrame:
    """The i-th row of left beside the i-th of right within each key; the shorter side ends the pairs."""
    nth = lambda x: x.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    return nth(left).drop(order).join(nth(right).drop(order), [key, "_i"]).withColumnRenamed("_i", "position")
