"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a target of words; complete epochs of the source come first, and what is left of the target is drawn
without replacement by exponential keys -ln(u) / weight: documents in the order of their keys, until their summed sizes
reach the budget. Sorting and prefix sums go over ranges of keys, so that a source of any size spans many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, small_side

#: Rows of a source that one range of keys holds, about; bins of keys for each power of e, of which ranges are made.
RANGE_ROWS, BINS = 20_000, 1_000


def uniform(text: Column) -> Column:
    """A number in (0, 1) that depends on the string alone."""
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, size): weights repeat over the sources in order, null last.

    target = least(most * source_size, level * weight); the level at which the targets add up to share of all sizes is
    found by sums over the sources sorted by most * source_size / weight: those under the level are at their most.
    """
    totals = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = totals.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")))
    ranked = ranked.withColumns({"cap": F.lit(most) * F.col("source_size"), "ratio": F.lit(most) * F.col("source_size") / F.col("w")})
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    levels = ranked.withColumns(
        {"caps": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "left": F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)), "all": F.lit(share) * F.sum("source_size").over(whole)}
    ).withColumn("level", (F.col("all") - F.col("caps")) / F.col("left"))
    # the level is that of the first source, in this order, which it does not lift to its most
    level = F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "level"))).over(whole)
    level = F.coalesce(level["level"], F.max("ratio").over(whole))
    return levels.withColumn("level", level).select("source", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def mix(docs: DataFrame, targets: DataFrame, id_col: str = "id") -> DataFrame:
    """docs (id, source, size, weight, u) with source_size, target and taken, the words the mix takes of each.

    epochs = floor(target / source_size) whole copies, then the document's share of the rest: all of it while the prefix
    sum by key stays under the rest, the words up to it for the one that crosses, none after. u: uniform in (0, 1). Rows of
    equal key follow each other by id and size; rows equal in these too (repeated ones) in any order, as they differ in
    nothing. Weights at or below 0 or null count as least. Columns of docs with the name of an added one are replaced,
    others pass through. No rows: none.

    Prefix sums go over ranges of keys: bins of the keys' logarithms are counted first, and cut into ranges of about
    equal numbers of rows, so that no task gets a source, nor the low weights of one, as a whole.
    """
    added = ("source_size", "target", "taken")
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added and not c.startswith("__")])
    kept = [F.col(f"`{c}`") for c in rows.columns]
    key = -F.log(F.col("u")) / F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(1e-6))
    rows = rows.withColumns({"__key": key, "__bin": F.floor(F.log(key) * BINS)})

    bins = rows.groupBy(F.col("source").alias("__s"), F.col("__bin").alias("__b")).agg(F.count(F.lit(1)).alias("__n"), F.sum("size").alias("__sum"))
    up_to = Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # some ten thousand bins a source at most
    bins = bins.withColumns({"__range": F.floor(F.coalesce(F.sum("__n").over(up_to), F.lit(0)) / RANGE_ROWS), "__low": F.coalesce(F.sum("__sum").over(up_to), F.lit(0))})
    bins = bins.withColumn("__before", F.min("__low").over(Window.partitionBy("__s", "__range")))
    wanted = targets.select(F.col("source").alias("__t"), "source_size", "target")
    bins = bins.join(wanted, F.col("__s").eqNullSafe(F.col("__t")), "left")
    bins = checkpoint(bins.select("__s", "__b", "__range", "__before", "source_size", "target"))

    same = F.col("source").eqNullSafe(F.col("__s")) & (F.col("__bin") == F.col("__b"))
    rows = rows.join(small_side(bins, bins.count()), same)
    inside = Window.partitionBy("source", "__range").orderBy("__key", id_col, "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("__before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.floor(F.col("target") - epochs * F.col("source_size"))
    taken = (epochs * F.col("size") + F.least(F.col("size"), F.greatest(rest - before, F.lit(0)))).cast("long")
    return rows.withColumn("taken", taken).select(*kept, *added)


def document_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, weight, u): words between white space; the weight is the share of letters among what is
    written; u depends on the id, or on the text where that is null.

    Null text: size 0, least weight. Null and repeated ids stay rows of their own. The narrow table is cut in the shared
    folder, as several passes read it.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")).cast("long")
    written = F.length(F.translate(text, " \t\n\x0b\f\r", ""))
    odd = written - F.length(F.translate(text, "0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~ \t\n\x0b\f\r", ""))
    weight = F.when(written > 0, 1 - odd / written).otherwise(0.0)
    u = uniform(F.coalesce(F.col(id_col).cast("string"), F.md5(text)))
    return checkpoint(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), F.greatest(weight, F.lit(0.05)).alias("weight"), u.alias("u")))
