"""Exact histogram of encoded lengths, whose suffix sums answer any context limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import count_docs
from .common import checkpoint


def length_histogram(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """(length, n_docs, n_tokens) for each encoded length that occurs. Null text: length 0. No documents: no rows."""
    lengths = count_docs(docs, path, pattern, text_col).withColumnRenamed("n_tokens", "length").groupBy("length")
    return lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("length").alias("n_tokens"))


def context_limits(histogram: DataFrame, block: int = 1024) -> DataFrame:
    """For each length of the histogram taken as a context limit: what lies at or under it, above it, and what is left.

    docs_within, tokens_within: documents of at most that length and their tokens; docs_over, tokens_over: the longer
    ones; tokens_truncated: all tokens when every document is cut at the limit; quantile: share of documents within.
    Sums go over blocks of lengths first, so that no window spans them all. The histogram is read twice, so it is
    cut in the shared folder and documents are encoded once.
    """
    blocked = checkpoint(histogram).withColumn("block", F.floor(F.col("length") / block))
    blocks = blocked.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("n_tokens").alias("bt"))
    over = Window.orderBy("block").rowsBetween(1, Window.unboundedFollowing)  # a row per block of lengths
    whole = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = blocks.select("block", F.coalesce(F.sum("bd").over(over), F.lit(0)).alias("ad"), F.coalesce(F.sum("bt").over(over), F.lit(0)).alias("at"), F.sum("bd").over(whole).alias("all_d"), F.sum("bt").over(whole).alias("all_t"))
    inside = Window.partitionBy("block").orderBy("length").rowsBetween(1, Window.unboundedFollowing)
    rows = blocked.join(after, "block")
    rows = rows.withColumn("docs_over", F.col("ad") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0)))
    rows = rows.withColumn("tokens_over", F.col("at") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return rows.select(
        F.col("length").alias("context_limit"), "n_docs", (F.col("all_d") - F.col("docs_over")).alias("docs_within"), (F.col("all_t") - F.col("tokens_over")).alias("tokens_within"), "docs_over", "tokens_over",
        (F.col("all_t") - F.col("tokens_over") + F.col("docs_over") * F.col("length")).alias("tokens_truncated"), ((F.col("all_d") - F.col("docs_over")) / F.col("all_d")).alias("quantile"),
    )
