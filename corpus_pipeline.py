"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthframe.llm import bpe, line_dedup, mixing, order_minhash, queries, toxicity
from hearthframe.llm.common import id_key, read, remove_folder, shared_folder


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of a toxic grade reaches the threshold go."""
    model = toxicity.fit(docs.select("doc_id", "text"), queries.graded_labels(spark, sf_dir), 1)
    return toxicity.score(docs, model).where(F.col("p_toxic") < toxicity.REJECT).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that near-equal ones precede go; so do documents that had text and have none left."""
    out = line_dedup.line_dedup(docs.withColumn("_had", F.length("text") > 0))
    return out.where("not (coalesce(_had, false) and text = '')").withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return order_minhash.without_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it whole, and once more if it takes half of it or more besides."""
    sizes = mixing.document_sizes(docs)
    taken = mixing.mix(sizes, mixing.source_targets(sizes))
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + F.lit(0.5))).otherwise(1).cast("int")
    taken = taken.groupBy(id_key("id").alias("_k")).agg(F.max(copies).alias("_copies"))
    out = docs.withColumn("_k", id_key("doc_id")).join(taken, "_k").where("_copies > 0")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, with digests of them and of what they decode to."""
    return bpe.encode_docs(docs, public_tokenizers.path(queries.VOCABULARY), public_tokenizers.PATTERN, ids=True).drop("text")


STAGES = [("toxicity", toxicity_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("mixing", mixing_stage), ("byte_bpe", bpe_stage)]

#: Fitted models, edit joins and byte-level merges are beyond SQL; tests/llm/test_pipeline.py holds the stages against plainer versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them is written under spark.checkpoint.dir, and goes once the next stage is written.

    The last stage reads its predecessor's table when the result is asked for, so that one stays.
    """
    docs, folder, before = read(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            remove_folder(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
