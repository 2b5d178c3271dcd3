"""Manifest directories arriving as files: each batch fingerprint is loaded once, whenever and however often it arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import small_side
from ..operators.commits import Overtaken, Store
from ..operators.storage import exists


def load_landing(spark: SparkSession, landing: str, schema: str, target: str, checkpoint: str, key: str = "batch_fingerprint"):
    """A started query that appends the rows of fingerprints not yet in target; available files, then it ends."""

    def load(batch: DataFrame, _: int) -> None:
        numbered = F.col("mls_number").isNotNull()
        fresh = batch.where(numbered).dropDuplicates([key, "mls_number"]).unionByName(batch.where(~numbered)).persist()
        if exists(spark, target):  # a folder for each fingerprint, so that only those of this batch are listed
            asked = fresh.select(key).distinct()
            known = spark.read.parquet(target).select(key).join(small_side(asked, asked.count()), key, "left_semi").distinct()
            fresh.join(known, key, "left_anti").write.mode("append").partitionBy(key).parquet(target)
        else:
            fresh.write.mode("append").partitionBy(key).parquet(target)
        fresh.unpersist()

    stream = spark.readStream.schema(schema).option("header", True).csv(landing)
    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load_landing_into(store: Store, table: str, landing: str, schema: str, checkpoint: str, key: str = "batch_fingerprint"):
    """A started query that appends to a table of the store the rows of fingerprints that it lacks, a commit a micro-batch; available files, then it ends.

    A micro-batch that runs again after a loss finds its fingerprints there and adds nothing; one that another writer overtakes looks again.
    Of rows with one number and fingerprint one is loaded; rows without a number are all loaded.
    """

    def load(batch: DataFrame, _: int) -> None:
        numbered = F.col("mls_number").isNotNull()
        fresh = batch.where(numbered).dropDuplicates([key, "mls_number"]).unionByName(batch.where(~numbered))
        while True:
            now = store.at()
            rows = fresh
            if table in now.tables:
                asked = fresh.select(key).distinct()
                known = store.read(table, now.version).select(key).join(small_side(asked, asked.count()), key, "left_semi").distinct()
                rows = fresh.join(known, key, "left_anti").select(*fresh.columns)
            if rows.isEmpty():
                return
            try:
                store.commit(appends={table: rows}, read_at=now, notes={"what": "landing"})
                return
            except Overtaken:
                continue

    stream = store.spark.readStream.schema(schema).option("header", True).csv(landing)
    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
