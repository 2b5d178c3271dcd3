"""Tables cut from their lineage in the folder that all executors share, and files there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Narrow rows that may be broadcast once they are counted.
BROADCAST_ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset and all runs on one machine."""
    context = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if told is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(told or tempfile.mkdtemp(prefix="hearthframe-"))
    return told or context._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that lost executors lose nothing of it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if its counted rows stay under the bound; as it is otherwise."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
