"""Pieces that several corpus operators share: shared-folder checkpoints, size-checked broadcasts, components."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

NO_ID = (1 << 63) - 1  # stands for a null id; such rows own nothing that a row with an id also has
BROADCAST_ROWS = 500_000  # narrow rows (at most some tens of bytes) that may be broadcast once counted


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; a temporary one only where that is unset and all runs on one machine."""
    context = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if told is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(told or tempfile.mkdtemp(prefix="hearthframe-"))
    return told or context._jsc.sc().getCheckpointDir().get()


def remove_folder(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Partitions that a table may have whatever its size, and rows that one holds at least beyond them.
FEW_PARTS, ROWS_A_PART = 16, 20_000


def checkpoint(df: DataFrame) -> DataFrame:
    """df with its lineage cut in the shared folder, in no more partitions than its counted rows are worth.

    Each shuffle of a small table in many partitions writes a file per partition; many such shuffles fill a disk.
    """
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    parts = out._jdf.queryExecution().toRdd().getNumPartitions()
    if parts <= FEW_PARTS:
        return out
    wanted = max(FEW_PARTS, out.count() // ROWS_A_PART)
    return out.coalesce(wanted) if wanted < parts else out


#: Rows whose texts are Python objects at once, and characters at which fewer are.
ROWS_AT_ONCE, BYTES_AT_ONCE = 2_000, 8 << 20


def map_texts(docs: DataFrame, text_col: str, added: str, compute: Callable[[Iterator[str | None]], dict[str, pa.Array]], keep: bool = True) -> DataFrame:
    """docs with the columns `added` (DDL), which compute() makes from some rows' texts at once.

    Batches stay Arrow's, so that ids and all other columns pass through exactly as they are, nulls among 64-bit
    numbers too. Columns of docs with the name of an added one are replaced. keep=False leaves the text out.
    """
    extra = StructType.fromDDL(added)
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c == text_col or c not in extra.names])
    passed = [c for c in rows.columns if c not in extra.names and (keep or c != text_col)]
    if text_col not in passed or dict(rows.dtypes)[text_col] != "string":
        rows = rows.select(*[F.col(f"`{c}`") for c in passed], F.col(f"`{text_col}`").cast("string").alias("_text"))
        text_col = "_text"
    kept = rows.select(*[F.col(f"`{c}`") for c in passed]).schema.fields
    schema = StructType([*kept, *extra.fields])
    made = to_arrow_schema(extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, ROWS_AT_ONCE)
                while part.num_rows > 1 and part.column(text_col).nbytes > BYTES_AT_ONCE:
                    part = part.slice(0, part.num_rows // 2)
                at += part.num_rows
                new = compute(x.as_py() for x in part.column(text_col))
                columns = [part.column(c) for c in passed] + [new[f.name].cast(f.type) for f in made]
                yield pa.RecordBatch.from_arrays(columns, names=[*passed, *made.names])

    return rows.mapInArrow(run, schema)


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if its counted rows stay under the bound; as it is otherwise."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def id_key(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def string_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the least node of node's connected component. edges: (u, v) of any ordered type.

    In a round each node points at the least of itself and its neighbours, pointers are followed once more, and the edges are
    contracted to what the pointers tell: those within one node go, so each round has fewer. Each is cut in the shared folder, and
    no edge reaches the driver.
    """
    both = checkpoint(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = None
    while True:
        up = checkpoint(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("at"), F.least("u", "m").alias("to")))
        again = up.select(F.col("at").alias("to"), F.col("to").alias("next"))
        up = checkpoint(up.join(again, "to").select("at", F.col("next").alias("to")))
        if labels is None:
            labels = up.select(F.col("at").alias("node"), F.col("to").alias("label"))
        else:
            moved = up.select(F.col("at").alias("label"), "to")
            labels = checkpoint(labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")))
        left, right = (up.select(F.col("at").alias(c), F.col("to").alias(f"{c}_to")) for c in ("u", "v"))
        both = checkpoint(both.join(left, "u").join(right, "v").where("u_to != v_to").select(F.col("u_to").alias("u"), F.col("v_to").alias("v")).distinct())
        if both.isEmpty():
            return labels
