"""Exact top-k by inner product in three phases with a uniform threshold.

The dimensions are cut into slices, each a list of scores. Phase 1 gathers each list's k best of each cell and scores
those vectors exactly: the k-th best is a cutoff that the answer cannot fall below. Phase 2 broadcasts it to the cells:
a score is the sum of its slices', so one that reaches the cutoff has a slice that reaches cutoff / slices; those
entries are collected. Phase 3 resolves them exactly and ranks. A cell is a block of queries and a block of vectors, both of
bounded size; all blocks meet once, dealt over the cluster, and nothing but counts reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries and vectors of a cell, about, and vectors that are scored at once within it.
QUERY_BLOCK, VECTOR_BLOCK, ROWS_AT_ONCE, EXACT_AT_ONCE = 1024, 8192, 1024, 1 << 16
FOUND = "query_key long, query_id long, vec_id long, score long"


def _by_width(table: pa.Table, key: str, vector: str) -> dict[int, tuple[np.ndarray, np.ndarray, pa.Table]]:
    """keys, matrix and rows of the table's vectors by their width."""
    out = {}
    widths = pc.list_value_length(table[vector])
    for width in pc.unique(widths).to_pylist():
        part = table.filter(pc.equal(widths, width)).combine_chunks()
        flat = part[vector].combine_chunks()
        flat = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        out[width] = (part[key].to_numpy(), flat.reshape(part.num_rows, width), part)
    return out


def _slices(width: int, slices: int) -> list[tuple[int, int]]:
    cuts = [i * width // slices for i in range(slices + 1)]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a] or [(0, width)]


def _exact(q: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The inner products of the rows i of q and j of v, some at once."""
    out = np.empty(len(i))
    for at in range(0, len(i), EXACT_AT_ONCE):
        part = slice(at, at + EXACT_AT_ONCE)
        out[part] = np.einsum("ij,ij->i", q[i[part]], v[j[part]])
    return out


def _told(query_key: list[np.ndarray], query_id: list[np.ndarray], vec_id: list[np.ndarray], score: list[np.ndarray]) -> pa.Table:
    columns = [pa.array(np.concatenate([np.zeros(0, np.int64), *[y.astype(np.int64) for y in x]])) for x in (query_key, query_id, vec_id, score)]
    return pa.table(columns, names=["query_key", "query_id", "vec_id", "score"])


def _pairs(asked: pa.Table, given: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Table, np.ndarray, np.ndarray, np.ndarray]]:
    """Query keys, queries, query rows, vector keys, vectors and vector ids of a cell, of each width that both have."""
    others = _by_width(given, "key", "vector")
    for width, (keys, q, rows) in _by_width(asked, "query_key", "query").items():
        if width in others:
            own, v, table = others[width]
            yield keys, q, rows, own, v, table["id"].to_numpy()


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, slices: int = 2) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query with every vector but its own.

    vectors, queries: (id long, vector array<long>) without nulls; a query meets vectors of its width only, 0 too. Equal
    scores: smaller id first; rows that repeat are ranked each. Rows equal in id and vector are one query and no candidates
    of it; other rows of a query's id are queries of their own, each with its ranks, and candidates like all others. Integer scores
    are exact while they stay under 2^53. No queries or vectors: no rows. Other columns are left out.
    """
    key = F.xxhash64(F.col("id").cast("long"), "vector")
    vectors = vectors.select(F.col("id").cast("long").alias("id"), "vector", key.alias("key"))
    asked = queries.select(F.col("id").cast("long").alias("query_id"), F.col("vector").alias("query"), key.alias("query_key")).dropDuplicates(["query_key"])
    n_rows, n_cols = (max(1, -(-x.count() // size)) for x, size in ((vectors, VECTOR_BLOCK), (asked, QUERY_BLOCK)))
    over = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = vectors.withColumn("row", (F.monotonically_increasing_id() % n_rows).cast("int")).withColumn("col", over(n_cols))

    def cells(rows: DataFrame) -> DataFrame:
        return rows.withColumn("at_col", F.pmod(F.col("query_key"), F.lit(n_cols)).cast("int")).withColumn("at_row", over(n_rows))

    def local_best(asked: pa.Table, given: pa.Table) -> pa.Table:
        out: tuple[list, list, list, list] = ([], [], [], [])
        for keys, q, rows, own, v, ids in _pairs(asked, given):
            qid = rows["query_id"].to_numpy()
            for a, b in _slices(v.shape[1], slices):
                best, at = np.full((len(keys), 0), 0.0), np.full((len(keys), 0), 0)
                for low in range(0, len(ids), ROWS_AT_ONCE):
                    part = q[:, a:b] @ v[low : low + ROWS_AT_ONCE, a:b].T
                    part = np.where(keys[:, None] == own[None, low : low + ROWS_AT_ONCE], -np.inf, part)
                    best, at = np.concatenate([best, part], axis=1), np.concatenate([at, np.broadcast_to(np.arange(low, low + part.shape[1]), part.shape)], axis=1)
                    if best.shape[1] > k:
                        top = np.argpartition(-best, k - 1, axis=1)[:, :k]
                        best, at = np.take_along_axis(best, top, axis=1), np.take_along_axis(at, top, axis=1)
                i, nth = np.nonzero(np.isfinite(best))
                j = at[i, nth]
                for x, y in zip(out, (keys[i], qid[i], ids[j], _exact(q, v, i, j)), strict=True):
                    x.append(y)
        return _told(*out)

    def sufficient(asked: pa.Table, given: pa.Table) -> pa.Table:
        out: tuple[list, list, list, list] = ([], [], [], [])
        for keys, q, rows, own_keys, v, ids in _pairs(asked, given):
            qid = rows["query_id"].to_numpy()
            floor = rows["low"].to_numpy(zero_copy_only=False).astype(np.float64)
            floor = np.where(np.isnan(floor), -np.inf, floor)[:, None]
            cuts = _slices(v.shape[1], slices)
            for low in range(0, len(ids), ROWS_AT_ONCE):
                some, own = v[low : low + ROWS_AT_ONCE], own_keys[low : low + ROWS_AT_ONCE]
                enters = np.zeros((len(keys), len(own)), bool)
                for a, b in cuts:
                    enters |= q[:, a:b] @ some[:, a:b].T >= np.floor(floor / len(cuts))
                i, j = np.nonzero(enters & (keys[:, None] != own[None, :]))
                score = _exact(q, some, i, j)
                kept = score >= floor[i, 0]
                for x, y in zip(out, (keys[i[kept]], qid[i[kept]], ids[low + j[kept]], score[kept]), strict=True):
                    x.append(y)
        return _told(*out)

    order = Window.partitionBy("query_key", "query_id").orderBy(F.desc("score"), "vec_id")
    gathered = cells(asked).groupBy("at_row", "at_col").cogroup(dealt.groupBy("row", "col")).applyInArrow(lambda a, b: local_best(a, b), FOUND).distinct()
    cut = gathered.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query_key", F.col("score").alias("low"))
    found = cells(asked.join(cut, "query_key", "left")).groupBy("at_row", "at_col").cogroup(dealt.groupBy("row", "col")).applyInArrow(lambda a, b: sufficient(a, b), FOUND)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def quantized(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(id, vector array<long>): floor(scale * x) of each component; rows with nulls, NaN or infinities take no part."""
    good = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return table.where(good).select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale)).alias("vector"))
