"""Divergence of each source's terms from its language's, counted by DuckDB in shards of (language, term)."""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BYTES_AT_ONCE, checkpoint, small_side, string_or_empty

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"  # runs of ASCII letters and of all that is beyond ASCII
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_DOCS, SMOOTH, SCALE, TOP_TERMS = 30, 5, 1_000_000_000, 50

#: Rows that a task's partial counts may have before they are handed on, and kept terms of a shard.
HELD_ROWS, TERMS_A_SHARD = 1_000_000, 20_000

COUNT = f"""
INSERT INTO part SELECT lang, source, term, CAST(sum(n) AS BIGINT), count(*)
FROM (SELECT doc, lang, source, term, count(*) AS n
      FROM (SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM texts) GROUP BY ALL)
GROUP BY ALL"""
SUM = "SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, CAST(sum(docs) AS BIGINT) AS docs FROM part GROUP BY ALL"
KEEP = f"""
SELECT lang, term, list(source) AS sources, list(n) AS counts FROM ({SUM}) GROUP BY lang, term HAVING sum(docs) >= {{min_docs}}"""

#: One shard of a language: kept (term, sources, counts), groups (source, size), and the language's number of kept terms and of their occurrences.
#: Sources with no occurrence of a term all give it the same chance z, so a pair's sum needs only the terms that a side has.
SHARD = f"""
WITH g AS (SELECT source, size, 1 + CAST({SCALE}::HUGEINT * {SMOOTH} // nullif(size + {SMOOTH}::HUGEINT * $terms, 0) AS BIGINT) AS z FROM groups),
u AS (SELECT term, unnest(sources) AS source, unnest(counts) AS n FROM kept),
c AS (SELECT term, source, z, 1 + CAST({SCALE}::HUGEINT * (n + {SMOOTH}) // (size + {SMOOTH}::HUGEINT * $terms) AS BIGINT) AS p FROM u JOIN g USING (source)),
t AS (SELECT term, 1 + CAST({SCALE}::HUGEINT * (sum(n) + {SMOOTH}) // ($size + {SMOOTH}::HUGEINT * $terms) AS BIGINT) AS q FROM u GROUP BY term),
top AS (SELECT source, term, p - q AS value FROM c JOIN t USING (term) WHERE p > q
        QUALIFY row_number() OVER (PARTITION BY source ORDER BY p - q DESC, term) <= {TOP_TERMS}),
own AS (SELECT source, p, count(*) AS m FROM c GROUP BY ALL),
has AS (SELECT source, sum(m) AS m FROM own GROUP BY source),
pairs AS (SELECT a.source AS a, b.source AS b, a.z AS za, b.z AS zb FROM g a JOIN g b ON a.source < b.source),
one AS (SELECT a, b, sum(m * abs(p - zb)) AS v FROM pairs JOIN own ON source = a GROUP BY ALL),
two AS (SELECT a, b, sum(m * abs(p - za)) AS v FROM pairs JOIN own ON source = b GROUP BY ALL),
met AS (SELECT x.source AS a, y.source AS b, sum(abs(x.p - y.p) - abs(x.p - y.z) - abs(y.p - x.z) + abs(x.z - y.z)) AS v
        FROM c x JOIN c y ON x.term = y.term AND x.source < y.source GROUP BY ALL)
SELECT 'term' AS part, source, term AS item, value FROM top
UNION ALL
SELECT 'pair', a, b, CAST(coalesce(one.v, 0) + coalesce(two.v, 0) + coalesce(met.v, 0)
    + ((SELECT count(*) FROM kept) - coalesce(h.m, 0) - coalesce(k.m, 0)) * coalesce(abs(za - zb), 0) AS BIGINT)
FROM pairs LEFT JOIN one USING (a, b) LEFT JOIN two USING (a, b) LEFT JOIN met USING (a, b) LEFT JOIN has h ON h.source = a LEFT JOIN has k ON k.source = b"""


def _session() -> duckdb.DuckDBPyConnection:
    """DuckDB within a task: one thread, as Spark has a task for each core."""
    return duckdb.connect(config={"threads": 1, "memory_limit": "500MB"})


def _count_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with _session() as db:
        db.execute("CREATE TABLE part (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
        for batch in batches:
            batch = batch.append_column("doc", pa.array(range(batch.num_rows)))
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at)
                while part.num_rows > 1 and part.nbytes > BYTES_AT_ONCE:
                    part = part.slice(0, part.num_rows // 2)
                at += part.num_rows
                db.register("texts", pa.Table.from_batches([part]))
                db.execute(COUNT)
                db.unregister("texts")
                if db.execute("SELECT count(*) FROM part").fetchall()[0][0] > HELD_ROWS:
                    yield from db.sql(SUM).to_arrow_table().to_batches(100_000)
                    db.execute("TRUNCATE part")
        yield from db.sql(SUM).to_arrow_table().to_batches(100_000)


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, sources, counts) of the terms in at least min_docs documents of the language; docs: text, lang, source without nulls."""
    counted = docs.select("lang", "source", "text").mapInArrow(_count_texts, "lang string, source string, term string, n long, docs long")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _session() as db:
            db.execute("CREATE TABLE part (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
            held = 0
            for batch in batches:
                db.register("more", pa.Table.from_batches([batch]))
                db.execute("INSERT INTO part SELECT * FROM more")
                db.unregister("more")
                held += batch.num_rows
                if held > HELD_ROWS:  # equal keys of several tasks become one row
                    db.execute(f"CREATE OR REPLACE TABLE part AS {SUM}")
                    held = 0
            yield from db.sql(KEEP.format(min_docs=min_docs)).to_arrow_table().to_batches(50_000)

    return counted.repartition("lang", "term").mapInArrow(merge, "lang string, term string, sources array<string>, counts array<long>")


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each (lang, source) is from its language's other sources, and its 50 most over-used terms.

    docs has text, lang, source; other columns are not read. Nulls count as empty strings, each row as a document. Terms are maximal
    runs of letters, only A-Z lower-cased; a language keeps those in at least min_docs of its documents. All sums are of integers.
    A language without kept terms gives pairs of value 0; a language with one source gives none; no documents give no rows.
    Ties go to the item that is smaller by its UTF-8 bytes.

    Tasks count their texts in DuckDB, hash shards of (lang, term) merge the counts and keep terms, shards of a language's kept terms
    make partial sums of pairs and their own top terms, and Spark adds and ranks these. A shard holds at most about TERMS_A_SHARD
    terms and the language's sources, of which the result has all pairs.
    """
    docs = docs.select(*[string_or_empty(c).alias(c) for c in ("lang", "source", "text")])
    kept = checkpoint(kept_terms(docs, min_docs))
    found = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("size"))
    groups = docs.select("lang", "source").distinct().join(found, ["lang", "source"], "left").fillna(0, ["size"])
    groups = checkpoint(groups)
    terms = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    langs = groups.groupBy("lang").agg(F.sum("size").alias("all_size")).join(terms, "lang", "left").fillna(0, ["terms"])
    langs = checkpoint(langs.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("terms") / TERMS_A_SHARD)).cast("int")))
    small = small_side(langs, langs.count())
    left = kept.join(small.select("lang", "shards"), "lang").select("lang", F.pmod(F.hash("term"), "shards").alias("shard"), "term", "sources", "counts")
    right = groups.join(small, "lang").select("lang", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "source", "size", "all_size", "terms")

    def shard(_: tuple[pa.Scalar, ...], kept: pa.Table, groups: pa.Table) -> pa.Table:
        lang, size, terms = (groups.column(c)[0].as_py() for c in ("lang", "all_size", "terms"))
        with _session() as db:
            db.register("kept", kept.select(["term", "sources", "counts"]))
            db.register("groups", groups.select(["source", "size"]))
            out = db.sql(SHARD, params={"size": size, "terms": terms}).to_arrow_table()
        return out.append_column("lang", pa.array([lang] * out.num_rows, pa.string())).select(["lang", "part", "source", "item", "value"]).cast(parts)

    parts = pa.schema([("lang", pa.string()), ("part", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])
    made = checkpoint(left.groupBy("lang", "shard").cogroup(right.groupBy("lang", "shard")).applyInArrow(shard, "lang string, part string, source string, item string, value long"))
    sums = made.where("part = 'pair'").groupBy("lang", "part", "source", "item").agg(F.sum("value").alias("value"))
    both = sums.select("lang", "part", "value", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x"))
    pairs = both.select("lang", "x.source", "part", "x.item", "value")
    rows = pairs.unionByName(made.where("part = 'term'"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return rows.withColumn("rank", rank).where(f"part = 'pair' or rank <= {TOP_TERMS}").select("lang", "source", "part", "item", "value", "rank")
