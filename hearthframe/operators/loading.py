"""Batches from report pages to canonical sales: one call imports a batch to files, one commit loads it, one promotes it."""

from __future__ import annotations

import json
from datetime import datetime
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import written
from . import ingestion
from .commits import Overtaken, Store, numbered
from .storage import COLUMNS, ENUMS, Refused, stored_rows

#: Files whose bytes Spark can hold in one row.
MOST_BYTES = (1 << 31) - 1
CRITICAL = ("SOLD_DATE_CONFLICT", "SOLD_PRICE_CONFLICT", "DUPLICATE_MLS")


def file_digests(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, length, sha256 in lowercase hex) of every file at or under the paths; refused by name if one is larger than a row can hold."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    large = [x.path for x in files.select("path", "length").where(F.col("length") > MOST_BYTES).take(5)]  # lengths alone read no file
    if large:
        raise Refused(f"files of more than {MOST_BYTES} bytes: {large}")
    found = files.select("path", "length", F.sha2("content", 256).alias("sha256"))
    listed = spark.createDataFrame([(unquote(p),) for p in files.inputFiles()], "path string")  # Spark reads no row of a file without bytes
    told = listed.select(F.regexp_replace("path", "^file:/+", "/").alias("path")).join(found.withColumn("path", F.regexp_replace("path", "^file:/+", "/")), "path", "left")
    return told.select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), F.coalesce("length", F.lit(0)).alias("length"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("sha256"))


def batch_name(single_sha: Column, full_sha: Column, at: datetime) -> Column:
    """The time and the first 12 hex digits of the digest of both files' digests."""
    return F.concat(F.lit(at.strftime("%Y%m%dT%H%M%S_")), F.substring(F.sha2(F.concat(single_sha, full_sha), 256), 1, 12))


def import_batch(single: DataFrame, full: DataFrame, sources: dict[str, tuple[str, str]], folder: str, at: datetime, parser_version: str, today: str, min_match_rate: float = 1.0) -> dict:
    """Writes a batch's records and files under folder, with summary.json, and returns the summary.

    single, full: positioned fragments (file, page_number, y, x0, x1, text) of the two reports; sources: report to (file name, sha256).
    The records are written once, and that pass makes the counts; accepted, rejected, conflicts, warnings and diagnostics are
    CSV folders with headers. critical_reconciliation_failed tells whether the batch may be loaded.
    """
    spark = single.sparkSession
    rows = ingestion.visual_rows(ingestion.cleaned_fragments(single))
    s, f = written(ingestion.single_line_records(single)), written(ingestion.client_full_records(full))
    order = F.struct("file", "page_number").alias("_ord")
    a = s.select(*[c for c in s.columns if c not in ("file", "page_number", "row_number", "status")], F.struct("file", "page_number", "row_number").alias("_ord") if "row_number" in s.columns else order)
    b = f.select(*[c for c in f.columns if c not in ("file", "page_number", "status")], order)
    records = ingestion.validate(ingestion.reconcile(a, b), today)
    seen = Observation()
    records.observe(seen, *ingestion.summary_counts(), F.sum(F.size("issues")).alias("_issues")).write.mode("overwrite").parquet(f"{folder}/records")
    counts = seen.get
    records = spark.read.parquet(f"{folder}/records")
    issues = ingestion.issue_rows(records)
    critical = F.col("reason_code").isin(*CRITICAL)
    csv = lambda x, name: x.write.mode("overwrite").csv(f"{folder}/{name}", header=True, escape='"')
    plain = [c for c in records.columns if c not in ("issues", "_s", "_f", "status")]
    csv(records.where("status = 'accepted'").select(*plain), "accepted.csv")
    csv(records.where("status = 'rejected'").select(*plain, F.array_join(ingestion.codes(), "|").alias("issue_codes")), "rejected.csv")
    told = Observation()
    out = issues.select("mls_number", F.col("reason_code").alias("code"), F.col("field_name").alias("field"), F.col("message").alias("detail"), critical.alias("_critical"))
    out = written(out.observe(told, F.sum(F.col("_critical").cast("int")).alias("critical"), F.count(F.lit(1)).alias("all")))
    csv(out.where("_critical").drop("_critical"), "conflicts.csv")
    csv(out.where("not _critical").drop("_critical"), "warnings.csv")
    diagnostics = ingestion.page_diagnostics(single, s, "single_line", ingestion.header_rows(rows)).unionByName(ingestion.page_diagnostics(full, f, "client_full"))
    paged = Observation()
    of = lambda c: F.sum(F.when(c, 1).otherwise(0))
    csv(diagnostics.observe(paged, *[of(F.col("report_type") == r).alias(r) for r in ("single_line", "client_full")], of(F.col("status") == "needs_ocr").alias("needs_ocr")), "extraction_diagnostics.csv")
    number = lambda x: int(x or 0)
    conflicts = number(told.get["critical"])
    rate = number(counts["matched"]) / max(number(counts["_full"]), 1)
    failed = number(counts["single_only"]) > 0 or number(counts["full_only"]) > 0 or number(counts["duplicates"]) > 0 or conflicts > 0 or rate < min_match_rate
    accepted = records.where("status = 'accepted'")
    ends = accepted.agg(F.min("sold_date").alias("a"), F.max("sold_date").alias("b"), F.countDistinct(F.nullif("neighbourhood", F.lit(""))).alias("n")).first()
    name = spark.range(1).select(batch_name(F.lit(sources["single_line"][1]), F.lit(sources["client_full"][1]), at)).first()[0]
    summary = {
        "batch_id": name, "contract_version": ingestion.CONTRACT_VERSIONS[0], "parser_version": parser_version, "sources": {k: {"file": v[0], "sha256": v[1]} for k, v in sources.items()},
        "reconciliation": {k: number(counts[k]) for k in ("matched", "single_only", "full_only", "duplicates")}, "match_rate_vs_client_full": round(rate, 4),
        "accepted": number(counts["accepted"]), "rejected": number(counts["rejected"]), "conflicts": conflicts, "warnings": number(told.get["all"]) - conflicts,
        "sold_date_range": [str(ends.a), str(ends.b)] if ends.a else None, "neighbourhood_count": ends.n,
        "pages": {k: number(paged.get[k]) for k in ("single_line", "client_full", "needs_ocr")}, "critical_reconciliation_failed": failed,
    }
    put_text(spark, f"{folder}/summary.json", json.dumps(summary, indent=2))
    return summary


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file on any file system that Spark reaches, in place of what was there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


class NotFound(LookupError):
    """No batch of that id."""


def find_batch(store: Store, batch_id: int | None = None, batch_uuid: str | None = None) -> DataFrame:
    """The import batch of an id, else of a uuid, as a table of one row; NotFound if there is none, ValueError if neither is told."""
    if batch_id is None and batch_uuid is None:
        raise ValueError("a batch is told by batch_id or batch_uuid")
    found = store.read("import_batches") if store.has("import_batches") else None
    if found is not None:
        found = found.where(F.col("id") == batch_id if batch_id is not None else F.col("batch_uuid") == batch_uuid)
    if found is None or found.isEmpty():
        raise NotFound(f"batch {batch_id if batch_id is not None else batch_uuid} not found")
    return found


def known_fingerprints(store: Store, plan: DataFrame) -> DataFrame:
    """The rows of plan whose batch_fingerprint is loaded already."""
    return plan.join(store.read("import_batches").select("batch_fingerprint").distinct(), "batch_fingerprint", "left_semi") if store.has("import_batches") else plan.limit(0)


def with_staging_ids(issues: DataFrame, staged: DataFrame) -> DataFrame:
    """issues (batch_id, mls_number, ..) with staging_sale_id, the id of the staged row of their number and batch; null if there is none."""
    ids = staged.select("batch_id", "mls_number", F.col("id").alias("staging_sale_id"))
    return issues.join(ids, ["batch_id", "mls_number"], "left").select(*issues.columns, "staging_sale_id")


def load_batches(store: Store, plan: DataFrame, staged: DataFrame, issues: DataFrame, authorized: bool = False) -> DataFrame:
    """Loads the batches of a plan in one commit; (batch_key, outcome, batch_id, staged_rows, issue_rows) of each.

    plan: batch_key, batch_fingerprint (unique), safe_to_write and columns of import_batches; staged: batch_key and columns of staging_sales;
    issues: batch_key, mls_number, severity, reason_code and others. outcome: refused (not safe), duplicate (its fingerprint is loaded, or comes before in
    the plan), else the status that it has after the load, review_required where an issue other than a conflict is unresolved, or staged. Ids follow
    the tables' largest ones, rows in order of their numbers. Without `authorized` nothing is written and no id is given. A writer that
    overtakes makes the whole load be planned anew; a failure leaves nothing to see. What is given is computed once, of staged only what is stored.
    """
    stored_rows(staged.limit(0), "staging_sales")  # names alone, before anything is written
    plan, issues = written(plan), written(issues)
    staged = written(staged.join(plan.where("safe_to_write").select("batch_key").distinct(), "batch_key", "left_semi").select("batch_key", *[c for c in staged.columns if c in COLUMNS["staging_sales"] and c != "batch_id"]))
    if not issues.where(~F.col("severity").isin(*ENUMS["import_issues", "severity"]) | F.col("severity").isNull()).isEmpty():
        raise Refused("unknown issue severity")
    while True:
        now = store.at()
        known = store.read("import_batches", now.version).select("batch_fingerprint") if "import_batches" in now.tables else plan.select("batch_fingerprint").limit(0)
        first = plan.where("safe_to_write").groupBy("batch_fingerprint").agg(F.min("batch_key").alias("_first"))
        x = plan.join(known.distinct().withColumn("_known", F.lit(True)), "batch_fingerprint", "left").join(first, "batch_fingerprint", "left")
        x = written(x.withColumn("_why", F.when(~F.col("safe_to_write"), "refused").when(F.col("_known") | (F.col("batch_key") != F.col("_first")), "duplicate")))
        fresh = x.where("_why is null").drop("_why", "_known", "_first", "safe_to_write")
        top = lambda t: (store.read(t, now.version).agg(F.max("id")).first()[0] or 0) + 1 if t in now.tables else 1
        fresh = numbered(fresh.orderBy("batch_fingerprint"), "id", top("import_batches")) if authorized else written(fresh.withColumn("id", F.lit(None).cast("long")))
        ids = fresh.select("batch_key", F.col("id").alias("batch_id"))
        rows = staged.join(ids, "batch_key")
        twice = rows.groupBy("batch_key", "mls_number").count().where("count > 1")
        if not twice.isEmpty():
            raise Refused(f"duplicate number within a batch: {twice.count()} numbers")
        keyed = stored_rows(rows.drop("batch_key"), "staging_sales")
        told = issues.join(ids, "batch_key").withColumn("resolved", F.lit(False))
        unresolved = told.where("severity != 'conflict'").select("batch_key").distinct().withColumn("_open", F.lit(True))
        status = fresh.join(unresolved, "batch_key", "left").withColumn("status", F.when(F.col("_open"), "review_required").otherwise("staged")).drop("_open")
        per = lambda t, n: t.groupBy("batch_key").agg(F.count(F.lit(1)).alias(n))
        result = x.select("batch_key", "_why").join(status.select("batch_key", "status", "id"), "batch_key", "left").join(per(rows, "staged_rows"), "batch_key", "left").join(per(told, "issue_rows"), "batch_key", "left")
        result = written(result.select("batch_key", F.coalesce("_why", "status").alias("outcome"), F.col("id").alias("batch_id"), F.coalesce("staged_rows", F.lit(0)).alias("staged_rows"), F.coalesce("issue_rows", F.lit(0)).alias("issue_rows")))
        if not authorized or fresh.isEmpty():
            return result
        kept = numbered(keyed.orderBy("batch_id", "mls_number"), "id", top("staging_sales"))
        told = numbered(told.drop("batch_key").orderBy("batch_id", "mls_number", "severity", "reason_code"), "id", top("import_issues"))
        linked = with_staging_ids(told, kept)
        try:
            store.commit(appends={"import_batches": status.drop("batch_key"), "staging_sales": kept, "import_issues": linked}, read_at=now, notes={"what": "load"})
            return result
        except Overtaken:
            continue


def promote_batches(store: Store, batch_ids: DataFrame, approved_by: str = "", authorized: bool = False) -> DataFrame:
    """Promotes the batches (batch_id) that pass their gates to canonical_sales, in one commit; the gates of each batch as promotion_gate() tells them.

    Running it again changes nothing: rows that are canonical with the same fingerprint are skipped. A batch with a canonical
    conflict gets an issue for each and no row. Two batches of one call with one number: that of the smaller id goes first, and
    the other waits for the next call, which sees what is canonical then.
    """
    while True:
        now = store.at()
        read = lambda t: store.read(t, now.version)
        staged = read("staging_sales").join(batch_ids, "batch_id", "left_semi")
        empty = staged.limit(0).select(*[c for c in staged.columns if c not in ("id", "batch_id", "validation_status", "source_single_line_page", "source_client_full_page")], F.col("batch_id").alias("source_batch_id"), F.lit("").alias("data_quality_status"), "id")
        canonical = read("canonical_sales") if "canonical_sales" in now.tables else empty
        plan = written(ingestion.promotion(staged, canonical))
        batches = read("import_batches").withColumnRenamed("id", "batch_id").join(batch_ids, "batch_id", "left_semi")
        gate = written(ingestion.promotion_gate(plan, batches.select("batch_id", "status", "accepted_count"), read("import_issues")))
        able = gate.where("promotable").select("batch_id")
        wanted = plan.where("action = 'insert'").join(able, "batch_id", "left_semi")
        first = wanted.groupBy("mls_number").agg(F.min("batch_id").alias("_first"), F.max("batch_id").alias("_last")).where("_first != _last")
        later = wanted.join(first, "mls_number").where("batch_id != _first").select("batch_id").distinct()
        gate = written(gate.join(later.withColumn("_later", F.lit(True)), "batch_id", "left").withColumns({"blocked_by": F.when(F.col("_later"), "number of another batch").otherwise(F.col("blocked_by")), "promotable": F.col("promotable") & F.col("_later").isNull()}).drop("_later"))
        if not authorized:
            return gate
        new = plan.where("action = 'insert'").join(gate.where("promotable").select("batch_id"), "batch_id", "left_semi").withColumnRenamed("batch_id", "source_batch_id").withColumn("data_quality_status", F.lit("approved"))
        new = stored_rows(new.drop("id", "action"), "canonical_sales")
        top = canonical.agg(F.max("id")).first()[0] or 0
        after, told = ingestion.promotion_outcome(plan, read("import_batches").withColumnRenamed("id", "batch_id"), gate)
        after = after.withColumnRenamed("batch_id", "id")
        if approved_by:
            done = gate.where("promotable").select(F.col("batch_id").alias("id"), F.lit(approved_by).alias("_by"))
            old = F.col("approved_by") if "approved_by" in after.columns else F.lit(None).cast("string")
            after = after.join(done, "id", "left").withColumn("approved_by", F.coalesce("_by", old)).drop("_by")
        told = told.withColumns({"resolved": F.lit(False), "staging_sale_id": F.lit(None).cast("long")})
        issue_top = read("import_issues").agg(F.max("id")).first()[0] or 0
        changes = {"canonical_sales": numbered(new.orderBy("mls_number"), "id", top + 1), "import_issues": numbered(told.orderBy("batch_id", "mls_number"), "id", issue_top + 1)}
        changes = {k: v for k, v in changes.items() if not v.isEmpty()}
        if not changes and gate.where("promotable").isEmpty():
            return gate
        try:
            store.commit(appends=changes, replaces={"import_batches": after}, read_at=now, notes={"what": "promotion"})
            return gate
        except Overtaken:
            continue
