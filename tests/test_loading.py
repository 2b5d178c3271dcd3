"""Commits over several tables, batches from pages to canonical sales, digests of files, names that are never stored."""

import hashlib
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hearthframe.operators import loading, storage
from hearthframe.operators.commits import Commit, Overtaken, Store, numbered

T1 = "k int, v string"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), T1)


def test_a_commit_shows_all_tables_or_none(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.at() == Commit() and not store.has("a")
    store.commit(appends={"a": rows(spark, (1, "x")), "b": rows(spark, (1, "y"))})
    broken = rows(spark, (2, "z")).withColumn("v", F.when(F.col("k") == 2, F.raise_error(F.lit("lost"))).otherwise("q"))
    with pytest.raises(Exception, match="lost"):
        store.commit(appends={"a": rows(spark, (2, "z")), "b": broken})
    assert store.at().version == 1 and store.read("a").count() == store.read("b").count() == 1  # what the lost job wrote to a is not seen
    store.commit(appends={"a": rows(spark, (3, "w"))}, replaces={"b": rows(spark, (9, "n"), (8, "m"))}, notes={"by": "me"})
    assert {r.k for r in store.read("a").collect()} == {1, 3} and {r.k for r in store.read("b").collect()} == {8, 9}
    assert {r.k for r in store.read("b", 1).collect()} == {1} and store.at(2).notes == {"by": "me"}
    gone = store.vacuum()
    assert len(gone) == 3 and {r.k for r in store.read("a").collect()} == {1, 3}  # the lost folders and the replaced one


def test_an_overtaken_writer_notices(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    seen = store.commit(appends={"a": rows(spark, (1, "x"))})
    store.commit(appends={"a": rows(spark, (2, "y"))})
    with pytest.raises(Overtaken):
        store.commit(replaces={"a": rows(spark)}, read_at=seen)
    store.commit(appends={"b": rows(spark, (5, "b"))}, read_at=seen)  # looks at another table alone
    assert store.read("a").count() == 2 and store.versions() == [1, 2, 3]
    assert not store._put(Commit(3, {}, {}))  # a number is given once
    assert store.at(3).tables


def test_append_once_tries_again_when_overtaken(spark, tmp_path, monkeypatch):
    store, other = (Store(spark, str(tmp_path / "s")) for _ in range(2))
    assert store.append_once(rows(spark, (1, "a"), (1, "a"), (2, "b"), (None, "c"), (None, "c")), "t", "k") == 4
    whole, once = store.commit, []

    def late(**more):
        if not once:
            once.append(1)
            other.commit(appends={"t": rows(spark, (3, "first"))})
        return whole(**more)

    monkeypatch.setattr(store, "commit", late)
    assert store.append_once(rows(spark, (2, "b"), (3, "second"), (4, "d")), "t", "k") == 1
    assert sorted((r.k, r.v) for r in store.read("t").where("k > 2").collect()) == [(3, "first"), (4, "d")]


def test_columns_may_be_added_but_keep_their_types(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.commit(appends={"a": rows(spark, (1, "x"))})
    store.commit(appends={"a": rows(spark, (2, "y")).withColumn("w", F.lit(7))})
    assert sorted((r.k, r.w) for r in store.read("a").collect()) == [(1, None), (2, 7)]
    with pytest.raises(ValueError, match="column v"):
        store.commit(appends={"a": spark.createDataFrame([(1, 2)], "k int, v int")})


def test_ids_are_dense_and_follow_the_order(spark):
    got = numbered(spark.range(100).repartition(7).orderBy(F.desc("id")).withColumnRenamed("id", "x"), "id", 11).collect()
    assert sorted((r.id, r.x) for r in got) == [(11 + i, 99 - i) for i in range(100)]
    assert numbered(spark.range(0).withColumnRenamed("id", "x"), "id").count() == 0


def test_digests_equal_hashlib(spark, tmp_path, monkeypatch):
    (tmp_path / "d" / "e").mkdir(parents=True)
    for name, data in (("a.pdf", b"x" * 1000), ("e/b.pdf", b"")):
        (tmp_path / "d" / name).write_bytes(data)
    got = {r.file: (r.length, r.sha256) for r in loading.file_digests(spark, str(tmp_path / "d")).collect()}
    assert got == {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in (("a.pdf", b"x" * 1000), ("b.pdf", b""))}
    a, b = got["a.pdf"][1], got["b.pdf"][1]
    name = spark.range(1).select(loading.batch_name(F.lit(a), F.lit(b), datetime(2026, 1, 2, 3, 4, 5))).first()[0]
    assert name == "20260102T030405_" + hashlib.sha256((a + b).encode()).hexdigest()[:12]
    monkeypatch.setattr(loading, "MOST_BYTES", 10)
    with pytest.raises(storage.Refused, match="a.pdf"):
        loading.file_digests(spark, str(tmp_path / "d"))


@pytest.mark.parametrize("name", storage.NEVER_STORED)
def test_private_names_are_never_stored(spark, name):
    with pytest.raises(storage.Refused, match=name.upper()):
        storage.stored_rows(spark.range(1).withColumns({"mls_number": F.lit("1"), "record_fingerprint": F.lit("f"), name.upper(): F.lit("secret")}), "staging_sales")


def test_unknown_columns_are_dropped_and_needed_ones_demanded(spark):
    assert len(storage.NEVER_STORED) == 29
    whole = spark.range(1).withColumns({"mls_number": F.lit("1"), "record_fingerprint": F.lit("f"), "batch_id": F.lit(1), "surprise": F.lit(1), "address": F.lit("1 Elm")})
    assert storage.stored_rows(whole, "staging_sales").columns == ["batch_id", "mls_number", "address", "record_fingerprint"]
    for lacking in (whole.withColumn("mls_number", F.lit("")), whole.withColumn("record_fingerprint", F.lit(None).cast("string")), whole.drop("mls_number")):
        with pytest.raises(storage.Refused):
            storage.stored_rows(lacking, "canonical_sales")


def parts(spark):
    plan = spark.createDataFrame([("p", "fp", True, 2), ("q", "fq", True, 1), ("r", "fr", False, 1), ("s", "fp", True, 2)], "batch_key string, batch_fingerprint string, safe_to_write boolean, accepted_count int")
    sale = [("p", "200000001", "a", 1), ("p", "200000002", "b", 2), ("q", "200000002", "c", 3), ("r", "200000003", "d", 4), ("s", "200000001", "a", 1)]
    staged = spark.createDataFrame(sale, "batch_key string, mls_number string, record_fingerprint string, odd int")
    issues = spark.createDataFrame([("q", "200000002", "warning", "W"), ("p", "200000009", "conflict", "C"), ("p", "200000002", "conflict", "C")], "batch_key string, mls_number string, severity string, reason_code string")
    return plan, staged, issues


def test_load_gives_ids_links_issues_and_is_refused_twice(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    dry = {r.batch_key: r.outcome for r in loading.load_batches(store, *parts(spark)).collect()}
    assert dry == {"p": "staged", "q": "review_required", "r": "refused", "s": "duplicate"} and store.at().version == 0
    got = {r.batch_key: (r.outcome, r.batch_id, r.staged_rows, r.issue_rows) for r in loading.load_batches(store, *parts(spark), authorized=True).collect()}
    assert got == {"p": ("staged", 1, 2, 2), "q": ("review_required", 2, 1, 1), "r": ("refused", None, 0, 0), "s": ("duplicate", None, 0, 0)} and store.at().version == 1
    ids = {(r.batch_id, r.mls_number): r.id for r in store.read("staging_sales").collect()}
    assert ids == {(1, "200000001"): 1, (1, "200000002"): 2, (2, "200000002"): 3}
    assert {(r.batch_id, r.mls_number, r.staging_sale_id) for r in store.read("import_issues").collect()} == {(1, "200000009", None), (1, "200000002", 2), (2, "200000002", 3)}
    again = {r.outcome for r in loading.load_batches(store, *parts(spark), authorized=True).where("batch_key != 'r'").collect()}
    assert again == {"duplicate"} and store.at().version == 1
    bad = parts(spark)[2].withColumn("severity", F.lit("odd"))
    with pytest.raises(storage.Refused):
        loading.load_batches(store, *parts(spark)[:2], bad, authorized=True)
    twice = parts(spark)[1].union(parts(spark)[1].where("batch_key = 'q'"))
    with pytest.raises(storage.Refused):
        loading.load_batches(Store(spark, str(tmp_path / "t")), parts(spark)[0], twice, parts(spark)[2], authorized=True)


def test_promotion_is_one_commit_and_changes_nothing_twice(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    plan, staged, issues = parts(spark)
    loading.load_batches(store, plan, staged, issues.limit(0), authorized=True)
    every = spark.range(1, 3).withColumnRenamed("id", "batch_id")
    assert {r.batch_id: r.promotable for r in loading.promote_batches(store, every).collect()} == {1: True, 2: False} and not store.has("canonical_sales")
    gate = {r.batch_id: r.blocked_by for r in loading.promote_batches(store, every, "me", authorized=True).collect()}
    assert gate == {1: None, 2: "number of another batch"}
    assert {(r.id, r.mls_number, r.source_batch_id, r.data_quality_status) for r in store.read("canonical_sales").collect()} == {(1, "200000001", 1, "approved"), (2, "200000002", 1, "approved")}
    assert {(r.id, r.status, r.approved_by) for r in store.read("import_batches").collect()} == {(1, "approved", "me"), (2, "staged", None)}
    gate = {r.batch_id: r.blocked_by for r in loading.promote_batches(store, every, "me", authorized=True).collect()}
    assert gate == {1: "status", 2: "canonical conflict"}  # another fingerprint of a canonical number
    assert [(r.batch_id, r.mls_number, r.reason_code) for r in store.read("import_issues").collect()] == [(2, "200000002", "CANONICAL_FINGERPRINT_CONFLICT")]
    assert store.read("canonical_sales").count() == 2 and store.at().version == 3
    gate = {r.batch_id: r.blocked_by for r in loading.promote_batches(store, every, "me", authorized=True).collect()}
    assert gate == {1: "status", 2: "unresolved conflicts"} and store.at().version == 3


def test_a_promotion_that_is_lost_before_its_commit_shows_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    plan, staged, issues = parts(spark)
    loading.load_batches(store, plan.where("batch_key = 'p'"), staged, issues.limit(0), authorized=True)

    def lost(_):
        raise RuntimeError("stop")

    monkeypatch.setattr(store, "_put", lost)
    with pytest.raises(RuntimeError, match="stop"):
        loading.promote_batches(store, spark.range(1, 2).withColumnRenamed("id", "batch_id"), authorized=True)
    fresh = Store(spark, store.root)
    assert fresh.at().version == 1 and not fresh.has("canonical_sales") and {r.status for r in fresh.read("import_batches").collect()} == {"staged"}


def fragments(spark, report):
    if report == "single":
        head = [("MLS® #", 10.0), ("Address", 100.0), ("List Price", 200.0), ("Sold Price", 300.0), ("Date", 400.0), ("Ty", 500.0)]
        lines = [head, [("202600001", 10.0), ("1 Elm St", 100.0), ("$300,000", 200.0), ("$310,000", 300.0), ("02/03/2026", 400.0), ("RD", 500.0)], [("202600002", 10.0), ("2 Elm St", 100.0), ("$1", 200.0), ("$320,000", 300.0), ("02/04/2026", 400.0), ("RD", 500.0)]]
        return spark.createDataFrame([("single.pdf", 1, 700.0 - 20 * i, x, x + 5, t) for i, line in enumerate(lines) for t, x in line], "file string, page_number int, y double, x0 double, x1 double, text string")
    pages = []
    for p, (n, price, day) in enumerate([("202600001", "$310,000", "02/03/2026"), ("202600002", "$321,000", "02/04/2026")], 1):
        text = [f"MLS® #: {n}", f"{p} Elm St, Winnipeg R3T 1A1", f"Sell Price: {price}", f"Sell Date: {day}", "List Price: $300,000", "Type: RD", "Nghbrhd: Elm Park", "Remarks: call the agent at home"]
        pages += [("full.pdf", p, 700.0 - 20 * i, 10.0, 60.0, t) for i, t in enumerate(text)]
    return spark.createDataFrame([*pages, ("full.pdf", 3, 1.0, 1.0, 2.0, "scan")], "file string, page_number int, y double, x0 double, x1 double, text string")


def test_import_batch_in_one_call(spark, tmp_path):
    out = str(tmp_path / "batch")
    told = loading.import_batch(fragments(spark, "single"), fragments(spark, "full"), {"single_line": ("single.pdf", "aa"), "client_full": ("full.pdf", "bb")}, out, datetime(2026, 3, 1), "p/1", "2026-03-01")
    assert told == json.loads((tmp_path / "batch" / "summary.json").read_text())
    csv = lambda n: spark.read.csv(f"{out}/{n}.csv", header=True).collect()
    assert (told["accepted"], told["rejected"], told["conflicts"]) == (len(csv("accepted")), len(csv("rejected")), len(csv("conflicts"))) == (1, 1, 1)
    assert told["warnings"] == len(csv("warnings")) and told["reconciliation"] == {"matched": 2, "single_only": 0, "full_only": 0, "duplicates": 0}
    assert told["pages"] == {"single_line": 1, "client_full": 3, "needs_ocr": 1} == {**told["pages"]} and len(csv("extraction_diagnostics")) == 4
    assert told["critical_reconciliation_failed"] and told["sold_date_range"] == ["2026-02-03", "2026-02-03"] and told["neighbourhood_count"] == 1
    assert csv("accepted")[0].mls_number == "202600001" and csv("rejected")[0].issue_codes.count("SOLD_PRICE_CONFLICT") == 1
    assert "agent" not in "".join(str(r) for n in ("accepted", "rejected", "warnings") for r in csv(n)).lower()


def test_landing_commits_each_fingerprint_once(spark, tmp_path):
    from hearthframe.streaming.landing import load_landing_into

    store = Store(spark, str(tmp_path / "s"))
    (tmp_path / "in").mkdir()
    for i, (checkpoint, lines) in enumerate([("a", "f,1\nf,1\nf,2\nf,\nf,\n"), ("a", "f,1\ng,3\n"), ("b", "")]):  # at last all files again, as after a lost checkpoint
        (tmp_path / "in" / f"{i}.csv").write_text("batch_fingerprint,mls_number\n" + lines)
        load_landing_into(store, "arrived", str(tmp_path / "in"), "batch_fingerprint string, mls_number string", str(tmp_path / checkpoint)).awaitTermination()
    assert sorted((r.batch_fingerprint, r.mls_number or "") for r in store.read("arrived").collect()) == [("f", ""), ("f", ""), ("f", "1"), ("f", "2"), ("g", "3")]
    assert store.versions() == [1, 2]


def test_a_load_computes_what_it_is_given_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    plan, staged, issues = parts(spark)
    schema = staged.schema

    def counted(rows):
        for r in rows:
            seen.add(1)
            yield r

    given = spark.createDataFrame(staged.rdd.mapPartitions(counted), schema)
    store = Store(spark, str(tmp_path / "s"))
    loading.load_batches(store, plan, given, issues, authorized=True)
    assert seen.value == 5 and store.read("staging_sales").count() == 3  # before, each check, count, sort and join computed all of them again
