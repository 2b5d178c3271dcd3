"""Each stage of the pipeline against a plainer version of what it decides, on the small table and on odd rows."""

import re

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from hearthframe.llm import bpe, order_minhash, queries

FOLDER = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(queries.VOCABULARY)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows that go into each stage and those that come out of it."""
    folder, out = tmp_path_factory.mktemp("stages"), {}
    odd = spark.createDataFrame([(None, None), (None, "a unique text of a row without any id at all"), (None, ""), (10**15, "one more line that nobody else has\n\nhi"), (10**15, "x" * 9000)], "doc_id long, text string")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = docs.unionByName(odd, allowMissingColumns=True)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out[name] = (docs, after)
        docs = after
    return out


def rows(df):
    return [(x.doc_id, x.text) for x in df.select("doc_id", "text").collect()]


def test_all_stages_but_the_last_keep_the_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "mixing", "byte_bpe"]
    for name in names[:-1]:
        assert stages[name][1].columns == stages[name][0].columns


def test_toxicity_keeps_clean_documents_and_odd_rows(spark, stages):
    before, after = (rows(x) for x in stages["toxicity"])
    labels = {x.doc_id: x.toxic for x in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    gone = {i for i, _ in before} - {i for i, _ in after}
    clean = [i for i, v in labels.items() if v == 0]
    assert len([i for i in clean if i in gone]) <= 0.05 * len(clean) and sum(i is None for i, _ in after) == 3


def test_lines_stay_where_they_come_first(stages):
    before, after = (rows(x) for x in stages["line_dedup"])
    passages = lambda t: [x for x in (t or "").split("\n") if len(x) >= 12]
    kept = [x for _, t in after for x in passages(t)]
    assert len(kept) == len(set(kept))  # no line twice
    had = {x for _, t in before for x in passages(t)}
    first = {}
    for i, t in sorted(before, key=lambda r: (r[0] is None, r[0] or 0)):
        for x in passages(t):
            first.setdefault(x, i)
    assert set(kept) <= had
    for i, t in after:
        assert all(first[x] == i for x in passages(t))
    assert {i for i, t in before if not t} <= {i for i, _ in after}  # empty before, so no loss


def test_one_row_of_each_class_stays(stages):
    before, after = (rows(x) for x in stages["near_dedup"])
    hashed = [order_minhash.word_hashes(t or "") for _, t in after]
    for i, a in enumerate(hashed):
        for b in hashed[:i]:
            assert order_minhash.similarity(a, b) < 0.8 or len(a) < 5
    texts = {t or "" for _, t in after}
    for _, t in before:  # what went has a near copy, by way of others, that stayed: at least every unlike text stays
        a = order_minhash.word_hashes(t or "")
        if (t or "") not in texts:
            assert any(order_minhash.similarity(a, order_minhash.word_hashes(u or "")) >= 0.8 for _, u in before if u != t)


def test_mix_comes_near_its_targets(stages):
    before, after = stages["mixing"]
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size, taken, largest = {}, {}, {}
    for x in before.select("source", "text").collect():
        size[x.source] = size.get(x.source, 0) + count(x.text)
        largest[x.source] = max(largest.get(x.source, 0), count(x.text))
    for x in after.select("source", "text").collect():
        taken[x.source] = taken.get(x.source, 0) + count(x.text)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, total = {}, set(order), 1.5 * sum(size.values())
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] >= 2 * size[s]]
        target |= {s: 2 * size[s] for s in full} if full else {s: level * weight[s] for s in open_}
        open_ -= set(full) if full else open_
    for s in order:
        assert abs(taken.get(s, 0) - target[s]) <= largest[s] + 1, s


def test_ids_decode_to_the_texts(spark, stages):
    before, after = stages["byte_bpe"]
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
    assert sorted(str(enc.decode(x.token_ids)) for x in after.collect()) == sorted(x.text or "" for x in before.collect())


def test_run_gives_what_the_stages_give(spark, stages):
    got = corpus_pipeline.run(spark, FOLDER)
    assert set(got.columns) >= {"doc_id", "token_ids", "n_tokens", "ids_sha256", "decoded_sha256"} and got.where(F.size("token_ids") != F.col("n_tokens")).count() == 0
    assert {x.doc_id for x in got.select("doc_id").collect()} <= {x.doc_id for x in stages["byte_bpe"][1].select("doc_id").collect()}


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0
