import hashlib
import re
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from odd import labels, odd_documents
from test_near_texts import brute_kept
from tokenizers import Tokenizer

from promptloom.llm import queries, quality_rules, secret_scan

FOLDER = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    kept = {}
    now = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, FOLDER).write.parquet(f"{tmp_path}/{i}")
        now = spark.read.parquet(f"{tmp_path}/{i}")
        kept[name] = now
        if i < 4:
            assert now.columns == columns
    first = {r["doc_id"]: r["text"] for r in docs.collect()}
    rules = quality_rules.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    good = {r["doc_id"] for r in quality_rules.apply_rules(docs, rules).collect() if r["kept"]}
    assert {r["doc_id"] for r in kept["quality rules"].collect()} == good

    left = {r["doc_id"] for r in kept["near-duplicates"].collect()}
    assert left == set(brute_kept([(k, first[k]) for k in sorted(good)]))

    clean = {r["doc_id"]: r["text"] for r in kept["secrets"].collect()}
    assert clean.keys() == left
    for k, t in clean.items():
        assert not secret_scan.base_spans(t) and (t == first[k] or secret_scan.spans(first[k]))

    mixed = Counter((r["doc_id"], r["text"]) for r in kept["mixing"].collect())
    assert {k for k, _ in mixed} == left and all(clean[k] == t for k, t in mixed)
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for (k, t), n in mixed.items():
        ids = own.encode(t, add_special_tokens=False).ids
        want[k, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += n
    assert Counter(tuple(r) for r in kept["tokens"].collect()) == want
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, FOLDER).collect()) == want


def test_odd_rows_pass_all_stages(spark, tmp_path):
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    now = odd_documents(spark)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        now = spark.read.parquet(f"{tmp_path}/{i}")
    assert now.count() >= 1
    now = odd_documents(spark).limit(0)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/e{i}")
        now = spark.read.parquet(f"{tmp_path}/e{i}")
    assert now.count() == 0


def test_ten_queries_are_registered():
    numbers = [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES]
    assert sorted(numbers) == list(range(1, 11))
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", ["op2_source_mixing", "op8_html_layout"])
def test_query_covers_its_table(spark, name):
    source = "pages" if "html" in name else "documents"
    assert queries.QUERIES[name](spark, FOLDER).count() == spark.read.parquet(f"{FOLDER}/{source}.parquet").count()
