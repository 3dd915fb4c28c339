"""Registered queries of this subpackage: SQL where there is some, and the pipeline stage by stage."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
import public_tokenizers
from contactmill.llm import bpe, byte_bpe, mixing, queries, rule_quality
from tests.llm.test_documents import WHITE, near_classes
from tools.compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    ok, rows, message, _ = compare(spark, duck(SF), name, SF)
    assert ok and rows, message


def test_every_operator_is_registered():
    assert set(queries.QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline_against_each_stage_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    model = rule_quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in rule_quality.score(docs, model).where("predicted = 1").collect()}
    rows = [r for r in rows if r.doc_id in good]
    unique = {WHITE.sub(" ", r.text or ""): r for r in sorted(rows, key=lambda r: -r.doc_id)}
    rows = sorted(unique.values(), key=lambda r: r.doc_id)
    kept = {i for i, _, c in near_classes([(r.doc_id, r.text) for r in rows]) if i == c}
    rows = [r for r in rows if r.doc_id in kept]
    mixed = mixing.mixed_sizes(spark.createDataFrame(rows, docs.schema)).collect()
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(byte_bpe.VOCABULARY), special_tokens={})
    texts = {r.doc_id: r.text for r in rows}
    want, cut = Counter(), Counter()
    for r in mixed:
        whole, rest = divmod(r.taken, r.size) if r.size else (0, 0)
        ids = encoding.encode_ordinary(texts[r.doc_id] or "")
        want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()] += whole
        cut[r.doc_id] += bool(rest)
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, SF).collect())
    assert +(want - got) == Counter()
    assert Counter(i for i, *_ in (got - want).elements()) == +cut


def test_stages_return_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.where("false"), SF).count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "byte_bpe"]
