import numpy as np

import corpus_pipeline
from listwright.llm import privacy
from listwright.llm.decontaminate import contamination
from listwright.llm.near_dup import MinHash, near_duplicates
from listwright.llm.queries import QUERIES
from listwright.llm.quality import quality_rules
from listwright.llm.shared import staged
from listwright.llm.tokens import IdEncoder

FOLDER = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert set(QUERIES) <= set(names)


def test_decisions_take_effect(spark, given):
    docs = given("documents")
    left = {r["doc_id"] for r in docs.collect()}
    for (name, stage), decide in zip(corpus_pipeline.STAGES[:3], (
            lambda d: quality_rules(d).where("NOT kept"), lambda d: near_duplicates(d, MinHash()).where("NOT kept"),
            lambda d: contamination(d, given("benchmark"))), strict=True):
        gone = {r["doc_id"] for r in decide(docs).collect()}
        after = staged(stage(spark, docs, FOLDER))
        assert after.columns == docs.columns and gone, name
        left -= gone
        docs = after
        assert {r["doc_id"] for r in docs.collect()} == left
    clean = staged(corpus_pipeline.STAGES[3][1](spark, docs, FOLDER))
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert not any("email" in r["spans"] for r in privacy.personal_data(clean).collect())
    packed = corpus_pipeline.STAGES[4][1](spark, clean, FOLDER).collect()
    encode = IdEncoder()
    want = {r["doc_id"]: encode(r["text"]) + np.uint32(1).tobytes() for r in clean.collect()}
    got = {}
    for r in sorted(packed, key=lambda r: r["start"]):
        got[r["doc_id"]] = got.get(r["doc_id"], b"") + r["ids"]
    assert got == want


def test_run_equals_its_stages(spark, given):
    docs = given("documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, staged(docs), FOLDER)
    columns = ["doc_id", "start", "length", "doc_tokens"]
    total = {tuple(r) for r in corpus_pipeline.run(spark, FOLDER).groupBy("doc_id").sum("length").collect()}
    assert total == {tuple(r) for r in docs.groupBy("doc_id").sum("length").collect()} and set(columns) <= set(docs.columns)


def test_empty_documents(spark, given):
    docs = given("documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0
