"""The pipeline against its operators' own results, one after another."""

import corpus_pipeline as P
from test_documents import leaked
from test_duplicates import components_of

from lodestrata.llm import queries as Q
from lodestrata.llm import secrets


def test_stages_in_turn(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dedup", "decontamination", "secrets", "tokens"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    scores = {r.doc_id: r.score for r in Q.op3_toxicity(spark, sf_dir).collect()}
    rows = {r.doc_id: r for r in docs.collect() if scores[r.doc_id] < Q.TOXIC_FROM}
    comp = components_of([(i, r.text) for i, r in rows.items()], 5)
    rows = {i: r for i, r in rows.items() if comp[i] == i}
    bad = {d for d, _ in leaked([(i, r.text) for i, r in rows.items()], items)}
    rows = {i: r for i, r in rows.items() if i not in bad}
    masked = P.mask_secrets(spark, docs, sf_dir)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    assert not any(secrets.find(r.text) for r in masked.collect())
    got = {r.doc_id: r for r in P.run(spark, sf_dir).collect()}
    assert got.keys() == rows.keys()
    assert all(len(r.ids) == r.n_tokens for r in got.values())
