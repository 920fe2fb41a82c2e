"""The pipeline against a plain version of each stage."""

import corpus_pipeline
from test_llm import BPE_FILE, plain_hits, plain_pii
from test_near_copies import all_pairs

from tickloom.llm import bpe, pii, quality_model


def test_pipeline_against_plain(spark):
    d = "/root/testdata/sf0.001"
    docs, labels, items = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    trees = quality_model.fit_documents(docs, labels)
    import numpy as np

    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    scores = trees.score(np.array([quality_model.statistics(r.text) for r in rows]))
    rows = [r for r, s in zip(rows, scores) if s >= 0.5]
    first, _ = all_pairs([r.text for r in rows])
    rows = [r for i, r in enumerate(rows) if first[i] == i]
    hits = plain_hits([r.text for r in rows], [(i.item_id, i.text) for i in items.collect()])
    rows = [r for r, h in zip(rows, hits) if not h[1]]
    coder = bpe.TrieBpe(BPE_FILE)
    want = {}
    for r in rows:
        base = plain_pii(r.text)
        want[r.doc_id] = np.frombuffer(next(coder.encode([pii.redact(r.text, base + pii.find_disguised(r.text, base))])), "<u4").tolist()
    got = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id: r.token_ids for r in got} == want and all(r.decodes for r in got)


def test_stages_keep_the_columns(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns
        assert stage(spark, docs.limit(0), d).count() == 0
