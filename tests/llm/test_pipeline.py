"""The pipeline's stages, each against a plain version of what it should keep."""

import corpus_pipeline
from tallyweave.llm import packing, quality, toxicity
from tallyweave.llm.common import table

from .test_near_copies import brute
from .test_ops import check_packing

LARGER = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = table(spark, LARGER, "documents")
    labels = table(spark, LARGER, "labels")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "simhash_near_dedup", "packing"]
    chain, model = toxicity.train(docs, labels), quality.train(docs, labels)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, LARGER)
        if name == "packing":
            check_packing(spark, docs, out)
            break
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        assert out.columns == docs.columns
        kept = {r["doc_id"]: r["text"] for r in out.collect()}
        assert len(kept) == out.count() and all(rows[i] == t for i, t in kept.items())
        if name == "toxicity":
            ids = list(rows)
            want = {i for i, p in zip(ids, chain.probabilities([rows[i] for i in ids])[:, -1], strict=True) if p < 0.5}
        elif name == "quality":
            import numpy as np

            ids = list(rows)
            want = {i for i, s in zip(ids, model.score(np.array([quality.features(rows[i]) for i in ids])), strict=True) if s >= 0.5}
        else:
            # Five-word shingles and a Jaccard similarity of 0.8, by plain Python.
            want, _ = brute(list(rows.items()))
        assert set(kept) == want and len(want) < len(rows)
        rows, docs = kept, out
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, LARGER).collect()} == set(rows)
    assert packing.LENGTH == 2048
