"""Each stage against brute force on its own input."""

import pytest

from .test_ngram_join import brute
from .test_ops import brute_contamination, check_packing

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf_dir, tmp_path):
    import public_tokenizers
    from fieldcast.llm import queries, secrets

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    scores = {r["doc_id"]: r["score"] for r in queries.op9_toxicity(spark, sf_dir).collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    enc = secrets.load_encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        rows = list(before.values())
        if name == "packing":
            check_packing(out.collect(), [(r["doc_id"], r["text"]) for r in rows])
            break
        assert out.columns == docs.columns
        after = {r["doc_id"]: r for r in out.collect()}
        texts = [(r["doc_id"], r["text"]) for r in rows]
        if name == "toxicity":
            keep = {d for d in before if scores[d] < 0.7}
        elif name == "ngram_join":
            keep = {d for d, _, c, _ in brute(texts) if d == c}
        elif name == "decontamination":
            keep = {x[0] for x in brute_contamination(texts, items) if not x[-1]}
        else:
            keep = set(before)
            for d, r in before.items():
                want = secrets.redact(r["text"], secrets.find_spans(r["text"], enc, 2.0))
                assert after[d]["text"] == want and after[d]["n_chars"] == len(want)
        assert set(after) == keep
        if name != "secrets":
            assert all(after[d] == before[d] for d in keep)
        docs, before = out, after
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
