"""The ngram_join stage with repeated and null ids."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_rows_go_not_ids(spark, sf_dir):
    words = [f"w{i}" for i in range(60)]
    first, near, near2 = " ".join(words), " ".join([*words, "x"]), " ".join([*words, "y"])
    other = " ".join(f"o{i}" for i in range(60))
    nulls = [" ".join(f"n{i}" for i in range(60)), " ".join([*(f"n{i}" for i in range(60)), "z"])]
    shared = [" ".join(f"s{i}" for i in range(60)), " ".join([*(f"s{i}" for i in range(60)), "z"])]
    rows = [(1, first), (2, near), (2, other), (3, near2), (4, "alone"), (4, "alone"), (5, None), *((None, x) for x in nulls), *((7, x) for x in shared)]
    df = spark.createDataFrame([(d, t, "more") for d, t in rows], "doc_id long, text string, lang string")
    out = corpus_pipeline.ngram_join(spark, df, sf_dir)
    want = [(1, first), (2, other), (4, "alone"), (5, None), (None, nulls[0]), (7, shared[0])]
    assert out.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(want, key=str)
