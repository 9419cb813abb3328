"""Each stage on nulls, empty and very long texts, repeated rows, clashing columns and an empty table."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

NAMES = ["doc_id", "text", "n_chars", "score", "items", "spans", "_text", "row", "contaminated", "name"]
SCHEMA = "doc_id long, text string, n_chars int, score string, items int, spans string, _text string, row string, contaminated int, name string"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(40_000))
KEY = "password: hunter2hunter2"


def rows():
    texts = [(1, "x y z one two three four"), (2, "x y z one two three four"), (2, "another text beside it, of its own"), (3, None), (4, ""), (5, "!!! ???"), (6, LONG), (None, "a null id and its words"), (7, f"say {KEY} now"), (8, "twice the very same row"), (8, "twice the very same row")]
    return [(d, t, None if t is None else len(t), f"s{k}", k, f"p{k}", "mine", "r", 1, None) for k, (d, t) in enumerate(texts)]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_rows_and_columns_stay(spark, sf_dir, name, stage):
    want = rows()
    out = stage(spark, spark.createDataFrame(want, SCHEMA), sf_dir)
    assert out.columns == NAMES and [f.dataType for f in out.schema] == [f.dataType for f in spark.createDataFrame(want, SCHEMA).schema]
    got = [tuple(r) for r in out.collect()]
    if name == "ngram_join":
        assert len(got) == len(want) - 2 and set(got) <= set(want)
        assert sorted(str(r[:2]) for r in got) == sorted({str(r[:2]) for r in want} - {str(want[1][:2])})
    elif name == "secrets":
        clean = [(r[0], r[1].replace(KEY, "[SECRET]"), len(r[1]) - len(KEY) + 8, *r[3:]) if r[1] and KEY in r[1] else r for r in want]
        assert sorted(got, key=str) == sorted(clean, key=str)
    else:
        assert sorted(got, key=str) == sorted(want, key=str)


def test_packing_takes_every_row(spark, sf_dir):
    out = corpus_pipeline.packing(spark, spark.createDataFrame(rows(), SCHEMA), sf_dir)
    assert out.filter("start = 0").count() == len(rows())
    assert out.agg(F.max("doc_tokens")).first()[0] > 40_000


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_empty_table(spark, sf_dir, name, stage):
    out = stage(spark, spark.createDataFrame([], SCHEMA), sf_dir)
    assert out.count() == 0 and (name == "packing" or out.columns == NAMES)


def test_decontamination_takes_only_hits(spark, sf_dir):
    item = next(r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if r["text"])
    df = spark.createDataFrame([(1, f"before {item} after"), (2, "clean words of no item at all")], "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.decontamination(spark, df, sf_dir).collect()] == [2]
