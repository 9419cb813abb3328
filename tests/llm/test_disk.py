"""What the n-gram join leaves on disk, and what it deals out, on tables beyond its broadcasts and cells."""

import random
import time

import pytest
from pyspark.sql import functions as F

from fieldcast.llm import cells, common, ngram_join

from .test_ngram_join import brute

FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _files(spark):
    found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return sum(f.getName().startswith("shuffle") for f in (found.apply(i) for i in range(found.size())))


def _near_copies(n, words=60, seed=5):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    rows = []
    for i in range(n):
        w = list(base)
        w[rng.randrange(words)] = f"x{i}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("cut", [common.saved, lambda df: common.written(df, "test")])
def test_shuffles_go_with_their_action(spark, cut):
    df = spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 10).alias("k")).count()
    before, kind = _files(spark), spark.conf.get(FREED)
    assert len(cut(df).collect()) == 10
    for _ in range(50):
        if _files(spark) <= before:
            break
        time.sleep(0.2)
    assert _files(spark) <= before
    assert spark.conf.get(FREED) == kind


def test_many_later_copies_sort_no_rows(spark, sf_dir, monkeypatch):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame([*_near_copies(30), (100, "alone"), (101, None)], "doc_id long, text string")
    monkeypatch.setattr(corpus_pipeline, "FEW_IDS", 0)
    out = corpus_pipeline.ngram_join(spark, docs, sf_dir)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort" not in plan
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 100, 101]


def test_only_members_travel(spark):
    own = spark.range(5000).select(F.col("id").alias("_id"), F.lit("text").alias("_text"))
    members = spark.range(0, 5000, 50).select(F.col("id").alias("_id"))
    got = {r["_id"] for r in cells.of_members(own, members, 100).collect()}
    assert set(range(0, 5000, 50)) <= got and len(got) < 1000
    assert cells.of_members(own, members.limit(0), 0).count() == 0


@pytest.mark.parametrize("links", [True, False])
def test_blocks_of_a_large_cell_take_turns(spark, monkeypatch, links):
    rows = _near_copies(80)
    dealt, save = [], cells.saved

    def counted(df):
        if df.columns == ["a", "b", "n"]:
            dealt.append(df)
        return save(df)

    monkeypatch.setattr(cells, "saved", counted)
    out = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), cell_shingles=300, links=links)
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert got == [w if links else w[:3] for w in brute(rows)]
    assert len(dealt) >= 8  # one block or so a turn: each reads the whole cell, which is the whole corpus here
