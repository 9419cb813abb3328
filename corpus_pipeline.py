"""Document pipeline of five stages; each works on what the one before it kept.

toxicity: documents with a score of 0.7 or more go. ngram_join: of each component only the smallest doc_id stays
(of equal or null ids, the row of the smallest text). decontamination: documents with a benchmark window go. secrets: found
spans are replaced in the text; all documents stay. packing: the rest is packed into sequences of 2048 tokens.

Each stage but the last returns the columns that it got, whatever their names: a row travels as one struct beside its id and
text. Only secrets changes values, ``text`` (and ``n_chars``, if there is one) of rows with a span.

Defined cases: a null, empty or wordless text is scored by the bias, links with nothing, is clean, and is packed as its end
id; very long texts are worked on whole; rows are told apart, not ids: repeated or null ids stay with other texts, while
repeated rows (equal id and text) are one document to ngram_join, which keeps one of them, and are kept by the other stages;
an empty table gives an empty result at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcast.llm.common import new_folder, saved, shuffles_freed, table, written
from fieldcast.llm.decontamination import contamination
from fieldcast.llm.ngram_join import jaccard_components
from fieldcast.llm.queries import packed, toxicity_scores
from fieldcast.llm.secrets import secret_spans

FEW_IDS = 500_000


def _carried(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): all columns as one struct, so that no column of a user meets one of an operator."""
    return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), "doc_id", "text")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity_scores(spark, _carried(docs), sf_dir).filter("score < 0.7").select("row.*")


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _carried(docs).withColumn("_key", F.col("doc_id"))
    if not docs.groupBy("doc_id").count().filter("count > 1").isEmpty():  # repeated or null ids: rows are told apart by their order
        rows = rows.dropDuplicates(["doc_id", "text"]).orderBy("doc_id", "text")  # repeated rows are one document
        rows = written(rows.withColumn("_key", F.monotonically_increasing_id()), "rows")
    named = rows.select(F.col("_key").alias("doc_id"), "text")
    later = saved(jaccard_components(named, links=False).filter("NOT doc_id <=> component_id").select(F.col("doc_id").alias("_key")).distinct())
    few = later.limit(FEW_IDS + 1).count() <= FEW_IDS
    return rows.join(later.hint("broadcast" if few else "shuffle_hash"), "_key", "left_anti").select("row.*")  # rows are never sorted: that spills them all


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination(_carried(docs), table(spark, sf_dir, "benchmark"), keep=["row"]).filter("NOT contaminated").select("row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secret_spans(_carried(docs), public_tokenizers.path("byte_bpe_50k.tiktoken"), keep=["row"])
    clean = {"text": F.coalesce("redacted", "row.text")}
    if "n_chars" in docs.columns:
        clean["n_chars"] = F.when(F.col("redacted").isNotNull(), F.length("redacted").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return found.select(*((clean[c] if c in clean else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

ORACLE_SQL = None  # a trained model and a tokenizer are beyond SQL; tests/llm compares each stage with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = new_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        with shuffles_freed(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
