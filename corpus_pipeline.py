"""A corpus from raw documents to packed training sequences, in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir), works on all rows its predecessor kept, and all but the
last return the columns of documents. run() writes each result as Parquet and reads it again for the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from llm import jaccard, mixing, packing, quality, secrets, tokens
from llm.common import ship, stage
from llm.queries import tokenizer_file

ACCEPT = 0.3  # documents with a lower quality score go
SEQUENCE = 2048


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    labels = quality.training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    model = quality.fit(docs, labels)
    return quality.score(docs, model, "_score").filter(F.col("_score") >= ACCEPT).select(*docs.columns)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return jaccard.keep_one(docs, jaccard.Rule(words=5, percent=80))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact(secrets.scan(docs))
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    pieces = tokens.token_pieces(docs, tokenizer_file("word_bpe_49k.json"), SEQUENCE)
    return packing.pack(pieces, packing.Capacity(tokens=SEQUENCE)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality classifier", good_quality), ("n-gram Jaccard join", no_near_copies), ("secret scans", no_secrets),
          ("mixing sources to target weights", mixed), ("best-fit packing", packed)]

#: the tokenizer and the fitted classifier have no SQL form; tests compare the stages with plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
