"""Corpus pipeline: quality classifier, near-duplicates, mixing, BPE encoding.

Each stage works on all rows that the one before kept, and its decisions take effect: documents that the classifier
rejects go, one document of each near-duplicate class stays, and mixing repeats or drops documents by their fitted
rates. The last stage gives the digests of every remaining document's encoding. A document that mixing repeats
comes as often in the result.

Nulls and repeats: a null text counts as empty; documents without doc_id, or that share one, are judged each by their own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from civicmesh.llm import queries
from civicmesh.llm.bpe_codec import digests
from civicmesh.llm.mixing import mix
from civicmesh.llm.quality import keep_good
from civicmesh.llm.simhash import keep_first
from civicmesh.llm.storage import stored

#: Shares of the mixture for each label class, and its size in multiples of the tokens that come in: with half as many
#: tokens again, clean documents' rates stay over one while toxic ones lose.
TARGETS, EPOCHS = {"q1t0": 0.90, "q1t1": 0.10}, 1.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score at least 0.3)."""
    return keep_good(docs, queries.table(spark, sf_dir, "labels"), cut=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate class."""
    return keep_first(docs, words=4, radius=4)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rates say."""
    return mix(docs, queries.label_domains(queries.table(spark, sf_dir, "labels")), TARGETS, epochs=EPOCHS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document."""
    return digests(docs.select("doc_id", "text"), queries.tokenizer(queries.TOKENIZER_WORD))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("mixing", mixing), ("encoding", encoding)]
#: SQL cannot express these models; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each but the last written as Parquet and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
