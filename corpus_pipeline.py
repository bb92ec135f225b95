"""The corpus pipeline over the documents table: quality, exact copies, near copies, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is written as Parquet and
read again as the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.bpe import bpe_round_trip
from tessera.llm.common import opened, sealed, written
from tessera.llm.exact_dedup import distinct_texts
from tessera.llm.minhash import without_near_duplicates
from tessera.llm.mixing import mix_sources, repeated
from tessera.llm.quality import fit_quality, score_quality
from tessera.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on these documents' labels, does not reject."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    bare, names = sealed(docs)
    return opened(score_quality(bare, model, names["text"]).where("predicted = 1"), names)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return distinct_texts(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return without_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    bare, names = sealed(docs)
    mixed = mix_sources(bare, names["doc_id"], names["text"], names["source"])
    return opened(repeated(mixed, list(names.values())), names)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them, for each document of the mix."""
    return bpe_round_trip(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("MinHash near-dedup", near), ("mixing", mixing), ("BPE", tokens)]
#: SQL cannot express the classifier; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, "pipeline-" + name.replace(" ", "-").lower())
    return docs
