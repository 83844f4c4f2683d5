"""The training-data pipeline: documents to packed sequences, each stage written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlens.llm import langid, mixing, packing, pseudonyms, similar
from textlens.llm.common import finished

#: Parameters of the run: the tokenizer's file (on every executor) and the pseudonyms' key, which a deployment replaces.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
KEY = "textlens"


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a main language go."""
    return langid.keep_identified(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies by SimHash, confirmed by a five-word similarity of 0.8 and completed by all other pairs of that similarity: of each group the document with the smallest id stays."""
    return similar.drop_similar(docs)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gets format-preserving pseudonyms."""
    out = pseudonyms.pseudonymise(docs, KEY)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights: documents repeat or go as the schedule takes them."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two lengths."""
    return packing.pack(docs, TOKENIZER)


STAGES = [("language ID", identify), ("SimHash near-dedup", deduplicate), ("PII pseudonyms", pseudonymise), ("source mix", mix), ("packing", pack)]

#: Language ID, SimHash and tokenizing aren't SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is a table in the shared folder, where nothing else of its stage stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = finished(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
