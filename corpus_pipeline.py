"""A corpus in five stages: toxic documents go, near copies are reduced to one, secrets are masked, sources are
mixed to target weights, and texts become token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the stages between are written as Parquet to the
shared folder and read again, so that a stage starts from files and survives lost executors.

Defined results: a null text counts as empty where a stage reads it and stays null. Empty texts are not toxic, share
fingerprint zero (one of them stays), hold no secrets, have size zero in the mix and no ids. Texts are read whole. Rows
with a null id are rows like others and come last where ids decide; null sources are a source of their own. Repeated rows
are near copies of each other, so one stays; after the mix a document may come up to three times. Empty tables pass
through. Columns of the caller keep their names, order and values, whatever the operators call theirs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, mixing, secrets, simhash, toxicity
from tessera.llm.common import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by a model of this corpus' labels."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = [f"__c{i}" for i in range(len(docs.columns))]
    scored = toxicity.score(docs.toDF(*names), model, names[docs.columns.index("text")], names)
    return scored.filter("score < 0.5").drop("score").toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group linked by 4 or fewer differing bits of 4-word shingles' fingerprints."""
    return simhash.one_of_each(docs, words=4, radius=4)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them."""
    return mixing.remixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed unsigned 32-bit integers) of every document of the mix."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id", "lang", "source", "n_chars"])


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scans", mask_secrets),
    ("source_mixing", mix_sources),
    ("byte_level_bpe", encode),
]

#: A trained model decides in the first stage, so SQL cannot express the result.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
