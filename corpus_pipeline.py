"""A corpus pipeline: toxic documents go, copies go, near copies go, sources are mixed, texts are encoded.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the
columns of documents; between stages documents are written as Parquet and read again.

Defined results: null texts count as empty and stay; of equal texts the row of the largest id stays, of near
copies those of the smallest; rows are told apart by id and text, so one that repeats an id with another text
is a document of its own; rows without an id count as copies, never as near copies; the mixture repeats
documents as its weights ask; empty tables give empty ones.
"""

from __future__ import annotations

from math import ceil, log2

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tersemill.llm.bpe_codec import bpe_codec
from tersemill.llm.common import materialize, scratch, small_batches, table
from tersemill.llm.exact_dedup import without_copies
from tersemill.llm.jaccard_join import without_near_copies
from tersemill.llm.mixing import mixture
from tersemill.llm.toxicity import fit_toxicity, without_toxic

#: Documents that an output shard of the mixture has, about.
SHARD = 4096


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return without_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture(docs, shards=1 << max(3, ceil(log2(max(1, docs.count()) / SHARD))))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return bpe_codec(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("jaccard_join", drop_near_copies), ("mixing", mix_sources), ("bpe_codec", encode)]

#: The mixture's draws and the trained score are not SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch() as keep:
            docs = materialize(stage(spark, docs, sf_dir), name)
            keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
