"""Corpus preparation in stages, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all
but the last return the columns of documents.

toxicity: documents scored toxic go. simhash_dedup: one document of each group of near
copies stays. substring_dedup: words of repeated 20-word passages go, the earliest
passage stays. mixing: each source's documents are repeated or left out to reach its
share. sentencepiece: texts become piece ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from nudgeframe.llm import mixing, sentencepiece, simhash, substring_dedup, toxicity
from nudgeframe.llm.common import read, shared_folder, ship

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")
#: SQL has no like of the learned lexicon, of SimHash or of the encoder.
ORACLE_SQL = None


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs.select(*DOCUMENT), read(spark, sf_dir, "labels"))


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.keep_one(docs.select(*DOCUMENT))


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return substring_dedup.deduplicate(docs.select(*DOCUMENT))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.materialise(docs.select(*DOCUMENT))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return sentencepiece.encode(docs.select(*DOCUMENT), sentencepiece.read_model()).drop("text")


STAGES = [
    ("toxicity", remove_toxic),
    ("simhash_dedup", remove_near_copies),
    ("substring_dedup", remove_repeats),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; their tables go to the shared folder."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
