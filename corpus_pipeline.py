"""A corpus pipeline: language ID, quality rules, near-dedup, source mixing, tokenization.

Each stage takes the documents that the one before kept, and its decisions take
effect; all but the last return the columns of ``documents``.  Stages that decide
on narrow tables bring their verdicts back by a semi join, so repeated rows and
null ids keep their number.  A stage's parameters are those of its operator's query.

Texts that are null, blank or without a letter end at the language stage.  Texts of
any length pass whole.  Null languages and sources are groups of their own.  Repeated
rows share one verdict in every stage.  Columns beyond those of ``documents``, whatever
their names, are kept up to the last stage, which gives the columns of its operator.
An empty table gives empty tables.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrow.llm.bpe import bpe_digests
from lumenrow.llm.common import shared_dir, written
from lumenrow.llm.language import identify
from lumenrow.llm.minhash import near_duplicates
from lumenrow.llm.mixing import NONE, drawn
from lumenrow.llm.quality import judged

#: A text whose best language has less than this share of the posterior is rejected, as one without letters is.
SURE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that have a language; what it's said to be isn't looked at."""
    told = identify(docs, keep=docs.columns, names=("__held_out", "__lang_pred", "__score"))
    return told.filter((F.col("__lang_pred") != "und") & (F.col("__score") >= SURE)).select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the base rules and lie near their group's centre."""
    good = judged(docs).filter("kept").select(*[F.col(c).alias(f"k_{c}") for c in ("doc_id", "lang", "source", "text_hash")])
    same = docs["doc_id"].eqNullSafe(good["k_doc_id"]) & F.xxhash64(docs["text"]).eqNullSafe(good["k_text_hash"]) & docs["lang"].eqNullSafe(good["k_lang"]) & docs["source"].eqNullSafe(good["k_source"])
    return docs.join(good, same, "left_semi")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group; documents without an id stay, and meet no join."""
    kept = near_duplicates(docs).filter("kept and doc_id is not null").select(F.col("doc_id").alias("k_doc_id"))
    named = docs.filter(docs["doc_id"].isNotNull())
    return named.join(kept, named["doc_id"] == kept["k_doc_id"], "left_semi").unionByName(docs.filter(docs["doc_id"].isNull()))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that are drawn for the targets of the operator's query."""
    taken = drawn(docs).filter("sampled").select(*[F.col(c).alias(f"k_{c}") for c in ("doc_id", "lang", "source", "text_hash")])
    same = docs["doc_id"].eqNullSafe(taken["k_doc_id"]) & (F.xxhash64(docs["text"]) == taken["k_text_hash"]) & (F.coalesce(docs["lang"], F.lit(NONE)) == taken["k_lang"]) & (F.coalesce(docs["source"], F.lit(NONE)) == taken["k_source"])
    return docs.join(taken, same, "left_semi")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language", language_stage),
    ("quality", quality_stage),
    ("near_dedup", dedup_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: Context trees and MinHash are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        written(stage(spark, docs, sf_dir), path)
        docs = spark.read.parquet(path)
    return docs
