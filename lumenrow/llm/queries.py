"""The queries of this subpackage, one for each operator, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .bpe import bpe_digests
from .common import documents
from .language import identify
from .license_scan import license_scan
from .lm_scoring import cross_entropy_difference
from .media_ts import media_columns
from .minhash import near_duplicates
from .mixing import mix_sources
from .quality import quality_verdicts
from .sharding import balanced_shards
from .url_trees import judge


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def op2_mcd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances to six places, so that other engines' last bits don't count."""
    return quality_verdicts(documents(spark, sf_dir)).withColumn("distance", F.round("distance", 6))


def op3_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares to six and four places, so that what raking's tolerance leaves doesn't count."""
    return mix_sources(documents(spark, sf_dir)).withColumns({"fitted": F.round("fitted", 6), "inclusion": F.round("inclusion", 4), "residual": F.round("residual", 6)})


def op4_bpe_prefix_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op6_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


def op7_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(documents(spark, sf_dir))


def op8_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets: documents labelled good and not toxic.  Losses to six places, so that other engines' last bits don't count."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    told = cross_entropy_difference(documents(spark, sf_dir), labels.filter("quality = 1 and toxic = 0").select("doc_id"))
    return told.withColumns({c: F.round(c, 6) for c in ("target_loss", "background_loss", "score")})


def op9_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_mpeg_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(documents(spark, sf_dir))


QUERIES = (
    op1_license_scan,
    op2_mcd_quality,
    op3_raked_mixture,
    op4_bpe_prefix_dp,
    op5_minhash_near_dedup,
    op6_ppm_language,
    op7_minimax_shards,
    op8_cross_entropy_difference,
    op9_url_trees,
    op10_mpeg_transport_stream,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op2_mcd_quality": oracles.quality_rules(), "op3_raked_mixture": oracles.mixture(), "op5_minhash_near_dedup": oracles.NEAR_DUPLICATES, "op8_cross_entropy_difference": oracles.cross_entropy()}
