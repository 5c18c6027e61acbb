"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, balltree, bpe, gif, jaccard, mixing, quality, quotes, resample, sharding, simhash, toxicity, warc
from .common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = quotes.link_quotes(table(spark, sf_dir, "conversations"))
    return linked.select("conv_id", "turn", "role", F.sha2("clean", 256).alias("clean_sha256"), "quotes", "linked", "reply_to", "root_turn", "depth")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id"], digests=True)


def op4_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.stored_texts(table(spark, sf_dir, "documents"))


def op5_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages"))


def op7_simhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_near_dups(table(spark, sf_dir, "documents"))


def op8_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_ball_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.top_products(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


def op10_shard_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_size(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = resample.importance_ranks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return ranks.select("doc_id", "n_features", "weight", "score", "rank")


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    numbered = (op1_mix_sources, op2_quotation_links, op3_byte_bpe, op4_gif_media, op5_toxicity_nnpu, op6_warc_index, op7_simhash_near_dups, op8_quality_trees, op9_ball_tree_topk, op10_shard_by_size, op11_importance_resampling, op12_jaccard_join, op13_filter_audit)
    return {f.__name__: f for f in numbered}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mixing.MIX_SQL, "op2_quotation_links": quotes.QUOTES_SQL, "op6_warc_index": warc.WARC_SQL, "op9_ball_tree_topk": balltree.TOP_SQL, "op10_shard_by_size": sharding.SHARD_SQL, "op11_importance_resampling": resample.RESAMPLE_SQL, "op13_filter_audit": audit.AUDIT_SQL}
