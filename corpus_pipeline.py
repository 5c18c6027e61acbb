"""From documents to token ids: toxic and poor texts go, one of each group of near copies stays, sources are mixed, texts encoded."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import bpe, mixing, quality, simhash, toxicity
from tesserae.llm.common import discard, materialize, scratch, table, unused

#: Scores from which a text counts as toxic, and below which it counts as poor.
TOXIC, POOR = 0.3, 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below TOXIC. Null and empty texts score as a text without features, and stay; repeated rows share their fate; very long texts are
    scored whole; an empty table stays empty; further columns pass, whatever they are called."""
    score = unused("toxic_score", docs.columns)
    scored = toxicity.with_score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), name=score)
    return scored.where(F.col(score) < TOXIC).select(*docs.columns)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score at least POOR. Null and empty texts are scored by their statistics like any other; repeated rows share their fate; very long
    texts are scored whole; an empty table stays empty; further columns pass, whatever they are called."""
    score = unused("quality_score", docs.columns)
    scored = quality.with_score(docs, quality.train(docs, table(spark, sf_dir, "labels")), name=score)
    return scored.where(F.col(score) >= POOR).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies. Null and wordless texts are copies of one another; null ids come last; an empty table stays empty; further
    columns pass, whatever they are called."""
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them. Null and empty texts have no words and go; a null source is a source; repeated rows are taken as the budget
    asks; an empty table stays empty; further columns pass, whatever they are called."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit numbers) and whether they decode to the text. A null text counts as empty; repeated rows
    are encoded alike; an empty table stays empty; further columns are not read."""
    ids = bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id", "lang", "source", "text"])
    return ids.select("doc_id", "lang", "source", "n_tokens", "ids", F.col("decoded").eqNullSafe(F.coalesce("text", F.lit("")).cast("binary")).alias("exact"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_poor),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]
#: The stages' models and merges are beyond SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark) as keep:
            docs = keep(materialize(stage(spark, docs, sf_dir), f"pipeline-{k}"))
        if last:
            discard(spark, last)
        last = docs.tesserae_path
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
