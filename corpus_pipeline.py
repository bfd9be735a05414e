"""A corpus pipeline: toxic texts out, unknown languages out, one of each near-duplicate group, mixed, encoded.

``STAGES`` lists (name, function); each takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's input. All but the last keep the columns of the documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import bpe, language_id, mixing, simhash, toxicity
from tickloom.llm.common import fresh, stored, table

ORACLE_SQL = None  # neither trained models nor XXH64 fingerprints can be written in SQL; tests compare stage by stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose worst window stays below the threshold; learned from the labelled ones among ``docs``."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    name = fresh(docs, "toxic_score")
    scored = toxicity.score(docs, model, name=name)
    return scored.filter(F.col(name) < toxicity.THRESHOLD).select(*docs.columns)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter that are near enough to a centroid of some language."""
    prefix = fresh(docs, "__language_")
    found = language_id.identify(docs, language_id.fit(docs), prefix=prefix)
    return found.filter(~F.col(f"{prefix}rejected")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids) of every document of the mix."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = bpe.encode(docs.select("doc_id", "source", "text"), ranks, public_tokenizers.PATTERN)
    return coded.select("doc_id", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic), ("language_id", keep_known_languages), ("simhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources), ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
