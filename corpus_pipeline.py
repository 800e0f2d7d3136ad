"""Corpus pipeline: language ID, quality rules, near-dedup, mixing to weights, SentencePiece encoding."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from barline.llm import langid, mixing, neardup, pieces, quality  # noqa: E402
from barline.llm.catalog import tokenizer_file  # noqa: E402
from barline.llm.common import table, written  # noqa: E402


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled documents teach."""
    return langid.keep_known(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their host's verdict."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, Jaccard similarity of at least 0.8."""
    return neardup.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents once for each time the mix takes them."""
    return mixing.mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document of the mix as SentencePiece ids, checked against the other library and decoded again."""
    return pieces.encode(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("near_dedup", near_dedup),
          ("mix_sources", mix_sources), ("encode_pieces", encode_pieces)]
#: SQL can't express the trained filter, the hypergeometric tree or the tokenizer; tests run a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
