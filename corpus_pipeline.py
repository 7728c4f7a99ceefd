"""A training-data pipeline over documents: rules, near duplicates, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written as Parquet and
read again as the next one's input. All but the last return the columns of documents. What a stage wrote on its way,
and its input, are removed when its result is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bibspark.llm import jaccard, mixing, pii, quality, sentencepiece
from bibspark.llm.queries import tokenizer
from bibspark.llm.shared import chain, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the frequent lines of their hosts; one document keeps such a line, so that
    what a host holds in many copies is left to the next stage."""
    return quality.keep(docs, keep_first=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity of 0.8 or more), the document with the smallest id."""
    return jaccard.one_of_each(docs, words=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the mix takes them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_pieces of every document of the mix."""
    return sentencepiece.encode(docs, tokenizer("piece_bpe_32k.model"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode),
]

#: Near duplicates, the tagger and the encoder can't be expressed in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs all stages but the last, whose result is computed as it is read."""
    docs = chain(table(spark, sf_dir, "documents"), [lambda d, stage=stage: stage(spark, d, sf_dir) for _, stage in STAGES[:-1]])
    return STAGES[-1][1](spark, docs, sf_dir)
