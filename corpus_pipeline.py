"""A pipeline over ``documents``: toxic documents go, one of each group of near copies stays, repeated passages are cut out, the rest is packed.

Null and empty texts are kept by the first stage, are one group of near copies in the second (the one of the smallest id stays), have nothing to cut in the
third, and are one piece of an end mark in the last. Rows without a doc_id pass the second stage as they are. Rows that repeat an id with another text are documents of their own; rows that
repeat an id and its text become one in the second stage. Ties go to the smaller id, then to the text of the smaller hash. Further columns are kept up to the last stage,
whatever their names. An empty table gives an empty one.

Every stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and is written as Parquet before the next one reads it.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankweave.llm import ngram_join, packing, simhash, substrings, toxicity
from rankweave.llm.shared import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject; it learns from the labels of ``docs`` that aren't held out."""
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near copies: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more. SimHash
    fingerprints of these sets meet in a grid of segment popcounts, and what they join is held against the similarity; a join of columns finds what lies further apart in bits."""
    return simhash.one_of_each(docs, functools.partial(ngram_join.placed, size=WORDS, similarity=SIMILARITY, grid=True))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words and more that a document with a smaller id holds."""
    return substrings.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


#: Near copies share this many words in a row at a Jaccard similarity of so much.
WORDS, SIMILARITY = 5, 0.8

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("packing", pack),
]

#: SQL expresses none of the stages; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
