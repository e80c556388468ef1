"""A corpus pipeline: quality filter, near-duplicate removal, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() applies
them to documents, writing every stage's result as Parquet and reading it for the next one. All but
the last return the columns of documents, further ones included, whatever they are called. An empty table
gives an empty result at every stage. Each stage's tables in the shared folder are removed when
the next one starts, as its input is by then a table of its own.

The result can't be stated in SQL (a trained classifier, a tokenizer, an online packing);
tests hold the stages against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cuewright.llm import common, line_quality, mixing, near_dup, packing

#: Scores below are rejected.
QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines the random field takes for good; learnt from labels outside the held-out fold.

    Null and empty texts are one empty line and judged as such; repeated rows are judged alike; without labels all stay.
    """
    common.release(spark)
    field = line_quality.train(docs, common.read(spark, sf_dir, "labels"), ~line_quality.held_out())
    return line_quality.passing(docs, field, QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of least id.

    Documents without words are copies of nothing and stay; of rows that repeat an id one stays; rows without an id stay.
    """
    common.release(spark)
    return near_dup.without_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix by source weights takes them.

    A null source is a source of its own, the last; documents without words stay once.
    """
    common.release(spark)
    return mixing.repeated_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of at most 2048 tokens.

    Null texts are empty and give their end id; repeated rows and null ids are placed each on its own.
    """
    common.release(spark)
    return packing.best_fit(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("mixed", mixed), ("packed", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
