"""A training corpus from documents: rules, languages, near-duplicates, repeats, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexspark.llm import host_rules, langid, minhash, packing, suffixes
from lexspark.llm._common import drop_stored, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the rules or whose host does.

    Null and empty texts fail; a null source is a host of its own; repeated rows and null ids are
    rows like others; other columns are kept as they are; an empty table stays empty.
    """
    return host_rules.keep(docs)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is not recognised, null texts and those without a letter too.

    The models learn from the documents given; ties go to the first name of a language. Repeated
    rows share a verdict; if no row names a language, none is kept.
    """
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near-duplicates (five-word shingles, 0.8).

    Texts without words and rows without an id stay; rows of one id stay or go together. An empty
    table stays empty, and other columns stay as they are, whatever their names.
    """
    return minhash.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out passages that occur earlier; what that cuts inside a character is dropped.

    No row goes; a text that repeats whole is left empty and a null one null. Rows of one id, or
    of none, are documents of their own unless their texts are equal too. An empty table stays
    empty, and other columns stay as they are, whatever their names.
    """
    return suffixes.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every document's tokens in training sequences.

    A null or empty text has its end token alone; repeated rows and null ids are rows like others; an
    empty table gives an empty result; columns besides doc_id and text are not read.
    """
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("language ID", languages), ("MinHash near-dedup", near_duplicates), ("suffix-array dedup", repeats), ("best-fit packing", pack)]

#: Three of the stages cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir; what a stage has read goes once its result is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        with scratch(spark) as keep:
            after = keep(stage(spark, docs, sf_dir), f"stage{i}")
        if last is not None:
            drop_stored(last)
        docs = last = after
    return docs
