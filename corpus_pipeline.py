"""A training corpus from raw documents: five stages, each written as Parquet and read again.

Language ID drops documents without a recognisable language; exact and near copies are thinned to one a group;
sources are mixed to their target weights, which drops documents or repeats them; what is left becomes tokens.
Every stage works on all that the one before kept and, but for the last, returns the columns of documents.

Null or wordless texts go at the first stage; null ids, languages and sources are values like any other. Wholly
repeated rows and rows with one id but different texts are rows of their own: copies are thinned by text, ties go to
the smaller id and then to a hash of the text, and no text that nothing else holds is lost. Long texts are read whole.
An empty table passes every stage as an empty one. Extra columns, whatever their names, stay up to the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gristmill.llm.bpe import bpe_digests
from gristmill.llm.common import discard, read, table
from gristmill.llm.exact_dedup import exact_dedup
from gristmill.llm.jaccard_join import near_dedup
from gristmill.llm.language_id import fit, identify
from gristmill.llm.mixing import mix


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; null texts and texts without letters go."""
    return identify(docs, fit(docs)).where("lang_pred <> 'und'").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity 0.75 or more connect."""
    return near_dedup(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left."""
    return bpe_digests(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mixed), ("tokens", tokens)]

# Language ID and the tokenizer are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        done, docs = docs, table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(done)
    return STAGES[-1][1](spark, docs, sf_dir)
