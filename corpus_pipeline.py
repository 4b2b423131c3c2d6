"""The training corpus: toxic documents go, then unidentified ones, then near duplicates; what stays is packed.

``STAGES`` lists (name, function); each function takes the session, the documents so far and the folder of tables, and returns a
frame.  Every stage's frame is written as Parquet, and read again as the next stage's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from chronoweave.llm import langid, neardup, packing, toxicity
from chronoweave.llm.common import read_table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score, by a model of the labelled ones among them, is below one half.

    Null and empty texts have no evidence and stay; repeated rows are judged alike; null doc_ids are judged, but never learnt from.
    """
    return toxicity.keep_clean(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near enough to a language that is learnt from them.

    Null texts and texts without a letter go; without any known language all go; repeated rows are judged alike; short texts are not rejected for their cosine.
    """
    return langid.keep_identified(docs, langid.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each component of near duplicates (of repeated rows one); a row without words is linked with nothing and stays."""
    return neardup.keep_first(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of up to 2048 tokens; a null or empty text is its end token; repeated rows are packed each by itself."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unidentified),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack),
]

#: Classifiers, sketches and packing are not expressible in SQL; the tests compare toxicity, near duplicates and packing with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on table ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
