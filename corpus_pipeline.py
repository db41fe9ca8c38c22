"""A corpus from raw documents to packed token windows, in stages that each call one operator of lexispark.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents, whatever they are: further columns, also with names
that the operators use themselves, are kept as they stand. Empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm import decontaminate, language, near_duplicates, packing, repeats
from lexispark.session import settle, table

#: Regression score under which no language is taken to fit a text.
LEAST_LANGUAGE_SCORE = 0.25


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has letters and fits a learned language.

    Null, empty and letterless texts go; so does everything where no row has both text and lang. Rows without lang or
    doc_id are judged like others. Of equal scores the language first in order counts. Repeated rows are judged alike.
    """
    model = language.fit(docs.where(language.remainder("doc_id", 4) != 2))
    return language.keep(docs, model, LEAST_LANGUAGE_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group linked by sets of five-word shingles alike by 0.8.

    Null, empty and wordless texts are linked with nothing and stay, as do rows without doc_id. Rows that share a doc_id
    are one document: they stay or go together.
    """
    dropped = settle(near_duplicates.near_duplicates(docs, k=5, percent=80).where("NOT kept").select("doc_id").distinct(), "dropped")
    few = dropped.count() <= near_duplicates.BROADCAST_ROWS
    return docs.join(F.broadcast(dropped) if few else dropped, "doc_id", "left_anti").select(docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 200 bytes that occur more than once; every document stays, some with an empty text.

    A null text stays null. Rows of equal doc_id and text lose the same spans, as each repeats the other. Spans are narrowed
    to whole characters; n_chars, where there is one, is counted anew.
    """
    return repeats.without_repeats(docs, repeats.find_repeats(docs, length=200))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; null, empty and repeated items are harmless;
    every row is judged by its own text, also where doc_ids repeat."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 4096 tokens. A null or empty text has its end token only; repeated rows are
    packed as often as they occur."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: Language identification and tokenizing can't be expressed in SQL; tests/llm holds stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents; each stage's rows are written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
