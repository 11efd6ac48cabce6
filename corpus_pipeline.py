"""A training corpus from ``documents``: five stages, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import jaccard, language, mixing, packing, quality
from palimpsest.llm.arrow import unused
from palimpsest.workspace import stored

#: A document stays if its language is as sure as this, and its quality this high.
LEAST_LANGUAGE, LEAST_QUALITY = 0.4, 0.5

#: Near duplicates: words of a shingle, and the least similarity in hundredths.
SHINGLE, SIMILAR = 5, 80


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, also null and empty texts, and those whose best language isn't sure.

    Every row is judged by its own text, so repeated rows go or stay together and a null id or source doesn't matter. A certainty of just
    LEAST_LANGUAGE stays. An empty table stays empty. Other columns go along, whatever their names.
    """
    lang, sure = unused("lang_pred", docs.columns), unused("sure", docs.columns)
    found = language.identify(docs, language.learned(docs), keep=docs.columns, names=(lang, sure))
    return found.where((F.col(lang) != "und") & (F.col(sure) >= LEAST_LANGUAGE)).drop(lang, sure)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose lines the field marks as bad, by their length.

    Every row is judged by its own text; a null text is an empty one, which has a score as any other. A score of just LEAST_QUALITY stays.
    An empty table stays empty. Other columns go along, whatever their names.
    """
    score = unused("quality", docs.columns)
    found = quality.score(docs, quality.learned(spark, docs, sf_dir), keep=docs.columns, name=score)
    return found.where(F.col(score) >= LEAST_QUALITY).drop(score)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 0.8 or more over five-word shingles join, directly or through others, the one with the smallest id stays.

    Rows are told apart by their texts: texts that differ under one id, and rows without an id, are each judged on their own, rows without an id
    after the others. Of rows equal in id and words one stays; null and empty texts link with nothing and all stay. An empty table stays
    empty. Other columns go along, whatever their names.
    """
    return jaccard.first_of_each_group(spark, docs, size=SHINGLE, percent=SIMILAR)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source's words as near to its target as words allow: repeated, whole or in part.

    A null source is a source of its own. A null or empty text has no words, so no mix takes it and it goes; rows that repeat are mixed each on
    its own, rows equal in all that orders them in any order. An empty table stays empty. Other columns go along, whatever their names.
    """
    return mixing.mixed_rows(spark, docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of up to 2048 ids: a row per piece, with its ids.

    A null or empty text is the single id that ends a document. Rows with equal ids are packed each on its own, null ids are carried along, other
    columns are left out. An empty table gives no pieces.
    """
    return packing.pack_sequences(docs, packing.tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("quality", good_quality),
    ("near_duplicates", one_of_each_group),
    ("mix", mixed),
    ("pack", packed),
]

#: Its models and tokens can't be told in SQL; the tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(spark, docs, name)
    return docs
