"""New documents held against postings that stay, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from palimpsest.functions import columns as C


def weigh(leaves: DataFrame, vocabulary: DataFrame, low: int = 1, high: int = 3) -> DataFrame:
    """``corpus, leaf_id, term, w`` of ``corpus, leaf_id, lemmas`` under a vocabulary ``term, idf`` that is fitted already."""
    from pyspark.sql import Window

    counts = leaves.select("corpus", "leaf_id", F.explode(C.ngrams(F.col("lemmas"), low, high)).alias("term")).groupBy("corpus", "leaf_id", "term").agg(F.count("*").alias("n"))
    doc = Window.partitionBy("corpus", "leaf_id")
    weights = counts.withColumn("tf", F.col("n") / F.max("n").over(doc)).join(vocabulary.select("term", "idf"), "term").withColumn("raw", F.col("tf") * F.col("idf"))
    return weights.withColumn("w", F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(doc))).where("w > 0").select("corpus", "leaf_id", "term", "w")


def match_batch(batch: DataFrame, known: DataFrame, vocabulary: DataFrame, threshold: float, low: int = 1, high: int = 3) -> DataFrame:
    """Pairs of new leaves and known postings at or above a similarity."""
    own = weigh(batch, vocabulary, low, high).select(F.col("corpus").alias("left_corpus"), F.col("leaf_id").alias("left_id"), "term", F.col("w").alias("a"))
    other = known.select(F.col("corpus").alias("right_corpus"), F.col("leaf_id").alias("right_id"), "term", F.col("w").alias("b"))
    found = own.join(other, "term").groupBy("left_corpus", "left_id", "right_corpus", "right_id").agg(F.sum(F.col("a") * F.col("b")).alias("cos_sim"))
    return found.where(F.col("cos_sim") >= threshold)


def match_stream(stream: DataFrame, known: DataFrame, vocabulary: DataFrame, threshold: float, sink: Callable[[DataFrame, int], None], low: int = 1, high: int = 3) -> DataStreamWriter:
    """A writer that hands the matches of every batch of ``corpus, leaf_id, lemmas`` to ``sink`` with the batch's number.

    Each document is matched once, when it comes; a sink that writes under the batch's number stays right when a batch is done again.
    """
    return stream.writeStream.foreachBatch(lambda batch, number: sink(match_batch(batch, known, vocabulary, threshold, low, high), number))
