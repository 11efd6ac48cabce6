"""Neighbouring words of old notebooks: cut endings, pairs of neighbours, and the strongest of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Endings in the order in which they come off.
ENDINGS = """
    int ent ient vnt ant are ere ire eat it et at atvr antvr arvm orvm ibvs vm vs es o am em is ias ia ae ii i e ate v a os
""".split()

#: Lines of these kinds are apparatus.
APPARATUS = r"\||HN|PHV|PNV"


def legacy_lines(lines: DataFrame, text: str = "text") -> DataFrame:
    """Lines that are no apparatus, in lower case with letters and blanks only."""
    kept = lines.where(~F.col(text).rlike(APPARATUS))
    return kept.withColumn(text, F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z ]", ""), " +", " ")))


def cut_endings(word: Column, endings: list[str] = ENDINGS, rounds: int = 3) -> Column:
    """u as v and j as i, then each ending in order taken off where it is, ``rounds`` times over."""
    table = F.array(*map(F.lit, endings * rounds))
    shorter = lambda x, e: F.when(x.endswith(e), F.left(x, F.length(x) - F.length(e))).otherwise(x)
    return F.aggregate(table, F.translate(F.translate(word, "u", "v"), "j", "i"), shorter)


def neighbour_counts(words: DataFrame, by: list[str], order: str = "pos", word: str = "word") -> DataFrame:
    """``w1, w2, n`` of neighbouring words within each ``by`` group, both ways round. Groups are lines or documents."""
    following = F.lead(word).over(Window.partitionBy(*by).orderBy(order))
    return _both_ways(words.select(F.col(word).alias("a"), following.alias("b")).where("b IS NOT NULL"))


def neighbours_in(rows: DataFrame, words: str) -> DataFrame:
    """The same of an array of words in each row: neighbours are paired inside the array, so nothing is sorted."""
    pair = F.expr(f"IF(size({words}) < 2, array(), transform(sequence(1, size({words}) - 1), i -> struct({words}[i - 1] AS a, {words}[i] AS b)))")
    return _both_ways(rows.select(F.inline(pair)))


def _both_ways(pairs: DataFrame) -> DataFrame:
    """Each direction is counted from the counts of ordered pairs."""
    once = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    return once.select(F.col("a").alias("w1"), F.col("b").alias("w2"), "n").union(once.select("b", "a", "n")).groupBy("w1", "w2").agg(F.sum("n").alias("n"))


def word_counts(words: DataFrame, word: str = "word") -> DataFrame:
    return words.groupBy(F.col(word).alias("term")).agg(F.count("*").alias("n"))


def strongest(pairs: DataFrame, n: int) -> DataFrame:
    """The ``n`` largest counts, each pair once."""
    once = pairs.groupBy(F.least("w1", "w2").alias("a"), F.greatest("w1", "w2").alias("b")).agg(F.max("n").alias("n"))
    return once.orderBy(F.desc("n"), "a", "b").limit(n)
