"""Rank aggregation over four measures, and cuts of ranked rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.pareto import METRICS

RANKS = {"cos_sim": "rank_cos", "tesserae": "rank_tess", "soft_cos": "rank_soft", "sw_norm": "rank_sw"}


def rank_desc(value: str, ties: Sequence[str | Column], by: Sequence[str] = ()) -> Column:
    """Place from the highest value on; ``ties`` settle equal ones, so no two rows share a place."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), *ties))


def rank_aggregate(rows: DataFrame, ties: Sequence[str] = ("cand_pos",), ids: Sequence[str] = ("left_id", "right_id"), by: Sequence[str] = ()) -> DataFrame:
    """Add the four ranks, ``rank_sum``, ``rank_final_position`` and ``rank_score`` = 1 / position.

    Rows are at most the search's budget (within each group of ``by``), which one task ranks.
    """
    out = rows
    for metric, name in RANKS.items():
        out = out.withColumn(name, rank_desc(metric, ties, by))
    out = out.withColumn("rank_sum", sum((F.col(x) for x in RANKS.values()), F.lit(0)))
    order = [F.asc("rank_sum"), F.desc("tesserae"), F.desc("sw_norm"), F.desc("soft_cos"), F.desc("cos_sim"), *ids]
    out = out.withColumn("rank_final_position", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out.withColumn("rank_score", F.lit(1.0) / F.col("rank_final_position"))


def borda(rows: DataFrame, by: Sequence[str] = ("left_corpus", "right_corpus"), ties: Sequence[str] = ("cand_pos",)) -> DataFrame:
    """Add the ranks, ``rank_sum, rank_mean, rank_borda`` and ``rank_final_position``, all within each corpus pair."""
    out = rows
    for metric, name in RANKS.items():
        out = out.withColumn(name, rank_desc(metric, ties, by))
    n = F.count("*").over(Window.partitionBy(*by))
    total = sum((F.col(x) for x in RANKS.values()), F.lit(0))
    out = out.withColumn("rank_sum", total).withColumn("rank_mean", total / 4).withColumn("rank_borda", (n + 1) * 4 - total)
    order = [F.asc("rank_sum"), F.desc("rank_borda"), F.asc("rank_mean"), F.desc("tesserae"), F.desc("sw_norm"), F.desc("soft_cos"), F.desc("cos_sim"), *ties]
    return out.withColumn("rank_final_position", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def report_top(rows: DataFrame, n: int, by: str, ids: Sequence[str] = ("left_id", "right_id")) -> DataFrame:
    """The ``n`` highest by a measure, or by ``soft-tess`` or ``sw-cos``, where two disagree most."""
    value = {"soft-tess": F.col("soft_cos") - F.col("tesserae"), "sw-cos": F.col("sw_norm") - F.col("cos_sim")}.get(by)
    return rows.withColumn("_v", F.col(by) if value is None else value).orderBy(F.desc("_v"), *ids).limit(n).drop("_v")


def detail_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("rank_final_position", "left_corpus", "right_corpus", "left_leaf_id", "right_leaf_id")


__all__ = ["METRICS", "RANKS", "borda", "detail_order", "rank_aggregate", "rank_desc", "report_top"]
