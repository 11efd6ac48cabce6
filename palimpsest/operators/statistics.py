"""Summaries of segments, pairs and strategies."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import columns as C


def summary(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Number, mean, median, largest, and the interpolated 90 and 95 per cent points."""
    return rows.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.max(value).alias("max"),
        F.percentile(value, 0.9).alias("p90"), F.percentile(value, 0.95).alias("p95"),
    )


def segment_statistics(segments: DataFrame, by: Sequence[str] = ("corpus",)) -> DataFrame:
    """Each corpus' segments: how many, and the least, median and most words and characters."""
    sized = segments.withColumns({"_words": F.size(C.words(F.col("text"))), "_chars": F.length("text")})
    out = [F.count("*").alias("segments")]
    for name in ("words", "chars"):
        out += [F.min(f"_{name}").alias(f"min_{name}"), F.median(f"_{name}").alias(f"median_{name}"), F.max(f"_{name}").alias(f"max_{name}")]
    return sized.groupBy(*by).agg(*out)


def correlations(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Pearson's r of every two measures, the strongest first; 0 where one of them is constant or there are fewer than two rows."""
    pairs = list(combinations(metrics, 2))
    one = rows.agg(*(F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    stack = ", ".join(f"'{a}', '{b}', r{i}" for i, (a, b) in enumerate(pairs))
    out = one.selectExpr(f"stack({len(pairs)}, {stack}) AS (metric_a, metric_b, r)").withColumn("r", F.coalesce(F.when(~F.isnan("r"), F.col("r")), F.lit(0.0)))
    return out.orderBy(F.desc(F.abs("r")), "metric_a", "metric_b")


def top_corpus_pairs(candidates: DataFrame, n: int = 20) -> DataFrame:
    return candidates.groupBy("left_corpus", "right_corpus").agg(F.count("*").alias("pairs")).orderBy(F.desc("pairs"), "left_corpus", "right_corpus").limit(n)


def most_pairs(counts: DataFrame, n: int = 20) -> DataFrame:
    """``top_corpus_pairs`` of pairs that are counted already, in several rows of a corpus pair or one."""
    return counts.groupBy("left_corpus", "right_corpus").agg(F.sum("pairs").alias("pairs")).orderBy(F.desc("pairs"), "left_corpus", "right_corpus").limit(n)


def scoring_summary(rows: DataFrame, beta: float, threshold: float, share: float) -> DataFrame:
    """How many pairs a gate on the cheap measures would let through, and how they are distributed."""
    from palimpsest.operators.metrics import gate

    passed = gate(F.col("cos_sim"), F.col("tesserae"), beta, threshold, share)
    return rows.agg(
        F.count("*").alias("pairs"), F.sum(passed.cast("int")).alias("passed"), F.avg(passed.cast("int")).alias("pass_rate"),
        *(f(m).alias(f"{name}_{m}") for m in ("cos_sim", "tesserae") for name, f in (("median", F.median), ("max", F.max))),
    )


def strategy_summary(rows: DataFrame) -> DataFrame:
    """Of ranked pairs: shares on the front and first of their corpus pair, mean layer, and means of the measures."""
    metrics = ("cos_sim", "tesserae", "soft_cos", "sw_norm")
    return rows.agg(
        F.count("*").alias("pairs"), F.avg(F.col("pareto_on_front").cast("int")).alias("on_front"), F.avg((F.col("rank_final_position") == 1).cast("int")).alias("first"),
        F.avg("pareto_layer").alias("mean_layer"), *(F.avg(m).alias(f"mean_{m}") for m in metrics),
    )


def token_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """``key, token, removed``: how many of each token of ``before`` are missing in ``after``, repeats counted (columns ``key, tokens``)."""
    a = before.select(key, F.explode("tokens").alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))
    b = after.select(key, F.explode("tokens").alias("token")).groupBy(key, "token").agg(F.count("*").alias("m"))
    return a.join(b, [key, "token"], "left").select(key, "token", (F.col("n") - F.coalesce("m", F.lit(0))).alias("removed")).where("removed > 0")


def zones(rows: DataFrame, key: str, order: str, per_zone: int) -> DataFrame:
    """The first, middle and last ``per_zone`` rows of each ``key``, with their ``zone``; a row is in one zone only."""
    w = Window.partitionBy(key)
    ranked = rows.withColumns({"_i": F.row_number().over(w.orderBy(order)), "_n": F.count("*").over(w)})
    middle = F.floor((F.col("_n") - per_zone) / 2)
    zone = F.when(F.col("_i") <= per_zone, "first").when(F.col("_i") > F.col("_n") - per_zone, "last").when((F.col("_i") > middle) & (F.col("_i") <= middle + per_zone), "middle")
    return ranked.withColumn("zone", zone).where("zone IS NOT NULL").drop("_i", "_n")


def registry_differences(**registries: DataFrame) -> DataFrame:
    """``name, missing_in``: names (column ``name``) that some of the tables have and others lack."""
    out = None
    for a, left in registries.items():
        for b, right in registries.items():
            if a != b:
                rows = left.select("name").join(right.select("name"), "name", "left_anti").withColumn("missing_in", F.lit(b))
                out = rows if out is None else out.union(rows)
    return out.distinct()
