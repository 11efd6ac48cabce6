"""Measures of a pair of segments over their lemmas."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import alignment as A

#: How alignment and soft cosine score.
MODEL: Mapping = {
    "soft_cosine_max_terms": 500, "sw_match": 2, "sw_mismatch": -1, "sw_gap": -1, "sw_lev_bonus_threshold": 2, "sw_max_seq_len": 300,
}


def enriched(candidates: DataFrame, leaves: DataFrame, columns: list[str]) -> DataFrame:
    """Candidates with ``columns`` of both leaves as ``left_<c>`` and ``right_<c>``; corpus and id are the key. Of leaves that share it the last by ``pos`` stands."""
    out = candidates
    if "pos" in leaves.columns:
        last = leaves.groupBy("side", "corpus", "leaf_id").agg(F.max_by(F.struct(*columns), "pos").alias("_own"))
        leaves = last.select("side", "corpus", "leaf_id", *(F.col("_own")[c].alias(c) for c in columns))
    for side in ("left", "right"):
        own = leaves.where(F.col("side") == side).select(
            F.col("corpus").alias(f"{side}_corpus"), F.col("leaf_id").alias(f"{side}_id"), *(F.col(c).alias(f"{side}_{c}") for c in columns)
        )
        out = out.join(own, [f"{side}_corpus", f"{side}_id"])
    return out


def with_tesserae(pairs: DataFrame, idf: DataFrame, key: tuple[str, ...] = ("left_corpus", "left_id", "right_corpus", "right_id")) -> DataFrame:
    """Add ``tesserae``; needs ``left_lemmas`` and ``right_lemmas``. Joined on the shared lemmas, so no table of idf travels."""
    shared = pairs.select(*key, F.explode(F.array_intersect("left_lemmas", "right_lemmas")).alias("term"))
    sums = shared.join(idf.select("term", "idf"), "term", "left").groupBy(*key).agg(F.sum(F.coalesce("idf", F.lit(0.0))).alias("_sum"), F.count("*").alias("_shared"))
    norm = F.sqrt(F.size(F.array_distinct("left_lemmas")) * F.size(F.array_distinct("right_lemmas")))
    return pairs.join(sums, list(key), "left").withColumn("tesserae", F.when(F.col("_shared") >= 2, F.col("_sum") / norm).otherwise(0.0)).drop("_sum", "_shared")


def with_alignment(pairs: DataFrame, model: Mapping | None = None) -> DataFrame:
    """Add ``soft_cos, sw_score_raw, sw_norm, alignment_a, alignment_b``: one vectorised pass.

    The norm divides by the shorter whole list, though the alignment sees its first tokens only.
    """
    own = {**MODEL, **(model or {})}
    schema = ", ".join(f"`{c}` {t}" for c, t in pairs.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            soft, raw, norm, rows_a, rows_b = [], [], [], [], []
            for a, b in zip(pdf["left_lemmas"], pdf["right_lemmas"], strict=True):
                a, b = (list(x) if x is not None else [] for x in (a, b))
                x, y, score = A.smith_waterman(a, b, own["sw_match"], own["sw_mismatch"], own["sw_gap"], own["sw_lev_bonus_threshold"], own["sw_max_seq_len"])
                soft.append(A.soft_cosine(a, b, 2, own["soft_cosine_max_terms"]))
                raw.append(score)
                norm.append(score / max(1, min(len(a), len(b))))
                rows_a.append(x)
                rows_b.append(y)
            yield pdf.assign(soft_cos=np.array(soft, float), sw_score_raw=np.array(raw, float), sw_norm=np.array(norm, float), alignment_a=rows_a, alignment_b=rows_b)

    return pairs.mapInPandas(run, f"{schema}, soft_cos double, sw_score_raw double, sw_norm double, alignment_a array<string>, alignment_b array<string>")


def pair_metrics(candidates: DataFrame, leaves: DataFrame, idf: DataFrame, model: Mapping | None = None) -> DataFrame:
    """All four measures of the candidates whose lists both hold lemmas."""
    pairs = enriched(candidates, leaves, ["lemmas"]).where((F.size("left_lemmas") > 0) & (F.size("right_lemmas") > 0))
    return with_alignment(with_tesserae(pairs, idf), model).drop("left_lemmas", "right_lemmas")


def term_similarity(a: Column, b: Column, most: int = 2) -> Column:
    """1 for equal terms, less by edits, 0 above ``most``."""
    d = F.levenshtein(a, b, most)
    return F.when(a == b, 1.0).when((d < 0) | (F.abs(F.length(a) - F.length(b)) > most), 0.0).otherwise(1.0 - d / F.greatest(F.length(a), F.length(b), F.lit(1)))


def soft_cosine_native(pairs: DataFrame, key: str, a: str, b: str, most: int = 2) -> DataFrame:
    """``key, soft_cos`` by joins: terms of a pair meet each other, so the cost is that of the lists and not of the table."""
    counts = {}
    for side, column in (("a", a), ("b", b)):
        counts[side] = pairs.select(key, F.explode(column).alias("t")).groupBy(key, "t").agg(F.count("*").alias("n"))

    def form(x: DataFrame, y: DataFrame, name: str) -> DataFrame:
        both = x.join(y.select(key, F.col("t").alias("u"), F.col("n").alias("m")), key)
        return both.groupBy(key).agg(F.sum(F.col("n") * F.col("m") * term_similarity(F.col("t"), F.col("u"), most)).alias(name))

    out = form(counts["a"], counts["b"], "ab").join(form(counts["a"], counts["a"], "aa"), key).join(form(counts["b"], counts["b"], "bb"), key)
    return out.select(key, F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).otherwise(0.0).alias("soft_cos"))


def hard_cosine_native(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """``key, hard_cos`` of raw counts."""
    x = pairs.select(key, F.explode(a).alias("t")).groupBy(key, "t").agg(F.count("*").alias("n"))
    y = pairs.select(key, F.explode(b).alias("t")).groupBy(key, "t").agg(F.count("*").alias("m"))
    both = x.join(y, [key, "t"], "full").na.fill(0, ["n", "m"])
    sums = both.groupBy(key).agg(F.sum(F.col("n") * F.col("m")).alias("ab"), F.sum(F.col("n") * F.col("n")).alias("aa"), F.sum(F.col("m") * F.col("m")).alias("bb"))
    return sums.select(key, F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).otherwise(0.0).alias("hard_cos"))


def shared_stats(a: Column, b: Column) -> dict[str, Column]:
    """Sizes and overlaps of the two sets of lemmas."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return {
        "shared": both, "union": either,
        "jaccard": F.when(either > 0, both / either).otherwise(0.0),
        "overlap": F.when(least > 0, both / least).otherwise(0.0),
    }


def alignment_stats(x: Column, y: Column, left: Column, right: Column, score: Column) -> dict[str, Column]:
    """An alignment's length, exact matches, gaps, how much of each list it covers, and its score by three lengths."""
    pairs = F.arrays_zip(x.alias("x"), y.alias("y"))
    n = F.size(x)
    count = lambda f: F.size(F.filter(pairs, f))
    real = lambda v: F.size(F.filter(v, lambda t: t != "-"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return {
        "alignment_length": n,
        "exact_matches": count(lambda p: p["x"] == p["y"]),
        "gaps": count(lambda p: (p["x"] == "-") | (p["y"] == "-")),
        "coverage_left": ratio(real(x), F.size(left)),
        "coverage_right": ratio(real(y), F.size(right)),
        "sw_by_min": ratio(score, F.least(F.size(left), F.size(right))),
        "sw_by_max": ratio(score, F.greatest(F.size(left), F.size(right))),
        "sw_by_alignment": ratio(score, n),
    }


def tesserae_evidence(pairs: DataFrame, idf: DataFrame, key: list[str]) -> DataFrame:
    """The shared lemmas of each pair with what each gives to the score, the rarest first."""
    norm = F.sqrt(F.size(F.array_distinct("left_lemmas")) * F.size(F.array_distinct("right_lemmas")))
    shared = pairs.select(*key, norm.alias("norm"), F.explode(F.array_intersect("left_lemmas", "right_lemmas")).alias("term"))
    found = shared.join(idf.select("term", "idf"), "term", "left").withColumn("idf", F.coalesce("idf", F.lit(0.0)))
    return found.select(*key, "term", "idf", (F.col("idf") / F.col("norm")).alias("contribution"), "norm").orderBy(*key, F.desc("idf"), "term")


def soft_evidence(pairs: DataFrame, key: list[str], most: int = 2) -> DataFrame:
    """Equal terms and near ones of each pair, by what they give to the soft cosine's numerator."""
    a = pairs.select(*key, F.explode("left_lemmas").alias("left_term")).groupBy(*key, "left_term").agg(F.count("*").alias("n"))
    b = pairs.select(*key, F.explode("right_lemmas").alias("right_term")).groupBy(*key, "right_term").agg(F.count("*").alias("m"))
    both = a.join(b, key).withColumn("similarity", term_similarity(F.col("left_term"), F.col("right_term"), most)).where("similarity > 0")
    both = both.withColumn("contribution", F.col("n") * F.col("m") * F.col("similarity")).withColumn("exact", F.col("left_term") == F.col("right_term"))
    return both.orderBy(*key, F.desc("contribution"), "left_term", "right_term")


def gate(cos: Column, tess: Column, beta: float, final_threshold: float, share: float) -> Column:
    """A retired pre-filter: whether a pair is worth the full score; one without a measure isn't. The bound is the product of the numbers as written (0.3 times 1.5 is 0.45)."""
    bound = float(Decimal(str(final_threshold)) * Decimal(str(share)))
    return F.coalesce(cos + F.lit(beta) * tess > bound, F.lit(False))


def vector_distance(x: DataFrame, y: DataFrame, key: str = "term", value: str = "n") -> DataFrame:
    """One row ``distance``: 1 - cosine of two tables of counts over the terms of either."""
    both = x.select(key, F.col(value).alias("a")).join(y.select(key, F.col(value).alias("b")), key, "full").na.fill(0)
    sums = both.agg(F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"))
    return sums.select((1.0 - F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.col("ab") / F.sqrt(F.col("aa").cast("double") * F.col("bb"))).otherwise(0.0)).alias("distance"))
