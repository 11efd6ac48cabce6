"""The pair lab: for every two corpora their nearest segments, each pair measured and ranked within its corpus pair."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators import edges, metrics, pareto, ranking, retrieval, statistics
from palimpsest.plans.config import Model
from palimpsest.workspace import stored

#: Right segments of a left one, and pairs of two corpora.
PER_LEFT, PER_PAIR = 1, 5

METRICS = ("cos_sim", "tesserae", "soft_cos", "sw_norm", "sw_score_raw", "jaccard", "overlap", "shared", "alignment_length")


def lab_candidates(leaves: DataFrame, pairs: Sequence[tuple[str, str]], model: Model = Model(), per_left: int = PER_LEFT, per_pair: int = PER_PAIR) -> DataFrame:
    """The most similar segments of each two corpora, under weights fitted to those two alone.

    ``leaves`` (``corpus, leaf_id, lemmas``) is laid out once for each pair that a corpus is in; the pair is a key of every later step.
    """
    spark = leaves.sparkSession
    sides = spark.createDataFrame([(a, b, s, a if s == "left" else b) for a, b in pairs for s in ("left", "right")], "pair_left string, pair_right string, side string, corpus string")
    laid = leaves.select("corpus", "leaf_id", "lemmas").join(F.broadcast(sides), "corpus")
    by = ["pair_left", "pair_right"]
    postings = retrieval.tfidf(laid, "lemmas", *model.ngram_range, model.max_df, model.min_df, fit_by=by)
    found = retrieval.similarities(postings, retrieval.pairs_frame(spark, pairs), on=by)
    best = retrieval.top_per_left(found, per_left)
    order = Window.partitionBy("left_corpus", "right_corpus").orderBy(F.desc("cos_sim"), "left_id", "right_id")
    return best.withColumn("cand_pos", F.row_number().over(order)).where(F.col("cand_pos") <= per_pair)


def lab_rows(candidates: DataFrame, leaves: DataFrame, model: Model = Model()) -> DataFrame:
    """All measures of the pairs, how much lists share, and what alignments cover."""
    from dataclasses import asdict

    both = leaves.select("corpus", "leaf_id", "lemmas")
    sided = both.withColumn("side", F.lit("left")).unionByName(both.withColumn("side", F.lit("right")))
    rows = metrics.enriched(candidates, sided, ["lemmas"]).where((F.size("left_lemmas") > 0) & (F.size("right_lemmas") > 0))
    rows = metrics.with_alignment(metrics.with_tesserae(rows, retrieval.idf_table(both)), asdict(model))
    rows = rows.withColumns(metrics.shared_stats(F.col("left_lemmas"), F.col("right_lemmas")))
    rows = rows.withColumns(metrics.alignment_stats(F.col("alignment_a"), F.col("alignment_b"), F.col("left_lemmas"), F.col("right_lemmas"), F.col("sw_score_raw")))
    return rows.withColumns({"left_length": F.size("left_lemmas"), "right_length": F.size("right_lemmas")}).drop("left_lemmas", "right_lemmas")


def strategies(rows: DataFrame) -> DataFrame:
    """Ranks, Borda points and Pareto layers within each corpus pair."""
    return pareto.pareto_layers(ranking.borda(rows), None, by=["left_corpus", "right_corpus"])


def run(leaves: DataFrame, left: Sequence[str], right: Sequence[str], model: Model = Model()) -> Mapping[str, DataFrame]:
    """``rows``, ``strategies``, and the summaries over them."""
    pairs = edges.corpus_pairs(list(left), list(right))
    spark = leaves.sparkSession
    rows = stored(spark, lab_rows(lab_candidates(leaves, pairs, model), leaves, model), "lab")
    ranked = stored(spark, strategies(rows), "strategies")
    return {
        "rows": rows,
        "strategies": ranked,
        "correlations": statistics.correlations(rows, METRICS),
        "by_pair": statistics.summary(rows, "soft_cos", ["left_corpus", "right_corpus"]),
        "summary": statistics.strategy_summary(ranked),
    }


def report(found: Mapping[str, DataFrame], n: int = 10) -> str:
    """A text: strongest correlations, then the best pairs by several orders."""
    lines = ["CORRELATIONS", *(f"  {r['metric_a']} ~ {r['metric_b']}: {r['r']:+.3f}" for r in found["correlations"].collect())]
    for by in ("soft_cos", "tesserae", "soft-tess", "sw-cos"):
        lines += ["", f"BEST BY {by}"]
        for r in ranking.report_top(found["rows"], n, by).collect():
            lines.append(f"  {r['left_id']} | {r['right_id']}  cos {r['cos_sim']:.4f} tess {r['tesserae']:.4f} soft {r['soft_cos']:.4f} sw {r['sw_norm']:.4f}")
    s = found["summary"].first()
    lines += ["", f"PAIRS {s['pairs']}  on front {s['on_front'] or 0:.3f}  first {s['first'] or 0:.3f}  mean layer {s['mean_layer'] or 0:.3f}"]
    return "\n".join(lines) + "\n"
