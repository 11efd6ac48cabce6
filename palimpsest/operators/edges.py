"""Edges between nodes: grouping pairs, node tables, undirected sums, degrees and paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import columns as C
from palimpsest.workspace import stored

GREY = "#999999"


def node_id(level: str, side: str) -> Column:
    """A pair's node on one side: its leaf, parent or corpus."""
    if level not in ("leaf", "parent", "corpus"):
        raise ValueError(f"Unknown node level: {level}")
    return F.col({"leaf": f"{side}_leaf_id", "parent": f"{side}_parent_id", "corpus": f"{side}_corpus"}[level])


def aggregate_edges(detail: DataFrame, left_level: str = "parent", right_level: str = "parent", weight_mode: str = "max", min_hits: int = 1) -> DataFrame:
    """A row for each pair of nodes: the sum or the largest of its rows' scores, how many there are, and the best ranked one.

    Edges of fewer than ``min_hits`` rows go. In order of weight, then rank and nodes.
    """
    if weight_mode not in ("sum", "max"):
        raise ValueError(f"Unknown weight_mode: {weight_mode}")
    best = ["rank_score", "left_leaf_id", "right_leaf_id", "left_parent_id", "right_parent_id", "left_corpus", "right_corpus", "right_doc_no", "tesserae", "soft_cos", "sw_norm", "cos_sim", "pareto_layer"]
    weight = F.sum("rank_score") if weight_mode == "sum" else F.max("rank_score")
    grouped = detail.groupBy("left_node", "right_node").agg(
        weight.alias("weight"), F.count("*").alias("hit_count"), F.min("rank_final_position").alias("best_rank"), F.min_by(F.struct(*best), "rank_final_position").alias("b")
    )
    whole = {"left_corpus", "right_corpus", "right_doc_no"}
    return (
        grouped.where(F.col("hit_count") >= min_hits)
        .select("left_node", "right_node", F.lit(left_level).alias("left_level"), F.lit(right_level).alias("right_level"), "weight", "hit_count", "best_rank", *(F.col(f"b.{c}").alias(c if c in whole else f"best_{c}") for c in best))
        .orderBy(F.desc("weight"), "best_rank", "left_node", "right_node")
    )


def top_edges(edges: DataFrame, n: int) -> DataFrame:
    return edges.orderBy(F.desc("weight"), "best_rank", "left_node", "right_node").limit(n)


def node_table(leaves: DataFrame, corpora: DataFrame, level: str, side: str, order: DataFrame) -> DataFrame:
    """``side, node_id, grp, group_order, label, legend_label, color`` of one side's nodes, each as its first leaf has it.

    ``corpora`` has corpus, display and color; what it doesn't know is grey and has its own id for a name. ``order`` has corpus and
    its place. Nodes are keyed by side and id, as the same id may be on both.
    """
    own = leaves.where(F.col("side") == side)
    node = {"leaf": "leaf_id", "parent": "parent_id", "corpus": "corpus"}[level]
    first = own.groupBy(F.col(node).alias("node_id")).agg(F.min_by("corpus", "pos").alias("grp"), F.min_by("parent_id", "pos").alias("parent_id"))
    named = first.join(F.broadcast(corpora.select(F.col("corpus").alias("grp"), "display", "color")), "grp", "left")
    named = named.join(F.broadcast(order.select(F.col("corpus").alias("grp"), "group_order")), "grp", "left")
    legend = F.coalesce("display", "grp")
    label = legend if level == "corpus" else F.col("node_id")
    doc = F.lit(None).cast("int") if level == "corpus" else C.doc_no(F.col("parent_id"))
    return named.select(F.lit(side).alias("side"), "node_id", "grp", F.coalesce("group_order", F.lit(10**9)).alias("group_order"), label.alias("label"), legend.alias("legend_label"), F.coalesce("color", F.lit(GREY)).alias("color"), doc.alias("doc_no"))


def natural_key(text: Column) -> Column:
    """What sorts digit runs as numbers: structs of (0, number, '') and (1, 0, text)."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"\d+|\D+"), F.lit(0))
    return F.transform(
        parts,
        lambda x: F.struct(
            F.when(x.rlike(r"^\d"), 0).otherwise(1).alias("kind"),
            F.when(x.rlike(r"^\d"), x.cast("decimal(38,0)")).otherwise(F.lit(0).cast("decimal(38,0)")).alias("number"),
            F.when(x.rlike(r"^\d"), "").otherwise(x).alias("word"),
        ),
    )


def node_order(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy("side", "group_order", F.col("doc_no").asc_nulls_last(), natural_key(F.col("node_id")), "label")


def known_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both in the node table."""
    out = edges
    for side in ("left", "right"):
        out = out.join(nodes.where(F.col("side") == side).select(F.col("node_id").alias(f"{side}_node")), f"{side}_node", "left_semi")
    return out


def collapse_undirected(edges: DataFrame, u: str = "u", v: str = "v", weight: str = "weight") -> DataFrame:
    """``u, v, weight`` with u < v: both directions added up, loops left out, a weight that is no number as 1."""
    w = F.coalesce(F.col(weight).try_cast("double"), F.lit(1.0))
    rows = edges.where(F.col(u) != F.col(v)).select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v"), w.alias("weight"))
    return rows.groupBy("u", "v").agg(F.sum("weight").alias("weight"))


def weighted_degree(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("u").alias("node"), "weight").union(edges.select(F.col("v").alias("node"), "weight"))
    return ends.groupBy("node").agg(F.sum("weight").alias("degree"))


def without_isolates(nodes: DataFrame, edges: DataFrame, key: str = "node") -> DataFrame:
    ends = edges.select(F.col("u").alias(key)).union(edges.select(F.col("v").alias(key))).distinct()
    return nodes.join(ends, key, "left_semi")


def emphasised(edges: DataFrame, n: int = 3) -> DataFrame:
    """Add ``width``: 4.0 for the ``n`` heaviest edges, 1.5 for the others."""
    heavy = edges.orderBy(F.desc("weight"), *edges.columns[:2]).limit(n).select(*edges.columns[:2]).withColumn("_top", F.lit(True))
    return edges.join(F.broadcast(heavy), edges.columns[:2], "left").withColumn("width", F.when(F.col("_top"), 4.0).otherwise(1.5)).drop("_top")


def with_thickness(edges: DataFrame) -> DataFrame:
    ends = edges.agg(F.min("weight").alias("_low"), F.max("weight").alias("_high"))
    return edges.join(F.broadcast(ends)).withColumn("thickness", C.thickness(F.col("weight"), F.col("_low"), F.col("_high"))).drop("_low", "_high")


def corpus_pairs(left: Sequence[str], right: Sequence[str]) -> list[tuple[str, str]]:
    """Of equal lists the pairs of the upper triangle, else all but those of a corpus with itself."""
    if list(left) == list(right):
        return [(a, b) for i, a in enumerate(left) for b in left[i + 1 :]]
    return [(a, b) for a in left for b in right if a != b]


def shortest_paths(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``source, target, distance`` between all nodes of a small undirected graph, an edge being 1 / weight long.

    Distances to ever farther nodes are relaxed until none gets shorter; the graph is one of corpora, so the table is small.
    """
    step = edges.where("weight > 0").selectExpr("u AS a", "v AS b", "1.0 / weight AS d").union(edges.where("weight > 0").selectExpr("v AS a", "u AS b", "1.0 / weight AS d"))
    found = step.selectExpr("a AS source", "b AS target", "d AS distance").union(step.selectExpr("a AS source", "a AS target", "CAST(0 AS DOUBLE) AS distance").distinct())
    nearest = lambda x: stored(spark, x.groupBy("source", "target").agg(F.min("distance").alias("distance")), "paths")
    found, seen = nearest(found), None
    while True:
        longer = found.join(step, found["target"] == step["a"]).select("source", F.col("b").alias("target"), (F.col("distance") + F.col("d")).alias("distance"))
        found = nearest(found.union(longer))
        now = found.agg(F.count("*"), F.round(F.sum("distance"), 9)).first()
        if now == seen:
            break
        seen = now
    return found
