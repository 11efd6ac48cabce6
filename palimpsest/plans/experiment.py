"""An experiment from files or tables to edges: seven stages, each a table."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import columns as C
from palimpsest.functions import latin
from palimpsest.operators import edges as E
from palimpsest.operators import metrics as M
from palimpsest.operators import pareto, ranking, retrieval
from palimpsest.operators.chunking import chunk
from palimpsest.plans.checkpoints import Stages, fingerprints
from palimpsest.plans.config import Experiment
from palimpsest.sources import corpora as sources
from palimpsest.sources import segmenters
from palimpsest.workspace import stored


@dataclass
class Result:
    experiment: Experiment
    leaves: DataFrame
    candidates: DataFrame
    detail: DataFrame
    edges: DataFrame
    nodes: DataFrame


def on_sides(segments: DataFrame, exp: Experiment) -> DataFrame:
    """Each corpus' segments on the sides that name it; a corpus on both has them twice."""
    spark = segments.sparkSession
    rows = [(side, c, i) for side, own in (("left", exp.left), ("right", exp.right)) for c, i in sources.order_of(own).items()]
    sides = spark.createDataFrame(rows, "side string, corpus string, corpus_order int")
    return segments.join(F.broadcast(sides), "corpus")


def leaves_of(segments: DataFrame, exp: Experiment) -> DataFrame:
    """``side, corpus, corpus_order, pos, leaf_id, parent_id, text``."""
    own = asdict(exp.chunking)
    cut = chunk(on_sides(segments, exp), **own)
    return cut.select("side", "corpus", "corpus_order", "pos", "leaf_id", "parent_id", "text")


def candidates_of(leaves: DataFrame, exp: Experiment) -> DataFrame:
    model, spark = exp.model, leaves.sparkSession
    postings = retrieval.tfidf(leaves, "lemmas", *model.ngram_range, model.max_df, model.min_df)
    own = asdict(exp.retrieval)
    both = own.pop("bidirectional")
    return retrieval.candidates(spark, leaves, postings, exp.left, exp.right, exp.mappings, own, both)


def metrics_of(candidates: DataFrame, leaves: DataFrame, exp: Experiment) -> DataFrame:
    """The four measures of every candidate, with ids, nodes and snippets."""
    idf = retrieval.idf_table(leaves)
    rows = M.enriched(candidates, leaves, ["lemmas", "parent_id", "text"]).where((F.size("left_lemmas") > 0) & (F.size("right_lemmas") > 0))
    rows = rows.withColumns({"left_text_snippet": C.snippet(F.col("left_text")), "right_text_snippet": C.snippet(F.col("right_text"))}).drop("left_text", "right_text")
    rows = M.with_alignment(M.with_tesserae(rows, idf), asdict(exp.model)).drop("left_lemmas", "right_lemmas")
    rows = rows.withColumnsRenamed({"left_id": "left_leaf_id", "right_id": "right_leaf_id"})
    rows = rows.withColumn("right_doc_no", C.doc_no(F.col("right_parent_id")))
    agg = exp.aggregation
    return rows.withColumns({"left_node": E.node_id(agg.left_node_level, "left"), "right_node": E.node_id(agg.right_node_level, "right")})


DETAIL = (
    "left_leaf_id right_leaf_id left_parent_id right_parent_id left_corpus right_corpus left_node right_node right_doc_no cos_sim tesserae soft_cos "
    "sw_score_raw sw_norm alignment_a alignment_b left_text_snippet right_text_snippet pareto_layer pareto_on_front rank_cos rank_tess rank_soft rank_sw "
    "rank_sum rank_final_position rank_score"
).split()


def ranked(metrics: DataFrame, exp: Experiment) -> DataFrame:
    """Rows of the first layers, ranked; alignments are cut to 25 tokens."""
    kept = pareto.pareto_layers(metrics, exp.keep_layers)
    rows = ranking.rank_aggregate(kept, ids=("left_leaf_id", "right_leaf_id"))
    rows = rows.withColumns({c: F.slice(c, 1, 25) for c in ("alignment_a", "alignment_b")})
    return rows.select(*DETAIL)


def run(spark: SparkSession, exp: Experiment, segments: DataFrame, corpora: DataFrame | None = None, folder: str | None = None, marks: Mapping | None = None, force_from: int | None = None) -> Result:
    """All stages over ``corpus, pos, seg_id, text``. With a ``folder`` each stage's table stays there for a later run with equal settings."""
    exp.validate()
    corpora = sources.corpora_frame(spark) if corpora is None else corpora
    stages = Stages(spark, folder, fingerprints(exp.as_dict(), dict(marks or {})), force_from)
    base = stages.get("segments", lambda: segments)
    cut = stages.get("leaves", lambda: leaves_of(base, exp))
    found = stages.get("lemmas", lambda: latin.lemmatize_segments(cut, min_length=exp.model.min_lemma_length))
    leaves = found if folder else stored(spark, found, "lemmas")
    candidates = stages.get("candidates", lambda: candidates_of(leaves, exp))
    candidates = candidates if folder else stored(spark, candidates, "candidates")
    metrics = stages.get("metrics", lambda: metrics_of(candidates, leaves, exp))
    detail = stages.get("ranked", lambda: ranked(metrics, exp))
    detail = detail if folder else stored(spark, detail, "ranked")
    agg = exp.aggregation
    edges = stages.get("edges", lambda: E.top_edges(E.aggregate_edges(detail, agg.left_node_level, agg.right_node_level, agg.weight_mode, agg.min_hits), exp.graph_top_n))
    nodes = None
    for side, own, level in (("left", exp.left, agg.left_node_level), ("right", exp.right, agg.right_node_level)):
        order = spark.createDataFrame(list(sources.order_of(own).items()) or [("", 0)], "corpus string, group_order int")
        table = E.node_table(leaves, corpora, level, side, order)
        nodes = table if nodes is None else nodes.union(table)
    return Result(exp, leaves, candidates, ranking.detail_order(detail), E.known_edges(edges, nodes).orderBy(F.desc("weight"), "best_rank", "left_node", "right_node"), nodes)


def run_files(spark: SparkSession, exp: Experiment, root: str = ".", folder: str | None = None, force_from: int | None = None, corpora: Mapping | None = None) -> Result:
    """The same from the corpora's files below ``root``, which are segmented first."""
    known = sources.CORPORA if corpora is None else corpora
    exp = exp.resolved()
    paths = {c: f"{root.rstrip('/')}/{known[c]['path']}" for c in exp.corpora}
    meta = {r["path"].rsplit("/", 1)[-1]: r["sha256"] for r in sources.file_meta(spark, paths).collect()} if folder else {}
    found = segmenters.segments(sources.read_files(spark, paths))
    return run(spark, exp, found, sources.corpora_frame(spark, known), folder, meta, force_from)


