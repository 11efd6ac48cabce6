"""TF-IDF postings and the budgeted similarity join."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import columns as C

Pair = tuple[str, str]


def document_frequency(leaves: DataFrame, terms: Column) -> DataFrame:
    """``term, df``: leaves that hold it. A leaf that is on both sides counts twice, as it has a row for each."""
    return leaves.select(F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def idf_table(leaves: DataFrame, lemmas: str = "lemmas") -> DataFrame:
    """``term, df, idf`` of single lemmas: ln(N / df), with no bound on df."""
    n = leaves.count()
    return document_frequency(leaves, F.col(lemmas)).withColumn("idf", F.log(F.lit(float(n)) / F.col("df")))


def tfidf(leaves: DataFrame, lemmas: str = "lemmas", low: int = 1, high: int = 3, max_df: float | int = 0.5, min_df: int = 2, fit_by: Sequence[str] = ()) -> DataFrame:
    """Postings ``side, corpus, leaf_id, term, w`` of n-grams, each leaf's weights with length one.

    tf is a term's count by the largest count of any n-gram in the leaf, also of those that df rules out; idf is ln(N / df) over the
    leaves of both sides. Leaves whose weights are all zero have none. With ``fit_by`` every group of those columns is a corpus of its own.
    """
    by = list(fit_by)
    doc = ["side", "corpus", "leaf_id", *(c for c in by if c not in ("side", "corpus", "leaf_id"))]
    terms = leaves.select(*doc, F.explode(C.ngrams(F.col(lemmas), low, high)).alias("term"))
    counts = terms.groupBy(*doc, "term").agg(F.count("*").alias("count"))
    # groups of one leaf: bounded by its length
    counts = counts.withColumn("tf", F.col("count") / F.max("count").over(Window.partitionBy(*doc)))
    if by:
        total = leaves.groupBy(*by).agg(F.count("*").alias("n"))
        df = counts.groupBy(*by, "term").agg(F.count("*").alias("df")).join(total, by)
    else:
        df = counts.groupBy("term").agg(F.count("*").alias("df")).withColumn("n", F.lit(leaves.count()))
    most = F.floor(F.col("n") * F.lit(max_df)) if isinstance(max_df, float) else F.lit(max_df)
    vocabulary = df.where((F.col("df") >= min_df) & (F.col("df") <= most)).select(*by, "term", F.log(F.col("n") / F.col("df")).alias("idf"))
    weights = counts.join(vocabulary, [*by, "term"]).withColumn("raw", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(*doc)))
    return weights.withColumn("w", F.col("raw") / norm).where("w > 0").select(*doc, "term", "w")


def allowed_pairs(left: Sequence[str], right: Sequence[str], mappings: Iterable[tuple[Sequence[str], Sequence[str]]]) -> list[Pair]:
    """Corpus pairs that the mappings allow; all, where that is none."""
    found = {(a, b) for source, target in mappings for a in source if a in left for b in target if b in right}
    return sorted(found or {(a, b) for a in left for b in right})


def allowed_by_left(left: Sequence[str], right: Sequence[str], mappings: Iterable[tuple[Sequence[str], Sequence[str]]]) -> list[Pair]:
    """As the one-heap search has it: a left corpus that no mapping names gets every right corpus."""
    rows: dict[str, set[str]] = {a: set() for a in left}
    for source, target in mappings:
        for a in source:
            if a in rows:
                rows[a] |= set(target)
    return sorted((a, b) for a, own in rows.items() for b in (own or set(right)))


def pairs_frame(spark: SparkSession, pairs: Sequence[Pair]) -> DataFrame:
    return spark.createDataFrame(list(pairs), "left_corpus string, right_corpus string")


def similarities(postings: DataFrame, pairs: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """``left_corpus, right_corpus, left_id, right_id, cos_sim`` above zero.

    The allowed corpus pairs go into the join's key, so no product of a pair that isn't allowed is made; ``pairs`` comes from a
    configuration and has a row per corpus pair, small enough to send to every executor.
    """
    a = postings.where("side = 'left'").select(F.col("corpus").alias("left_corpus"), F.col("leaf_id").alias("left_id"), "term", F.col("w").alias("a"), *on)
    b = postings.where("side = 'right'").select(F.col("corpus").alias("right_corpus"), F.col("leaf_id").alias("right_id"), "term", F.col("w").alias("b"), *on)
    a = a.join(F.broadcast(pairs), "left_corpus")
    joined = a.join(b, ["term", "right_corpus", *on])
    found = joined.groupBy("left_corpus", "right_corpus", "left_id", "right_id").agg(F.sum(F.col("a") * F.col("b")).alias("cos_sim"))
    return found.where("cos_sim > 0")


def pair_budgets(leaves: DataFrame, pairs: DataFrame, budget: int, strategy: str = "weighted_sqrt", min_pair_budget: int | None = 50, max_pair_budget: int | None = None) -> DataFrame:
    """``left_corpus, right_corpus, n_left, n_right, budget`` of the pairs that have leaves on both sides.

    The budget is dealt equally or by sqrt(n_left * n_right), rounded half to even, then raised to the floor and cut to the ceiling.
    """
    if budget <= 0:
        raise ValueError(f"budget must be positive, got {budget}")
    if strategy not in ("equal", "weighted_sqrt"):
        raise ValueError(f"Unsupported pair budget strategy: {strategy}")
    sizes = leaves.groupBy("side", "corpus").agg(F.count("*").alias("n"))
    left = sizes.where("side = 'left'").select(F.col("corpus").alias("left_corpus"), F.col("n").alias("n_left"))
    right = sizes.where("side = 'right'").select(F.col("corpus").alias("right_corpus"), F.col("n").alias("n_right"))
    active = pairs.distinct().join(left, "left_corpus").join(right, "right_corpus").withColumn("_w", F.sqrt(F.col("n_left") * F.col("n_right")))
    totals = active.agg(F.sum("_w").alias("_all"), F.count("*").alias("_pairs"))
    active = active.join(F.broadcast(totals))  # one row
    if strategy == "equal":
        share = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("_pairs")))
    else:
        share = F.greatest(F.lit(1), F.bround(F.lit(float(budget)) * (F.col("_w") / F.col("_all")), 0).cast("long"))
    if min_pair_budget is not None:
        share = F.greatest(share, F.lit(min_pair_budget))
    if max_pair_budget is not None:
        share = F.least(share, F.lit(max_pair_budget))
    return active.select("left_corpus", "right_corpus", "n_left", "n_right", share.cast("long").alias("budget"))


def top_per_left(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` most similar right leaves of every left leaf within a corpus pair; none for ``k`` of 0."""
    order = Window.partitionBy("left_corpus", "right_corpus", "left_id").orderBy(F.desc("cos_sim"), "right_id")
    return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def top_per_right(found: DataFrame, k: int) -> DataFrame:
    """The same for right leaves: a cut that the default search doesn't make."""
    order = Window.partitionBy("left_corpus", "right_corpus", "right_id").orderBy(F.desc("cos_sim"), "left_id")
    return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def cut_to_budget(found: DataFrame, budgets: DataFrame) -> DataFrame:
    order = Window.partitionBy("left_corpus", "right_corpus").orderBy(F.desc("cos_sim"), "left_id", "right_id")
    rows = found.withColumn("_r", F.row_number().over(order)).join(F.broadcast(budgets.select("left_corpus", "right_corpus", "budget")), ["left_corpus", "right_corpus"])
    return rows.where(F.col("_r") <= F.col("budget")).drop("_r", "budget")


def merged(found: DataFrame, cap: int | None) -> DataFrame:
    """One row per pair of leaves, the most similar first, up to ``cap`` (null or 0: all)."""
    best = found.groupBy("left_id", "right_id").agg(F.max_by(F.struct("left_corpus", "right_corpus"), "cos_sim").alias("_c"), F.max("cos_sim").alias("cos_sim"))
    best = best.select("left_id", "right_id", "_c.left_corpus", "_c.right_corpus", "cos_sim")
    return best.orderBy(F.desc("cos_sim"), "left_id", "right_id").limit(cap) if cap and cap > 0 else best


def numbered(candidates: DataFrame) -> DataFrame:
    """Add ``cand_pos``, from 1, in the order of similarity and ids. Candidates are no more than the budget, so one task ranks them."""
    return candidates.withColumn("cand_pos", F.row_number().over(Window.orderBy(F.desc("cos_sim"), "left_id", "right_id")))


#: How many candidates a search keeps.
DEFAULTS: Mapping = {
    "mode": "pair_quota", "pair_budget_strategy": "weighted_sqrt", "min_pair_budget": 50, "max_pair_budget": None,
    "per_left_leaf_cap": 10, "per_right_leaf_cap": 10,
}


def candidates(spark: SparkSession, leaves: DataFrame, postings: DataFrame, left: Sequence[str], right: Sequence[str], mappings, retrieval: Mapping, bidirectional: bool = False) -> DataFrame:
    """The search as a whole: ``cand_pos, left_id, right_id, left_corpus, right_corpus, cos_sim``.

    ``pair_quota`` keeps the best of each left leaf within each allowed corpus pair, cuts each pair to its share of the budget and merges.
    ``global_heap`` keeps the best of all. ``bidirectional`` also cuts to ``per_right_leaf_cap``.
    """
    own = {**DEFAULTS, **retrieval}
    budget = int(own.get("budget") or 0)
    if own["mode"] not in ("pair_quota", "global_heap"):
        raise ValueError(f"Unsupported retrieval.mode: {own['mode']}")
    if budget <= 0:
        raise ValueError(f"retrieval.budget must be positive, got {budget}")
    if own["mode"] == "global_heap":
        found = similarities(postings, pairs_frame(spark, allowed_by_left(left, right, mappings)))
        return numbered(found.orderBy(F.desc("cos_sim"), "left_id", "right_id").limit(budget))
    pairs = pairs_frame(spark, allowed_pairs(left, right, mappings))
    found = top_per_left(similarities(postings, pairs), int(own["per_left_leaf_cap"]))
    if bidirectional:
        found = top_per_right(found, int(own["per_right_leaf_cap"]))
    shares = pair_budgets(leaves, pairs, budget, own["pair_budget_strategy"], own["min_pair_budget"], own["max_pair_budget"])
    cap = own.get("global_budget_after_merge", budget)
    return numbered(merged(cut_to_budget(found, shares), cap))


def threshold_candidates(postings: DataFrame, pairs: DataFrame, threshold: float, top_k_per_left: int | None = None, on: Sequence[str] = ()) -> DataFrame:
    """Pairs at or above a similarity, of the best ``top_k_per_left`` of a left leaf if given."""
    found = similarities(postings, pairs, on)
    return (top_per_left(found, top_k_per_left) if top_k_per_left is not None else found).where(F.col("cos_sim") >= threshold)


def top_terms(postings: DataFrame, n: int) -> DataFrame:
    """Each leaf's ``n`` heaviest terms."""
    order = Window.partitionBy("side", "corpus", "leaf_id").orderBy(F.desc("w"), "term")
    return postings.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def shared_terms(postings: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    """The ``n`` terms that do most for the similarity of each pair of ``chosen`` (``left_id, right_id``)."""
    a = postings.where("side = 'left'").select(F.col("leaf_id").alias("left_id"), "term", F.col("w").alias("left_w"))
    b = postings.where("side = 'right'").select(F.col("leaf_id").alias("right_id"), "term", F.col("w").alias("right_w"))
    both = chosen.select("left_id", "right_id").join(a, "left_id").join(b, ["right_id", "term"]).withColumn("product", F.col("left_w") * F.col("right_w"))
    order = Window.partitionBy("left_id", "right_id").orderBy(F.desc("product"), "term")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
