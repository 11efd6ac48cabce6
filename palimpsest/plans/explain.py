"""Evidence for an experiment's best pairs, from its stage tables, as Markdown."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import latin
from palimpsest.operators import metrics as M
from palimpsest.operators import retrieval
from palimpsest.plans.checkpoints import Stages
from palimpsest.plans.config import Experiment


def evidence(detail: DataFrame, leaves: DataFrame, exp: Experiment, top_k: int = 3, top_terms: int = 15) -> dict[str, DataFrame]:
    """Tables about the ``top_k`` best ranked pairs: shared terms, lemmas that give to each measure, and tokens of one side only."""
    chosen = detail.orderBy("rank_final_position", "left_leaf_id", "right_leaf_id").limit(top_k)
    keyed = chosen.select("rank_final_position", "left_corpus", "right_corpus", F.col("left_leaf_id").alias("left_id"), F.col("right_leaf_id").alias("right_id"))
    rows = M.enriched(keyed, leaves, ["lemmas", "text"])
    postings = retrieval.tfidf(leaves, "lemmas", *exp.model.ngram_range, exp.model.max_df, exp.model.min_df)
    key = ["rank_final_position"]
    one_side = rows.select(*key, F.array_except("left_lemmas", "right_lemmas").alias("left_only"), F.array_except("right_lemmas", "left_lemmas").alias("right_only"))
    analysed = rows.select(*key, *(latin.analysis(f"{side}_text").alias(side) for side in ("left", "right")))
    return {
        "pairs": chosen,
        "shared_terms": retrieval.shared_terms(postings, rows.select("left_id", "right_id"), top_terms).join(keyed.select(*key, "left_id", "right_id"), ["left_id", "right_id"]),
        "tesserae": M.tesserae_evidence(rows, retrieval.idf_table(leaves), key),
        "soft": M.soft_evidence(rows, key),
        "one_side": one_side,
        "preprocessing": analysed,
    }


def report(found: dict[str, DataFrame], top_terms: int = 15) -> str:
    """The tables as a text of seven parts per pair."""

    def rows(name: str) -> dict[int, list]:
        out: dict[int, list] = {}
        for r in found[name].collect():
            out.setdefault(r["rank_final_position"], []).append(r)
        return out

    terms, tess, soft, only, pre = (rows(x) for x in ("shared_terms", "tesserae", "soft", "one_side", "preprocessing"))
    lines = ["# Best borrowings", ""]
    for r in sorted(found["pairs"].collect(), key=lambda r: r["rank_final_position"]):
        at = r["rank_final_position"]
        lines += [f"## {at}. {r['left_leaf_id']} → {r['right_leaf_id']}", ""]
        lines += ["### Scores", "", *(f"- {k}: {r[k]:.6f}" for k in ("cos_sim", "tesserae", "soft_cos", "sw_norm")), f"- Pareto layer {r['pareto_layer']}, rank sum {r['rank_sum']}", ""]
        lines += ["### Texts", "", f"> {r['left_text_snippet']}", "", f"> {r['right_text_snippet']}", ""]
        for p in pre.get(at, []):
            lines += ["### Preprocessing", "", *(f"- {s}: mode {p[s]['mode']}, {len(p[s]['raw_tokens'])} tokens, {len(p[s]['final_tokens'])} kept" for s in ("left", "right")), ""]
        lines += ["### Shared TF-IDF terms", "", *(f"- {t['term']}: {t['product']:.6f}" for t in sorted(terms.get(at, []), key=lambda t: t["rank"])[:top_terms]), ""]
        lines += ["### Shared lemmas", "", *(f"- {t['term']}: idf {t['idf']:.4f}, gives {t['contribution']:.6f}" for t in sorted(tess.get(at, []), key=lambda t: (-t["idf"], t["term"]))[:top_terms]), ""]
        near = sorted((t for t in soft.get(at, []) if not t["exact"]), key=lambda t: (-t["contribution"], t["left_term"], t["right_term"]))
        lines += ["### Near lemmas", "", *(f"- {t['left_term']} ~ {t['right_term']}: {t['contribution']:.4f}" for t in near[:top_terms]), ""]
        for o in only.get(at, []):
            lines += ["### Alignment and the rest", "", f"- left: {' '.join(r['alignment_a'])}", f"- right: {' '.join(r['alignment_b'])}", f"- left only: {' '.join(o['left_only'][:40])}", f"- right only: {' '.join(o['right_only'][:40])}", ""]
    return "\n".join(lines)


def explain(spark: SparkSession, exp: Experiment, folder: str, marks: dict, top_k: int = 3, top_terms: int = 15) -> str:
    """The report of a finished experiment; an error where its stages are missing or were made with other settings."""
    from palimpsest.plans.checkpoints import fingerprints

    stages = Stages(spark, folder, fingerprints(exp.as_dict(), marks))
    stages.strict("leaves")
    leaves = stages.strict("lemmas")
    stages.strict("candidates")
    return report(evidence(stages.strict("ranked"), leaves, exp, top_k, top_terms), top_terms)


def settings(exp: Experiment) -> str:
    return "\n".join(f"{k}: {v}" for k, v in asdict(exp).items())
