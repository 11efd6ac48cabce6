"""Sliding word windows over segments."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import columns as C

MODE = "sliding_window_words"


def chunk(segments: DataFrame, enabled: bool = False, mode: str = MODE, window_words: int = 180, overlap_words: int = 60, min_words: int = 20, per_corpus: Mapping[str, Mapping] | None = None) -> DataFrame:
    """Leaves of ``corpus, seg_id, text`` rows: the same columns with ``leaf_id`` and ``parent_id``, and the leaf's text.

    A segment stays whole when chunking is off for its corpus, or when it has fewer than ``min_words`` or no more than ``window_words`` words.
    Otherwise windows begin every ``window_words - overlap_words`` words until one reaches the end, in a closed form that needs no loop: a
    window is there when it is the first or the one before it hadn't reached the end. Windows of fewer than ``min_words`` words don't count.
    """
    whole = segments.withColumns({"leaf_id": F.col("seg_id"), "parent_id": F.col("seg_id")})
    if not enabled:
        return whole
    if mode != MODE:
        raise ValueError(f"Unsupported chunking mode: {mode}")

    def setting(key: str, default):
        value = F.lit(default)
        for corpus, own in (per_corpus or {}).items():
            if key in own:
                value = F.when(F.col("corpus") == corpus, F.lit(own[key])).otherwise(value)
        return value

    on, window, overlap, least = setting("enabled", True), setting("window_words", window_words), setting("overlap_words", overlap_words), setting("min_words", min_words)
    step = F.greatest(F.lit(1), window - F.greatest(F.lit(0), overlap))

    def windows(w):
        n = F.size(w)
        split = on & (n >= least) & (n > window)
        starts = F.filter(F.sequence(F.lit(0), n - 1, step), lambda s: ((s == 0) | (s - step + window < n)) & (F.least(n, s + window) - s >= least))
        text = lambda at: F.array_join(F.slice(w, at + 1, F.greatest(F.lit(0), F.least(n, at + window) - at)), " ")
        return F.transform(
            F.when(split, starts).otherwise(F.array(F.lit(0))),
            lambda at: F.struct(at.alias("at"), F.least(n, at + window).alias("past"), split.alias("split"), F.when(split, text(at)).otherwise(F.col("text")).alias("text")),
        )

    # an array of one binds the words, which are split once, and windows' texts are made before rows are multiplied
    keep = [c for c in segments.columns if c != "text"]
    rows = segments.select(*keep, F.posexplode(F.flatten(F.transform(F.array(C.words(F.col("text"))), windows))).alias("_idx", "_at"))
    name = F.concat(F.col("seg_id"), F.lit("__w"), F.col("_idx"), F.lit("_W"), F.col("_at.at"), F.lit("-"), F.col("_at.past"))
    return rows.select(*keep, F.col("_at.text").alias("text"), F.when(F.col("_at.split"), name).otherwise(F.col("seg_id")).alias("leaf_id"), F.col("seg_id").alias("parent_id"))
