"""Pareto layers: which rows nothing is better than, then which of the rest, and so on."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("cos_sim", "tesserae", "soft_cos", "sw_norm")


def dominates(a: str, b: str, metrics: Sequence[str] = METRICS) -> Column:
    """Row ``a`` is nowhere worse than row ``b`` and somewhere better; ``a`` and ``b`` are aliases."""
    ge, gt = F.lit(True), F.lit(False)
    for m in metrics:
        ge, gt = ge & (F.col(f"{a}.{m}") >= F.col(f"{b}.{m}")), gt | (F.col(f"{a}.{m}") > F.col(f"{b}.{m}"))
    return ge & gt


def layers_of(points: np.ndarray, keep: int | None = None, block: int = 512) -> np.ndarray:
    """The layer of each row, from 1; 0 for those below ``keep``.

    A row's layer is one more than the highest of those that dominate it, and those have larger sums, so one pass in order of
    falling sums settles all. Equal rows share a layer.
    """
    unique, where = np.unique(points, axis=0, return_inverse=True)
    where = where.ravel()
    order = np.argsort(-unique.sum(1), kind="stable")
    # sums may round to a tie; of two such rows the lexically larger one can only be the dominating one
    order = order[np.lexsort((*(-unique[order].T[::-1]), -np.round(unique[order].sum(1), 9)))]
    rows, layer = unique[order], np.zeros(len(unique), np.int64)
    for begin in range(0, len(rows), block):
        chunk = rows[begin : begin + block]
        own = np.ones(len(chunk), np.int64)
        for at in range(0, begin, 4096):
            before = rows[at : min(begin, at + 4096)]
            over = (before[None] >= chunk[:, None]).all(2)
            own = np.maximum(own, 1 + (over * layer[at : at + len(before)][None]).max(1, initial=0))
        inside = (chunk[None] >= chunk[:, None]).all(2)
        for i in range(1, len(chunk)):
            if inside[i, :i].any():
                own[i] = max(own[i], 1 + own[:i][inside[i, :i]].max())
        layer[begin : begin + block] = own
    out = np.empty(len(unique), np.int64)
    out[order] = layer
    out = out[where]
    return np.where(out > keep, 0, out) if keep else out


def pareto_layers(rows: DataFrame, keep: int | None = None, metrics: Sequence[str] = METRICS, by: Sequence[str] = ()) -> DataFrame:
    """Add ``pareto_layer`` and ``pareto_on_front``; with ``keep`` only the rows of the first so many layers stay.

    With ``keep`` every partition first drops what is below that layer among its own rows: such a row is below it among all, and no row above it
    loses a dominating one by that. What is left, a few layers, meets in one task (or one for each group of ``by``). Without ``keep`` all rows do.
    """
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    names = list(metrics)

    def points(pdf: pd.DataFrame) -> np.ndarray:
        return pdf[names].fillna(0.0).to_numpy(float)

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if by:
                yield from (g[layers_of(points(g), keep) > 0] for _, g in pdf.groupby(list(by), dropna=False))
            else:
                yield pdf[layers_of(points(pdf), keep) > 0]

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        layer = layers_of(points(pdf), keep)
        out = pdf.assign(pareto_layer=layer.astype(np.int32), pareto_on_front=layer == 1)
        return out[layer > 0]

    left = rows.mapInPandas(prune, schema) if keep else rows
    return left.groupBy(*by).applyInPandas(settle, f"{schema}, pareto_layer int, pareto_on_front boolean")


def pareto_layers_native(rows: DataFrame, keep: int, key: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    """The same by anti-joins, a layer at a time; for few rows, as each is held against all."""
    rest, out = rows, None
    for layer in range(1, keep + 1):
        a, b = rest.alias("a"), rest.alias("b")
        front = b.join(a, dominates("a", "b", metrics), "left_anti").select("b.*")
        found = front.withColumn("pareto_layer", F.lit(layer)).withColumn("pareto_on_front", F.lit(layer == 1))
        out = found if out is None else out.union(found)
        rest = rest.join(front.select(*key), list(key), "left_anti")
    return out


def front_curve(rows: DataFrame, x: str, y: str) -> DataFrame:
    """For each layer the highest ``y`` of every ``x``, along ``x``."""
    return rows.groupBy("pareto_layer", x).agg(F.max(y).alias(y)).orderBy("pareto_layer", x)
