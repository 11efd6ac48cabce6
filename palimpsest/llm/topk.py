"""Exact top-k inner products: tiles of queries and shards, partial selection, tree merging."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a shard, queries of a block, queries multiplied at once, and lists that one merge takes.
SHARD, BLOCK, STRIP, FAN = 8192, 8192, 256, 8

LONG = (1 << 63) - 1


def _product(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer products; beyond a long they are held at its ends."""
    largest = [int(max(x.max(initial=0), -int(x.min(initial=0)))) for x in (queries, rows)]
    bound = largest[0] * largest[1] * max(1, rows.shape[1])
    if bound < 1 << 53:
        kind = np.float32 if bound < 1 << 24 else np.float64  # every partial sum is a whole number that the type holds
        return (queries.astype(kind) @ rows.T.astype(kind)).astype(np.int64)
    if bound <= LONG:
        return queries @ rows.T
    exact = queries.astype(object) @ rows.T.astype(object)
    return np.clip(exact, -LONG, LONG).astype(np.int64)


def best_of_tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its ``k`` highest products with rows of other ids: how many there are, ids and scores in order.

    ``ids`` ascend and are distinct, so ties go to the smaller column.
    """
    n, counts, best_ids, best = len(ids), [], [], []
    own = np.searchsorted(ids, query_ids)
    has_own = (own < n) & (ids[np.minimum(own, n - 1)] == query_ids)
    for at in range(0, len(queries), STRIP):
        score = _product(queries[at : at + STRIP], rows)
        here = has_own[at : at + STRIP]
        span = max(int(score.max()), -int(score.min())) + 2
        if span < LONG // (n + 1):
            rank = score * n + np.arange(n - 1, -1, -1)
            lowest = -span * n
            rank[np.flatnonzero(here), own[at : at + STRIP][here]] = lowest
            keep = min(k + 1, n)
            top = np.argpartition(rank, n - keep, axis=1)[:, n - keep :]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(rank, top, 1), axis=1), 1)
        else:
            top = np.argsort(-score, axis=1, kind="stable")
        column = np.where(here, own[at : at + STRIP], -1)[:, None]
        for line, valid, values in zip(top, top != column, np.take_along_axis(score, top, 1), strict=True):
            found = line[valid][:k]
            counts.append(len(found))
            best_ids.append(ids[found])
            best.append(values[valid][:k])
    return np.array(counts, np.int64), np.concatenate(best_ids), np.concatenate(best)


def _by_length(table: pa.Table, id_col: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids ascending and vectors, apart by length; of rows with the same id the smallest vector stands."""
    ids, vectors = table.column(id_col).to_numpy(), table.column("_v").combine_chunks()
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.chunk(0) if vectors.num_chunks else pa.array([], vectors.type)
    ends = vectors.offsets.to_numpy()
    flat, sizes = vectors.values.to_numpy(zero_copy_only=False), np.diff(ends)
    if len(np.unique(ids)) < len(ids):
        order = sorted(range(len(ids)), key=lambda i: (ids[i], flat[ends[i] : ends[i + 1]].tolist()))
        picked = [i for j, i in enumerate(order) if not j or ids[order[j - 1]] != ids[i]]
    else:
        picked = np.argsort(ids)
    picked = np.asarray(picked, np.int64)
    out = {}
    for size in np.unique(sizes[picked]).tolist():
        own = picked[sizes[picked] == size]
        out[size] = ids[own], flat[ends[own][:, None] + np.arange(size)].reshape(len(own), size).astype(np.int64)
    return out


def top_k(
    spark: SparkSession,
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 64.0,
    shard: int = SHARD,
    block: int = BLOCK,
) -> DataFrame:
    """For every query row its ``k`` highest inner products with rows of other ids: ``query_id, rank, <id_col>, score``.

    Components are floor(scale * x), with x as a double; ties go to the smaller id, and fewer than ``k`` rows give all there are.
    Queries and rows are dealt by a hash of the id into blocks and shards of bounded size; each (block, shard)
    tile is one matrix product whose best ``k`` per query are selected there. Lists of a query meet
    ``FAN`` at a time, level by level, and are cut to ``k`` again.

    Rows whose id or vector is null, or whose vector holds null or a component that isn't finite, take no part; neither
    do such queries. Vectors are compared with those of their own length. Of rows that repeat an id the smallest
    vector stands. Empty tables give no rows, and other columns are ignored. Products beyond a long are
    held at its ends.
    """

    def whole(frame: DataFrame) -> DataFrame:
        x = F.col(vector_col)
        fine = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False)))
        return frame.where(fine).select(F.col(id_col).cast("long").alias(id_col), F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("_v"))

    rows, asked = whole(vectors), whole(queries)
    size = [x.agg(F.count("*"), F.max(F.array_max(F.transform("_v", lambda v: F.abs(v))))).first() for x in (rows, asked)]
    shards, blocks = max(1, -(-size[0][0] // shard)), max(1, -(-size[1][0] // block))
    largest = max(x[1] or 0 for x in size)  # components travel as the smallest type that holds them all
    kind = "smallint" if largest < 1 << 15 else "int" if largest < 1 << 31 else "bigint"
    rows, asked = (x.withColumn("_v", F.col("_v").cast(f"array<{kind}>")) for x in (rows, asked))
    place = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(n)).cast("int")
    left = asked.withColumn("_block", place(1, blocks)).withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = rows.withColumn("_shard", place(2, shards)).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    best = pa.list_(pa.struct([("s", pa.int64()), ("v", pa.int64())]))

    def tile(asked: pa.Table, own: pa.Table) -> pa.Table:
        names = ["query_id", "_part", "top"]
        if not asked.num_rows or not own.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], best)], names=names)
        part, candidates, out = own.column("_shard")[0].as_py(), _by_length(own, id_col), []
        for size, (query_ids, values) in _by_length(asked, id_col).items():
            if size in candidates:
                counts, ids, scores = best_of_tile(query_ids, values, *candidates[size], k)
                ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(-scores), pa.array(ids)], ["s", "v"]))
                out.append(pa.table([pa.array(query_ids), pa.array(np.full(len(query_ids), part, np.int32)), lists.cast(best)], names=names))
        return pa.concat_tables(out) if out else tile(asked.slice(0, 0), own)

    found = left.groupBy("_block", "_shard").cogroup(right.groupBy("_block", "_shard")).applyInArrow(tile, "query_id long, _part int, top array<struct<s:long,v:long>>")
    parts = shards
    while True:
        parts = -(-parts // FAN)
        found = found.groupBy("query_id", F.floor(F.col("_part") / FAN).cast("int").alias("_part")).agg(
            F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top")
        )
        if parts == 1:
            break
    ranked = found.select("query_id", F.posexplode("top").alias("_pos", "_hit"))
    return ranked.select("query_id", (F.col("_pos") + 1).alias("rank"), F.col("_hit.v").alias(id_col), (-F.col("_hit.s")).alias("score"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(spark, vectors, vectors.where(F.col("vec_id") % 20 == 0))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
