"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import heapq
import math
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.arrow import STEP_BYTES, small_batches, steps, utf8
from palimpsest.operators.ordering import with_running_totals
from palimpsest.workspace import stored

#: Weights of the sources in order, repeating; the most times a text is used; output shards.
WEIGHTS, REPEATS, SHARDS = (1, 2, 3), 3, 8

#: Blocks of the whole corpus and of the smallest target, and the most blocks.
BLOCKS, LEAST_BLOCKS, MOST_BLOCKS = 1 << 14, 256, 1 << 24

#: A table of as many sources is broadcast; a larger one is joined by key.
BROADCAST_SOURCES = 100_000

WORDS = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> dict[str | None, float]:
    """Shares of all sizes by weight; what is above ``repeats`` times a source's size goes to the others by weight."""
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {x: weights[i % len(weights)] for i, x in enumerate(names)}
    fixed: dict[str | None, float] = {}
    while True:
        free = [x for x in names if x not in fixed]
        left, whole = sum(sizes.values()) - sum(fixed.values()), sum(weight[x] for x in free)
        share = {x: left * weight[x] / whole for x in free}
        over = [x for x in free if share[x] > repeats * sizes[x]]
        if not over:
            return fixed | share
        fixed |= {x: float(repeats * sizes[x]) for x in over}


def sainte_lague(wanted: list[float], seats: int, most: list[int]) -> list[int]:
    """Seats by highest quotients wanted / (2 * seats + 1), ties to the earlier; no more than ``most``.

    A divisor that can't give too many seats skips the quotients that certainly win.
    """
    total = sum(wanted)
    if not total:
        return [0] * len(wanted)
    sure = total / max(seats - len(wanted), 1)
    got = [min(m, max(0, math.floor(x / sure + 0.5))) if seats > len(wanted) else 0 for x, m in zip(wanted, most, strict=True)]
    heap = [(-x / (2 * g + 1), i) for i, (x, g, m) in enumerate(zip(wanted, got, most, strict=True)) if x > 0 and g < m]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(heap, (-wanted[i] / (2 * got[i] + 1), i))
    return got


#: Rounds of the permutation of a source's blocks, and the prime that its sums are taken by.
ROUNDS, PRIME = 4, (1 << 31) - 1


def permuted(blocks: np.ndarray, side: int, keys: tuple[tuple[int, int, int], ...]) -> np.ndarray:
    """A keyed permutation of the numbers below ``side`` squared: the two digits by ``side``, one after the other, are moved by a function of the other."""
    left, right = blocks // side, blocks % side
    for a, b, c in keys:
        left, right = right, (left + (right * a + b) % PRIME * (right + c) % PRIME) % side
    return left * side + right


#: The same in SQL, of the block ``b``.
PERMUTED = f"""aggregate(_keys, struct(b div _side AS l, b % _side AS r),
  (s, k) -> struct(s.r AS l, (s.l + (s.r * k.a + k.b) % {PRIME}L * (s.r + k.c) % {PRIME}L) % _side AS r), s -> s.l * _side + s.r)"""


@dataclass(frozen=True)
class Quota:
    """What one source gives: ``shares`` are its blocks in each shard, ``words`` what it gives in all, settled to the word.

    Blocks are taken in the order of their permuted numbers, pass after pass. Of the last pass those below ``full`` are taken whole, and
    ``part`` words of that at ``full``. ``bounds`` are the first numbers of each shard, counted on from pass to pass.
    """

    source: str | None
    source_size: int
    target: float
    blocks: int
    shares: tuple[int, ...]
    words: int
    side: int
    keys: tuple[tuple[int, int, int], ...]
    full: int
    part: int
    bounds: tuple[int, ...]


def quota(source: str | None, size: int, target: float, shares: tuple[int, ...], words: int, block: int, seed: int) -> Quota:
    """Settle which blocks a source gives: the seeded permutation, where it ends and where each shard's blocks begin."""
    n = max(1, -(-size // block))
    side, rng = math.isqrt(n - 1) + 1, random.Random(f"{seed}/{source!r}")
    keys = tuple((rng.randrange(1, PRIME), rng.randrange(PRIME), rng.randrange(PRIME)) for _ in range(ROUNDS))
    number = permuted(np.arange(n, dtype=np.int64), side, keys)
    order = np.argsort(number)
    lengths = np.full(n, block, np.int64)
    lengths[-1] = size - (n - 1) * block
    upto, rest = np.cumsum(lengths[order]), words % max(1, size)
    whole = int(np.searchsorted(upto, rest, "right"))
    part = rest - int(upto[whole - 1]) if whole else rest
    starts = np.cumsum([0, *shares[:-1]]) if shares else []
    bounds = tuple(int(c // n * side * side + number[order[c % n]]) for c in starts)
    return Quota(source, size, target, n, shares, words, side, keys, int(number[order[whole]]) if whole < n else side * side, part, (0, *bounds[1:]))


def plan(sizes: dict[str | None, int], seed: int = 0, shards: int = SHARDS, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> tuple[int, list[Quota]]:
    """Tokens in a block, every source's integer quotas per shard and its words in all.

    The method is house-monotone: more seats never cost a source one. So a
    shard's quotas are what its seats add to those of the shards before it.

    Blocks may be larger than a small source's target; words are apportioned by the same method one by one, so what a source gives
    is within a word or so of its target whatever the block.
    """
    total = sum(sizes.values())
    if not total:
        return 1, [quota(x, n, 0.0, (0,) * shards, 0, 1, seed) for x, n in sizes.items()]
    wanted = targets(sizes, weights, repeats)
    smallest = min(x for x in wanted.values() if x > 0)
    block = max(1, total // MOST_BLOCKS, min(total // BLOCKS, int(smallest) // LEAST_BLOCKS))
    names = list(wanted)
    blocks = [-(-sizes[x] // block) for x in names]
    seats = round(total / block)
    upto = [sainte_lague([wanted[x] for x in names], seats * j // shards, [repeats * b for b in blocks]) for j in range(shards + 1)]
    words = sainte_lague([wanted[x] for x in names], total, [repeats * sizes[x] for x in names])
    out = []
    for i, name in enumerate(names):
        shares = tuple(upto[j + 1][i] - upto[j][i] for j in range(shards))
        out.append(quota(name, sizes[name], wanted[name], shares, words[i], block, seed))
    return block, out


def mix_sources(
    spark: SparkSession,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 0,
    shards: int = SHARDS,
    weights: tuple[int, ...] = WEIGHTS,
    repeats: int = REPEATS,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Which words of every document a mix of the sources takes.

    Each source's documents, in a seeded order, are one stream of words that
    is cut into blocks of equal tokens. Apportionment gives every source its
    number of blocks in each shard, and of words in all; a seeded permutation orders the blocks, which are
    taken in that order, pass after pass, the last of them in part. Each shard takes as many as its quota says.

    Gives the id and source, ``size`` (words), ``source_size``, ``target``,
    ``taken`` (words, repeats counted), ``passes`` (whole uses) and ``spans``: the
    word ranges of each use, in order, with their ``pass`` and ``shard``.

    A null text has no words; a null source is a source of its own, last in
    order. Rows that repeat count each on their own. A source without words has target
    0. An empty table gives no rows. Other columns are ignored, but for those that ``carry`` names: they go
    along as ``c0``, ``c1`` and so on.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(
        id_col,
        F.col(source_col).alias("source"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), text).alias("_at"),
        *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)),
    )
    narrow = narrow if carry else stored(spark, narrow, "sizes")
    sizes = {r["source"]: r["n"] for r in narrow.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    block, quotas = plan(sizes, seed, shards, weights, repeats)
    table = spark.createDataFrame(
        [(q.source, q.source_size, q.target, q.words // max(1, q.source_size), q.full, q.part, q.side, list(q.keys), list(q.bounds)) for q in quotas],
        "_name string, source_size long, target double, passes long, _full long, _part long, _side long, _keys array<struct<a:long,b:long,c:long>>, _bounds array<long>",
    )
    table = F.broadcast(table) if len(quotas) <= BROADCAST_SOURCES else table
    ordered = with_running_totals(spark, narrow, "source", ["_at", id_col], "size")
    placed = ordered.join(table, F.col("source").eqNullSafe(F.col("_name"))).withColumn("_end", F.col("before") + F.col("size"))
    own = f"IF(size = 0, CAST(array() AS array<bigint>), sequence(before div {block}, (_end - 1) div {block}))"
    placed = placed.withColumn("_own", F.expr(f"transform({own}, b -> struct(b AS b, {PERMUTED} AS at))"))
    begin = f"greatest(x.b * {block}, before)"
    shard = "cast(size(filter(_bounds, y -> y <= p * _side * _side + x.at)) - 1 AS int)"
    spans = F.expr(
        f"""flatten(transform(sequence(0L, passes), p -> transform(
              filter(_own, x -> p < passes OR x.at < _full OR (x.at = _full AND _part > {begin} - x.b * {block})),
              x -> struct({begin} - before AS begin,
                least(x.b * {block} + IF(p = passes AND x.at = _full, _part, {block}), _end) - before AS end, p AS pass, {shard} AS shard))))"""
    )
    taken = F.expr("aggregate(spans, 0L, (sum, x) -> sum + x.end - x.begin)")
    return placed.withColumn("spans", spans).select(id_col, "source", "size", "source_size", "target", taken.alias("taken"), "passes", "spans", *(f"c{i}" for i in range(len(carry))))


def _bounded(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about STEP_BYTES characters together at most."""
    at = held = 0
    for k, x in enumerate(texts):
        held += len(x or "")
        if held > STEP_BYTES and k > at:
            yield at, k
            at, held = k, len(x or "")
    if at < len(texts):
        yield at, len(texts)


def mixed_rows(spark: SparkSession, docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document as often as whole passes use it, then a row for each run of words of the last pass.

    Such a row's text goes from the run's first word to its last, and ``length_col``, where there is one, is its length.
    """
    columns = small_batches(docs).columns
    found = mix_sources(spark, docs, text_col=text_col, carry=tuple(columns), **options).select("passes", "spans", *(f"c{i}" for i in range(len(columns))))
    text, length = f"c{columns.index(text_col)}", f"c{columns.index(length_col)}" if length_col in columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text):
            data, ends = utf8(batch.column(text))
            blank = np.isin(data, np.frombuffer(b" \t\n\v\f\r", np.uint8))
            edge = np.ones(len(data), bool)
            edge[1:] = blank[:-1]
            edge[ends[:-1][ends[:-1] < len(data)]] = True
            begin = np.flatnonzero(edge & ~blank)
            stop = np.append(np.flatnonzero(blank), len(data))
            raw, rows, texts = data.tobytes(), [], []
            first = np.searchsorted(begin, ends)
            whole = batch.column(text).to_pylist()
            for k, (passes, spans) in enumerate(zip(batch.column("passes").to_pylist(), batch.column("spans").to_pylist(), strict=True)):
                rows += [k] * passes
                texts += [whole[k]] * passes
                runs: list[list[int]] = []
                for span in spans:
                    if span["pass"] < passes:
                        continue
                    if runs and runs[-1][1] == span["begin"]:
                        runs[-1][1] = span["end"]
                    else:
                        runs.append([span["begin"], span["end"]])
                for a, b in runs:
                    last = begin[first[k] + b - 1]
                    to = min(int(stop[np.searchsorted(stop, last)]), int(ends[k + 1]))
                    rows.append(k)
                    texts.append(raw[begin[first[k] + a] : to].decode())
            for low, past in _bounded(texts):  # a document's other columns go along with each of its runs, its text doesn't
                own = pa.array(rows[low:past])
                made = {c: batch.column(c).take(own) for c in names if c not in (text, length)}
                made[text] = pa.array(texts[low:past], batch.column(text).type)
                if length:
                    made[length] = pa.array([None if x is None else len(x) for x in texts[low:past]], batch.column(length).type)
                yield pa.RecordBatch.from_arrays([made[c] for c in names], names=names)

    names = [f"c{i}" for i in range(len(columns))]
    schema = ", ".join(f"c{i} {t}" for i, (_, t) in enumerate(docs.dtypes))
    return found.mapInArrow(run, schema).toDF(*columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
