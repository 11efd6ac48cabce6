"""Near-duplicate documents: an exact Jaccard join of word n-grams by prefixes under several token orders."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from palimpsest.llm.arrow import small_batches, steps, utf8
from palimpsest.operators.components import connected_components
from palimpsest.workspace import stored

#: Words of a shingle, the least similarity in hundredths, and token orders.
WORDS, PERCENT, ORDERS = 3, 90, 3

#: Counters of shingles, of which a row of the sketch holds so many.
COUNTERS, CHUNK = 1 << 20, 1 << 12

#: Bits of a set's signature, as 64-bit numbers: each tells whether an odd number of its shingles falls there.
PARITIES = 8
SIGNATURE = [f"p{i}" for i in range(PARITIES)]

#: Sets of so many shingles have a second signature of so many bits, which pairs are held to before their texts are fetched.
LONG, LONG_BITS = 1024, 1 << 13

#: Sets of a token that are compared in one piece, and the most of which all pairs are told.
BLOCK, SMALL = 512, 8

#: Postings that a task sorts at once, and of a token among them the most that go to its common bucket; of more, the first few do.
SORTED, LOCAL, BRIDGES = 1 << 20, 64, 2

#: Rows of postings that are looked at together.
GATHERED = 1 << 14

#: Tokens by which a pair that meets often is told once.
FIRST = 4

#: As many ids are sent to every executor (8 bytes each); more are joined by key.
BROADCAST_IDS = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers, another for each seed."""
    x = (x ^ _ODD[seed]) * _ODD[(seed + 1) % 6]
    x = (x ^ (x >> np.uint64(32))) * _ODD[(seed + 2) % 6]
    return x ^ (x >> np.uint64(29))


def shingle_sets(data: np.ndarray, ends: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct shingles as 64-bit hashes, ascending, and where each document's begin and the last end.

    A-Z are lower-cased, words are what blanks (bytes 9 to 13 and 32) separate. A document of fewer words than a
    shingle has its whole sequence as its one shingle, one without words none.
    """
    data = LOWER[data]
    blank = BLANK[data]
    edge = np.ones(len(data), bool)
    edge[1:] = blank[:-1]
    edge[ends[:-1][ends[:-1] < len(data)]] = True
    begin = np.flatnonzero(edge & ~blank)
    stop = np.ones(len(data), bool)
    stop[:-1] = blank[1:]
    stop[ends[1:][ends[1:] > 0] - 1] = True
    end = np.flatnonzero(stop & ~blank) + 1
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    spans = np.append(np.stack([begin, end], 1).ravel(), len(data)).astype(np.int64)
    both = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * len(begin), [None, pa.py_buffer(spans), pa.py_buffer(data)])
    coded = both.take(pa.array(np.arange(len(begin)) * 2)).dictionary_encode()
    names = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    word = names[coded.indices.to_numpy(zero_copy_only=False)]
    upto = np.searchsorted(begin, ends)  # words before each document's end
    many = np.diff(upto)
    count = np.where(many >= size, many - size + 1, np.minimum(many, 1))
    at = np.concatenate([[0], np.cumsum(count)])
    first = np.arange(at[-1]) - np.repeat(at[:-1], count) + np.repeat(upto[:-1], count)
    left = np.repeat(upto[1:], count) - first  # words from here to the document's end
    out = np.zeros(len(first), np.uint64)
    padded = np.concatenate([word, np.zeros(size, np.uint64)])
    for k in range(size):
        out = mix(out + np.where(k < left, padded[first + k], np.uint64(k + 1)), k % 6)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        out[a:b].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[at[:-1][count > 0]] = True
    return out[fresh], np.concatenate([[0], np.cumsum(fresh)])[at]


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
    return total[at[1:]] - total[at[:-1]]


def names_of(shingles: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each set, whatever the order."""
    return _sums(mix(shingles, 3), at).view(np.int64), _sums(mix(shingles, 4), at).view(np.int64)


def parities(shingles: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Each set's signature. Where two signatures differ in so many bits, the sets differ in as many shingles at least."""
    place = mix(shingles, 5) >> np.uint64(55)
    word, bit = (place >> np.uint64(6)).astype(np.int8), np.uint64(1) << (place & np.uint64(63))
    out = []
    for i in range(PARITIES):
        upto = np.concatenate([[np.uint64(0)], np.bitwise_xor.accumulate(np.where(word == i, bit, np.uint64(0)))])
        out.append((upto[at[1:]] ^ upto[at[:-1]]).view(np.int64))
    return out


def long_parities(shingles: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """The second signature of each set, null for a short one."""
    out: list[bytes | None] = [None] * (len(at) - 1)
    for k in np.flatnonzero(np.diff(at) >= LONG).tolist():
        place = (mix(shingles[at[k] : at[k + 1]], 2) >> np.uint64(64 - (LONG_BITS - 1).bit_length())).astype(np.int64)
        out[k] = np.packbits((np.bincount(place, minlength=LONG_BITS) & 1).astype(np.uint8)).tobytes()
    return out


def may_link(bits: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Holds for every pair that links: sizes ``a`` and ``b`` are near, and no more bits differ than shingles of such sets may."""
    bits, a, b = bits.astype(np.int64), a.astype(np.int64), b.astype(np.int64)
    return (np.minimum(a, b) * 100 >= np.maximum(a, b) * percent) & (bits * (100 + percent) <= (a + b) * (100 - percent))


def _counter(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64(COUNTERS - 1)).astype(np.int64)


def describe(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """One pass over the texts: a row per document with its set's size, name and signature, and each task's rows of the counters.

    A counter tells about how many documents hold a shingle, which shares it with others. Long sets have a second signature.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in steps(batches, "text"):
            shingles, at = shingle_sets(*utf8(batch.column("text")), size)
            counts += np.bincount(_counter(shingles), minlength=COUNTERS)
            n = batch.num_rows
            rest = pa.array(long_parities(shingles, at), pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), *map(pa.array, names_of(shingles, at)), *map(pa.array, parities(shingles, at)), *rest], names=names)
        flat = counts.reshape(-1, CHUNK)
        used = np.flatnonzero(flat.any(1))
        if len(used):
            nothing = [pa.nulls(len(used), pa.int64()) for _ in range(4 + PARITIES)]
            yield pa.RecordBatch.from_arrays([*nothing, pa.nulls(len(used), pa.binary()), pa.array(used.astype(np.int32)), pa.array([_packed(x) for x in flat[used]], pa.binary())], names=names)

    names = ["doc_id", "n", "f1", "f2", *SIGNATURE, "whole", "chunk", "counts"]
    slim = small_batches(docs).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc_id long, n long, f1 long, f2 long, {', '.join(f'{x} long' for x in SIGNATURE)}, whole binary, chunk int, counts binary")


def _packed(counts: np.ndarray) -> bytes:
    """Numbers of the fewest bytes that hold them."""
    top = int(counts.max())
    return counts.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // CHUNK}").astype(np.int64)


def _added(table: pa.Table) -> pa.Table:
    total = np.zeros(CHUNK, np.int64)
    for raw in table.column("counts").to_pylist():
        total += _unpacked(raw)
    return pa.table([table.column("chunk")[:1], pa.array([_packed(total)], pa.binary())], names=["chunk", "counts"])


def document_counts(described: DataFrame) -> np.ndarray:
    """All tasks' counters added up, level by level, as powers of two; the driver gets a fixed number of them, whatever the input."""
    rows = described.where(F.col("chunk").isNotNull()).select("chunk", "counts")
    some = rows.withColumn("_salt", F.spark_partition_id() % 64).groupBy("chunk", "_salt").applyInArrow(_added, "chunk int, counts binary")
    total = np.zeros((COUNTERS // CHUNK, CHUNK), np.int64)
    for row in some.groupBy("chunk").applyInArrow(_added, "chunk int, counts binary").collect():
        total[row["chunk"]] = _unpacked(bytes(row["counts"]))
    return np.frexp(total.ravel().astype(np.float64))[1].astype(np.uint8)


def prefix(shingles: np.ndarray, counts: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The set's first shingles under an order by (about how many documents hold it, scrambled hash), as tokens of that order.

    Two sets of the least similarity share at least ceil(percent * n / 100) shingles of either, so their prefixes share one.
    """
    scrambled = mix(shingles, order)
    rank = (counts[_counter(shingles)].astype(np.uint64) << np.uint64(56)) | (scrambled >> np.uint64(8))
    keep = len(shingles) + percent * len(shingles) // -100 + 1
    first = np.argpartition(rank, keep - 1)[:keep]
    if keep < len(shingles):  # the rank is cut to 64 bits: let every equal of the last one in
        first = np.flatnonzero(rank <= rank[first].max())
    return scrambled[first]


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys begins, and how long it is."""
    fresh = np.ones(len(keys[0]), bool)
    fresh[1:] = False
    for key in keys:
        fresh[1:] |= key[1:] != key[:-1]
    starts = np.flatnonzero(fresh)
    return starts, np.diff(np.append(starts, len(fresh)))


def _dealt(token: np.ndarray, n: np.ndarray, f1: np.ndarray, place: int, local: int, size: int) -> pa.RecordBatch:
    """A task's postings, each set once in a token. Of a token with more than ``local``, the rows stay together in blocks of ``size``,
    and the first of each also go to the token's common bucket, where they say that there is more."""
    order = np.lexsort((f1, n, token))
    token, n, f1 = token[order], n[order], f1[order]
    keep, _ = _runs(token, f1, n)
    token, n, f1 = token[keep], n[keep], f1[keep]
    starts, sizes = _runs(token)
    inside = np.arange(len(token)) - np.repeat(starts, sizes)
    many = np.repeat(sizes > local, sizes)
    block = np.where(many, (np.int64(place) << 12) + inside // size + 1, 0)
    lead = many & (inside % size < BRIDGES)
    columns = [np.concatenate([x, x[lead]]) for x in (token, n, f1)]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0]), pa.array(np.concatenate([block, np.zeros(int(lead.sum()), np.int64)])), pa.array(np.concatenate([many, many[lead]])), *map(pa.array, columns[1:])],
        names=["token", "block", "many", "n", "f1"],
    )


def postings(spark: SparkSession, docs: DataFrame, counts: np.ndarray, text_col: str, size: int, percent: int) -> DataFrame:
    """A row (token, size and first half of the name of the set) for each set and token of its prefix under the first order."""
    shared = spark.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = place = 0
        for batch in steps(batches, "text"):
            shingles, at = shingle_sets(*utf8(batch.column("text")), size)
            f1, _ = names_of(shingles, at)
            n = np.diff(at)
            tokens, owners = [], []
            for k in np.unique(f1, return_index=True)[1].tolist():
                if n[k]:
                    tokens.append(prefix(shingles[at[k] : at[k + 1]], shared.value, 0, percent).view(np.int64))
                    owners.append(np.full(len(tokens[-1]), k))
            if tokens:
                who = np.concatenate(owners)
                held.append([np.concatenate(tokens), n[who].astype(np.int32), f1[who]])
                rows += len(who)
            if rows >= SORTED:
                yield _dealt(*map(np.concatenate, zip(*held, strict=True)), (TaskContext.get().partitionId() << 16) + place, LOCAL, BLOCK)
                held, rows, place = [], 0, place + 1
        if held:
            yield _dealt(*map(np.concatenate, zip(*held, strict=True)), (TaskContext.get().partitionId() << 16) + place, LOCAL, BLOCK)

    slim = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    return slim.mapInArrow(run, "token long, block long, many boolean, n int, f1 long")


def _groups(batches: Iterator[pa.RecordBatch], keys: int, limit: int) -> Iterator[tuple[list[np.ndarray], bool]]:
    """Rows in order, about ``limit`` at a time, and whether the last group of equal first ``keys`` columns is complete: it is, unless it is very large."""
    parts: list[list[np.ndarray]] = []
    for batch in batches:
        if batch.num_rows:
            parts.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        if sum(len(x[0]) for x in parts) < limit:
            continue
        rows = [np.concatenate(c) for c in zip(*parts, strict=True)]
        starts, _ = _runs(*rows[:keys])
        cut = int(starts[-1])
        if cut == 0:
            yield rows, False
            parts = []
        else:
            yield [x[:cut] for x in rows], True
            parts = [[x[cut:] for x in rows]]
    if parts:
        yield [np.concatenate(c) for c in zip(*parts, strict=True)], True


def shared_tokens(found: DataFrame) -> DataFrame:
    """Postings of tokens that several sets have, in parts of at most BLOCK sets and one that the part before has too.

    ``many`` tells that a token has several parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: tuple | None = None  # the last group's key and rows so far
        for rows, complete in _groups(batches, 2, GATHERED):
            token, block, many, n, f1 = rows
            keep, _ = _runs(token, block, n, f1)
            token, block, many, n, f1 = (x[keep] for x in (token, block, many, n, f1))
            starts, sizes = _runs(token, block)
            before = np.zeros(len(starts), np.int64)
            if carry and carry[0] == (token[0], block[0]):
                before[0] = carry[1]
            inside = np.arange(len(token)) - np.repeat(starts - before, sizes)
            whole = before + sizes
            more = np.maximum.reduceat(many, starts) | (whole > BLOCK) | (before > 0) | (not complete)
            carry = ((token[-1], block[-1]), int(whole[-1]))
            part = np.where((np.repeat(block[starts], sizes) == 0) & (inside >= BLOCK), -(inside // BLOCK), block)
            bridge = np.flatnonzero((block == 0) & (inside >= BLOCK - 1) & (inside % BLOCK == BLOCK - 1))
            keep = np.repeat((whole > 1) | (not complete), sizes)
            columns = [x[keep] for x in (token, part, np.repeat(more, sizes), n, f1)]
            extra = [token[bridge], -(inside[bridge] // BLOCK) - 1, np.ones(len(bridge), bool), n[bridge], f1[bridge]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x, y])) for x, y in zip(columns, extra, strict=True)], names=["token", "part", "many", "n", "f1"])

    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = found.repartition(parts, "token", "block").sortWithinPartitions("token", "block", F.col("many").desc(), "n", "f1")
    return dealt.mapInArrow(run, "token long, part long, many boolean, n int, f1 long")


def _bits(signs: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(signs[a] ^ signs[b]).sum(1, dtype=np.int64)


def _all_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of every signature of one side with every one of the other."""
    out = np.zeros((len(a), len(b)), np.int64)
    for w in range(PARITIES):
        out += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    return out


def _forest(weight: np.ndarray, far: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a least spanning forest of what is nearer than ``far``."""
    m = len(weight)
    best, to, left = weight[0].copy(), np.zeros(m, np.int64), np.ones(m, bool)
    left[0] = False
    best[0] = far + 1
    a, b = [], []
    for _ in range(m - 1):
        k = int(best.argmin())
        if best[k] < far:
            a.append(int(to[k]))
            b.append(k)
        left[k] = False
        best[k] = far + 1
        nearer = (weight[k] < best) & left
        best[nearer] = weight[k][nearer]
        to[nearer] = k
    return np.array(a, np.int64), np.array(b, np.int64)


@lru_cache(maxsize=None)
def _triangle(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def _wide(rows: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """Rows dealt and sorted by their keys, with the set's number, size and signature."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(*keys, *more, "node", "n", *SIGNATURE).repartition(parts, *keys).sortWithinPartitions(*keys, "node")


def spanning(wide: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets that hold together what may link in each part of a token's bucket, and what that leaves open.

    ``token`` null: a pair (``u``, ``v``). In a small part those are all pairs that sizes and signatures let pass, in a larger one a
    least spanning forest of them by differing bits. Else ``u`` is a member of the token's bucket that has more such pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _ in _groups(batches, 2, GATHERED):
            token, part, many, node, n = rows[:5]
            signs = np.stack(rows[5:], 1).view(np.uint64)
            starts, sizes = _runs(token, part)
            pairs, opened = [], [np.repeat(many[starts], sizes)]
            for size in range(2, SMALL + 1):
                own = starts[sizes == size]
                if len(own):
                    i, j = _triangle(size)
                    a, b = (own[:, None] + i).ravel(), (own[:, None] + j).ravel()
                    fine = may_link(_bits(signs, a, b), n[a], n[b], percent) & (node[a] != node[b])
                    pairs.append((a[fine], b[fine]))
            rest = np.zeros(len(token), bool)
            for at, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
                for low in range(at, at + size, BLOCK + 1):  # a part is no larger, but for an unlikely run of equal names
                    own = slice(low, min(low + BLOCK + 1, at + size))
                    bits = _all_bits(signs[own], signs[own])
                    fine = may_link(bits, n[own, None], n[None, own], percent) & (node[own, None] != node[None, own])
                    tie = ((node[own, None] ^ node[None, own]).view(np.uint64) * _ODD[0]) >> np.uint64(44)
                    far = 1 << 40
                    a, b = _forest(np.where(fine, (bits << 20) | tie.view(np.int64), far), far)
                    pairs.append((a + low, b + low))
                    fine[a, b] = fine[b, a] = False
                    rest[own] = fine.any(1)
            opened.append(rest)
            a, b = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
            u, v = np.minimum(node[a], node[b]), np.maximum(node[a], node[b])
            if len(u):
                u, v = np.unique(np.stack([u, v], 1), axis=0).T
                yield pa.RecordBatch.from_arrays([pa.nulls(len(u), pa.int64()), pa.array(u), pa.array(v)], names=["token", "u", "v"])
            more = np.flatnonzero(opened[0] | opened[1])
            if len(more):
                yield pa.RecordBatch.from_arrays([pa.array(token[more]), pa.array(node[more]), pa.nulls(len(more), pa.int64())], names=["token", "u", "v"])

    return wide.mapInArrow(run, "token long, u long, v long")


def across(opened: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (``u``, ``v``) of open members of a token's bucket that are in different components and may link, each told once.

    Members outside a bucket's largest component are held against all its members, piece by piece. Of the tokens in which
    a pair meets, the smallest tells it, as far as each set's first few tokens show.
    """
    now = opened.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = now.groupBy("token", "component").agg(F.count("*").alias("_k")).groupBy("token")
    usual = sizes.agg(F.max_by("component", F.struct("_k", "component")).alias("_usual"), F.sum("_k").alias("_all"), F.max("_k").alias("_most")).where("_all > _most")
    now = now.join(usual, "token")
    first = now.groupBy("node").agg(F.slice(F.array_sort(F.collect_list("token")), 1, FIRST).alias("first"))
    now = now.withColumn("_left", F.expr(f"cast(ceil((_all - _most) / {BLOCK}) as int)")).withColumn("_right", F.expr(f"cast(ceil(_all / {BLOCK}) as int)"))
    asks = now.where("component <> _usual").withColumn("i", F.expr("cast(pmod(xxhash64(node), _left) as int)")).withColumn("j", F.explode(F.expr("sequence(0, _right - 1)")))
    told = now.withColumn("j", F.expr("cast(pmod(xxhash64(node), _right) as int)")).withColumn("i", F.explode(F.expr("sequence(0, _left - 1)")))
    keys = ["token", "i", "j", "node", "component"]
    both = asks.select(*keys, F.lit(True).alias("asks")).union(told.select(*keys, F.lit(False).alias("asks"))).join(first, "node").join(sets.drop("whole"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _ in _groups(batches, 3, GATHERED):
            token, i, j, ask, component, own, node, n = rows[:8]
            signs = np.stack(rows[8:], 1).view(np.uint64)
            early = np.full((len(own), FIRST), np.iinfo(np.int64).max)
            for k, x in enumerate(own):
                early[k, : len(x)] = x
            starts, sizes = _runs(token, i, j)
            us, vs = [], []
            for at, size in zip(starts.tolist(), sizes.tolist(), strict=True):
                k = np.arange(at, at + size)
                for low in range(0, int(ask[k].sum()), BLOCK):
                    left = k[ask[k]][low : low + BLOCK]
                    right = k[~ask[k]]
                    fine = may_link(_all_bits(signs[left], signs[right]), n[left, None], n[None, right], percent)
                    a, b = np.nonzero(fine & (component[left, None] != component[None, right]))
                    a, b = left[a], right[b]
                    before = ((early[a][:, :, None] == early[b][:, None, :]) & (early[a] < token[at])[:, :, None]).any((1, 2))
                    us.append(np.minimum(node[a], node[b])[~before])
                    vs.append(np.maximum(node[a], node[b])[~before])
            if sum(map(len, us)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    return _wide(both, ["token", "i", "j"], "asks", "component", "first").mapInArrow(run, "u long, v long").distinct()


def held_to_long(spark: SparkSession, pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (``u``, ``v``) of sets, those that their second signatures let pass, where both have one."""
    own = sets.where("whole IS NOT NULL").select("node", "n", "whole")
    for side in ("u", "v"):
        pairs = pairs.join(own.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("whole").alias(f"w{side}")), side, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for k, (a, b, x, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("nu", "nv", "wu", "wv")), strict=True)):
                if x is not None and y is not None:
                    bits = np.bitwise_count(np.frombuffer(x, np.uint64) ^ np.frombuffer(y, np.uint64)).sum(dtype=np.int64)
                    keep[k] = may_link(bits, np.int64(a), np.int64(b), percent)
            yield batch.select(["u", "v"]).filter(pa.array(keep))

    return stored(spark, pairs.select("u", "v", "nu", "nv", "wu", "wv").mapInArrow(run, "u long, v long"), "held")


def details(spark: SparkSession, docs: DataFrame, wanted: DataFrame, counts: np.ndarray, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """For each wanted set (its number, name and a document that has it) its text and the prefixes under the other orders."""
    shared = spark.sparkContext.broadcast(counts)
    orders = [f"o{k}" for k in range(1, ORDERS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            shingles, at = shingle_sets(*utf8(batch.column("text")), size)
            f1, f2 = names_of(shingles, at)
            kept = np.flatnonzero(np.diff(at) > 0)
            columns = [pa.array(f1[kept]), pa.array(f2[kept]), batch.column("text").take(pa.array(kept))]
            for order in range(1, ORDERS):
                own = [(prefix(shingles[at[k] : at[k + 1]], shared.value, order, percent) >> np.uint64(32)).astype(np.uint32).view(np.int32) for k in kept.tolist()]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own) if own else np.zeros(0, np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=["f1", "f2", "text", *orders])

    ids = stored(spark, wanted.select(F.col("rep").alias("_id")).distinct(), "wanted-ids")
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("_doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    made = slim.join(side, F.col("_doc").eqNullSafe(F.col("_id")), "left_semi").select("text").mapInArrow(run, f"f1 long, f2 long, text string, {', '.join(f'{o} array<int>' for o in orders)}")
    names = wanted.select("f1", "f2", "node")
    found = stored(spark, made.join(F.broadcast(names) if ids.count() <= BROADCAST_IDS // 4 else names, ["f1", "f2"]).drop("f1", "f2"), "details")
    return found if found.count() == wanted.count() else stored(spark, found.dropDuplicates(["node"]), "details")


def verified(spark: SparkSession, pairs: DataFrame, sets: DataFrame, docs: DataFrame, counts: np.ndarray, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """Of pairs (``u``, ``v``) of sets, those that share tokens under the other orders too and whose whole texts have the similarity."""
    pairs = held_to_long(spark, pairs, sets, percent)
    wanted = stored(spark, pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(sets.select("node", "f1", "f2", "rep"), "node"), "wanted")
    texts = details(spark, docs, wanted, counts, id_col, text_col, size, percent)
    orders = [f"o{k}" for k in range(1, ORDERS)]
    for side in ("u", "v"):
        pairs = pairs.join(texts.select(F.col("node").alias(side), F.col("text").alias(f"t{side}"), *(F.col(o).alias(f"{o}{side}") for o in orders)), side)
    meet = " AND ".join(f"arrays_overlap({o}u, {o}v)" for o in orders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "tu", "tv"):
            (sa, at), (sb, bt) = (shingle_sets(*utf8(batch.column(c)), size) for c in ("tu", "tv"))
            keep = []
            for k in range(batch.num_rows):
                a, b = sa[at[k] : at[k + 1]], sb[bt[k] : bt[k + 1]]
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(common > 0 and 100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return stored(spark, pairs.where(meet).select("u", "v", "tu", "tv").mapInArrow(run, "u long, v long"), "links")


def set_components(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, by_id: bool) -> tuple[DataFrame, DataFrame]:
    """The described documents, and all sets (``f1``, ``f2``, ``rep``, ``node``) with their ``component``, a set's number.

    ``rep`` is the smallest id of a document that has the set, null if none has an id. With ``by_id`` sets of one id are linked.
    """
    described = stored(spark, describe(docs, id_col, text_col, size), "described")
    counts = document_counts(described)
    rows = described.where("chunk IS NULL").select("doc_id", "n", "f1", "f2", *SIGNATURE, "whole")
    known = rows.where("n > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.min("n").cast("int").alias("n"), *(F.min(x).alias(x) for x in SIGNATURE), F.min("whole").alias("whole"))
    sets = stored(spark, known.withColumn("node", F.monotonically_increasing_id()), "sets")
    tokens = stored(spark, shared_tokens(postings(spark, docs, counts, text_col, size, percent)), "tokens")
    wide = _wide(tokens.join(sets.drop("n", "whole"), "f1"), ["token", "part"], "many")
    found = stored(spark, spanning(wide, percent), "spanning")
    pairs = stored(spark, found.where("token IS NULL").select("u", "v").distinct(), "pairs")
    links = verified(spark, pairs, sets, docs, counts, id_col, text_col, size, percent)
    if by_id:
        several = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(*(f(x).alias(f"_{k}{x}") for k, f in enumerate((F.min, F.max)) for x in ("f1", "f2"))).where("_0f1 <> _1f1 OR _0f2 <> _1f2")
        if several.limit(1).count():
            own = rows.where("n > 0").join(several.select("doc_id"), "doc_id").join(sets.select("f1", "f2", "node"), ["f1", "f2"]).select("doc_id", "node")
            own = stored(spark, own.distinct(), "sets-of-ids")
            links = links.union(own.join(own.groupBy("doc_id").agg(F.min("node").alias("_least")), "doc_id").where("node <> _least").select(F.col("_least").alias("u"), F.col("node").alias("v")))
    labels = connected_components(spark, links)
    opened = stored(spark, found.where("token IS NOT NULL").select("token", F.col("u").alias("node")).distinct(), "opened")
    more = stored(spark, across(opened, sets, labels, percent).join(pairs, ["u", "v"], "left_anti"), "across")
    if more.limit(1).count():
        fresh = verified(spark, more, sets, docs, counts, id_col, text_col, size, percent)
        if fresh.limit(1).count():
            labels = connected_components(spark, links.union(fresh))
    labels = labels.groupBy("node").agg(F.min("component").alias("component"))
    return rows.select("doc_id", "n", "f1", "f2"), sets.select("f1", "f2", "rep", "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def jaccard_components(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """Every document with ``n_shingles`` and ``component_id``, the smallest id that links reach.

    Documents link when their sets of word shingles have a Jaccard similarity of ``percent`` hundredths or more; the
    search is exact. Equal sets are one node. Two sets that link share a token of their prefixes under every one of several
    global orders, each with its own hash, with shingles of few documents first. The first order's tokens bring sets together; there sizes and signatures of
    parities rule out what can't link. What is left must meet under all other orders as well before whole texts are verified.

    In a token's bucket of many sets, pieces of at most BLOCK sets are each held together by the pairs of a least spanning forest by
    differing bits, so a group of near copies costs about as many pairs as it has members. Members whose further pairs would join different components
    are held against those after it, so no link is lost.

    Null and empty texts have no shingles and link with nothing. Rows with equal ids are one document, with the links of any of them, and have one component. A row
    without an id links as any other and gets its set's component, null if no row there has an id; it never names one. An empty table gives no rows, and other columns are ignored.
    """
    rows, sets = set_components(spark, docs, id_col, text_col, size, percent, by_id=True)
    least = sets.groupBy("component").agg(F.min("rep").alias("_least"))
    named = stored(spark, sets.join(least, "component").select(F.col("f1").alias("_f1"), F.col("f2").alias("_f2"), "_least"), "components")
    # equal sets may be many; the other side has each set once, so a hot one can be split
    found = rows.join(named, (F.col("f1") == F.col("_f1")) & (F.col("f2") == F.col("_f2")) & (F.col("n") > 0), "left")
    # an id with an empty text beside others has the component of those
    both = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("n").alias("_n0"), F.max("n").alias("_n1")).where("_n0 = 0 AND _n1 > 0").select(F.col("doc_id").alias("_doc"))
    if both.limit(1).count():
        other = found.where("n > 0").join(both, F.col("doc_id") == F.col("_doc"), "left_semi").groupBy(F.col("doc_id").alias("_doc")).agg(F.min("_least").alias("_other"))
        found = found.join(other, F.col("doc_id") == F.col("_doc"), "left").withColumn("_least", F.coalesce("_least", "_other"))
    return found.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("_least", "doc_id").alias("component_id"))


def first_of_each_group(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of those that links join, directly or through others, one stays.

    It is one with the smallest id; rows without an id come last. Rows are told apart by their
    texts, so different texts under one id, and rows without an id, are each judged on their own; of rows equal in id and set one
    stays. Rows without words link with nothing and all stay. An empty table stays empty, and all columns stay as they are.
    """
    rows, sets = set_components(spark, docs, id_col, text_col, size, percent, by_id=False)
    order = F.struct(F.col("rep").isNull().alias("none"), "rep", "f1", "f2")
    best = sets.groupBy("component").agg(F.min(order).alias("b")).select(F.col("b.f1").alias("_f1"), F.col("b.f2").alias("_f2"), F.col("b.rep").alias("_rep"))
    best = stored(spark, best, "kept-sets")
    odd = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("_k")).where("_k > 1").select(F.col("doc_id").alias("_id"))
    gone = rows.where("n > 0").join(best, (F.col("f1") == F.col("_f1")) & (F.col("f2") == F.col("_f2")) & (F.col("doc_id") == F.col("_rep")), "left_anti").select(F.col("doc_id").alias("_id")).where("_id IS NOT NULL")
    odd = stored(spark, odd, "repeated-ids")
    gone = stored(spark, gone.union(odd).distinct(), "gone")
    own = [f"c{i}" for i in range(len(docs.columns))]  # whatever the columns are called
    plain = docs.select(*(F.col(f"`{c}`").alias(x) for c, x in zip(docs.columns, own, strict=True)))
    key = F.col(own[docs.columns.index(id_col)]).cast("long")
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    kept = plain.where(key.isNotNull()).join(side, key == F.col("_id"), "left_anti")
    again = plain.where(key.isNull())
    if odd.limit(1).count():
        again = again.union(plain.join(odd, key == F.col("_id"), "left_semi"))
    elif not rows.where("doc_id IS NULL").limit(1).count():
        return kept.toDF(*docs.columns)
    packed = again.select(key.alias("doc_id"), F.col(own[docs.columns.index(text_col)]).cast("string").alias("text"), F.struct(*own).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            shingles, at = shingle_sets(*utf8(batch.column("text")), size)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(np.diff(at)), *map(pa.array, names_of(shingles, at))], names=["doc_id", "row", "n", "f1", "f2"])

    schema = StructType([packed.schema["doc_id"], packed.schema["row"], *(StructField(x, LongType()) for x in ("n", "f1", "f2"))])
    named = packed.mapInArrow(run, schema)
    first = named.where("n > 0").join(best, (F.col("f1") == F.col("_f1")) & (F.col("f2") == F.col("_f2")) & F.col("doc_id").eqNullSafe(F.col("_rep")), "left_semi")
    one = first.groupBy("doc_id", "f1", "f2").agg(F.first("row").alias("row")).select("row").union(named.where("n = 0").select("row"))
    return kept.union(one.select("row.*")).toDF(*docs.columns)


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]]) WHEN len(w) > 0 THEN [w] ELSE [] END) AS g FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM k JOIN n x ON u = x.doc_id JOIN n y ON v = y.doc_id WHERE 100 * k >= 90 * (x.n + y.n - k)),
b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
c AS (SELECT DISTINCT u AS node, u AS other FROM b UNION SELECT c.node, b.v FROM c JOIN b ON c.other = b.u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.low, d.doc_id) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN (SELECT node, min(other) AS low FROM c GROUP BY node) m ON d.doc_id = m.node
"""
