"""TF-IDF postings that stay with their leaves.

Leaves are packed, about a million words to a row (a chunk). What travels is each chunk's list of distinct words, answered with their numbers, and
its list of distinct terms (a number, or two for a word pair), answered with how many leaves of all chunks hold them; the lists are sorted
and compressed, so they are a fraction of the text where a row per posting would be many times as long. Numbers are dense and a term's code is
made of them, not hashed: results are exact.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.workspace import new_path, stored

#: Words of a chunk (a longer leaf is a chunk of its own), and asked-for entries that meet in a task.
WORDS, ENTRIES = 1 << 20, 1 << 21

#: Left leaves of a block, right leaves of a tile, and products that are summed at once.
BLOCK, TILE, PRODUCTS = 512, 2048, 1 << 21

#: Where pairs are only counted: words of a block of left leaves (a longer leaf is a block of its own), and numbers that a task holds before it tells them.
BLOCK_WORDS, HELD = 1 << 16, 1 << 22

KEYS = ("side", "corpus", "leaf_id")
CHUNK = "chunk long, n_leaves long, n_words long, has_left boolean, has_right boolean, side array<string>, corpus array<string>, leaf_id array<string>, parts binary, sizes binary, words binary, n_distinct long, codes binary"
COUNTED = "block long, corpus array<string>, words binary, codes binary, length binary, leaf binary"
BLOCKS = "corpus array<string>, leaf_id array<string>, codes binary, leaf binary, w binary"
PAIRS = "left_corpus string, right_corpus string, left_id string, right_id string, cos_sim double"
COUNTS = "left_corpus string, right_corpus string, pairs long"


class Packed(NamedTuple):
    """Packed leaves and where the answers lie."""

    chunks: DataFrame
    words: str
    terms: str
    low: int
    high: int
    n: int


class Leaves(NamedTuple):
    """A chunk's leaves, and its postings by leaf: ``leaf``, ``term`` (a place in ``codes``) and ``w`` above zero."""

    keys: dict[str, pa.Array]
    codes: np.ndarray
    leaf: np.ndarray
    term: np.ndarray
    w: np.ndarray


def pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0, their bytes put together by place and compressed."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:9], "little")
    planes = np.frombuffer(pa.decompress(data[9:], decompressed_size=n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<u8").astype(np.int64)


def pack_rising(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=0))


def pack_words(words: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.record_batch([words.cast(pa.large_string())], names=["w"])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack_words(data: bytes) -> pa.Array:
    return pa.ipc.open_stream(data).read_all().column(0).combine_chunks()


def _small_batches(spark: SparkSession) -> None:
    """Rows of packed arrays go to Python few at a time, unless the session has settings of its own."""
    for name, default, own in (("maxRecordsPerBatch", "10000", "1000"), ("maxBytesPerBatch", "67108864b", "8m")):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}") == default:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", own)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _frame(spark_schema: str, **columns) -> pa.RecordBatch:
    """Rows as the schema, whose fields are strings, longs, doubles, binaries and lists of strings, wants them."""
    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    fields = [f.strip().split(" ") for f in spark_schema.split(",")]
    arrays = [v.cast(kinds[t]) if isinstance(v := columns[name], pa.Array) else pa.array(v, kinds[t]) for name, t in fields]
    return pa.record_batch(arrays, names=[name for name, _ in fields])


# --- packing --------------------------------------------------------------------------


def _chunk(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(held).combine_chunks()
    lists = rows.column("lists").combine_chunks() if rows.num_rows else None
    parts = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
    flat = lists.flatten()
    sizes = np.asarray(pc.fill_null(pc.list_value_length(flat), 0))
    coded = flat.flatten().dictionary_encode()
    order = np.asarray(pc.array_sort_indices(coded.dictionary))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    codes = rank[np.asarray(coded.indices)] if len(coded) else np.zeros(0, np.int64)
    own = {k: [rows.column(k).to_pylist()] for k in KEYS}
    return _frame(
        CHUNK, chunk=[number], n_leaves=[int(parts.sum())], n_words=[len(codes)], has_left=["left" in own["side"][0]], has_right=["right" in own["side"][0]], **own,
        parts=[pack(parts)], sizes=[pack(sizes)], words=[pack_words(coded.dictionary.take(pa.array(order)))], n_distinct=[len(order)], codes=[pack(codes)],
    )


def _chunker(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made, held, words = TaskContext.get().partitionId() << 32, 0, [], 0
        for batch in batches:
            begin = 0
            ends = np.concatenate([[0], np.cumsum(np.asarray(batch.column("n_words")))])
            while begin < batch.num_rows:
                end = max(begin + (0 if held else 1), int(np.searchsorted(ends, ends[begin] + most - words, "right")) - 1)
                if end > begin:
                    held.append(batch.slice(begin, end - begin))
                    words += int(ends[end] - ends[begin])
                if end < batch.num_rows:
                    yield _chunk(first + made, held)
                    made, held, words = made + 1, [], 0
                begin = end
        if held:
            yield _chunk(first + made, held)

    return run


def _one_row_each(leaves: DataFrame, lemmas: str) -> tuple[DataFrame, bool]:
    """A row per leaf with its ``lists`` of lemmas: rows of one side, corpus and id are one leaf, but no word pair lies in two of them. Also whether there are such.

    Only rows whose key repeats are grouped; of all others the texts don't travel.
    """
    rows = leaves.select(*KEYS, F.col(lemmas).alias("_l"))
    again = leaves.groupBy(*KEYS).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    again = stored(leaves.sparkSession, again, "repeated")
    repeated = not again.isEmpty()
    if not repeated:
        rows = rows.withColumn("lists", F.array("_l"))
    else:
        same = [rows[k].eqNullSafe(again[k]) for k in KEYS]
        once = rows.join(again, same, "left_anti").withColumn("lists", F.array("_l"))
        rows = once.drop("_l").unionByName(rows.join(again, same, "left_semi").groupBy(*KEYS).agg(F.collect_list("_l").alias("lists")))
    size = F.aggregate("lists", F.lit(0).cast("long"), lambda n, x: n + F.coalesce(F.size(x), F.lit(0)))
    return rows.select(*KEYS, "lists", size.alias("n_words")), repeated


def _word_buckets(words: pa.Array, buckets: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode()) % buckets for w in words.to_pylist()), np.int64, len(words))


def _term_buckets(codes: np.ndarray, buckets: int) -> np.ndarray:
    mixed = codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _dealt(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    begins = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for i, own in zip(begins, np.split(order, begins[1:]), strict=True) if len(order) else ():
        yield int(bucket[order[i]]), own


def _answered(asked: DataFrame, answer, name: str) -> str:
    """Bring together what all chunks ask a bucket, and write the answers to a folder for each chunk."""
    spark = asked.sparkSession
    rows = asked.groupBy("bucket").applyInArrow(answer, "chunk long, bucket long, answer binary")
    path = new_path(spark, name)
    rows.repartition("chunk").write.partitionBy("chunk").parquet(path)
    return path


def _files(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _answers(path: str, chunk: int) -> dict[int, np.ndarray]:
    store, base = _files(path)
    folder = f"{base}/chunk={chunk}"
    if store.get_file_info(folder).type == fs.FileType.NotFound:
        return {}
    rows = ds.dataset(folder, filesystem=store, format="parquet", exclude_invalid_files=False).to_table(columns=["bucket", "answer"])
    return {b: unpack(a) for b, a in zip(rows.column("bucket").to_pylist(), rows.column("answer").to_pylist(), strict=True)}


def _placed(answers: dict[int, np.ndarray], bucket: np.ndarray) -> np.ndarray:
    out = np.zeros(len(bucket), np.int64)
    for b, own in _dealt(bucket):
        out[own] = answers[b]
    return out


def _number_words(table: pa.Table) -> pa.Table:
    """Each word's number: its place among the bucket's sorted words, and the bucket."""
    lists = [unpack_words(x) for x in table.column("words").to_pylist()]
    coded = pa.concat_arrays(lists).dictionary_encode()
    order = np.asarray(pc.array_sort_indices(coded.dictionary))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    bucket, buckets = table.column("bucket")[0].as_py(), table.column("buckets")[0].as_py()
    numbers = rank[np.asarray(coded.indices)] * buckets + bucket + 1
    if len(order) and int(numbers.max()) >= 1 << 31:
        raise ValueError("more than 2^31 distinct words")
    cut = np.cumsum([len(x) for x in lists])[:-1]
    return _answer_table(table, np.split(numbers, cut))


def _answer_table(table: pa.Table, answers: list[np.ndarray]) -> pa.Table:
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "answer": pa.array([pack(a) for a in answers], pa.binary())})


def _text(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """For each word of a chunk, the list that it is in, and the leaf."""
    parts, sizes = unpack(row["parts"]), unpack(row["sizes"])
    part = np.repeat(np.arange(len(sizes)), sizes)
    return part, np.repeat(np.arange(len(parts)), parts)[part] if len(part) else part


def _ngrams(row: dict, words_at: str, word_buckets: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's distinct codes, and for each leaf's term: leaf, place of its code, count, and the leaf's largest count."""
    words = unpack_words(row["words"])
    number = _placed(_answers(words_at, row["chunk"]), _word_buckets(words, word_buckets)) if len(words) else np.zeros(0, np.int64)
    part, leaf = _text(row)
    text = number[unpack(row["codes"])] if row["n_words"] else np.zeros(0, np.int64)
    codes, of = [], []
    if low <= 1:
        codes, of = [text], [leaf]
    if high >= 2:
        inner = np.flatnonzero(part[1:] == part[:-1])
        codes.append(text[inner] << 32 | text[inner + 1])
        of.append(leaf[inner])
    distinct, place = np.unique(np.concatenate(codes), return_inverse=True)
    keys, count = np.unique(np.concatenate(of) * max(1, len(distinct)) + place, return_counts=True)
    leaf, place = np.divmod(keys, max(1, len(distinct)))
    begins = np.flatnonzero(np.diff(leaf, prepend=-1))
    most = np.repeat(np.maximum.reduceat(count, begins), np.diff(begins, append=len(leaf))) if len(leaf) else count
    return distinct, leaf, place, count, most


def packed(leaves: DataFrame, lemmas: str = "lemmas", low: int = 1, high: int = 2, max_df: float | int = 0.5, min_df: int = 2, words: int = WORDS, entries: int = ENTRIES) -> Packed:
    """Pack leaves (``side, corpus, leaf_id`` and a list of lemmas) and find which terms count, and how much.

    tf is a term's count by the largest count of any n-gram in the leaf, also of those that df rules out; idf is ln(N / df) over the rows of both sides.
    """
    if not 1 <= low <= high <= 2:
        raise ValueError(f"packed postings have single words and pairs, not {low} to {high}")
    spark = leaves.sparkSession
    _small_batches(spark)
    chunks = stored(spark, _one_row_each(leaves, lemmas)[0].mapInArrow(_chunker(words), CHUNK), "chunks")
    sums = chunks.agg(F.sum("n_leaves").alias("n"), F.sum("n_words").alias("words"), F.sum("n_distinct").alias("distinct")).first()
    n, word_buckets, term_buckets = sums["n"] or 0, (sums["distinct"] or 0) // entries + 1, 2 * (sums["words"] or 0) // entries + 1

    def ask_words(batches):
        for row in _rows(batches):
            known = unpack_words(row["words"])
            for b, own in _dealt(_word_buckets(known, word_buckets)):
                yield _frame("chunk long, bucket long, buckets long, words binary", chunk=[row["chunk"]], bucket=[b], buckets=[word_buckets], words=[pack_words(known.take(pa.array(own)))])

    asked = chunks.select("chunk", "words").mapInArrow(ask_words, "chunk long, bucket long, buckets long, words binary")
    words_at = _answered(asked, _number_words, "words")

    def ask_terms(batches):
        for row in _rows(batches):
            codes, _, place, _, _ = _ngrams(row, words_at, word_buckets, low, high)
            held = np.bincount(place, minlength=len(codes))
            for b, own in _dealt(_term_buckets(codes, term_buckets)):
                yield _frame("chunk long, bucket long, codes binary, held binary", chunk=[row["chunk"]], bucket=[b], codes=[pack_rising(codes[own])], held=[pack(held[own])])

    most = int(np.floor(n * max_df)) if isinstance(max_df, float) else max_df

    def count(table: pa.Table) -> pa.Table:
        lists = [np.cumsum(unpack(x)) for x in table.column("codes").to_pylist()]
        held = np.concatenate([unpack(x) for x in table.column("held").to_pylist()])
        _, place = np.unique(np.concatenate(lists), return_inverse=True)
        df = np.bincount(place, weights=held).astype(np.int64)
        df[(df < min_df) | (df > most)] = 0
        return _answer_table(table, np.split(df[place], np.cumsum([len(x) for x in lists])[:-1]))

    asked = chunks.select("chunk", "n_words", "parts", "sizes", "words", "codes").mapInArrow(ask_terms, "chunk long, bucket long, codes binary, held binary")
    terms_at = _answered(asked, count, "terms")
    return Packed(chunks, f"{word_buckets} {words_at}", f"{term_buckets} {terms_at}", low, high, n)


def _weighted(row: dict, own: tuple) -> Leaves:
    words_at, terms_at, low, high, n = own
    word_buckets, words_at = words_at.split(" ", 1)
    term_buckets, terms_at = terms_at.split(" ", 1)
    codes, leaf, place, count, most = _ngrams(row, words_at, int(word_buckets), low, high)
    df = _placed(_answers(terms_at, row["chunk"]), _term_buckets(codes, int(term_buckets))) if len(codes) else codes
    good = df[place] > 0
    leaf, place, tf = leaf[good], place[good], (count / most)[good]
    raw = tf * np.log(n / df[place])
    norm = np.sqrt(np.bincount(leaf, weights=raw * raw, minlength=len(row["leaf_id"])))[leaf]
    good = (raw > 0) & (norm > 0)
    keys = {k: pa.array(row[k], pa.string()) for k in KEYS}
    return Leaves(keys, codes, leaf[good], place[good], raw[good] / norm[good])


def _only(p: Packed) -> tuple:
    return p.words, p.terms, p.low, p.high, p.n


def _spelled(row: dict, p: tuple, codes: np.ndarray) -> pa.Array:
    """The texts of codes that the chunk holds."""
    word_buckets, words_at = p[0].split(" ", 1)
    words = unpack_words(row["words"])
    number = _placed(_answers(words_at, row["chunk"]), _word_buckets(words, int(word_buckets)))
    order = np.argsort(number)
    at = lambda x: words.take(pa.array(order[np.searchsorted(number, x, sorter=order)]))
    first, last = codes >> 32, codes & 0xFFFFFFFF
    single = first == 0
    head = at(np.where(single, last, first))
    return pc.if_else(pa.array(single), head, pc.binary_join_element_wise(head, at(last), pa.scalar(" ", pa.large_string()))) if len(codes) else pa.array([], pa.large_string())


# --- what is asked of them ------------------------------------------------------------


def rows(p: Packed, only: Sequence[tuple[str, str]] | None = None, digits: int | None = None) -> DataFrame:
    """``side, corpus, leaf_id, term, w``: a row per posting; of the leaves of ``only`` (``side, leaf_id``), a list as long as a report, if given."""
    own, schema, wanted = _only(p), "side string, corpus string, leaf_id string, term string, w double", None if only is None else set(only)

    def run(batches):
        for row in _rows(batches):
            if wanted is not None and not wanted.intersection(zip(row["side"], row["leaf_id"], strict=True)):
                continue
            x = _weighted(row, own)
            keep = np.arange(len(x.leaf))
            if wanted is not None:
                keep = np.flatnonzero(np.array([k in wanted for k in zip(row["side"], row["leaf_id"], strict=True)])[x.leaf])
            spelled = _spelled(row, own, x.codes)
            for i in range(0, len(keep), 1 << 17):
                at = keep[i : i + (1 << 17)]
                keys = {k: v.take(pa.array(x.leaf[at])) for k, v in x.keys.items()}
                yield _frame(schema, **keys, term=spelled.take(pa.array(x.term[at])), w=pa.array(x.w[at] if digits is None else rounded(x.w[at], digits)))

    return p.chunks.mapInArrow(run, schema)


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    return np.floor(x * 10.0**digits + 0.5) / 10.0**digits


def _first(groups: np.ndarray, n: int) -> np.ndarray:
    """Of sorted groups, whether a row is among the first ``n`` of its group."""
    begins = np.flatnonzero(np.diff(groups, prepend=-1))
    return np.arange(len(groups)) - np.repeat(begins, np.diff(begins, append=len(groups))) < n


def top_terms(p: Packed, n: int, digits: int) -> DataFrame:
    """Each leaf's ``n`` heaviest terms by weights of so many digits, ties by term."""
    own, schema = _only(p), "side string, corpus string, leaf_id string, term string, w double, rank long"

    def run(batches):
        for row in _rows(batches):
            x = _weighted(row, own)
            w = rounded(x.w, digits)
            order = np.lexsort((-w, x.leaf))
            # whatever is as heavy as a leaf's n-th is spelled
            place = np.arange(len(order)) - np.searchsorted(x.leaf[order], x.leaf[order])
            least = np.full(len(row["leaf_id"]), -1.0)
            last = order[place == n - 1]
            least[x.leaf[last]] = w[last]
            order = order[w[order] >= least[x.leaf[order]]]
            spelled = _spelled(row, own, x.codes[x.term[order]])
            by = np.empty(len(order), np.int64)
            by[np.asarray(pc.array_sort_indices(spelled))] = np.arange(len(order))
            again = np.lexsort((by, -w[order], x.leaf[order]))
            again = again[_first(x.leaf[order][again], n)]
            order, spelled = order[again], spelled.take(pa.array(again))
            leaf = x.leaf[order]
            rank = np.arange(len(order)) - np.searchsorted(leaf, leaf) + 1
            yield _frame(schema, **{k: v.take(pa.array(leaf)) for k, v in x.keys.items()}, term=spelled, w=pa.array(w[order]), rank=pa.array(rank))

    return p.chunks.mapInArrow(run, schema)


def _left_blocks(p: Packed, block: int) -> DataFrame:
    own = _only(p)

    def run(batches):
        for row in _rows(batches):
            x = _weighted(row, own)
            left = np.flatnonzero(np.array([s == "left" for s in row["side"]]))
            for i in range(0, len(left), block):
                some = left[i : i + block]
                at = np.full(len(row["side"]), -1)
                at[some] = np.arange(len(some))
                keep = np.flatnonzero(at[x.leaf] >= 0)
                keep = keep[np.argsort(x.term[keep], kind="stable")]
                yield _frame(
                    BLOCKS, corpus=[[row["corpus"][j] for j in some]], leaf_id=[[row["leaf_id"][j] for j in some]],
                    codes=[pack_rising(x.codes[x.term[keep]])], leaf=[pack(at[x.leaf[keep]])], w=[x.w[keep].tobytes()],
                )

    return stored(p.chunks.sparkSession, p.chunks.where("has_left").mapInArrow(run, BLOCKS), "left")


def _ranks(ids: list) -> np.ndarray:
    out = np.empty(len(ids), np.int64)
    out[np.asarray(pc.array_sort_indices(pa.array(ids, pa.string()), null_placement="at_start"))] = np.arange(len(ids))
    return out


def similarities(p: Packed, pairs: Sequence[tuple[str, str]], digits: int, threshold: float | None = None, per_left: int | None = None, per_right: int | None = None, best: int | None = None,
                 block: int = BLOCK, tile: int = TILE, products: int = PRODUCTS) -> DataFrame:
    """``left_corpus, right_corpus, left_id, right_id, cos_sim`` of leaves that share a term, within the allowed corpus pairs, a configuration's.

    Blocks of left leaves meet chunks of right ones, where sums are made whole, so no product travels. With ``threshold``, similarities from there on. With
    ``per_left``, ``per_right`` or ``best`` only what can still be among so many of a left leaf (for each right corpus), of a right leaf or of all leaves
    the task: the cut itself is made over the few rows that are left.
    """
    own, allowed = _only(p), {x for x in pairs if None not in x}

    def run(batches):
        last, x, right = None, None, None
        for row in _rows(batches):
            if row["chunk"] != last:
                last, x = row["chunk"], _weighted(row, own)
                right = np.array([s == "right" for s in row["side"]])
                right_rank = _ranks(row["leaf_id"])
                corpora = sorted({c for c in row["corpus"] if c is not None})
                kind = np.array([corpora.index(c) if c is not None else -1 for c in row["corpus"]], np.int64)
            ids, of = row["b_leaf_id"], row["b_corpus"]
            left_rank, names = _ranks(ids), sorted({c for c in of if c is not None})
            left_kind = np.array([names.index(c) if c is not None else -1 for c in of], np.int64)
            may = np.zeros((len(names) + 1, len(corpora) + 1), bool)  # the last of either: no corpus
            for i, a in enumerate(names):
                may[i, : len(corpora)] = [(a, b) in allowed for b in corpora]
            codes, leaf, w = np.cumsum(unpack(row["b_codes"])), unpack(row["b_leaf"]), np.frombuffer(row["b_w"])
            known, begin, length = np.unique(codes, return_index=True, return_counts=True)
            if not len(known) or not len(x.leaf):
                continue
            at = np.minimum(np.searchsorted(known, x.codes), len(known) - 1)
            at[known[at] != x.codes] = -1
            keep = np.flatnonzero((at[x.term] >= 0) & right[x.leaf] & may.any(0)[kind][x.leaf])
            lefts = {"left_corpus": pa.array(of, pa.string()), "left_id": pa.array(ids, pa.string())}
            for i in range(0, len(row["side"]), tile):
                a, b = np.searchsorted(x.leaf[keep], (i, i + tile))
                if a == b:
                    continue
                some = keep[a:b]
                width = min(tile, len(row["side"]) - i)
                total = np.zeros(len(ids) * width)
                term = at[x.term[some]]
                ends = np.cumsum(length[term])
                lo = 0
                while lo < len(some):
                    hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + products, "right")))
                    n = length[term[lo:hi]]
                    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    entry = np.repeat(begin[term[lo:hi]], n) + within
                    cell = leaf[entry] * width + np.repeat(x.leaf[some[lo:hi]] - i, n)
                    total += np.bincount(cell, weights=w[entry] * np.repeat(x.w[some[lo:hi]], n), minlength=len(total))
                    lo = hi
                cell = np.flatnonzero(total > 0)
                li, ri = np.divmod(cell, width)
                ri += i
                ok = may[left_kind[li], kind[ri]]
                li, ri, cos = li[ok], ri[ok], rounded(total[cell[ok]], digits)
                if threshold is not None:
                    ok = cos >= threshold
                    li, ri, cos = li[ok], ri[ok], cos[ok]
                if per_left is not None:
                    g = li * len(corpora) + kind[ri]
                    order = np.lexsort((right_rank[ri], -cos, g))
                    order = order[_first(g[order], per_left)]
                elif per_right is not None:
                    g = ri * len(names) + left_kind[li]
                    order = np.lexsort((left_rank[li], -cos, g))
                    order = order[_first(g[order], per_right)]
                elif best is not None:
                    order = np.lexsort((right_rank[ri], left_rank[li], -cos))[:best]
                else:
                    order = np.arange(len(cos))
                for j in range(0, len(order), 1 << 17):
                    o = order[j : j + (1 << 17)]
                    rights = {"right_corpus": x.keys["corpus"].take(pa.array(ri[o])), "right_id": x.keys["leaf_id"].take(pa.array(ri[o]))}
                    yield _frame(PAIRS, **{k: v.take(pa.array(li[o])) for k, v in lefts.items()}, **rights, cos_sim=pa.array(cos[o]))

    blocks = _left_blocks(p, block)
    both = p.chunks.where("has_right").crossJoin(blocks.select(*(F.col(c).alias(f"b_{c}") for c in blocks.columns)))
    return both.mapInArrow(run, PAIRS)


# --- pairs counted without postings ---------------------------------------------------


def _blocks(path: str) -> Iterator[dict]:
    store, base = _files(path)
    for batch in ds.dataset(base, filesystem=store, format="parquet", exclude_invalid_files=False).to_batches(batch_size=1, batch_readahead=1, fragment_readahead=1):
        yield from _rows([batch])


def _held(words: pa.Array, part: np.ndarray, leaf: np.ndarray, codes: np.ndarray, block: dict, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a chunk's leaves, which terms of the block each holds: leaf and place, each once."""
    known = np.cumsum(unpack(block["codes"]))
    number = np.asarray(pc.fill_null(pc.index_in(words, value_set=unpack_words(block["words"])), -1)).astype(np.int64) + 1
    text = number[codes]
    found, of = [], []
    if low <= 1:
        at = np.flatnonzero(text)
        found, of = [text[at]], [leaf[at]]
    if high >= 2:
        at = np.flatnonzero((text[1:] > 0) & (text[:-1] > 0) & (part[1:] == part[:-1]))
        found.append(text[at] << 32 | text[at + 1])
        of.append(leaf[at])
    found, of = np.concatenate(found), np.concatenate(of)
    place = np.minimum(np.searchsorted(known, found), len(known) - 1)
    good = known[place] == found
    return np.divmod(np.unique(of[good] * len(known) + place[good]), len(known))


def pair_counts(leaves: DataFrame, pairs: Sequence[tuple[str, str]], lemmas: str = "lemmas", low: int = 1, high: int = 2, max_df: float | int = 0.5, min_df: int = 2,
                words: int = WORDS, block_words: int = BLOCK_WORDS, cells: int = BLOCK * TILE, products: int = PRODUCTS, held: int = HELD) -> DataFrame:
    """``left_corpus, right_corpus, pairs``: how many pairs ``similarities`` finds, without finding how similar they are; a corpus pair may have several rows.

    A similarity is above zero where the leaves share a term that df lets through, unless all leaves hold it: any other weighs more than zero in every leaf.
    Only terms of left leaves can be shared. So those are stored, in blocks, and all texts are read twice: to count how many leaves hold such terms, and to count
    pairs. Of right leaves only keys are shuffled, and nothing is stored, unless several rows are one leaf: then texts are put together once, and kept in chunks.
    """
    if not 1 <= low <= high <= 2:
        raise ValueError(f"packed postings have single words and pairs, not {low} to {high}")
    spark, allowed = leaves.sparkSession, {x for x in pairs if None not in x}
    _small_batches(spark)
    rows, repeated = _one_row_each(leaves, lemmas)
    n, chunker, small = leaves.count(), _chunker(words), _chunker(block_words)
    most = min(int(np.floor(n * max_df)) if isinstance(max_df, float) else max_df, n - 1)

    def make(batches):
        first = TaskContext.get().partitionId() << 32
        for i, row in enumerate(_rows(small(batches))):
            own = unpack_words(row["words"])
            part, leaf = _text(row)
            text = unpack(row["codes"]) + 1
            inner = np.flatnonzero(part[1:] == part[:-1])
            codes = np.concatenate([text] * (low <= 1) + [text[inner] << 32 | text[inner + 1]] * (high >= 2))
            of = np.concatenate([leaf] * (low <= 1) + [leaf[inner]] * (high >= 2))
            if not len(codes):
                continue
            distinct, place = np.unique(codes, return_inverse=True)
            some, of = np.unique(of, return_inverse=True)
            place, of = np.divmod(np.unique(place * len(some) + of), len(some))
            yield _frame(
                COUNTED, block=[first + i], corpus=[[row["corpus"][j] for j in some]], words=[pack_words(own)], codes=[pack_rising(distinct)],
                length=[pack(np.bincount(place, minlength=len(distinct)))], leaf=[pack(of)],
            )

    at = new_path(spark, "left")
    rows.where("side = 'left'").mapInArrow(make, COUNTED).write.parquet(at)

    texts = stored(spark, rows.mapInArrow(chunker, CHUNK), "chunks") if repeated else rows

    def each(batches):
        for row in _rows(batches if repeated else chunker(batches)):
            if row["n_words"]:
                own = (unpack_words(row["words"]), *_text(row), unpack(row["codes"]))
                for block in _blocks(at):
                    yield row, block, *_held(*own, block, low, high)

    def ask(batches):
        sums: dict[int, np.ndarray] = {}

        def told():
            for b, x in sums.items():
                yield _frame("chunk long, bucket long, held binary", chunk=[b], bucket=[b], held=[pack(x)])
            sums.clear()

        for _, block, _, place in each(batches):
            size = int.from_bytes(block["codes"][1:9], "little")
            sums[block["block"]] = sums.get(block["block"], 0) + np.bincount(place, minlength=size)
            if sum(map(len, sums.values())) > held:
                yield from told()
        yield from told()

    def count(table: pa.Table) -> pa.Table:
        df = sum(unpack(x) for x in table.column("held").to_pylist())
        return _answer_table(table.slice(0, 1), [((df >= min_df) & (df <= most)).astype(np.int64)])

    kept = _answered(texts.mapInArrow(ask, "chunk long, bucket long, held binary"), count, "kept")

    def meet(batches):
        names, corpora = ({c: i for i, c in enumerate(sorted(x))} for x in ({a for a, _ in allowed}, {b for _, b in allowed}))
        sums = np.zeros((len(names), len(corpora)), np.int64)
        for row, block, leaf, place in each(batches):
            n_left, width = len(block["corpus"]), max(1, cells // len(block["corpus"]))
            left_kind = np.array([names.get(c, -1) for c in block["corpus"]], np.int64)
            kind = np.array([corpora.get(c, -1) if s == "right" else -1 for c, s in zip(row["corpus"], row["side"], strict=True)], np.int64)
            keep = _answers(kept, block["block"])[block["block"]][place] > 0
            keep &= kind[leaf] >= 0
            leaf, place = leaf[keep], place[keep]
            length, left = unpack(block["length"]), unpack(block["leaf"])
            begin = np.cumsum(length) - length
            for i in range(0, len(row["side"]), width):
                lo, end = np.searchsorted(leaf, (i, i + width))
                if lo == end:
                    continue
                cell = np.zeros(n_left * width, bool)
                ends = np.cumsum(length[place[lo:end]])
                first = lo
                while lo < end:
                    hi = max(lo + 1, first + int(np.searchsorted(ends, (ends[lo - first - 1] if lo > first else 0) + products, "right")))
                    m = length[place[lo:hi]]
                    within = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                    cell[left[np.repeat(begin[place[lo:hi]], m) + within] * width + np.repeat(leaf[lo:hi] - i, m)] = True
                    lo = hi
                li, ri = np.divmod(np.flatnonzero(cell), width)
                li, ri = left_kind[li], kind[ri + i]
                sums += np.bincount((li * len(corpora) + ri)[li >= 0], minlength=sums.size).reshape(sums.shape)
        got = [(x, y, int(k)) for x, y in allowed if (k := sums[names[x], corpora[y]])]
        yield _frame(COUNTS, left_corpus=[x for x, _, _ in got], right_corpus=[y for _, y, _ in got], pairs=[k for _, _, k in got])

    return texts.mapInArrow(meet, COUNTS)
