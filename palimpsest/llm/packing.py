"""Packing token streams into fixed windows by multiway differencing."""

from __future__ import annotations

import base64
import heapq
import itertools
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.arrow import small_batches, steps, utf8

#: Windows that are filled together, the longest piece, and the tokens per window left free so that near-equal windows fit.
WINDOWS, PIECE, SLACK = 64, 256, 26

#: The vocabulary's added tokens, which the ``.tiktoken`` form leaves out: their strings in a text are one id.
ADDED = {"<|endoftext|>": 50256}

SCHEMA = "{id} {type}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def differencing(lengths: list[int], windows: int) -> np.ndarray:
    """Karmarkar-Karp: the window of each item.

    Every item begins as a partial partition (its length, 0, ..., 0). The two
    partitions with the largest spread are merged, the fullest window of one
    onto the emptiest of the other, until one is left.
    """
    n, k = len(lengths), windows
    sums: dict[int, np.ndarray] = {}
    made: list[tuple[int, int, np.ndarray]] = []
    heap = [(-x, i) for i, x in enumerate(lengths)]
    heapq.heapify(heap)

    def loads(node: int) -> np.ndarray:
        if node >= n:
            return sums.pop(node)
        own = np.zeros(k, np.int64)
        own[0] = lengths[node]
        return own

    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = loads(a) + loads(b)[::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        sums[n + len(made)] = both
        heapq.heappush(heap, (int(both[-1] - both[0]), n + len(made)))
        made.append((a, b, order))
    window = np.zeros(n, np.int64)
    names: dict[int, np.ndarray] = {heap[0][1]: np.arange(k)} if heap else {}
    for at in range(len(made) - 1, -1, -1):
        a, b, order = made[at]
        own = names.pop(n + at)
        for child, slot in ((a, order), (b, k - 1 - order)):
            if child >= n:
                names[child] = np.empty(k, np.int64)
                names[child][slot] = own
            else:
                window[child] = own[np.flatnonzero(slot == 0)[0]]
    if n == 1:
        window[0] = 0
    return window


def fill(lengths: list[int], capacity: int) -> np.ndarray:
    """Windows by differencing; one more whenever a window is over capacity."""
    windows = max(1, -(-sum(lengths) // capacity))
    while True:
        found = differencing(lengths, windows)
        if np.bincount(found, lengths, windows).max(initial=0) <= capacity:
            return found
        windows += 1


@lru_cache(maxsize=2)
def _encoder(path: str) -> tuple[Callable[[list[str]], list], Callable[[str], list[int]] | None, np.ndarray]:
    """What encodes a list of chunks, what encodes a text without added tokens in one go, and each id's bytes.

    A ``.json`` file is read by tokenizers, chunk by chunk. A ``.tiktoken`` file holds the same
    kind of vocabulary as ranks; its library gives equal ids several times faster.
    """
    if path.endswith(".tiktoken"):
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED)
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            size[rank] = len(token)
        return lambda chunks: [own.encode(x, allowed_special="all") for x in chunks], own.encode_ordinary, size
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda chunks: [x.ids for x in tokenizer.encode_batch_fast(chunks, add_special_tokens=False)], None, np.zeros(0, np.int64)


def _blank(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def _may_be_blank(lead: np.ndarray) -> np.ndarray:
    """First bytes of characters that may be white space."""
    return (lead == 0xC2) | ((lead >= 0xE1) & (lead <= 0xE3))


def _encode(chunks: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct chunks in a row, and how many each has.

    Chunks that begin with a single space and end with an ASCII character that isn't white space split apart again
    wherever they are put together, so they are encoded as one text; the ids' bytes tell where each ends.
    """
    encode, at_once, size = _encoder(path)
    data, ends = utf8(chunks)
    n, many = len(chunks), np.diff(ends)
    plain = np.zeros(n, bool)
    if at_once is not None and n:
        long = np.flatnonzero(many >= 2)
        second, last = data[ends[long] + 1], data[ends[long + 1] - 1]
        plain[long] = (data[ends[long]] == 32) & ~_blank(second) & ~_may_be_blank(second) & (last < 0x80) & ~_blank(last)
        for token in ADDED:
            if token.encode() in data.tobytes():
                plain &= ~pc.match_substring(chunks, token).to_numpy(zero_copy_only=False)
    counts, parts = np.zeros(n, np.int64), []
    whole = np.flatnonzero(plain)
    if len(whole):
        joined = data[np.repeat(plain, many)].tobytes().decode()
        ids = np.array(at_once(joined), np.uint32)
        upto = np.cumsum(size[ids])
        stop = np.cumsum(many[whole])
        past = np.searchsorted(upto, stop) + 1
        if not np.array_equal(upto[past - 1], stop):
            raise ValueError("chunks that were put together share a token")
        counts[whole] = np.diff(past, prepend=0)
        parts.append((whole, ids))
    rest = np.flatnonzero(~plain)
    if len(rest):
        found = encode(chunks.take(pa.array(rest)).to_pylist())
        counts[rest] = np.fromiter(map(len, found), np.int64, len(rest))
        parts.append((rest, np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(counts[rest].sum()))))
    first = np.cumsum(counts) - counts
    flat = np.zeros(int(counts.sum()), np.uint32)
    for which, ids in parts:
        own = counts[which]
        flat[np.arange(len(ids)) + np.repeat(first[which] - (np.cumsum(own) - own), own)] = ids
    return flat, counts


def _chunk_starts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places where a text can be cut without changing its byte-level BPE ids.

    The pretokenizer's pieces hold white space only at their front or as a run
    of its own, so a single space between two characters that are not white
    space always opens a piece; added tokens hold no white space. A neighbour that could be Unicode white space
    makes the place unsafe; the chunk is then longer, and its ids the same.
    """
    at = np.zeros(len(data) + 1, bool)
    at[ends[:-1]] = True
    if len(data) >= 3:
        blank = _blank(data)
        before = ~blank & (data < 0x80)
        before[1:] |= (data[1:] >= 0x80) & (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
        at[1:-2] |= (data[1:-1] == 32) & before[:-2] & ~blank[2:] & ~_may_be_blank(data[2:])
    return np.flatnonzero(at[:-1])


def token_ids(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and where each text's ids begin and the last end.

    Words repeat, so every distinct chunk is encoded once and looked up after.
    """
    data, ends = utf8(column)
    starts = _chunk_starts(data, ends)
    chunks = pa.LargeStringArray.from_buffers(
        len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))
    ).dictionary_encode()
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(len(ends), np.int64)
    code = chunks.indices.to_numpy(zero_copy_only=False)
    flat, counts = _encode(chunks.dictionary, path)
    first = np.cumsum(counts) - counts
    many = counts[code]
    upto = np.concatenate([[0], np.cumsum(many)])
    ids = flat[np.arange(upto[-1]) + np.repeat(first[code] - upto[:-1], many)]
    return ids, upto[np.searchsorted(starts, ends)]


def pack_sequences(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int = 1,
    windows: int = WINDOWS,
    piece: int = PIECE,
    slack: int = SLACK,
) -> DataFrame:
    """Pack every document's ids, with ``end_id`` after them, into sequences of at most ``capacity`` ids.

    One row per piece: the id column, ``start`` (the document's ids before
    it), ``length``, ``doc_tokens``, ``sequence_id``, ``offset`` in the
    sequence, and ``ids`` as little-endian unsigned 32-bit numbers.

    Whole windows are cut from long documents first. What is left goes, in
    pieces of at most ``piece`` ids, into groups of ``windows`` windows whose
    pieces are dealt by differencing. A group takes ``slack`` ids less per window
    than would fit, the document at its edge is cut there, and each task's last
    group is what is left. Nothing is shuffled; a task holds one group and one
    step of texts.

    A null or empty text is the single id ``end_id``. Rows with equal ids are
    packed each on its own, a null id is carried along, an empty table gives no
    rows, and other columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_id = TaskContext.get().partitionId() << 33
        budget = windows * (capacity - slack)
        group: list[tuple] = []  # id, start, ids, all ids of the document
        held = 0

        def rows(placed: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*placed, strict=True))
            ints = [pa.array(c, pa.int64()) for c in columns[1:6]]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *ints, pa.array(columns[6], pa.binary())], names=names)

        def close() -> list[tuple]:
            nonlocal next_id
            window = fill([len(x[2]) for x in group], capacity)
            used: dict[int, list[int]] = {}
            placed = []
            for (doc, start, ids, total), at in zip(group, window.tolist(), strict=True):
                own = used.setdefault(at, [len(used), 0])
                placed.append((doc, start, len(ids), total, next_id + own[0], own[1], ids.tobytes()))
                own[1] += len(ids)
            next_id += len(used)
            group.clear()
            return placed

        names = [id_col, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        id_type = None
        for batch in steps(batches, text_col):
            id_type = batch.schema.field(id_col).type
            ids, upto = token_ids(batch.column(text_col), tokenizer)
            out: list[tuple] = []
            for k, doc in enumerate(batch.column(id_col).to_pylist()):
                own = np.append(ids[upto[k] : upto[k + 1]], np.uint32(end_id)).astype("<u4")
                whole = len(own) // capacity * capacity
                for at in range(0, whole, capacity):
                    out.append((doc, at, capacity, len(own), next_id, 0, own[at : at + capacity].tobytes()))
                    next_id += 1
                at = whole
                while at < len(own):
                    to = min(at + piece, len(own), at + budget - held)
                    group.append((doc, at, own[at:to], len(own)))
                    held += to - at
                    at = to
                    if held == budget:
                        out += close()
                        held = 0
            if out:
                yield rows(out)
        if group:
            yield rows(close())

    slim = small_batches(docs).select(id_col, F.col(text_col).cast("string").alias(text_col))
    return slim.mapInArrow(pack, SCHEMA.format(id=f"`{id_col}`", type=kind))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def tokenizer_path(kind: str = "tiktoken") -> str:
    """The byte-level vocabulary of 50,257 ids; ``json`` is the same for the slower library."""
    import public_tokenizers

    return public_tokenizers.path(f"byte_bpe_50k.{kind}")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack_sequences(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path()))
