"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.arrow import small_batches, steps, utf8

#: Documents of each label that are learned from, and lines of each: the bounds of the sample.
DOCUMENTS, LINES = 1200, 64

#: Lines whose features are held at a time (some 500 bytes each).
BLOCK = 1 << 14

#: What kind of byte each is. Letters of either case, digits, blanks, and punctuation by use.
KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100)), "digit": b"0123456789", "blank": b" \t\r\v\f",
    "end": b".", "shout": b"!?", "comma": b",;:'\"()-", "bar": b"|", "mark": b"*#$%&@^~_=+<>\\/`{}[]",
}
NAMES = list(KINDS)
TABLE = np.full(256, len(NAMES), np.int64)
for _k, _bytes in enumerate(KINDS.values()):
    TABLE[list(_bytes)] = _k

#: Features of a line itself; a line also has those of the line before and the line after.
OWN = len(NAMES) + 1 + 11
WIDTH = 3 * OWN + 1


def lines_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every line, and how many lines each document has; an empty text is one empty line."""
    breaks = np.flatnonzero(data == 10)
    doc = np.searchsorted(ends, breaks, "right") - 1
    many = np.bincount(doc, minlength=len(ends) - 1) + 1 if len(breaks) else np.ones(len(ends) - 1, np.int64)
    first = np.cumsum(many) - many
    begin, end = np.empty(int(many.sum()), np.int64), np.empty(int(many.sum()), np.int64)
    inner = np.ones(len(begin), bool)
    inner[first] = False
    begin[first], begin[inner] = ends[:-1], breaks + 1
    last = np.ones(len(begin), bool)
    last[first + many - 1] = False
    end[first + many - 1], end[last] = ends[1:], breaks
    return begin, end, many


def _hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for every span, in order and apart: equal ones have equal numbers."""
    if not len(begin):
        return np.zeros(0, np.int64)
    lines = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), 2 * len(begin), [None, pa.py_buffer(np.append(np.stack([begin, end], 1).ravel(), len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    )
    return lines.take(pa.array(np.arange(len(begin)) * 2)).dictionary_encode().indices.to_numpy(zero_copy_only=False)


def _again(data: np.ndarray, begin: np.ndarray, end: np.ndarray, doc: np.ndarray | None = None) -> np.ndarray:
    """Whether a line's text comes more than once in its document; an empty line's doesn't count."""
    out = np.zeros(len(begin), bool)
    full = np.flatnonzero(end > begin)
    text = _hashes(data, begin[full], end[full]).astype(np.int64)
    text = text if doc is None else doc[full] * (len(data) + len(begin) + 1) + text
    _, where, copies = np.unique(text, return_inverse=True, return_counts=True)
    out[full] = copies[where] > 1
    return out


def features(data: np.ndarray, ends: np.ndarray, again: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines, WIDTH) features, the lines' lengths in bytes, and the lines of each document.

    ``again`` tells of each line whether its document has it more than once, where the bytes are only part of the document.
    """
    begin, end, many = lines_of(data, ends)
    n, size = len(begin), end - begin
    # every byte's line; a break belongs to the line that it ends
    line = np.repeat(np.arange(n), np.diff(np.append(begin, len(data)))) if len(data) else np.zeros(0, np.int64)
    kind = TABLE[data]
    counts = np.bincount(line * (len(NAMES) + 1) + kind, minlength=n * (len(NAMES) + 1)).reshape(n, -1).astype(np.float64)
    counts[:, -1] -= np.bincount(line[data == 10], minlength=n) if len(data) else 0
    long = np.maximum(size, 1)[:, None]
    share = counts / long
    same = np.zeros(len(data))
    if len(data) > 1:
        same[1:] = (data[1:] == data[:-1]) & (line[1:] == line[:-1])
    repeats = np.bincount(line, same, n) / long[:, 0] if len(data) else np.zeros(n)
    words = counts[:, NAMES.index("blank")] + 1
    letters = np.maximum(counts[:, 0] + counts[:, 1], 1)
    doc = np.repeat(np.arange(len(many)), many)
    again = _again(data, begin, end, doc) if again is None else again
    gap = np.isin(data, np.frombuffer(b" \t\r\v\f\n", np.uint8))
    word = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1] | (line[1:] != line[:-1])])) if len(data) else np.zeros(0, np.int64)
    upto = np.minimum(np.append(np.flatnonzero(gap), len(data))[np.searchsorted(np.flatnonzero(gap), word)], end[line[word]])
    name = _hashes(data, word, upto)
    twice = np.bincount(line[word][1:], (name[1:] == name[:-1]) & (line[word][1:] == line[word][:-1]), n) / words if len(word) > 1 else np.zeros(n)
    last_byte = data[np.maximum(end - 1, 0)] if len(data) else np.zeros(n, np.uint8)
    more = np.stack(
        [
            np.log1p(size) / 8, np.minimum(size / letters / 4, 2), counts[:, 0] / letters, letters / words / 16, repeats * 8, again, twice * 2,
            np.minimum(share[:, NAMES.index("mark")] * 10, 1), np.minimum(share[:, NAMES.index("shout")] * 10, 1),
            np.isin(last_byte, np.frombuffer(b".!?", np.uint8)) & (size > 0), size == 0,
        ],
        1,
    )
    own = np.concatenate([share, more], 1)
    x = np.zeros((n, WIDTH))
    x[:, :OWN] = own
    inner = np.flatnonzero(doc[1:] == doc[:-1]) if n > 1 else np.zeros(0, np.int64)
    x[inner + 1, OWN : 2 * OWN] = own[inner]
    x[inner, 2 * OWN : 3 * OWN] = own[inner + 1]
    x[:, -1] = 1
    return x, size, many


class Lines:
    """One document's lines, whose features are made for a run of them at a time."""

    def __init__(self, data: np.ndarray):
        breaks = np.flatnonzero(data == 10)
        breaks = breaks.astype(np.int32) if len(data) < 1 << 31 else breaks
        self.data, self.n = data, len(breaks) + 1
        self.begin, self.end = np.concatenate([breaks[:0], [0], breaks + 1]).astype(breaks.dtype), np.append(breaks, len(data)).astype(breaks.dtype)
        self.again = _again(data, self.begin, self.end)

    def features(self, first: int, past: int) -> tuple[np.ndarray, np.ndarray]:
        """Features and lengths of the lines from ``first`` to before ``past``, as the whole document gives them."""
        low, high = max(0, first - 1), min(self.n, past + 1)
        part = self.data[self.begin[low] : self.end[high - 1]]
        x, size, _ = features(part, np.array([0, len(part)]), self.again[low:high])
        return x[first - low : past - low], size[first - low : past - low]


@dataclass
class Chain:
    """``weights`` of a line's features for good against bad, ``turn`` from label to label, and the line from a document's mean to its score."""

    weights: np.ndarray
    turn: np.ndarray
    slope: float = 1.0
    lift: float = 0.0


def _batches(many: np.ndarray, cells: int = 1 << 18) -> Iterator[np.ndarray]:
    """Documents of like numbers of lines together, so that padding stays small."""
    order = np.argsort(many, kind="stable")
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and many[order[to]] <= 1.25 * many[order[at]] + 4 and (to - at + 1) * many[order[to]] <= cells:
            to += 1
        yield order[at:to]
        at = to


def forward_backward(emit: np.ndarray, many: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For padded (documents, lines) scores of good against bad, documents by rising length: P(good) per line, and expected turns.

    Messages are scaled to sum to one at every line, so the longest document neither over- nor underflows.
    """
    docs, longest = emit.shape
    weight = np.exp(np.stack([-np.maximum(emit, 0), np.minimum(emit, 0)]).transpose(2, 0, 1))  # (lines, labels, documents)
    turns = np.exp(turn - turn.max())
    ahead, scale, behind = np.empty((longest, 2, docs)), np.ones((longest, docs)), np.ones((longest, 2, docs))
    since = np.searchsorted(many, np.arange(longest), "right")  # documents from here on have a line there
    for t in range(longest):
        on = slice(since[t], docs)
        now = weight[t][:, on] * (turns.T @ ahead[t - 1][:, on]) if t else weight[0].copy()
        scale[t, on] = now.sum(0)
        ahead[t][:, on] = now / scale[t, on]
    pairs = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        on = slice(since[t + 1], docs)
        onward = weight[t + 1][:, on] * behind[t + 1][:, on] / scale[t + 1, on]
        pairs += (ahead[t][:, on] @ onward.T) * turns
        behind[t][:, on] = turns @ onward
    real = np.arange(longest)[:, None] < many[None, :]
    return np.where(real, ahead[:, 1] * behind[:, 1], 0).T, pairs


def _padded(values: np.ndarray, first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    places = np.arange(int(many.max()))[None, :]
    real = places < many[:, None]
    return np.where(real, values[np.minimum(first[:, None] + places, len(values) - 1)], 0.0), real


def marginals(chain: Chain, x: np.ndarray, many: np.ndarray) -> np.ndarray:
    """P(good) of every line."""
    emit, first, out = x @ chain.weights, np.cumsum(many) - many, np.empty(len(x))
    for own in _batches(many):
        padded, real = _padded(emit, first[own], many[own])
        good, _ = forward_backward(padded, many[own], chain.turn)
        out[(first[own][:, None] + np.arange(padded.shape[1])[None, :])[real]] = good[real]
    return out


def means(good: np.ndarray, size: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Each document's mean over lines, by their bytes and breaks."""
    doc = np.repeat(np.arange(len(many)), many)
    return np.bincount(doc, good * (size + 1), len(many)) / np.bincount(doc, size + 1, len(many))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def long_marginals(emit: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """P(good) of every line of one document: the chain is cut into about as many pieces as a piece has lines.

    The pieces' products of steps are made side by side, carried from piece to piece, and then each piece's messages, again side by side;
    besides the scores it takes two numbers a line.
    """
    n, turns = len(emit), np.exp(turn - turn.max())
    length = max(1, int(np.sqrt(n)))
    pieces = -(-n // length)
    score = np.zeros(pieces * length)
    score[:n] = emit
    score = np.ascontiguousarray(score.reshape(pieces, length).T)  # (places, pieces)
    real = np.ascontiguousarray((np.arange(pieces * length) < n).reshape(pieces, length).T)

    def step(t: int) -> np.ndarray:
        """(labels before, labels now, pieces); nothing changes beyond the document's end, and nothing comes before its first line."""
        weight = np.exp(np.stack([-np.maximum(score[t], 0), np.minimum(score[t], 0)]))
        out = turns[:, :, None] * weight[None]
        if t == 0:
            out[:, :, 0] = weight[None, :, 0]
        return np.where(real[t], out, np.eye(2)[:, :, None])

    whole = np.repeat(np.eye(2)[:, :, None], pieces, 2)
    for t in range(length):
        whole = np.einsum("ijp,jkp->ikp", whole, step(t))
        whole /= whole.sum((0, 1))
    ahead, behind = np.full((2, pieces), 0.5), np.full((2, pieces), 0.5)
    for p in range(1, pieces):
        ahead[:, p] = ahead[:, p - 1] @ whole[:, :, p - 1]
        ahead[:, p] /= ahead[:, p].sum()
    for p in range(pieces - 2, -1, -1):
        behind[:, p] = whole[:, :, p + 1] @ behind[:, p + 1]
        behind[:, p] /= behind[:, p].sum()
    good = np.empty((length, pieces))
    for t in range(length):
        ahead = np.einsum("ip,ijp->jp", ahead, step(t))
        ahead /= ahead.sum(0)
        good[t] = ahead[1]
    for t in range(length - 1, -1, -1):
        both = good[t] * behind[1]
        good[t] = both / (both + (1 - good[t]) * behind[0])
        behind = np.einsum("ijp,jp->ip", step(t), behind)
        behind /= behind.sum(0)
    return good.T.ravel()[:n]


def _long_mean(chain: Chain, data: np.ndarray) -> float:
    """The mean of a document of many lines, whose features are made a block at a time."""
    lines = Lines(data)
    emit = np.empty(lines.n)
    for at in range(0, lines.n, BLOCK):
        to = min(at + BLOCK, lines.n)
        emit[at:to] = lines.features(at, to)[0] @ chain.weights
    good = long_marginals(emit, chain.turn)
    size = (lines.end - lines.begin).astype(np.float64) + 1
    return float((good * size).sum() / size.sum())


def score_documents(chain: Chain, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Each document's score; documents of up to BLOCK lines together are looked at at once, one of more lines alone."""
    lines = np.diff(np.searchsorted(np.flatnonzero(data == 10), ends)) + 1
    upto, out, at = np.concatenate([[0], np.cumsum(lines)]), np.empty(len(lines)), 0
    while at < len(lines):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + BLOCK, "right")) - 1)
        own = data[ends[at] : ends[to]]
        if lines[at] > BLOCK:
            out[at] = _long_mean(chain, own)
        else:
            x, size, many = features(own, ends[at : to + 1] - ends[at])
            out[at:to] = means(marginals(chain, x, many), size, many)
        at = to
    return 1 / (1 + np.exp(-(chain.slope * _logit(out) + chain.lift)))


def train(x: np.ndarray, size: np.ndarray, many: np.ndarray, label: np.ndarray, weight: np.ndarray, rounds: int = 120, rate: float = 0.12, decay: float = 1e-4) -> Chain:
    """Maximum likelihood by Adam, every line labelled as its document, then the line from means to scores with ``weight`` per document."""
    chain = Chain(np.zeros(x.shape[1]), np.zeros((2, 2)))
    doc = np.repeat(np.arange(len(many)), many)
    truth, first = label[doc].astype(np.float64), np.cumsum(many) - many
    # each document counts alike, and so does each label
    part = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum())) / many
    held = np.zeros((2, 2))
    for k in (0, 1):
        held[k, k] = (part * (many - 1))[label == k].sum()
    groups = [(own, part[own]) for own in _batches(many)]
    state = [np.zeros_like(chain.weights), np.zeros_like(chain.weights), np.zeros((2, 2)), np.zeros((2, 2))]
    for k in range(1, rounds + 1):
        emit, good, pairs = x @ chain.weights, np.empty(len(x)), np.zeros((2, 2))
        for own, _ in groups:
            padded, real = _padded(emit, first[own], many[own])
            for kind in (0, 1):
                sub = np.flatnonzero(label[own] == kind)
                if not len(sub):
                    continue
                p, turns = forward_backward(padded[sub], many[own][sub], chain.turn)
                good[(first[own][sub][:, None] + np.arange(padded.shape[1])[None, :])[real[sub]]] = p[real[sub]]
                share = (part[own][sub] * many[own][sub]).sum() / max(1, many[own][sub].sum())
                pairs += turns * share
        grad_w = x.T @ ((good - truth) * part[doc]) + decay * chain.weights
        grad_t = pairs - held + 0.05 * chain.turn
        pace = rate * min(1.0, 2 * (1 - k / (rounds + 1)))
        for value, g, m, v in ((chain.weights, grad_w, state[0], state[1]), (chain.turn, grad_t, state[2], state[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value -= pace * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    q = _logit(means(marginals(chain, x, many), size, many))
    a, b, w = 1.0, 0.0, weight / weight.sum()
    for _ in range(50):  # Newton, with a little pull to the line as it is
        p = 1 / (1 + np.exp(-(a * q + b)))
        g = np.array([(w * (p - label) * q).sum() + 1e-3 * (a - 1), (w * (p - label)).sum()])
        s = w * p * (1 - p)
        hess = np.array([[(s * q * q).sum() + 1e-3, (s * q).sum()], [(s * q).sum(), s.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(hess, g), -1, 1)
        a, b = a - step[0], b - step[1]
    chain.slope, chain.lift = float(max(a, 0.05)), float(b)
    return chain


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, documents: int = DOCUMENTS, lines: int = LINES) -> Chain | None:
    """Learn from a bounded sample: for each label ``documents`` ids of ``labels`` by hash, and a run of ``lines`` lines of each text, from a place by the id's hash.

    ``docs`` has doc_id and text, ``labels`` doc_id and quality. Only features come to the driver. None where either label has no text.
    """
    known = labels.where(allowed & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    share = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(2)), F.lit(1 << 40)) / float(1 << 40)
    below = F.coalesce(*[F.when(F.col("quality") == k, min(1.0, documents / n)) for k, n in counts.items()], F.lit(0.0))
    # the sample has a bounded number of ids, so it may be sent to every executor
    picked = known.where(share < below).orderBy(F.xxhash64("doc_id"), "doc_id").limit(3 * documents)
    rows = small_batches(docs).select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "quality", F.col("text").cast("string").alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            data, ends = utf8(batch.column("text"))
            out = []
            for k, (doc, quality) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("quality").to_pylist(), strict=True)):
                own = Lines(data[ends[k] : ends[k + 1]])
                at = zlib.crc32(str(doc).encode()) % (max(0, own.n - lines) + 1)
                x, size = own.features(at, min(own.n, at + lines))
                out.append((doc, quality, size.astype("<i8").tobytes(), x.astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["doc_id", "quality", "size", "x"])

    found = rows.mapInArrow(describe, "doc_id long, quality long, size binary, x binary").limit(4 * documents).collect()
    found.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    label = np.array([r["quality"] for r in found], np.int64)
    if len(np.unique(label)) < 2:
        return None
    size = [np.frombuffer(r["size"], "<i8") for r in found]
    x = np.concatenate([np.frombuffer(r["x"], "<f4") for r in found]).reshape(-1, WIDTH).astype(np.float64)
    weight = np.array([counts[k] / (label == k).sum() for k in label.tolist()])
    return train(x, np.concatenate(size), np.array([len(s) for s in size]), label, weight)


def score(docs: DataFrame, chain: Chain | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """Each document's quality in ``name``, 0 to 1, after the ``keep`` columns (the id, unless given).

    A null text is empty, and an empty text is one empty line. Ids may be null or repeat; every row
    gives one row, and an empty table none. Where nothing was learned every score is 0.5.
    """
    keep = [id_col] if keep is None else keep
    own = [f"c{i}" for i in range(len(keep))]  # names that Arrow functions take, whatever the columns are called
    text = own[keep.index(text_col)] if text_col in keep else "text"
    slim = small_batches(docs).select(*(F.col(f"`{c}`").alias(x) for c, x in zip(keep, own, strict=True)), *([] if text_col in keep else [F.col(f"`{text_col}`").cast("string").alias(text)]))
    schema = "".join(f"{c} {t}, " for c, t in slim.dtypes if c in own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text):
            found = np.full(batch.num_rows, 0.5) if chain is None else score_documents(chain, *utf8(batch.column(text)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(found)], names=[*own, "score"])

    return slim.mapInArrow(run, f"{schema}score double").toDF(*keep, name)


def learnable() -> Column:
    """Rows that may be learned from: crc32 of the id's text mod 3 isn't 1; a null id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 != 1, F.lit(False))


def learned(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Chain | None:
    return fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learnable())


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = score(docs, learned(spark, docs, sf_dir))
    return found.select("doc_id", (~learnable()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
