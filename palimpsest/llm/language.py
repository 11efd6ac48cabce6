"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.arrow import small_batches, steps, utf8

#: Documents of each language that are learned from, windows of each, and bytes of a window then: the bounds of the sample.
DOCUMENTS, WINDOWS, LEARNED = 400, 6, 64

#: Hidden units of a direction, bytes of a window when predicting, and windows multiplied at once.
UNITS, WINDOW, BATCH = 8, 128, 2048

#: Languages whose counts are sent to every executor; more are joined by key.
BROADCAST_LANGUAGES = 100_000

#: The symbol after a window's last byte.
PAD = 256


@dataclass
class Network:
    """Weights: for each direction ``embed`` (a gate row per symbol: update, reset, new), ``turn`` and ``bias`` of the new gate; then the head."""

    languages: list[str]
    embed: list[np.ndarray]
    turn: list[np.ndarray]
    bias: list[np.ndarray]
    head: np.ndarray
    shift: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [*self.embed, *self.turn, *self.bias, self.head, self.shift]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _new(languages: list[str], units: int, seed: int) -> Network:
    rng, h = np.random.default_rng(seed), units
    draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    return Network(
        languages, [draw(PAD + 1, 3 * h) for _ in "fb"], [draw(h, 3 * h) for _ in "fb"], [np.zeros(h, np.float32) for _ in "fb"],
        draw(2 * h, len(languages)), np.zeros(len(languages), np.float32),
    )


def _learn(net: Network, symbols: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss over all positions and its gradients, by backpropagation through time.

    ``symbols`` is (time, windows); every position that holds a byte is to name its window's language. States are zero beyond a window's
    end, so either direction begins at its first byte there.
    """
    time, batch = symbols.shape
    h = net.turn[0].shape[0]
    states, kept, here = [], [], (symbols != PAD)[:, :, None].astype(np.float32)
    for way in (0, 1):
        state, outs, steps_ = np.zeros((batch, h), np.float32), [None] * time, [None] * time
        for t in range(time) if way == 0 else range(time - 1, -1, -1):
            x, u = net.embed[way][symbols[t]], state @ net.turn[way]
            z, r = _sigmoid(x[:, :h] + u[:, :h]), _sigmoid(x[:, h : 2 * h] + u[:, h : 2 * h])
            inner = u[:, 2 * h :] + net.bias[way]
            n = np.tanh(x[:, 2 * h :] + r * inner)
            steps_[t] = (state, z, r, inner, n)
            state = (n + z * (state - n)) * here[t]
            outs[t] = state
        states.append(np.stack(outs))
        kept.append(steps_)
    both = np.concatenate(states, 2)
    logits = both @ net.head + net.shift
    logits -= logits.max(2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(2, keepdims=True)
    real = (symbols != PAD)[:, :, None] / np.float32(max(1, (symbols != PAD).sum()))
    hit = np.take_along_axis(p, np.broadcast_to(target[None, :, None], (time, batch, 1)), 2)
    loss = float(-(np.log(hit + 1e-9) * real).sum())
    d = p * real
    np.put_along_axis(d, np.broadcast_to(target[None, :, None], (time, batch, 1)), (hit - 1) * real, 2)
    d = d.astype(np.float32)
    grad_head, grad_shift = np.einsum("tbh,tbl->hl", both, d), d.sum((0, 1))
    back = d @ net.head.T
    embeds, turns, biases = [], [], []
    for way in (0, 1):
        ge, gt, gb = np.zeros_like(net.embed[way]), np.zeros_like(net.turn[way]), np.zeros_like(net.bias[way])
        carry = np.zeros((batch, h), np.float32)
        dx_all = np.empty((time, batch, 3 * h), np.float32)
        for t in range(time - 1, -1, -1) if way == 0 else range(time):
            state, z, r, inner, n = kept[way][t]
            carry = (carry + back[t][:, way * h : (way + 1) * h]) * here[t]
            dn = carry * (1 - z) * (1 - n * n)
            dz = carry * (state - n) * z * (1 - z)
            dr = dn * inner * r * (1 - r)
            dinner = dn * r
            du = np.concatenate([dz, dr, dinner], 1)
            dx_all[t, :, :h], dx_all[t, :, h : 2 * h], dx_all[t, :, 2 * h :] = dz, dr, dn
            gt += state.T @ du
            gb += dinner.sum(0)
            carry = carry * z + du @ net.turn[way].T
        np.add.at(ge, symbols.ravel(), dx_all.reshape(-1, 3 * h))
        embeds.append(ge)
        turns.append(gt)
        biases.append(gb)
    return loss, [*embeds, *turns, *biases, grad_head, grad_shift]


def train(windows: list[bytes], labels: list[str], units: int = UNITS, batch: int = 256, rounds: int = 160, rate: float = 0.02, seed: int = 0) -> Network:
    """Fit the network by Adam on windows of one length at most; equal input gives equal weights."""
    languages = sorted(set(labels))
    net, rng = _new(languages, units, seed), np.random.default_rng(seed)
    longest = max(map(len, windows), default=0)
    symbols = np.full((len(windows), longest), PAD, np.int64)
    for row, w in zip(symbols, windows, strict=True):
        row[: len(w)] = np.frombuffer(w, np.uint8)
    target = np.array([languages.index(x) for x in labels], np.int64)
    by_label = [np.flatnonzero(target == k) for k in range(len(languages))]
    first, second = [np.zeros_like(x) for x in net.parts()], [np.zeros_like(x) for x in net.parts()]
    for k in range(1, rounds + 1 if len(languages) > 1 else 1):
        picked = np.concatenate([rng.choice(own, max(1, batch // len(languages))) for own in by_label])
        shown = symbols[picked].T.copy()
        cut = np.where(rng.random(len(picked)) < 0.3, rng.integers(2, 24, len(picked)), longest)  # documents may be short
        shown[np.arange(longest)[:, None] >= cut] = PAD
        _, grads = _learn(net, shown, target[picked])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        pace = rate * min(1.0, 3 * (1 - k / (rounds + 1)))
        for part, g, m, v in zip(net.parts(), grads, first, second, strict=True):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            part -= pace * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return net


def position_probabilities(net: Network, symbols: np.ndarray, active: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """For each time of (time, windows) symbols, the probabilities of (languages, windows) there.

    Windows fall in length: at time t the first ``active[t]`` have a byte, and only those are worked on, so that a window's numbers
    don't depend on its neighbours. Units are rows here, so that every gate is one run of memory. The halves
    that a sigmoid by tanh needs are in the weights already.
    """
    time, batch = symbols.shape
    h = net.turn[0].shape[0]
    half = np.array([0.5] * (2 * h) + [1.0] * h, np.float32)
    logits = np.zeros((time, len(net.languages), batch), np.float32)
    room = [np.empty((rows, batch), np.float32) for rows in (3 * h, 3 * h, h)]
    for way in (0, 1):
        embed, turn = (np.ascontiguousarray((w * half).T) for w in (net.embed[way], net.turn[way]))
        head, bias = np.ascontiguousarray(net.head[way * h : (way + 1) * h].T), net.bias[way][:, None]
        whole = np.zeros((h, batch), np.float32)
        for t in range(time) if way == 0 else range(time - 1, -1, -1):
            k = batch if active is None else int(active[t])
            x, u, n = room if k == batch else (np.empty((rows, k), np.float32) for rows in (3 * h, 3 * h, h))
            state = whole[:, :k]
            np.take(embed, symbols[t, :k], axis=1, out=x, mode="clip")
            np.dot(turn, state, out=u)
            gates, fresh = x[: 2 * h], u[2 * h :]
            gates += u[: 2 * h]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            fresh += bias
            np.multiply(fresh, gates[h:], out=n)
            n += x[2 * h :]
            np.tanh(n, out=n)
            state -= n
            state *= gates[:h]
            state += n
            logits[t, :, :k] += head @ state
    logits += net.shift[:, None]
    logits -= logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(1, keepdims=True)
    yield from logits


def document_probabilities(net: Network, data: np.ndarray, ends: np.ndarray, window: int = WINDOW, batch: int = BATCH) -> np.ndarray:
    """Each document's mean of its positions' probabilities; empty ones have zeros.

    A document's windows of ``window`` bytes follow each other without overlap, each begins with a fresh state, and all count.
    """
    sizes = np.diff(ends)
    many = -(-sizes // window)
    doc = np.repeat(np.arange(len(sizes)), many)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    begin = ends[:-1][doc] + nth * window
    length = np.minimum(window, ends[1:][doc] - begin)
    sums = np.zeros((len(doc), len(net.languages)))
    batch = max(32, batch * 64 // max(64, len(net.languages)))
    padded = np.concatenate([data, np.zeros(window, np.uint8)])
    order = np.argsort(-length, kind="stable")  # windows of like length together: short ones need few steps
    for at in range(0, len(order), batch):
        own = order[at : at + batch]
        n = length[own]
        places = np.arange(int(n.max()))[:, None]
        symbols = np.where(places < n, padded[begin[own] + places], PAD).astype(np.intp)
        active = np.searchsorted(-n, -np.arange(int(n.max())), "left")  # those longer than t
        for k, p in zip(active.tolist(), position_probabilities(net, symbols, active), strict=True):
            sums[own[:k]] += p[:, :k].T
    out = np.zeros((len(sizes), len(net.languages)))
    np.add.at(out, doc, sums)
    return out / np.maximum(sizes, 1)[:, None]


def sample_windows(docs: DataFrame, labels: Column, allowed: Column, id_col: str, text_col: str, documents: int = DOCUMENTS, windows: int = WINDOWS, length: int = LEARNED) -> tuple[list[bytes], list[str]]:
    """A bounded sample: about ``documents`` of each language, by a hash of the id, and ``windows`` spread over each of their texts."""
    named = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), labels.alias("label")).where(
        allowed & F.col("label").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0)
    )
    counts = named.groupBy("label").agg(F.count("*").alias("_n"))
    languages = counts.count()
    if not languages:
        return [], []
    share = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(1)), F.lit(1 << 40)) / float(1 << 40)
    # a label of few documents has all of them, so every label is learned
    counts = F.broadcast(counts) if languages <= BROADCAST_LANGUAGES else counts
    picked = named.join(counts, "label").where(share * F.col("_n") < documents).select("id", "text", "label")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = utf8(batch.column("text"))
            out = []
            for k, (one, label) in enumerate(zip(batch.column("id").to_pylist(), batch.column("label").to_pylist(), strict=True)):
                begin, end = int(ends[k]), int(ends[k + 1])
                places = np.unique(np.linspace(begin, max(begin, end - length), windows).astype(np.int64))
                out += [(None if one is None else str(one), label, int(p), data[p : min(end, p + length)].tobytes()) for p in places]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int64(), pa.binary()), strict=True)], names=["id", "label", "place", "window"])

    cuts = picked.mapInArrow(cut, "id string, label string, place long, window binary")
    rows = cuts.orderBy(F.xxhash64("id"), "id", "label", "place").limit(2 * documents * windows * languages).collect()
    rows.sort(key=lambda r: (r["id"] or "", r["label"], r["place"], bytes(r["window"])))
    return [bytes(r["window"]) for r in rows], [r["label"] for r in rows]


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Each document's language and the mean probability of that language over all bytes, as ``names``, after the ``keep`` columns (the id, unless given).

    A null text, or one without a letter, is ``und`` with score 0, and so is everything where nothing
    was learned. Ids may be null or repeat; every row gives one row, and an empty table none. A step of
    a few MB of texts is held at a time.
    """
    keep = [id_col] if keep is None else keep
    own = [f"c{i}" for i in range(len(keep))]  # names that Arrow functions take, whatever the columns are called
    text = own[keep.index(text_col)] if text_col in keep else "text"
    given = F.col(f"`{text_col}`").cast("string")
    has_letter = F.coalesce(given.rlike(r"\p{L}"), F.lit(False)).alias("letter")
    slim = small_batches(docs).select(*(F.col(f"`{c}`").alias(x) for c, x in zip(keep, own, strict=True)), *([] if text_col in keep else [given.alias(text)]), has_letter)
    schema = "".join(f"{c} {t}, " for c, t in slim.dtypes if c in own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text):
            letter = batch.column("letter").to_numpy(zero_copy_only=False)
            if net is None:
                found, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            else:
                p = document_probabilities(net, *utf8(batch.column(text)))
                found = [net.languages[k] if x else "und" for k, x in zip(p.argmax(1).tolist(), letter.tolist(), strict=True)]
                score = np.where(letter, np.round(np.clip(p.max(1), 0, 1), 6), 0.0)
            kept = [batch.column(c) for c in own]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.string()), pa.array(score, pa.float64())], names=[*own, "found", "sure"])

    return slim.mapInArrow(run, f"{schema}found string, sure double").toDF(*keep, *names)


def learnable(id_col: str = "id") -> Column:
    """Rows that may be learned from: crc32 of the id's text mod 5 isn't 0; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 != 0, F.lit(False))


def learned(docs: DataFrame) -> Network | None:
    """The network for ``doc_id, text, lang``; none where no row may be learned from."""
    windows, labels = sample_windows(docs, F.col("lang"), learnable(), "doc_id", "text")
    return train(windows, labels) if windows else None


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, learned(docs))
    return found.select("doc_id", (~learnable("doc_id")).alias("held_out"), "lang_pred", "score")
