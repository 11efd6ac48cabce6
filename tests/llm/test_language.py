import zlib

import numpy as np
import regex
from cases import ROWS, documents, nothing
from pyspark.sql import functions as F

from palimpsest.llm import language as L


def small_net():
    texts = {"en": b"the cat and the dog were there with them ", "fr": b"le chat et la souris est dans une maison ", "de": b"der hund und die katze ist nicht im haus "}
    windows, labels = [], []
    for name, t in texts.items():
        for k in range(0, len(t)):
            windows.append((t + t)[k : k + 32])
            labels.append(name)
    return L.train(windows, labels, rounds=60), texts


def test_gradients_agree_with_differences():
    net = L._new(["a", "b", "c"], 3, 0)
    for part in net.parts():
        part[...] = part.astype(np.float64)
    rng = np.random.default_rng(0)
    symbols = rng.integers(97, 101, (5, 4))
    symbols[3:, 0] = L.PAD
    target = np.array([0, 1, 2, 1])
    _, grads = L._learn(net, symbols, target)
    for part, grad in zip(net.parts(), grads, strict=True):
        at = tuple(rng.integers(0, n) for n in part.shape) if part.shape[0] != L.PAD + 1 else (int(symbols[0, 1]), 2)
        keep, h = part[at], np.float32(1e-2)
        part[at] = keep + h
        up = L._learn(net, symbols, target)[0]
        part[at] = keep - h
        down = L._learn(net, symbols, target)[0]
        part[at] = keep
        assert abs((up - down) / (2 * h) - grad[at]) < 2e-2 * max(1.0, abs(float(grad[at])) * 5)


def test_learns_and_pools_over_windows():
    net, texts = small_net()
    data = b"".join(t * 20 for t in texts.values())
    ends = np.concatenate([[0], np.cumsum([len(t) * 20 for t in texts.values()])])
    p = L.document_probabilities(net, np.frombuffer(data, np.uint8), ends)
    assert [net.languages[k] for k in p.argmax(1)] == list(texts)
    assert np.allclose(p.sum(1), 1, atol=1e-4)


def test_pooling_is_the_mean_over_positions_of_separate_windows():
    net, texts = small_net()
    data = np.frombuffer(texts["en"] * 9, np.uint8)
    got = L.document_probabilities(net, data, np.array([0, 0, len(data)]), window=50)
    want = np.zeros(3)
    for a in range(0, len(data), 50):
        w = data[a : a + 50].astype(np.intp)[:, None]
        want += sum(p[:, 0] for p in L.position_probabilities(net, w))
    assert np.allclose(got[1], want / len(data), atol=1e-5)
    assert not got[0].any()


def test_und_and_rows(spark):
    net, _ = small_net()
    rows = L.identify(documents(spark), net).collect()
    assert len(rows) == len(ROWS)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    assert all(by[i] == [("und", 0.0)] for i in (3, 4, 7))
    assert by[6][0] == by[6][1] and by[1] == by[2]
    assert all(0 <= s <= 1 for x in by.values() for _, s in x)
    assert L.identify(nothing(spark), net).collect() == []
    assert {r["lang_pred"] for r in L.identify(documents(spark), None).collect()} == {"und"}


def test_learns_nothing_from_held_out_rows(spark):
    import zlib

    held = [(i, "some words in a text", "en", "a") for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert L.learned(documents(spark, held)) is None
    assert L.learned(nothing(spark)) is None


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = L.op1_language(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) / len(found) >= 0.9


def test_every_language_is_learned(spark):
    rows = [(5 * k + i, f"{chr(97 + k % 26) * 3}{chr(97 + k // 26) * 3} words " * 3, f"l{k}", "a") for k in range(70) for i in range(1, 5)]
    windows, labels = L.sample_windows(documents(spark, rows), F.col("lang"), L.learnable(), "doc_id", "text")
    known = {la for i, _, la, _ in rows if zlib.crc32(str(i).encode()) % 5}
    assert len(known) > 64 and set(labels) == known


def test_query_against_documents_one_by_one(spark, sf):
    """Each document by itself, window by window and position by position."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    net = L.learned(docs)
    found = {r["doc_id"]: r for r in L.op1_language(spark, sf).collect()}
    for r in docs.collect():
        raw, got = (r["text"] or "").encode(), found[r["doc_id"]]
        assert got["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if not regex.search(r"\p{L}", r["text"] or ""):
            assert (got["lang_pred"], got["score"]) == ("und", 0.0)
            continue
        total = np.zeros(len(net.languages))
        for at in range(0, len(raw), L.WINDOW):
            symbols = np.frombuffer(raw[at : at + L.WINDOW], np.uint8).astype(np.intp)[:, None]
            total += sum(p[:, 0] for p in L.position_probabilities(net, symbols, np.ones(len(symbols), np.intp)))
        p = total / len(raw)
        assert abs(p.max() - got["score"]) < 2e-4 and p[net.languages.index(got["lang_pred"])] > p.max() - 2e-4
