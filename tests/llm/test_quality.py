import itertools
import zlib

import numpy as np
from cases import ROWS, documents, nothing

from palimpsest.llm import quality as Q
from palimpsest.llm.arrow import utf8


def arrays(texts):
    import pyarrow as pa

    return utf8(pa.array(texts))


def test_lines():
    data, ends = arrays(["a\nbb\n", "", "c", "\n\n", None])
    begin, end, many = Q.lines_of(data, ends)
    raw = data.tobytes()
    assert many.tolist() == [3, 1, 1, 3, 1]
    assert [raw[a:b] for a, b in zip(begin, end, strict=True)] == [b"a", b"bb", b"", b"", b"c", b"", b"", b"", b""]


def test_marginals_and_turns_against_all_paths():
    rng = np.random.default_rng(0)
    many = np.array([1, 3, 4])
    emit, turn = np.zeros((3, 4)), rng.normal(size=(2, 2))
    for d, n in enumerate(many):
        emit[d, :n] = rng.normal(size=n) * 3
    good, pairs = Q.forward_backward(emit, many, turn)
    want = np.zeros((2, 2))
    for d, n in enumerate(many):
        paths = list(itertools.product((0, 1), repeat=int(n)))
        w = np.array([np.exp(sum(emit[d, t] * y for t, y in enumerate(p)) + sum(turn[a, b] for a, b in zip(p, p[1:], strict=False))) for p in paths])
        w /= w.sum()
        for t in range(n):
            assert abs(good[d, t] - sum(x for x, p in zip(w, paths, strict=True) if p[t])) < 1e-9
        for x, p in zip(w, paths, strict=True):
            for a, b in zip(p, p[1:], strict=False):
                want[a, b] += x
    assert np.allclose(pairs, want)


def test_long_chains_stay_finite():
    emit = np.full((1, 20000), 900.0)
    emit[0, ::2] = -900.0
    good, _ = Q.forward_backward(emit, np.array([20000]), np.array([[0.0, -5.0], [3.0, 1.0]]))
    assert np.isfinite(good).all() and good.min() >= 0 and good.max() <= 1 + 1e-9


def test_a_document_scores_alike_in_any_batch():
    rng = np.random.default_rng(1)
    chain = Q.Chain(rng.normal(size=Q.WIDTH), rng.normal(size=(2, 2)))
    texts = ["A line.\nAnother!!\n***", "", None, "x\n" * 50, "word " * 30]
    whole = Q.score_documents(chain, *arrays(texts))
    assert np.allclose(whole, [Q.score_documents(chain, *arrays([t]))[0] for t in texts])


def test_marginals_in_pieces_are_those_of_the_whole_chain():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 7, 50, 1000):
        emit, turn = rng.normal(size=n) * 4, rng.normal(size=(2, 2)) * 2
        good, _ = Q.forward_backward(emit[None, :], np.array([n]), turn)
        assert np.allclose(Q.long_marginals(emit, turn), good[0])
    assert np.isfinite(Q.long_marginals(np.tile([900.0, -900.0], 5000), np.array([[0.0, -5.0], [3.0, 1.0]]))).all()


def test_blocks_of_lines_give_what_whole_documents_do(monkeypatch):
    rng = np.random.default_rng(3)
    chain = Q.Chain(rng.normal(size=Q.WIDTH), rng.normal(size=(2, 2)))
    texts = ["".join(rng.choice(["a b\n", "\n", "Buy now!!\n", "same line\n", "long words of a line.", "é\n"], 200)) for _ in range(4)] + ["x", "", None, "\n"]
    whole = Q.score_documents(chain, *arrays(texts))
    x, size, many = Q.features(*arrays(texts[:1]))
    lines = Q.Lines(arrays(texts[:1])[0])
    for a, b in ((0, 5), (5, 9), (0, lines.n), (lines.n - 3, lines.n)):
        assert np.array_equal(lines.features(a, b)[0], x[a:b]) and np.array_equal(lines.features(a, b)[1], size[a:b])
    for block in (1, 7, 50):
        monkeypatch.setattr(Q, "BLOCK", block)
        assert np.allclose(Q.score_documents(chain, *arrays(texts)), whole)


def test_ten_megabytes_of_breaks():
    import tracemalloc

    rng = np.random.default_rng(4)
    chain = Q.Chain(rng.normal(size=Q.WIDTH), rng.normal(size=(2, 2)))
    text = arrays(["\n" * 10_000_000])
    tracemalloc.start()
    assert 0 <= Q.score_documents(chain, *text)[0] <= 1
    assert tracemalloc.get_traced_memory()[1] < 900e6
    tracemalloc.stop()


def plain_score(chain, text):
    """A document by itself: emissions of its lines, then messages in logarithms, line by line."""
    x, size, _ = Q.features(*arrays([text]))
    emit = [np.array([-max(e, 0), min(e, 0)]) for e in x @ chain.weights]
    add = lambda v: float(np.logaddexp(*v))
    ahead, behind = [emit[0]], [np.zeros(2)]
    for e in emit[1:]:
        ahead.append(np.array([add(ahead[-1] + chain.turn[:, k]) for k in (0, 1)]) + e)
    for e in emit[:0:-1]:
        behind.append(np.array([add(chain.turn[k] + e + behind[-1]) for k in (0, 1)]))
    good = [1 / (1 + np.exp((a + b)[0] - (a + b)[1])) for a, b in zip(ahead, behind[::-1], strict=True)]
    p = np.clip(sum(g * (s + 1) for g, s in zip(good, size, strict=True)) / (size + 1).sum(), 1e-6, 1 - 1e-6)
    return 1 / (1 + np.exp(-(chain.slope * np.log(p / (1 - p)) + chain.lift)))


def test_query_against_documents_one_by_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    chain = Q.learned(spark, docs, sf)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in Q.op2_quality(spark, sf).collect():
        want = plain_score(chain, texts[r["doc_id"]])
        assert abs(r["score"] - want) < 1e-6 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_rows(spark):
    chain = Q.Chain(np.zeros(Q.WIDTH), np.zeros((2, 2)))
    rows = Q.score(documents(spark), chain).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert Q.score(nothing(spark), chain).collect() == []
    assert {r["score"] for r in Q.score(documents(spark), None).collect()} == {0.5}
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Q.fit(documents(spark), labels, Q.learnable()) is None


def test_held_out_accuracy(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = Q.op2_quality(spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["quality"] == r["predicted"] for r in found) / len(found) >= 0.9
