import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from cases import ROWS, documents, nothing
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import packing as P


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.tokenizer_path("json"))
    return lambda x: t.encode(x, add_special_tokens=False).ids


TRICKY = ["", "a  b\n c  d 　 é è  x", "don't 'll we're\t\n\n x 12 3é4   y", " lead", "trail ", "\u0085 q", " ", "  ", "a b c  d", "x" * 5000, "ß 　 ß", "' s 's", "\x1c a \x1fb", "😀 😀😀 é"]


def test_ids_are_the_tokenizers(plain):
    for kind in ("tiktoken", "json"):
        ids, upto = P.token_ids(pa.array([*TRICKY, None]), P.tokenizer_path(kind))
        assert [ids[a:b].tolist() for a, b in zip(upto, upto[1:], strict=False)] == [plain(x) for x in TRICKY] + [[]]


def test_strings_of_added_tokens_are_one_id(plain):
    rng = random.Random(4)
    parts = ["<|endoftext|>", "<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", "a", " the", "é", "　", "'s"]
    texts = ["<|endoftext|>", "one <|endoftext|> two", "one<|endoftext|>two  <|endoftext|>", *("".join(rng.choices(parts, k=rng.randrange(1, 12))) for _ in range(300))]
    assert plain("a<|endoftext|>b")[1:2] == [50256]
    for kind in ("tiktoken", "json"):
        ids, upto = P.token_ids(pa.array(texts), P.tokenizer_path(kind))
        assert [ids[a:b].tolist() for a, b in zip(upto, upto[1:], strict=False)] == [plain(x) for x in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab 's\t\n  　é1ß.-\u0085\x1c"), max_size=25), min_size=1, max_size=5))
def test_ids_of_any_white_space(texts):
    from tokenizers import Tokenizer

    t = _JSON.get(0) or _JSON.setdefault(0, Tokenizer.from_file(P.tokenizer_path("json")))
    ids, upto = P.token_ids(pa.array(texts), P.tokenizer_path())
    assert [ids[a:b].tolist() for a, b in zip(upto, upto[1:], strict=False)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


_JSON: dict = {}


def test_differencing():
    assert sorted(np.bincount(P.differencing([8, 7, 6, 5, 4], 2), [8, 7, 6, 5, 4])) == [14, 16]
    rng = random.Random(0)
    for n, k in ((1, 1), (1, 3), (5, 4), (200, 8)):
        lengths = [rng.randrange(1, 300) for _ in range(n)]
        window = P.differencing(lengths, k)
        loads = np.bincount(window, lengths, k)
        assert len(window) == n and loads.sum() == sum(lengths)
        if n > 10 * k:
            assert loads.max() - loads.min() < 40
    assert np.bincount(P.fill([60, 60, 60], 100), [60, 60, 60]).max() <= 100


def holds(found, ids):
    pieces, windows = {}, {}
    for r in found:
        own = np.frombuffer(bytes(r["ids"]), "<u4")
        assert len(own) == r["length"] > 0
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["doc_tokens"], own.tolist()))
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc, rows in pieces.items():
        whole = []
        for start, total, own in sorted(rows):
            assert start == len(whole) and total == len(ids[doc])
            whole += own
        assert whole == ids[doc]
    assert pieces.keys() == ids.keys()
    lengths = []
    for rows in windows.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 2048
        lengths.append(at)
    return lengths


def test_pieces_and_windows(spark, plain):
    rows = [r for i, r in enumerate(ROWS) if r[0] is not None and i != 6]
    found = P.pack_sequences(documents(spark, rows), P.tokenizer_path()).collect()
    holds(found, {i: [*plain(t or ""), 1] for i, t, _, _ in rows})
    both = P.pack_sequences(documents(spark), P.tokenizer_path()).collect()
    assert sum(r["length"] for r in both) == sum(len(plain(t or "")) + 1 for _, t, _, _ in ROWS)
    assert P.pack_sequences(nothing(spark), P.tokenizer_path()).collect() == []


def test_little_padding(spark, sf, plain):
    docs = spark.read.parquet(f"{sf}/documents.parquet").coalesce(1)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = P.pack_sequences(docs, P.tokenizer_path())
    lengths = holds(found.collect(), {k: [*plain(t), 1] for k, t in texts.items()})
    assert sum(2048 - x for x in lengths) <= 0.03 * sum(lengths) + 2048
    for r in P.digest(found).join(found.select("doc_id", "start", "ids"), ["doc_id", "start"]).collect():
        assert r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))


def test_ids_of_a_whole_table_are_those_of_the_json_form(spark, sf, plain):
    """Every piece of the query, against the slower library's ids of each whole text."""
    want = {r["doc_id"]: np.array([*plain(r["text"] or ""), 1], "<u4") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in P.op9_packing(spark, sf).collect():
        ids = want[r["doc_id"]]
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
