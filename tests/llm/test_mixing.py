import random
import re

import numpy as np
import pytest
from cases import ROWS, documents, nothing
from pyspark.sql import functions as F

from palimpsest.llm import mixing as M


def slow_sainte_lague(wanted, seats, most):
    got = [0] * len(wanted)
    for _ in range(seats):
        best = max((i for i in range(len(wanted)) if wanted[i] > 0 and got[i] < most[i]), key=lambda i: (wanted[i] / (2 * got[i] + 1), -i), default=None)
        if best is None:
            break
        got[best] += 1
    return got


def test_apportionment_is_that_of_single_seats():
    rng = random.Random(0)
    for _ in range(60):
        n = rng.randrange(1, 6)
        wanted = [rng.choice([0, 1, 5, rng.random() * 100]) for _ in range(n)]
        most = [rng.randrange(0, 60) for _ in range(n)]
        seats = rng.randrange(0, 120)
        assert M.sainte_lague(wanted, seats, most) == slow_sainte_lague(wanted, seats, most)


def test_targets():
    got = M.targets({"a": 100, "b": 10, "c": 100, None: 0})
    assert got[None] == 0 and abs(sum(got.values()) - 210) < 1e-9
    assert got["b"] == 30.0 and all(got[k] <= 3 * v + 1e-9 for k, v in {"a": 100, "b": 10, "c": 100}.items())
    assert abs(got["c"] / got["a"] - 3) < 1e-9 and list(M.targets({})) == []


def test_quotas_per_shard_add_up():
    block, quotas = M.plan({"a": 50_000, "b": 9_000, "c": 120_000}, shards=8)
    for q in quotas:
        assert all(x >= 0 for x in q.shares) and abs(sum(q.shares) * block - q.target) <= 2 * block and sum(q.shares) <= 3 * q.blocks
    per = [sum(q.shares[j] for q in quotas) for j in range(8)]
    assert max(per) - min(per) <= 1


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def rows_of(n=400):
    rng = random.Random(1)
    return [(i, " ".join(rng.choice(["ab", "cd", "efg"]) for _ in range(rng.randrange(0, 60))), "en", rng.choice(["a", "a", "a", "a", "b", "c", None])) for i in range(n)]


def test_taken_words_come_near_targets(spark):
    rows = rows_of()
    found = M.mix_sources(spark, documents(spark, rows)).collect()
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    wanted = M.targets(sizes)
    assert sorted((r["doc_id"], r["size"]) for r in found) == sorted((i, words(t)) for i, t, _, _ in rows)
    for s in sizes:
        own = [r for r in found if r["source"] == s]
        assert all(r["source_size"] == sizes[s] and abs(r["target"] - wanted[s]) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - wanted[s]) <= 0.03 * wanted[s] + 3
    again = M.mix_sources(spark, documents(spark, rows)).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again))


@pytest.mark.parametrize("most", [1, 4, 64])
def test_small_sources_meet_their_targets_whatever_the_block(spark, monkeypatch, most):
    """As on a corpus so large that the cap on blocks makes them longer than a source."""
    monkeypatch.setattr(M, "MOST_BLOCKS", most)
    rows = rows_of() + [(1000 + i, "one two three four five", "en", s) for i, s in enumerate(["x"] * 8 + ["y", "z", "z"])]
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    docs, wanted = documents(spark, rows, extra=False), M.targets(sizes)
    assert M.plan(sizes)[0] >= sum(sizes.values()) // 64 > sizes["x"] > sizes["y"]
    found = M.mix_sources(spark, docs).collect()
    mixed = M.mixed_rows(spark, docs).collect()
    for s in sizes:
        own = [r for r in found if r["source"] == s]
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - wanted[s]) <= 1
        assert sum(words(r["text"]) for r in mixed if r["source"] == s) == sum(r["taken"] for r in own)
    assert sum(r["taken"] for r in found) == sum(sizes.values())


def test_words_of_the_last_pass_and_shares_of_shards_add_up():
    rng = random.Random(3)
    for _ in range(300):
        size, block = rng.randrange(1, 60), rng.randrange(1, 20)
        n, want = -(-size // block), rng.randrange(3 * size + 1)
        shares = tuple(rng.randrange(2 * n) for _ in range(4))
        q = M.quota("a", size, 0.0, shares, want, block, rng.random())
        ranks = M.permuted(np.arange(n), q.side, q.keys).tolist()
        assert len(set(ranks)) == n and max(ranks) < q.side**2
        lengths = [min(block, size - b * block) for b in range(n)]
        assert sum(x for x, r in zip(lengths, ranks, strict=True) if r < q.full) + q.part == want % size
        assert all(q.part < x for x, r in zip(lengths, ranks, strict=True) if r == q.full)
        seats = [p * q.side**2 + r for p in range(9) for r in ranks]
        for j in range(3):
            assert sum(q.bounds[j] <= x < q.bounds[j + 1] for x in seats) == shares[j]


def brute(rows, seed, spark):
    """Every word by itself: its block, the block's place in the permutation, and whether a pass takes it."""
    docs = documents(spark, rows, extra=False).select("doc_id", "source", "text", F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))).alias("at")).collect()
    sizes = {}
    for r in docs:
        sizes[r["source"]] = sizes.get(r["source"], 0) + words(r["text"])
    block, quotas = M.plan(sizes, seed)
    taken, shards = {}, {}
    for q in quotas:
        ranks, at = M.permuted(np.arange(q.blocks), q.side, q.keys).tolist(), 0
        for r in sorted((r for r in docs if r["source"] == q.source), key=lambda r: (r["at"], r["doc_id"])):
            taken[r["doc_id"]] = 0
            for _ in range(words(r["text"])):
                b, inside = divmod(at, block)
                at += 1
                for p in range(4):
                    if (p + 1) * q.source_size <= q.words or (p * q.source_size <= q.words and (ranks[b] < q.full or (ranks[b] == q.full and inside < q.part))):
                        taken[r["doc_id"]] += 1
                        shard = max(j for j in range(8) if q.bounds[j] <= p * q.side**2 + ranks[b])
                        shards[q.source, shard] = shards.get((q.source, shard), 0) + 1
    return taken, shards, block, quotas


def test_taken_words_against_words_one_by_one(spark, sf):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for some in (rows, rows_of()):
        taken, shards, block, quotas = brute(some, 0, spark)
        found = M.mix_sources(spark, documents(spark, some, extra=False)).collect()
        assert {r["doc_id"]: r["taken"] for r in found} == taken
        got = {}
        for r in found:
            for x in r["spans"]:
                got[r["source"], x["shard"]] = got.get((r["source"], x["shard"]), 0) + x["end"] - x["begin"]
        assert got == shards
        for q in quotas:  # a shard's words are its quota of blocks, but for blocks cut short and the last shard, which takes what words leave over
            for j, share in enumerate(q.shares[:-1]):
                assert abs(shards.get((q.source, j), 0) - share * block) <= (1 + q.words // max(1, q.source_size)) * block + block
    assert {r["doc_id"]: r["taken"] for r in M.op8_mixing(spark, sf).collect()} == brute(rows, 0, spark)[0]


def test_edges(spark):
    found = M.mix_sources(spark, documents(spark)).collect()
    assert len(found) == len(ROWS) and all(r["taken"] <= 3 * r["size"] for r in found)
    assert M.mix_sources(spark, nothing(spark)).collect() == []
    blank = [(1, None, "en", "a"), (2, " ", "en", None)]
    assert {r["taken"] for r in M.mix_sources(spark, documents(spark, blank)).collect()} == {0}


def test_rows_of_the_mix_hold_the_words_that_are_taken(spark):
    rows = rows_of(150)
    docs = documents(spark, rows, extra=False)
    taken = {r["doc_id"]: r["taken"] for r in M.mix_sources(spark, docs).collect()}
    mixed = M.mixed_rows(spark, docs)
    assert mixed.columns == docs.columns
    got, texts = {}, {i: t for i, t, _, _ in rows}
    for r in mixed.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + words(r["text"])
        assert r["text"] in texts[r["doc_id"]] and r["n_chars"] == len(r["text"])
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in taken.items() if v}


@pytest.mark.parametrize("text", ["  a b  ", "a", "é\tü 　x"])
def test_cutting_whole_texts(spark, text):
    docs = documents(spark, [(1, text, "en", "a")], extra=False)
    assert sum(words(r["text"]) for r in M.mixed_rows(spark, docs).collect()) == words(text)
