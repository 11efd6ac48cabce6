"""Packed postings against the queries' SQL, on rows that repeat, are null, empty or tie, in chunks of few words."""

import random

import numpy as np
import pytest
from compare import duck_rows, spark_rows
from pyspark.sql import functions as F

from palimpsest.operators import postings
from palimpsest.plans import queries as Q
from palimpsest.plans.registry import ORACLES, QUERIES

NAMES = ["tfidf", "similarity_join", "top_per_left", "top_per_right", "threshold_join", "global_heap", "candidates", "top_terms", "shared_terms", "top_corpus_pairs"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """No words and one word, one id twice within and across sources, equal texts, null text and source, a word in every text, a long text."""
    import duckdb

    at, rng = tmp_path_factory.mktemp("odd"), random.Random(3)
    some = lambda n: " ".join(rng.choice(["the", *(f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(5))}" for _ in range(3))]) for _ in range(n))
    docs = [(i, some(rng.randrange(2, 60)), f"src{i % 7}") for i in range(150)]
    docs += [(3, some(20), "src3"), (3, some(20), "src3"), (3, docs[3][1], "src3"), (3, "qaq qaq", "src4"), (200, None, "src1"), (201, "", "src1"), (202, "Solus!", "src2"), (203, some(9), "src5")]
    docs += [(210 + i, docs[8][1], "src1") for i in range(9)] + [(230, some(5000), "src2"), (231, some(30), None), (231, some(30), None), (232, "wab wab wab", "src0"), (-5, "wab", "src0")]
    asked = [(i, docs[i * 5][1] if i % 2 else some(12)) for i in range(25)] + [(25, ""), (26, None), (27, "solus"), (4, docs[8][1])]
    for name, rows, schema in (("documents", docs, "doc_id long, text string, source string"), ("benchmark", asked, "item_id long, text string")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(at / name))
        duckdb.sql(f"COPY (SELECT * FROM '{at}/{name}/*.parquet') TO '{at}/{name}.parquet' (FORMAT parquet)")
    for t in ("region nation customer supplier part orders lineitem events embeddings pages labels conversations").split():
        duckdb.sql(f"COPY (SELECT 1 AS x) TO '{at}/{t}.parquet' (FORMAT parquet)")
    return str(at)


@pytest.mark.parametrize("name", NAMES)
def test_odd_tables_in_small_chunks(spark, odd, name, monkeypatch):
    small = lambda s, d: postings.packed(Q.passages(s, d).repartition(3), low=1, high=2, words=200, entries=300)
    monkeypatch.setattr(Q, "packed", small)
    whole = postings.similarities
    monkeypatch.setattr(postings, "similarities", lambda *a, **k: whole(*a, **k, block=4, tile=7, products=50))
    got, want = spark_rows(QUERIES[name](spark, odd)), duck_rows(ORACLES[name], odd)
    assert got[1] and got == want


def test_only_lists_of_distinct_terms_travel(spark, tmp_path):
    """What is kept and asked is a fraction of a row per posting (before, five shuffles of all of them)."""
    rng = random.Random(5)
    rows = [("left" if i < 5 else "right", "c", str(i), [rng.choice("abcdefghij") * rng.randrange(1, 9) for _ in range(400)]) for i in range(300)]
    leaves = spark.createDataFrame(rows, "side string, corpus string, leaf_id string, lemmas array<string>")
    p = postings.packed(leaves)
    n = postings.rows(p).count()
    kept = p.chunks.select(F.sum(sum((F.length(c) for c in ("parts", "sizes", "words", "codes")), F.lit(0)))).first()[0]
    asked = spark.read.parquet(p.terms.split(" ", 1)[1]).select(F.sum(F.length("answer"))).first()[0]
    assert n > 30_000 and kept < 8 * n and asked < 4 * n


def test_packed_numbers():
    rng = np.random.default_rng(0)
    for values in (np.zeros(0, np.int64), np.array([0]), np.array([255, 256, 0]), rng.integers(0, 1 << 62, 1000), np.array([(1 << 63) - 1])):
        assert np.array_equal(postings.unpack(postings.pack(values)), values)


def test_no_longer_terms(spark):
    with pytest.raises(ValueError):
        postings.packed(spark.createDataFrame([], "side string, corpus string, leaf_id string, lemmas array<string>"), low=1, high=3)


def test_no_leaves(spark):
    p = postings.packed(spark.createDataFrame([], "side string, corpus string, leaf_id string, lemmas array<string>"))
    assert postings.rows(p).count() == 0 and postings.top_terms(p, 5, 9).count() == 0 and postings.similarities(p, [("a", "b")], 9).count() == 0


@pytest.mark.parametrize("words,block_words", [(200, 40), (1 << 20, 1 << 16), (50, 1)])
def test_pairs_are_counted_in_small_blocks(spark, odd, words, block_words, monkeypatch):
    whole = postings.pair_counts
    small = lambda leaves, pairs: whole(leaves.repartition(3), pairs, words=words, block_words=block_words, cells=30, products=50, held=100)
    monkeypatch.setattr(postings, "pair_counts", small)
    got, want = spark_rows(QUERIES["top_corpus_pairs"](spark, odd)), duck_rows(ORACLES["top_corpus_pairs"], odd)
    assert got[1] and got == want


@pytest.mark.parametrize("most,ids", [(0.5, 30), (0.5, None), (0.01, None), (1.0, None), (3, 30), (3, None), (40, None), (1000, 30)])
def test_counted_pairs_are_those_with_a_similarity(spark, most, ids):
    """On several left corpora, with words in every leaf and bounds by share and by number; leaves of several rows, or none of them."""
    rng = random.Random(8)
    word = lambda: "abcdefghijklmnopqrstuvwxyz"[min(25, int(rng.expovariate(0.2)))] * rng.randrange(1, 3)
    rows = [(rng.choice(["left", "right"]), rng.choice(["u", "v", None]), str(rng.randrange(ids) if ids else i), ["all", *(word() for _ in range(rng.randrange(6)))]) for i in range(40)]
    leaves = spark.createDataFrame(rows, "side string, corpus string, leaf_id string, lemmas array<string>").cache()
    pairs = [("u", "u"), ("u", "v"), ("v", "v"), ("w", "u"), (None, "u")]
    got = postings.pair_counts(leaves, pairs, max_df=most, words=30, block_words=10).groupBy("left_corpus", "right_corpus").agg(F.sum("pairs")).collect()
    want = postings.similarities(postings.packed(leaves, max_df=most), pairs, 15).groupBy("left_corpus", "right_corpus").count().collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_counting_pairs_keeps_nothing_of_right_leaves(spark, tmp_path, monkeypatch):
    """Before, all texts were stored in chunks, and an answer for every distinct term."""
    from palimpsest import workspace

    monkeypatch.setattr(workspace, "workspace", lambda _: str(tmp_path / "kept"))
    rng = random.Random(6)
    docs = [(i, " ".join("".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(400)), f"src{i % 3}") for i in range(300)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, docs[i][1][:40]) for i in range(5)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert QUERIES["top_corpus_pairs"](spark, str(tmp_path)).count() == 3
    size = lambda name: sum(p.stat().st_size for p in (tmp_path / name).rglob("*.parquet"))
    assert size("kept") < size("documents.parquet") / 20


def test_no_pairs_to_count(spark):
    empty = spark.createDataFrame([], "side string, corpus string, leaf_id string, lemmas array<string>")
    assert postings.pair_counts(empty, [("a", "b")]).count() == 0
    with pytest.raises(ValueError):
        postings.pair_counts(empty, [], high=3)
