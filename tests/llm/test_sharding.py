import zlib

import pytest
from cases import ROWS, documents, nothing

from palimpsest.llm import sharding as S


def check(rows, found, shards, tolerance):
    sizes = sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in found) == sizes
    total = sum(x[1] for x in sizes)
    for s in range(shards):
        own = [r for r in found if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        largest = max((x[1] for x in sizes), default=0)
        assert abs(sum(r["size"] for r in own) - total / shards) <= tolerance * total / shards + 2 * largest


@pytest.mark.parametrize("hot", [0, 300])
def test_shards_are_near_equal(spark, hot):
    rows = [(i, f"text {i} " + "x" * (i * 37 % 200), "en", "a") for i in range(600)] + [(1000 + i, "the same text again and again " * 4, "en", "a") for i in range(hot)]
    found = S.histogram_shards(spark, documents(spark, rows)).collect()
    check(rows, found, 8, 0.05)
    by_text = {}
    for r in found:
        by_text.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert sum(len(x) > 1 for x in by_text.values()) <= bool(hot)


def test_edges(spark):
    check(ROWS, S.histogram_shards(spark, documents(spark), 3).collect(), 3, 1.0)
    assert S.histogram_shards(spark, nothing(spark)).collect() == []
    same = [(5, "a", "en", "a")] * 50
    assert len(S.histogram_shards(spark, documents(spark, same)).collect()) == 50
    empty = [(i, None, "en", "a") for i in range(90)]
    check(empty, S.histogram_shards(spark, documents(spark, empty)).collect(), 8, 0.2)


def test_query_agrees_with_itself(spark, sf):
    one, two = (sorted(map(tuple, S.op7_sharding(spark, sf).collect()), key=repr) for _ in range(2))
    assert one == two and {r[3] for r in one} == {"bytes"}


@pytest.mark.parametrize("hot", [0, 400])
def test_shards_against_sorted_prefix_sums(spark, sf, hot):
    """Splitters against exact sums below them, shards and slots against the whole table in order."""
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs = documents(spark, rows + [(10_000 + i, "one text of many " * 9, "en", "a") for i in range(hot)], extra=False)
    keys = sorted((r["_k1"], r["_k2"], r["doc_id"], r["size"]) for r in S.keyed(docs).collect())
    total = sum(k[3] for k in keys)
    splitters = S.find_splitters(S.keyed(docs), 8)
    largest = max(k[3] for k in keys)
    for j, (a, b) in enumerate(splitters, 1):
        below = sum(k[3] for k in keys if (k[0] + (1 << 63), k[1] + (1 << 63)) < (a, b))
        assert abs(below - total * j / 8) <= S.TOLERANCE * total / 8 / 2 + largest
    want, upto = {}, {}
    for k1, k2, doc, _ in keys:
        shard = sum((a, b) <= (k1 + (1 << 63), k2 + (1 << 63)) for a, b in splitters)
        want[doc] = (shard, upto.get(shard, 0))
        upto[shard] = upto.get(shard, 0) + 1
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in S.histogram_shards(spark, docs).collect()} == want
