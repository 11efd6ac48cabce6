import random
import re

import numpy as np
from cases import ROWS, documents, nothing
from compare import duck_rows, spark_rows
from pyspark.sql import functions as F

from palimpsest.llm import jaccard as J
from palimpsest.llm.arrow import utf8


def brute(rows, size=3, percent=90):
    low = {i: i + 32 for i in range(65, 91)}
    sets, out = [], []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append(frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if k and 100 * k >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    for a, (i, _) in enumerate(rows):  # rows of one id are one document
        for b, (j, _) in enumerate(rows[:a]):
            if i is not None and i == j:
                parent[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[root(a)] = min(least.get(root(a), i), i)
    for a, (i, _) in enumerate(rows):
        out.append((i, len(sets[a]), least.get(root(a), i)))
    return sorted(out, key=repr)


def run(spark, rows):
    found = J.jaccard_components(spark, documents(spark, [(i, t, "en", "a") for i, t in rows]))
    return sorted((tuple(r) for r in found.collect()), key=repr)


def variants(rng, words, n, edits):
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randrange(0, edits + 1)):
            k = rng.randrange(len(w))
            w[k] = rng.choice("abcdefgh") * 3 + str(rng.randrange(1000))
        out.append(" ".join(w))
    return out


def test_against_brute_force(spark):
    rng = random.Random(0)
    base = [[f"w{rng.randrange(500)}" for _ in range(rng.choice([4, 30, 60, 120]))] for _ in range(12)]
    texts = [t for b in base for t in variants(rng, b, 9, 4)]
    shared = " ".join(f"common{k}" for k in range(40))
    texts += [shared + " " + " ".join(f"own{i}x{k}" for k in range(30)) for i in range(25)] + [shared] * 3
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_large_group_of_near_copies(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(70)]
    rows = list(enumerate(variants(rng, words, 60, 3) + [" ".join(words)] * 20))
    assert run(spark, rows) == brute(rows)


def test_threshold_is_met_exactly(spark):
    rows = []
    for n in (9, 10, 18, 19, 20, 38, 40):
        words = [f"n{n}w{k}" for k in range(n + 2)]
        rows += [(n * 10, " ".join(words)), (n * 10 + 1, " ".join(words + ["x"])), (n * 10 + 2, " ".join(words[1:])), (n * 10 + 3, " ".join([*words, "y", "z"]))]
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    rows = [(i, t) for i, t, _, _ in ROWS]
    assert run(spark, rows) == brute(rows)
    assert J.jaccard_components(spark, nothing(spark)).collect() == []


def test_parts_hold_all_of_a_bucket_wherever_batches_end(spark, monkeypatch):
    """A token's sets are all told, in parts that share one, and tokens of one set go."""
    rng = random.Random(3)
    rows = sorted({(t, 0, False, 10 + rng.randrange(3), rng.randrange(10**6)) for t, m in enumerate([1, 2, 40, 1, 9, 33, 5]) for _ in range(m)})
    frame = spark.createDataFrame(rows, "token long, block long, many boolean, n int, f1 long")
    for gathered, block in ((3, 8), (1000, 8), (7, 64)):
        monkeypatch.setattr(J, "GATHERED", gathered)
        monkeypatch.setattr(J, "BLOCK", block)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
        found = [tuple(r) for r in J.shared_tokens(frame).collect()]
        parts = {}
        for token, part, many, n, f1 in found:
            parts.setdefault((token, part), set()).add(f1)
            assert many or sum(r[0] == token for r in rows) <= block, (token, gathered)
        assert {(t, f) for t, _, _, _, f in found} == {(r[0], r[4]) for r in rows if sum(x[0] == r[0] for x in rows) > 1}
        assert max(map(len, parts.values())) <= block + 1
        for (token, part), own in parts.items():
            if part:
                assert own & parts[token, part + 1]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    dealt = J._dealt(np.repeat(np.array([5, 7]), [30, 3]), np.full(33, 9, np.int32), np.arange(33), 1, 10, 20).to_pylist()
    assert sorted(r["f1"] for r in dealt if r["token"] == 7) == [30, 31, 32]
    assert len({r["block"] for r in dealt if r["token"] == 5}) == 3 and sum(r["block"] == 0 for r in dealt if r["token"] == 5) == 2 * J.BRIDGES


def test_forest_is_least_and_spans():
    rng = np.random.default_rng(4)
    for _ in range(40):
        m = int(rng.integers(2, 12))
        weight = rng.integers(0, 60, (m, m))
        weight = np.minimum(weight, weight.T)
        weight[weight > 30] = 1000
        a, b = J._forest(weight, 1000)
        root = list(range(m))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        total = 0
        for w, i, j in sorted((int(weight[i, j]), i, j) for i in range(m) for j in range(i) if weight[i, j] < 1000):
            if find(i) != find(j):
                root[find(i)] = find(j)
                total += w
        assert weight[a, b].sum() == total and len(a) == m - len({find(x) for x in range(m)})


def test_second_signature_lets_links_pass_and_holds_long_strangers():
    rng = np.random.default_rng(7)
    common = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    near = [np.unique(np.concatenate([common, rng.integers(0, 1 << 63, 200).astype(np.uint64)])) for _ in range(2)]
    far = np.unique(rng.integers(0, 1 << 63, 5200).astype(np.uint64))
    a, b, c = (np.frombuffer(J.long_parities(x, np.array([0, len(x)]))[0], np.uint64) for x in (*near, far))
    bits = lambda x, y: np.bitwise_count(x ^ y).sum(dtype=np.int64)
    sizes = [np.int64(len(x)) for x in (*near, far)]
    assert bits(a, b) <= 400 and J.may_link(bits(a, b), sizes[0], sizes[1], 90) and not J.may_link(bits(a, c), sizes[0], sizes[2], 90)
    assert J.long_parities(common[:10], np.array([0, 10])) == [None]


def test_pieces_of_large_buckets_miss_nothing(spark, monkeypatch):
    """Blocks far smaller than the groups, and hot tokens already within a task."""
    for name, value in (("BLOCK", 5), ("SMALL", 2), ("LOCAL", 6), ("SORTED", 300), ("GATHERED", 50)):
        monkeypatch.setattr(J, name, value)
    rng = random.Random(5)
    rows = []
    for g in range(3):
        words = [f"g{g}w{k}" for k in range(64)]
        rows += variants(rng, words, 45, 5)
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_repeated_and_missing_ids(spark, sf):
    a, b = [" ".join(f"{x}{k}" for k in range(40)) for x in "ab"]
    near = b + " z"
    rows = [(3, a), (5, a), (5, b), (7, near), (5, ""), (None, a + " y"), (None, b + " y"), (None, "alone with its words"), (None, None), (9, "")]
    assert run(spark, rows) == brute(rows)
    found = dict.fromkeys(r for r in run(spark, rows))
    assert {c for i, _, c in found if i in (3, 5, 7)} == {3}


def test_first_of_each_group_goes_by_text(spark):
    a, b, c = [" ".join(f"{x}{k}" for k in range(40)) for x in "abc"]
    rows = [(3, a), (5, a), (5, b), (7, b + " z"), (None, c), (None, c), (None, a), (8, None), (8, ""), (None, ""), (4, "x y"), (4, "x y")]
    docs = documents(spark, [(i, t, "en", "a") for i, t in rows]).withColumn("a.b", F.lit(1))
    kept = J.first_of_each_group(spark, docs)
    assert kept.columns == docs.columns
    want = [(3, a), (5, b), (None, c), (8, None), (8, ""), (None, ""), (4, "x y")]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(want, key=repr)
    assert J.first_of_each_group(spark, nothing(spark)).collect() == []


def test_prefixes_of_sets_that_link_meet_and_signatures_let_them_pass():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 9, J.COUNTERS).astype(np.uint8)
    for _ in range(300):
        n = int(rng.integers(1, 80))
        common = rng.integers(0, 1 << 63, n).astype(np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, int(rng.integers(0, 6))).astype(np.uint64)])) for _ in range(2))
        k, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if 100 * k >= 90 * union:
            for order in range(J.ORDERS):
                assert len(np.intersect1d(J.prefix(a, counts, order, 90), J.prefix(b, counts, order, 90)))
            pa, pb = (J.parities(x, np.array([0, len(x)])) for x in (a, b))
            bits = sum(int(np.bitwise_count((x ^ y).view(np.uint64))[0]) for x, y in zip(pa, pb, strict=True))
            assert bits <= union - k and J.may_link(np.array(bits), np.array(len(a)), np.array(len(b)), 90)


def test_shingles():
    import pyarrow as pa

    texts = ["A b C d", "a B c D", "a b", "A  b", "a", "", None, "b a", "x\ty z x y z x y z"]
    s, at = J.shingle_sets(*utf8(pa.array(texts)))
    got = [tuple(s[a:b].tolist()) for a, b in zip(at, at[1:], strict=False)]
    assert [len(x) for x in got] == [2, 2, 1, 1, 1, 0, 0, 1, 3]
    assert got[0] == got[1] and got[2] == got[3] and len({got[2], got[4], got[7]}) == 3


def test_sql(spark, sf):
    assert spark_rows(J.op10_jaccard(spark, sf)) == duck_rows(J.OP10_SQL, sf)
