import math
import random

import numpy as np
from compare import duck_rows, spark_rows

from palimpsest.llm import topk as T


def brute(rows, queries, k=20):
    best = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(64 * x) for x in v]
        best[i] = min(best.get(i, q), q)
    out = []
    for i in sorted({q for q in queries if q in best}):
        found = sorted((-sum(a * b for a, b in zip(best[i], v, strict=True)), j) for j, v in best.items() if j != i and len(v) == len(best[i]))
        out += [(i, r, j, -s) for r, (s, j) in enumerate(found[:k], 1)]
    return out


def run(spark, rows, k=20, **sizes):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, query_id string, top string")
    found = T.top_k(spark, frame, frame.where("vec_id % 20 = 0"), k, **sizes)
    return sorted(tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect())


def test_against_brute_force_over_many_tiles(spark):
    rng = random.Random(0)
    rows = [(i, [float(np.float32(rng.choice([-0.5, 0.25, 0.75, rng.random()]))) for _ in range(6)], 0, "x", "y") for i in range(230)]
    rows += [(400, None, 0, "x", "y"), (420, [0.1, None, 0.2, 0.3, 0.4, 0.5], 0, "x", "y"), (440, [float("nan")] * 6, 0, "x", "y"), (460, [float("inf")] * 6, 0, "x", "y")]
    rows += [(None, [0.5] * 6, 0, "x", "y"), (480, [0.5, 0.5], 0, "x", "y"), (481, [0.25, 0.5], 0, "x", "y"), (500, [], 0, "x", "y"), (20, rows[20][1], 0, "x", "y")]
    want = brute([r[:2] for r in rows], [r[0] for r in rows if r[0] is not None and r[0] % 20 == 0], 7)
    assert run(spark, rows, 7, shard=20, block=4) == want
    assert run(spark, rows, 7) == want


def test_ties_go_to_the_smaller_id_and_few_rows_give_all(spark):
    rows = [(i, [1.0, 1.0], 0, "", "") for i in range(5)]
    assert run(spark, rows) == [(0, r, r, 8192) for r in range(1, 5)]
    assert run(spark, []) == []


def test_products_of_any_size():
    for scale in (1, 1 << 20, 1 << 29, 1 << 40):
        rng = random.Random(scale)
        a, b = (np.array([[rng.randrange(-scale, scale + 1) for _ in range(3)] for _ in range(n)], np.int64) for n in (4, 9))
        want = [[max(-T.LONG, min(T.LONG, sum(int(x) * int(y) for x, y in zip(q, r, strict=True)))) for r in b] for q in a]
        assert T._product(a, b).tolist() == want
        ids = np.arange(9) * 3
        counts, found, scores = T.best_of_tile(np.array([0, 1, 2, 6]), a, ids, b, 4)
        at = 0
        for q, n, row in zip((0, 1, 2, 6), counts, want, strict=True):
            best = sorted((-s, i) for s, i in zip(row, ids.tolist(), strict=True) if i != q)[:4]
            assert [(-s, i) for s, i in best] == list(zip(scores[at : at + n].tolist(), found[at : at + n].tolist(), strict=True))
            at += n


def test_sql(spark, sf):
    assert spark_rows(T.op3_topk(spark, sf)) == duck_rows(T.OP3_SQL, sf)
