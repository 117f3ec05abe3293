import numpy as np
from pyspark.sql import functions as F

from postlens.llm import topk


def test_copies_do_not_displace_neighbours(spark):
    rng = np.random.default_rng(4)
    x = {i: rng.normal(size=24).round(2) for i in range(300)}
    rows = [(i, v.tolist()) for i, v in x.items()]
    near = sorted(x, key=lambda i: -float(x[0] @ x[i]))[:4]
    rows += [(i, x[i].tolist()) for i in near for _ in range(40)]
    rows += [(near[1], (x[near[1]] + 0.0001).tolist())]  # the same integers or another score
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.exact_top_k(d, F.col("vec_id") % 50 == 0, groups=1).collect()))
    q = [(i, np.floor(256 * np.array(v)).astype(np.int64)) for i, v in rows]
    want = []
    for i in range(0, 300, 50):
        pairs = {(-int(a @ b), j) for k, a in q if k == i for j, b in q if j != i}
        want += [(i, rank, j, -s) for rank, (s, j) in enumerate(sorted(pairs)[:5], 1)]
    assert got == want


def clustered(rng, n, dims=64, clusters=20):
    centres = rng.normal(size=(clusters, dims))
    x = centres[rng.integers(0, clusters, n)] + 0.3 * rng.normal(size=(n, dims))
    return np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64).T


def test_most_candidates_are_dropped_early():
    rng = np.random.default_rng(5)
    c = clustered(rng, 3000)
    ids, q = np.arange(3000), c[:, ::50]
    bar = topk.first_bars(ids[::50], q, ids[:1500], c[:, :1500], 5)
    kept: list = []
    i, found, score = topk.best_of_blocks(ids[::50], q, ids, c, 5, bar, kept)
    assert kept[1] < 0.5 and kept[-1] < 0.1 and kept == sorted(kept, reverse=True)
    total = q.T @ c
    total[np.arange(60), ids[::50]] = -(1 << 60)
    want = [(k, int(j), int(total[k, j])) for k in range(60) for j in np.lexsort((ids, -total[k]))[:5]]
    assert sorted(zip(i.tolist(), found.tolist(), score.tolist(), strict=True)) == sorted(want)


def test_blocks_out_of_reach_are_left_out():
    one = np.ones((8, 1), np.int64)
    i, _, _ = topk.best_of_blocks(np.array([1]), one, np.array([2]), one, 1, np.array([1000]))
    assert not len(i)


def test_repeated_ids_and_large_components(spark):
    rows = [(1, [1.0, 2.0], "a"), (1, [1.0, 2.0], "a"), (1, [3.0, 0.0], "b"), (2, [1.0, 1.0], "c"), (3, [1e300, 1.0], "d"), (4, [-262144.0, 1.0], "e"), (5, [524288.0, 0.0], "f"), (6, [float("nan"), 1.0], "g"), (7, [None, 1.0], "h")]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = [tuple(r) for r in topk.exact_top_k(d, F.col("vec_id") == 2).orderBy("rank").collect()]
    # the score of 3 stays at the largest long; both vectors of 1 have the same score
    assert got == [(2, 1, 3, (1 << 63) - 1), (2, 2, 5, 256**2 * 524288), (2, 3, 1, 3 * 256**2), (2, 4, 4, 256**2 * (1 - 262144))]


def test_large_finite_vectors_are_scored(spark):
    d = spark.createDataFrame([(50, [3e5, 1.0]), (0, [1.0, 2.0]), (7, [4e5, 0.0])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.exact_top_k(d, F.col("vec_id") % 50 == 0).collect()))
    x = {50: (76800000, 256), 0: (256, 512), 7: (102400000, 0)}
    dot = lambda a, b: x[a][0] * x[b][0] + x[a][1] * x[b][1]
    assert got == [(0, 1, 7, dot(0, 7)), (0, 2, 50, dot(0, 50)), (50, 1, 7, dot(50, 7)), (50, 2, 0, dot(50, 0))]
    assert topk.exact_top_k(d.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_blocks_are_not_sent_by_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.floor(256 * rng.normal(size=(900, 16))).astype(np.int64)
    d = spark.createDataFrame([(i, (v / 256).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    for name, size in (("QUERIES", 4), ("QUERY_BLOCKS", 3), ("CANDIDATES", 100)):
        monkeypatch.setattr(topk, name, size)
    out = topk.exact_top_k(d, F.col("vec_id") % 20 == 0)  # several query groups
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").removesuffix("b")) <= 8 << 20
    total = x[::20] @ x.T
    total[np.arange(45), np.arange(0, 900, 20)] = -(1 << 60)
    want = [(20 * k, rank, int(j), int(total[k, j])) for k in range(45) for rank, j in enumerate(np.lexsort((np.arange(900), -total[k]))[:5], 1)]
    assert sorted(map(tuple, out.collect())) == want
