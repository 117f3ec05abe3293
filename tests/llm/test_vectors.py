"""Vector operators against brute force: clusters, copies, ties, repeated rows, nulls, large numbers."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.llm import codes, neardup, negatives, vectors
from postlens.llm import queries as Q

SCHEMA = "vec_id long, embedding array<double>, label int, low string, id long, cid long, weight long, key long, n int"


def table(spark, rows):
    """Rows of (vec_id, vector, label) with further columns whose names clash with those the operators use."""
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], y, "x", 1, 2, 3, 4, 5) for i, v, y in rows], SCHEMA)


def clustered(seed, n=400, dims=12, centres=25, noise=0.08):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(centres, dims))
    x = at[rng.integers(0, centres, n)] + noise * rng.normal(size=(n, dims))
    return [(k, v.round(3).tolist(), int(rng.integers(0, 4))) for k, v in enumerate(x)]


ODD = [(900, None, 1), (901, [None, 1.0] + [0.0] * 10, 1), (902, [float("nan")] * 12, 2), (903, [float("inf")] + [0.0] * 11, 2), (904, [0.0] * 12, 1), (905, [1.0, 2.0], 1), (None, [1.0] * 12, 1), (906, [1.0] * 12, None)]


def usable(rows, dims=12):
    fine = [(i, np.pad(np.array(v, float), (0, dims - len(v))), y) for i, v, y in rows if v is not None and None not in v]
    return [r for r in fine if np.isfinite(r[1]).all()]


def brute_negatives(rows, every, k=5):
    x = [(i, np.floor(256 * v).astype(object), y) for i, v, y in usable(rows) if i is not None and y is not None]
    out = set()
    for i, a, y in x:
        if i % every:
            continue
        score = [(int(a @ b), j, z) for j, b, z in x if j != i]
        for ps, p in sorted({(-s, j) for s, j, z in score if z == y})[:k]:
            fits = sorted({(-s, j) for s, j, z in score if z != y and 80 * -ps <= 100 * s <= 100 * -ps})[:k]
            out |= {(i, p, r, j, -ps, -s) for r, (s, j) in enumerate(fits, 1)}
    return out


@pytest.mark.parametrize("blocks", [(4096, 512), (37, 5)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(negatives, "CANDIDATES", blocks[0])
    monkeypatch.setattr(negatives, "ANCHORS", blocks[1])
    rows = clustered(1) + ODD
    rows += [rows[20], rows[20], (21, rows[40][1], 3), (1000, rows[40][1], rows[40][2]), (1001, rows[40][1], (rows[40][2] + 1) % 4)]  # repeated, a second vector, ties
    got = negatives.hard_negatives(table(spark, rows), F.col("vec_id") % 20 == 0).collect()
    assert len(got) == len(set(got)) > 100
    assert {(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got} == brute_negatives(rows, 20)


def test_hard_negatives_of_nothing(spark):
    d = table(spark, [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 2)])  # no positive
    assert negatives.hard_negatives(d, F.col("vec_id") == 0).count() == 0
    assert negatives.hard_negatives(d.limit(0), F.lit(True)).count() == 0
    text = spark.createDataFrame([(0, [1.0], "a"), (1, [1.0], "a"), (2, [0.9], "b"), (3, [1e18], "b")], "vec_id long, embedding array<double>, label string")
    got = negatives.hard_negatives(text, F.col("vec_id") == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2, 256 * 256, 256 * 230)]


def test_bounds_drop_pairs_and_lose_none():
    rng = np.random.default_rng(3)
    x = vectors.integers(vectors.as_matrix([np.array(v) for _, v, _ in clustered(5, 2000, 32, 30, 0.1)]), 256)
    axes, energy = vectors.principal_axes((x @ x.T).astype(float))
    assert np.allclose(axes @ axes.T, np.eye(32)) and (np.diff(energy) <= 1e-6 * energy[0]).all()
    q, turned = x[:, :100], axes @ x
    low = np.array([np.sort(s)[-20] for s in q.T @ x])
    kept = []
    i, j, t = vectors.survivors(turned[:, :100], turned, vectors.cuts_at(energy, negatives.SHARES), low, None, kept)
    total = q.T @ x
    assert set(zip(i.tolist(), j.tolist(), strict=True)) >= set(zip(*(z.tolist() for z in np.nonzero(total >= low[:, None])), strict=True))
    assert kept[-1] < 0.2 and kept == sorted(kept, reverse=True) and np.abs(t - total[i, j]).max() < 1e-3
    high = low + rng.integers(0, 2000, 100)
    i, j, _ = vectors.survivors(turned[:, :100], turned, vectors.cuts_at(energy, negatives.SHARES), low, high)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) >= set(zip(*(z.tolist() for z in np.nonzero((total >= low[:, None]) & (total <= high[:, None]))), strict=True))


def brute_links(rows, least=0.93):
    """(row number -> links), (row number -> smallest id of its component)."""
    n = len(rows)
    x = {k: np.pad(np.array(v, float), (0, 12 - len(v))) for k, (_, v, y) in enumerate(rows) if v is not None and None not in v and y is not None}
    x = {k: v for k, v in x.items() if np.isfinite(v).all() and v.any()}
    links = {k: {j for j in x if j != k and rows[j][2] == rows[k][2] and x[j] @ x[k] / (np.linalg.norm(x[j]) * np.linalg.norm(x[k])) >= least} if k in x else set() for k in range(n)}
    comp = list(range(n))
    for k in range(n):
        seen, todo = {k}, [k]
        while todo:
            todo += [j for j in links[todo.pop()] if j not in seen and not seen.add(j)]
        comp[k] = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
    return [len(links[k]) for k in range(n)], comp


@pytest.mark.parametrize("tile", [1024, 16])
def test_near_duplicates_equal_brute_force(spark, tile):
    rows = clustered(2, 300, noise=0.12) + ODD + [(950, [2.0 * x for x in clustered(2, 300, noise=0.12)[7][1]], clustered(2, 300, noise=0.12)[7][2])]
    rows += [rows[7], rows[7], (7, rows[9][1], rows[9][2]), (960, [-0.0, 1.0], 1), (961, [0.0, 1.0], 1)]
    got = sorted(map(tuple, neardup.near_duplicates(table(spark, rows), tile=tile).collect()), key=str)
    links, comp = brute_links(rows)
    want = sorted([(r[0], n, c, r[0] is not None and r[0] == c) for r, n, c in zip(rows, links, comp, strict=True)], key=str)
    assert got == want and max(links) > 3


def test_near_duplicates_of_one_label_of_copies(spark):
    v = clustered(4, 3)
    rows = [(k, v[k % 2][1], 1) for k in range(500)] + [(1000 + k, [1.0 + k * 1e-6] + [0.5] * 11, 1) for k in range(300)]
    got = {r.vec_id: r for r in neardup.near_duplicates(table(spark, rows), tile=64).collect()}
    assert len(got) == 800 and {got[k].n_links for k in range(500)} == {249} and {got[k].n_links for k in range(1000, 1300)} == {299}
    assert [k for k, r in sorted(got.items()) if r.kept] == [0, 1, 1000]
    assert neardup.near_duplicates(table(spark, [])).count() == 0


def test_tiles_stop_early():
    a, b = (vectors.as_matrix([np.array(v) for _, v, _ in clustered(s, 500, 64, 500, 0)]) for s in (6, 7))
    m = neardup.units(np.concatenate([a, b], axis=1))
    axes, energy = vectors.principal_axes(m @ m.T)
    kept = []
    i, _ = neardup.linked(a, b, axes, vectors.cuts_at(energy, neardup.SHARES), 0.93, kept)
    assert not len(i) and kept[-1] < 0.01


def brute_codes(rows, parts, entries, rounds, dims):
    x = sorted(((i, np.floor(1024 * v).astype(np.int64).astype(object)) for i, v, _ in usable(rows, dims)), key=lambda r: (r[0] is None, r[0], list(r[1])))
    m = np.array([v for _, v in x]).reshape(len(x), parts, -1)
    books = m[[k for k, r in enumerate(x) if r[0] is not None][:entries]].transpose(1, 0, 2).copy()
    near = lambda: [[min(range(books.shape[1]), key=lambda e: (sum((v[p] - books[p][e]) ** 2), e)) for p in range(parts)] for v in m]
    for _ in range(rounds):
        at = near()
        for p in range(parts):
            for e in range(books.shape[1]):
                own = [v[p] for v, a in zip(m, at, strict=True) if a[p] == e]
                if own:
                    books[p, e] = sum(own) // len(own)
    at = near()
    error = [int(sum(sum((v[p] - books[p][a[p]]) ** 2) for p in range(parts))) for v, a in zip(m, at, strict=True)]
    return [(i, "".join(f"{c:02x}" for c in a), e) for (i, _), a, e in zip(x, at, error, strict=True)], hashlib.sha256(",".join(str(int(y)) for y in books.ravel()).encode()).hexdigest()


def test_vector_codes_equal_brute_force(spark):
    rows = clustered(8, 260) + ODD + [clustered(8, 260)[3]] * 2 + [(3, [9.5] * 12, 2), (970, [3e4] * 12, None)]
    random.Random(1).shuffle(rows)
    out, books = codes.vector_codes(table(spark, rows).repartition(5), parts=4, entries=20, rounds=4, per_block=16)
    got = out.collect()
    want, sha = brute_codes(rows, 4, 20, 4, 12)
    assert codes.digest(books) == sha
    assert sorted(((r.vec_id, r.code, r.error) for r in got), key=str) == sorted(want, key=str)
    label = {}
    for i, v, y in rows:
        label.setdefault((i, str(v)), y)
    sums = {}
    for r in got:
        sums.setdefault(r.label_error, []).append(r.error)
    assert all(sum(v) % k == 0 if k else not any(v) for k, v in sums.items())
    assert {r.label_error for r in got if r.vec_id in (906, 970)} == {sum(r.error for r in got if r.vec_id in (906, 970))}


def test_rounds_shuffle_fewer_and_fewer_parts(spark):
    v = table(spark, clustered(9, 600, 8, 40)).select(F.col("vec_id").alias("id"), "label", "embedding")
    moved = []
    codes.train(v, 8, 4, 30, 5, 1024.0, 64, moved)
    assert moved[0] == 2400 and all(a < 0.5 * moved[0] for a in moved[1:]) and moved[-1] < moved[1]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("codes_")]


def test_vector_codes_of_nothing_and_odd_sizes(spark):
    out, books = codes.vector_codes(table(spark, []))
    assert out.count() == 0 and books.shape[1] == 0
    out, books = codes.vector_codes(table(spark, [(1, [1.0] * 5, 1), (2, [1e300] * 5, 1)]), entries=1, rounds=1)
    assert books.shape == (4, 1, 2) and {r.code for r in out.collect()} == {"00000000"}
    with pytest.raises(ValueError):
        codes.vector_codes(table(spark, []), entries=300)


def test_sql_agrees(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    for name, sql in Q.oracle_sql().items():
        got = Q.queries()[name](spark, sf).toPandas()
        want = con.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        rows = lambda d: sorted(map(tuple, d[sorted(want.columns)].astype(str).to_numpy().tolist()))
        assert rows(got) == rows(want), name
