"""Vectors in blocks: exact integers and their products, rotation to principal axes, pairs that bounds cannot rule out.

Integers are floor(scale * x), held at +-2^62; products that 64 bits cannot hold are
held at the ends of their range. All else is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integers beyond are held here.
LIMIT = 1 << 62
#: Share of pairs below which they go on as a list, pairs that are multiplied at once.
FEW, AT_ONCE = 0.15, 1 << 16
#: Rounding slack of rotated products, as a share of the norms.
SLACK = 1e-11
LOW, HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def whole(c: Column | str) -> Column:
    """Whether a vector is there, with no component null or not finite."""
    c = F.col(c) if isinstance(c, str) else c
    odd = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return c.isNotNull() & ~F.coalesce(odd, F.lit(True))


def as_matrix(vectors: Iterable[np.ndarray], dims: int | None = None) -> np.ndarray:
    """Column-major: a column for each vector, shorter ones padded with zeros."""
    vectors = list(vectors)
    out = np.zeros((max(map(len, vectors), default=0) if dims is None else dims, len(vectors)))
    for k, v in enumerate(vectors):
        out[: len(v), k] = v
    return out


def integers(m: np.ndarray, scale: float, limit: int = LIMIT) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * m), -limit, limit).astype(np.int64)


def stored(m: np.ndarray) -> tuple[str, bytes]:
    """The narrowest type that holds the numbers exactly, and their bytes."""
    kinds = ("<i2", "<i4", "<i8") if m.dtype.kind == "i" else ("<f4", "<f8")
    with np.errstate(over="ignore"):
        kind = next(k for k in kinds if k[-1] == "8" or (m == m.astype(k)).all())
    return kind, m.astype(kind).tobytes()


def loaded(data: bytes, kind: str, dims: int) -> np.ndarray:
    m = np.frombuffer(data, kind)
    return m.reshape(dims, -1).astype(np.float64 if kind[1] == "f" else np.int64)


def pack(rows: DataFrame, per_block: int, scale: float | None, sort: list[str] | None = None) -> DataFrame:
    """Blocks of at most per_block rows of a task: n, dims, kind, data (integers if a scale is given, else as they are), and each further column of longs, or lists of longs, as bytes."""
    names = [c for c in rows.columns if c != "embedding"]

    def block(g: pd.DataFrame) -> dict:
        g = g.sort_values(sort, kind="stable") if sort else g
        m = as_matrix(g.embedding)
        kind, data = stored(m if scale is None else integers(m, scale))
        out = {"n": len(g), "dims": len(m), "kind": kind, "data": data}
        for c in names:
            lists = isinstance(g[c].iloc[0], (list, np.ndarray))
            out[c] = (pad_lists(g[c]) if lists else g[c].to_numpy(np.int64)).tobytes()
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, n = [], 0
        for b in batches:
            left.append(b)
            n += len(b)
            if n >= per_block:
                every = pd.concat(left, ignore_index=True)
                full = n // per_block * per_block
                for at in range(0, full, per_block):
                    yield pd.DataFrame([block(every.iloc[at : at + per_block])])
                left, n = [every.iloc[full:]], n - full
        if n:
            yield pd.DataFrame([block(pd.concat(left, ignore_index=True))])

    return rows.mapInPandas(run, "n int, dims int, kind string, data binary" + "".join(f", {c} binary" for c in names))


def pad_lists(lists: Iterable) -> np.ndarray:
    lists = [np.asarray(x, np.int64) for x in lists]
    out = np.full((len(lists), max(1, max(map(len, lists), default=1))), LOW)
    for k, x in enumerate(lists):
        out[k, : len(x)] = x
    return out


def same_dims(*ms: np.ndarray) -> list[np.ndarray]:
    dims = max(map(len, ms))
    return [np.pad(x, ((0, dims - len(x)), (0, 0))) for x in ms]


def largest_sum(q: np.ndarray, c: np.ndarray) -> float:
    return float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * len(q)


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """q.T @ c of column-major integers: by floats while sums stay exact, else by integers, wide ones where they must be."""
    bound = largest_sum(q, c)
    if not q.size or not c.size:
        return np.zeros((q.shape[1], c.shape[1]), np.int64)
    if bound < 1 << 24:
        return (q.astype(np.float32).T @ c.astype(np.float32)).astype(np.int64)
    if bound < 1 << 53:
        return (q.astype(np.float64).T @ c.astype(np.float64)).astype(np.int64)
    if bound < 1 << 62:
        return q.T @ c
    return held(q.astype(object).T @ c.astype(object))


def held(x: np.ndarray) -> np.ndarray:
    return np.minimum(np.maximum(x, LOW), HIGH).astype(np.int64)


def products(q: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """scores(q, c)[i, j]: of few pairs, these alone are multiplied."""
    if len(i) > FEW * q.shape[1] * c.shape[1]:
        return scores(q, c)[i, j]
    wide = largest_sum(q, c) >= 1 << 62
    q, c = (x.astype(object) for x in (q, c)) if wide else (q, c)
    parts = [(q[:, i[k : k + AT_ONCE]] * c[:, j[k : k + AT_ONCE]]).sum(axis=0) for k in range(0, len(i), AT_ONCE)]
    return (held(np.concatenate(parts)) if wide else np.concatenate(parts).astype(np.int64)) if parts else np.zeros(0, np.int64)


def best(query: np.ndarray, found: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best (id, score), ties to the smaller id; repeated ones count once."""
    order = np.lexsort((found, ~score, query))  # ~score falls as score rises, for all of 64 bits
    query, found, score = query[order], found[order], score[order]
    new = np.r_[True, (query[1:] != query[:-1]) | (found[1:] != found[:-1]) | (score[1:] != score[:-1])][: len(order)]
    order, query = order[new], query[new]
    begin = np.flatnonzero(np.r_[True, query[1:] != query[:-1]][: len(query)])
    return order[np.arange(len(query)) - np.repeat(begin, np.diff(np.r_[begin, len(query)])) < k]


def kth_best(n: int, query: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Of n queries with at most k scores each: the k-th, or LOW."""
    out = np.full(n, LOW)
    full = np.bincount(query, minlength=n) == k
    np.minimum.at(low := np.full(n, HIGH), query, score)
    out[full] = low[full]
    return out


def moments(rows: DataFrame, dims: int, prepare: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of x x' over prepare(matrix) of all rows' `embedding`: a matrix for each task, added up by position; dims x dims numbers reach the driver."""
    if not dims:
        return np.zeros((0, 0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dims, dims))
        for b in batches:
            for at in range(0, len(b), 4096):
                m = prepare(as_matrix(b.embedding.iloc[at : at + 4096], dims)).astype(np.float64)
                total += m @ m.T
        yield pd.DataFrame({"i": np.arange(dims), "row": list(total)})

    each = rows.select("embedding").mapInPandas(run, "i int, row array<double>")
    summed = each.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((dims, dims))
    out[summed.i, summed.j] = summed.v
    return out


def principal_axes(moment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(axes as rows, their energy), largest first. Any orthogonal matrix gives right bounds, so rounding here loses nothing."""
    if not np.isfinite(moment).all():  # sums beyond the range of doubles: the axes as they are
        return np.eye(len(moment)), np.ones(len(moment))
    energy, axes = np.linalg.eigh((moment + moment.T) / 2)
    return axes[:, ::-1].T.copy(), np.maximum(energy[::-1], 0)


def cuts_at(energy: np.ndarray, shares: Iterable[float]) -> list[int]:
    """Where the leading dimensions hold these shares of the energy, as ends of steps."""
    so_far = np.cumsum(energy) / max(energy.sum(), 1e-300)
    return sorted({min(int(np.searchsorted(so_far, s)) + 1, len(energy)) for s in shares} - {len(energy)})


def rest_norms(m: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Row s: norms of the columns from the s-th cut on; row 0 of all."""
    return np.array([np.sqrt((m[at:] ** 2).sum(axis=0)) for at in [0, *cuts]])


def survivors(q: np.ndarray, c: np.ndarray, cuts: list[int], low: np.ndarray, high: np.ndarray | None = None, kept: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(i, j, their products if all dimensions were added): the pairs of rotated columns whose product may lie from low[i] to high[i].

    Products are added up one step of leading dimensions at a time; what the rest can
    add is at most the product of its norms. kept: gets the share of pairs left after each step.
    """
    qr, cr = rest_norms(q, cuts), rest_norms(c, cuts)
    low = low.astype(np.float64) - 1e-9 * np.abs(low.astype(np.float64))
    high = None if high is None else high.astype(np.float64) + 1e-9 * np.abs(high.astype(np.float64))
    possible = np.flatnonzero(qr[0] * cr[0].max(initial=0) * (1 + SLACK) >= low)
    left = np.flatnonzero(cr[0] * qr[0].max(initial=0) * (1 + SLACK) >= low.min(initial=np.inf))
    none = np.zeros(0, np.int64)
    if not len(possible) or not len(left):
        return none, none, None
    size, total, pairs = q.shape[1] * c.shape[1], np.zeros((len(possible), len(left))), None

    def may(t, i, j, s):
        rest = qr[s][i] * cr[s][j] + SLACK * qr[0][i] * cr[0][j]
        ok = t + rest >= low[i]
        return ok if high is None else ok & (t - rest <= high[i])

    for s, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(q)], strict=True), 1):
        if pairs is None:
            total += q[a:b, possible].T @ c[a:b, left]
        else:
            i, j, t = pairs
            t = t + np.concatenate([(q[a:b, i[k : k + AT_ONCE]] * c[a:b, j[k : k + AT_ONCE]]).sum(axis=0) for k in range(0, max(len(i), 1), AT_ONCE)])
            pairs = i, j, t
        if s > len(cuts):
            break
        if pairs is None:
            keep = may(total, possible[:, None], left[None], s)
            if keep.mean() * total.size <= FEW * size:
                i, j = np.nonzero(keep)
                pairs = possible[i], left[j], total[i, j]
            else:
                rows, columns = keep.any(axis=1), keep.any(axis=0)
                possible, left, total = possible[rows], left[columns], total[rows][:, columns]
        else:
            i, j, t = pairs
            ok = may(t, i, j, s)
            pairs = i[ok], j[ok], t[ok]
        if kept is not None:
            kept.append((total.size if pairs is None else len(pairs[0])) / size)
        if pairs is not None and not len(pairs[0]):
            return none, none, None
    if pairs is None:
        slack = SLACK * qr[0][possible][:, None] * cr[0][left][None]
        ok = total + slack >= low[possible][:, None]
        if high is not None:
            ok &= total - slack <= high[possible][:, None]
        i, j = np.nonzero(ok)
        return possible[i], left[j], total[i, j]
    i, j, t = pairs
    slack = SLACK * qr[0][i] * cr[0][j]
    ok = t + slack >= low[i]
    ok = ok if high is None else ok & (t - slack <= high[i])
    return i[ok], j[ok], t[ok]
