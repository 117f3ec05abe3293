"""Hard-negative mining by exact scores, with bounds from an orthogonal rotation to principal axes.

Vectors become integers floor(scale * x). The rotation is fitted on the second moments
of all rows. Anchors go in blocks against blocks of all rows, twice: first an anchor's
nearest rows of its own label (its positives), then, for each positive, the best rows
of other labels whose score lies between `low` percent of the positive's and all of it.
In both, a pair of blocks adds up products of leading rotated components step by step;
the norms of the rest, and a slack for rounding, bound what is still to come, so that
pairs out of reach of the anchor's bars or windows are dropped early. What is left is
verified with integer products. Bars rise with what a task has found; a window of Spark
keeps the first ranks. No block holds more than a fixed number of rows, whatever its labels.

Defined cases: rows with a null id or label, and vectors that are null or hold null or
non-finite components, take no part; shorter vectors count as padded with zeros; scores
that 64 bits cannot hold stay at the ends of their range; rows with the anchor's own id
are neither positives nor negatives of it; rows that repeat an id and score count once;
rows that repeat an anchor's id with other contents are mined on their own; labels that
are not whole numbers are told apart by a 64-bit hash; empty tables, and anchors without
positives or negatives, give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch
from .vectors import HIGH, LOW, best, cuts_at, integers, kth_best, loaded, moments, pack, principal_axes, products, same_dims, survivors, whole

#: Rows in a block of candidates, and of anchors.
CANDIDATES, ANCHORS = 4096, 512
#: Shares of the energy after which bounds are looked at.
SHARES = (0.3, 0.5, 0.7, 0.85, 0.95)
#: Anchor blocks whose bars a task remembers.
BLOCKS_KNOWN = 1024


def label_key(c: Column, kind: str) -> Column:
    return c.cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(c.cast("string"))


def against_all(anchors: DataFrame, candidates: DataFrame, groups: int) -> DataFrame:
    """Every block of anchors beside every block of candidates, dealt by groups of the latter."""
    grp = F.pmod(F.xxhash64("id", "data"), F.lit(groups)).cast("int").alias("grp")
    q = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), *[F.col(c).alias(f"q_{c}") for c in anchors.columns])
    return candidates.select(grp, "*").join(q.hint("merge"), "grp").drop("grp")


class Side:
    """A block: ids, labels, integers, and the same rotated."""

    def __init__(self, r, prefix: str, axes: np.ndarray):
        get = lambda c: getattr(r, prefix + c)
        self.ids, self.labels = (np.frombuffer(get(c), np.int64) for c in ("id", "label"))
        self.ints = loaded(get("data"), get("kind"), get("dims"))
        self.turned = axes[:, : len(self.ints)] @ self.ints


def own_label_best(q: Side, c: Side, cuts: list[int], k: int, bar: np.ndarray, kept: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor place, id, score): what may be among the anchors' k best of their own label. Both blocks are sorted by label."""
    out = [(np.zeros(0, np.int64),) * 3]
    for label in np.intersect1d(q.labels, c.labels):
        a, b = (slice(np.searchsorted(s.labels, label), np.searchsorted(s.labels, label, "right")) for s in (q, c))
        i, j, _ = survivors(q.turned[:, a], c.turned[:, b], cuts, bar[a], None, kept)
        ints = same_dims(q.ints[:, a], c.ints[:, b])
        t = products(*ints, i, j)
        ok = (q.ids[a][i] != c.ids[b][j]) & (t >= bar[a][i])
        i, found, t = i[ok] + a.start, c.ids[b][j[ok]], t[ok]
        at = best(i, found, t, k)
        out.append((i[at], found[at], t[at]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def in_windows(q: Side, c: Side, cuts: list[int], k: int, low: np.ndarray, high: np.ndarray, kept: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor place, positive's place, id, score): of other labels, what may be among the k best of a positive's window; low and high: a row for each anchor, LOW where there is no positive."""
    there = high != LOW
    least, most = np.where(there, low, HIGH).min(axis=1), high.max(axis=1)
    some = np.flatnonzero(there.any(axis=1) & (least <= most))
    none = np.zeros(0, np.int64)
    if not len(some):
        return none, none, none, none
    i, j, _ = survivors(q.turned[:, some], c.turned, cuts, least[some], np.where(most == HIGH, np.inf, most.astype(np.float64))[some], kept)
    ints = same_dims(q.ints[:, some], c.ints)
    t, i = products(*ints, i, j), some[i]
    ok = (q.labels[i] != c.labels[j]) & (q.ids[i] != c.ids[j]) & (t >= least[i]) & (t <= most[i])
    i, j, t = i[ok], j[ok], t[ok]
    out = [(none,) * 4]
    for p in range(high.shape[1]):
        ok = there[i, p] & (t >= low[i, p]) & (t <= high[i, p])
        a, found, s = i[ok], c.ids[j[ok]], t[ok]
        at = best(a, found, s, k)
        out.append((a[at], np.full(len(at), p), found[at], s[at]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, scale: float = 256.0, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", groups: int | None = None
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. The rotation is fitted, and blocks are written, when this is called; the last step reads them."""
    spark = vectors.sparkSession
    label = label_key(vectors[label_col], dict(vectors.dtypes)[label_col])
    v = vectors.select(vectors[id_col].cast("long").alias("id"), label.alias("label"), vectors[vector_col].cast("array<double>").alias("embedding"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    v = v.where(F.col("id").isNotNull() & F.col("label").isNotNull() & whole("embedding"))
    dims = v.agg(F.max(F.size("embedding"))).first()[0] or 0
    axes, energy = principal_axes(moments(v, dims, lambda m: integers(m, scale)))
    cuts, groups = cuts_at(energy, SHARES), groups or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    scratch = Scratch(spark)
    candidates = scratch.written(pack(v.drop("anchor"), CANDIDATES, scale, ["label"]))
    # rows that repeat an anchor and its contents are one anchor; blocks are written before they are shuffled, as a task that runs again may see its rows in another order
    anchors = v.where("anchor").select("id", "label", "embedding", F.xxhash64("id", "label", "embedding").alias("key")).dropDuplicates(["key"])

    def mine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bars: dict[bytes, np.ndarray] = {}
        for b in batches:
            for r in b.itertuples():
                q, c = Side(r, "q_", axes), Side(r, "", axes)
                name = xxhash.xxh128_digest(r.q_key)
                if name not in bars:
                    if len(bars) >= BLOCKS_KNOWN:
                        bars.clear()
                    bars[name] = np.full(r.q_n, LOW)
                i, found, t = own_label_best(q, c, cuts, positives, bars[name])
                bars[name] = np.maximum(bars[name], kth_best(r.q_n, i, t, positives))
                yield pd.DataFrame({"key": np.frombuffer(r.q_key, np.int64)[i], "positive": found, "score": t})

    found = against_all(scratch.written(pack(anchors, ANCHORS, scale, ["label"])), candidates, groups).mapInPandas(mine, "key long, positive long, score long").distinct()
    first = W.partitionBy("key").orderBy(F.desc("score"), "positive")
    chosen = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= positives)
    chosen = chosen.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rank", "positive", "score"))).alias("p"))  # at most `positives` entries
    chosen = scratch.written(chosen.select("key", "p.positive", "p.score"))
    known = anchors.join(chosen, "key")

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bars: dict[bytes, np.ndarray] = {}
        for b in batches:
            for r in b.itertuples():
                q, c = Side(r, "q_", axes), Side(r, "", axes)
                chosen, high = (np.frombuffer(x, np.int64).reshape(r.q_n, -1) for x in (r.q_positive, r.q_score))
                name = xxhash.xxh128_digest(r.q_key)
                if name not in bars:
                    if len(bars) >= BLOCKS_KNOWN:
                        bars.clear()
                    least = -(-(high.astype(object) * low) // 100)  # low percent, rounded up
                    bars[name] = np.where(high == LOW, LOW, least).astype(np.int64)
                i, p, neg, t = in_windows(q, c, cuts, negatives, bars[name], high)
                width = high.shape[1]
                bar = kth_best(r.q_n * width, i * width + p, t, negatives).reshape(-1, width)
                bars[name] = np.maximum(bars[name], bar)
                yield pd.DataFrame({"key": np.frombuffer(r.q_key, np.int64)[i], "anchor_id": q.ids[i], "positive_id": chosen[i, p], "positive_score": high[i, p], "negative_id": neg, "negative_score": t})

    blocks = scratch.written(pack(known, ANCHORS, scale, ["label"]))
    kinds = "key long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = against_all(blocks, candidates, groups).mapInPandas(windows, kinds).distinct()
    order = W.partitionBy("key", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
