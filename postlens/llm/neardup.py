"""Near-duplicate vectors of equal label by tiled comparison along principal axes.

Equal vectors of a label form one class. Classes are ordered by label, then by cells of
their leading principal components, and cut into blocks of at most TILE. Two blocks meet
in a tile only if they share a label and the boxes around its leading components lie no
farther apart than the threshold allows. In a tile, products of unit vectors are added
up for the leading dimensions first; the norms of the suffixes bound the rest, and work
stops when no pair can reach the threshold. A tile sends on, for each class, the number
of vectors it links to, and a spanning forest of its links: never all pairs. So a label
that holds all rows, or a vector that a third of them repeat, is many tiles of bounded
size and no task holds a label. Components come by minima and pointer jumps.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and
rows without a label, link with nothing; shorter vectors count as padded with zeros;
rows that repeat an id and vector are vectors of their own, linked with each other; a
null id is left out when the smallest id of a component is taken, and its row is not
kept; classes are told apart by a 64-bit hash of label and vector; empty tables give no
rows; extra columns are ignored. Cosines within 1e-9 of the threshold are computed
again from the vectors as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .jaccard import components
from .vectors import AT_ONCE, as_matrix, cuts_at, loaded, moments, principal_axes, same_dims, stored, survivors, whole

#: Classes in a block; leading components that order classes, and that make boxes.
TILE, ORDER, BOX = 1024, 4, 8
#: Shares of the energy after which bounds are looked at.
SHARES = (0.1, 0.2, 0.3, 0.45, 0.65)
#: Products this near to the threshold are computed again.
NEAR = 1e-9


def units(m: np.ndarray) -> np.ndarray:
    """Columns scaled to length one, without overflow; zero columns stay."""
    m = m / np.where((top := np.abs(m).max(axis=0, initial=0)) > 0, top, 1)
    return m / np.where((norm := np.sqrt((m**2).sum(axis=0))) > 0, norm, 1)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of columns beside each other."""
    a, b = (m / np.ldexp(1.0, np.frexp(np.abs(m).max(axis=0, initial=1e-300))[1]) for m in (x, y))  # by powers of two: exact
    return (a * b).sum(axis=0) / (np.sqrt((a * a).sum(axis=0)) * np.sqrt((b * b).sum(axis=0)))


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n places, the smallest place of its component."""
    low = np.arange(n)
    while len(i):
        before = low.copy()
        np.minimum.at(low, i, low[j])
        np.minimum.at(low, j, low[i])
        while (low != low[low]).any():
            low = low[low]
        if (low == before).all():
            break
    return low


def linked(x: np.ndarray, y: np.ndarray, axes: np.ndarray, cuts: list[int], least: float, kept: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): the columns of x and y with a cosine of at least `least`."""
    i, j, t = survivors(axes[:, : len(x)] @ units(x), axes[:, : len(y)] @ units(y), cuts, np.full(x.shape[1], least - 2 * NEAR), None, kept)
    if t is None:
        return i, j
    ok = t >= least
    close = np.flatnonzero(np.abs(t - least) <= NEAR)
    x, y = same_dims(x, y)
    for k in range(0, len(close), AT_ONCE):
        at = close[k : k + AT_ONCE]
        ok[at] = cosines(x[:, i[at]], y[:, j[at]]) >= least
    return i[ok], j[ok]


def blocks_of(classes: DataFrame, axes: np.ndarray, least: float, tile: int) -> DataFrame:
    """(bid, labels, cids, weights, dims, kind, data, parts): classes in order, at most `tile` a block; parts: for each label a box of leading components."""
    order, box = min(ORDER, len(axes)), min(BOX, len(axes))
    cell = math.sqrt(max(2 - 2 * least, 1e-6))

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lead = axes[:order] @ units(as_matrix(b.embedding, axes.shape[1]))
            yield b.assign(**{f"c{k}": np.floor(lead[k] / cell).astype(np.int32) for k in range(order)})

    cells = [f"c{k}" for k in range(order)]
    kinds = "label long, cid long, weight long, embedding array<double>"
    placed = classes.select("label", "cid", "weight", "embedding").mapInPandas(places, ", ".join([kinds, *[f"{c} int" for c in cells]]))
    n = -(-classes.count() // (2 * tile)) or 1
    placed = placed.repartitionByRange(n, "label", *cells, "cid").sortWithinPartitions("label", *cells, "cid").drop(*cells)

    def block(g: pd.DataFrame) -> dict:
        m, labels = as_matrix(g.embedding, axes.shape[1]), g.label.to_numpy(np.int64)
        lead = axes[:box] @ units(m)
        begin = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1]])
        lo, hi = np.minimum.reduceat(lead, begin, axis=1), np.maximum.reduceat(lead, begin, axis=1)
        parts = [{"label": int(labels[at]), "lo": lo[:, k].tolist(), "hi": hi[:, k].tolist()} for k, at in enumerate(begin)]
        kind, data = stored(m)
        whole_numbers = {"labels": labels.tobytes(), "cids": g.cid.to_numpy(np.int64).tobytes(), "weights": g.weight.to_numpy(np.int64).tobytes()}
        return {"bid": int(g.cid.iloc[0]), **whole_numbers, "dims": len(m), "kind": kind, "data": data, "parts": parts}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for b in batches:
            left = b if left is None else pd.concat([left, b], ignore_index=True)
            while len(left) >= tile:
                yield pd.DataFrame([block(left.iloc[:tile])])
                left = left.iloc[tile:]
        if left is not None and len(left):
            yield pd.DataFrame([block(left)])

    return placed.mapInPandas(run, "bid long, labels binary, cids binary, weights binary, dims int, kind string, data binary, parts array<struct<label:long,lo:array<double>,hi:array<double>>>")


def near_blocks(blocks: DataFrame, box: int, least: float) -> DataFrame:
    """(x, y) of the blocks, a block and itself among them, that may hold a pair: they share a label whose boxes are near enough."""
    part = blocks.select("bid", F.explode("parts").alias("p")).select("bid", "p.label", *[F.col(f"p.{e}")[k].alias(f"{e}{k}") for k in range(box) for e in ("lo", "hi")])
    x, y = (part.select("label", *[F.col(c).alias(f"{s}_{c}") for c in part.columns if c != "label"]) for s in "xy")
    apart = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"x_lo{k}") - F.col(f"y_hi{k}"), F.col(f"y_lo{k}") - F.col(f"x_hi{k}")), 2) for k in range(box)), F.lit(0.0))
    return x.join(y, "label").where((F.col("x_bid") <= F.col("y_bid")) & (apart <= 2 - 2 * least + 1e-6)).select(F.col("x_bid").alias("x"), F.col("y_bid").alias("y")).distinct()


def near_duplicates(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", tile: int = TILE) -> DataFrame:
    """One row per vector: id, n_links (other vectors linked directly), component_id, kept. Links are made when this is called."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    v = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[label_col].alias("own"), vectors[vector_col].cast("array<double>").alias("embedding"))
    plus = F.transform("embedding", lambda x: x + F.lit(0.0))  # no negative zeros
    label = F.col("own").cast("long") if dict(v.dtypes)["own"] in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(F.col("own").cast("string"))
    able = F.col("own").isNotNull() & whole("embedding") & F.exists("embedding", lambda x: x != 0)
    v = v.select("id", label.alias("label"), F.when(F.coalesce(able, F.lit(False)), plus).alias("embedding")).withColumn("cid", F.when(F.col("embedding").isNotNull(), F.xxhash64("label", "embedding")))
    classes = scratch.written(v.where("cid is not null").groupBy("cid").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("weight"), F.min("id").alias("low")))
    dims = classes.agg(F.max(F.size("embedding"))).first()[0] or 0
    axes, energy = principal_axes(moments(classes, dims, units))
    cuts = cuts_at(energy, SHARES)
    blocks = scratch.written(blocks_of(classes, axes, least, tile))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                (la, ca, wa, ma), (lb, cb, wb, mb) = ((*(np.frombuffer(getattr(r, s + c), np.int64) for c in ("labels", "cids", "weights")), loaded(getattr(r, s + "data"), getattr(r, s + "kind"), getattr(r, s + "dims"))) for s in "xy")
                own = r.x == r.y
                ii, jj = [], []
                for label in np.intersect1d(la, lb):
                    p, q = (slice(np.searchsorted(z, label), np.searchsorted(z, label, "right")) for z in (la, lb))
                    i, j = linked(ma[:, p], mb[:, q], axes, cuts, least)
                    ii.append(i + p.start)
                    jj.append(j + q.start)
                i, j = np.concatenate(ii), np.concatenate(jj)
                if own:
                    i, j = i[i != j], j[i != j]
                links = np.bincount(i, wb[j], len(ca))  # below 2^53
                at = np.flatnonzero(links)
                n, cid = links[at], ca[at]
                if not own:
                    more = np.bincount(j, wa[i], len(cb))
                    n, cid = np.r_[n, more[more > 0]], np.r_[cid, cb[more > 0]]
                every, j = (ca, j) if own else (np.r_[ca, cb], j + len(ca))
                low = forest(len(every), i, j)
                tied = np.flatnonzero(low != np.arange(len(every)))
                yield pd.DataFrame({"a": np.r_[cid, every[tied]], "b": np.r_[np.zeros(len(cid), np.int64), every[low[tied]]], "n": np.r_[n.astype(np.int64), np.zeros(len(tied), np.int64)]})

    sides = {s: blocks.select(F.col("bid").alias(s), *[F.col(c).alias(s + c) for c in ("labels", "cids", "weights", "dims", "kind", "data")]) for s in "xy"}
    tiles = near_blocks(blocks, min(BOX, dims), least).join(sides["x"].hint("merge"), "x").join(sides["y"].hint("merge"), "y")
    # n > 0: links of class a within a tile; n = 0: a and b are connected
    found = scratch.written(tiles.mapInPandas(compare, "a long, b long, n long"))
    links = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "cid")
    of_class = classes.select("cid", "weight", "low").join(links, "cid", "left").join(components(found.where("n = 0").select("a", "b")), "cid", "left")
    of_class = of_class.select("cid", "low", F.coalesce("comp", "cid").alias("comp"), (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    of_class = scratch.written(of_class.join(of_class.groupBy("comp").agg(F.min("low").alias("component_id")), "comp").select("cid", "n_links", "component_id"))
    scratch.remove(blocks, classes, found)
    out = v.select("id", "cid").join(of_class, "cid", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
