"""Exact top-k inner-product search by columnar branch and bound.

Vectors become integers floor(scale * x), stored in column-major blocks of bounded
size (one array per dimension group), dimensions of most energy first. Every block of queries meets every block of
candidates as one row of a join on the groups of both. Both sides are shuffled, as blocks of queries go to every
candidate group: sent to all by the driver, they would be there as often as there are groups. A query's bar, the k-th best
score among a sample of PILOT candidates of all blocks, rises with what the task has
found so far. Blocks whose largest norm cannot reach any bar are left out; in the
others scores accumulate one dimension group at a time, and after each group the pairs
whose score plus remaining mass (product of remaining norms) stays below the query's
bar are dropped: first candidates are compacted away as columns, and once few pairs
are left, these alone go on as a list. A window keeps each query's k best.

Defined cases: vectors that are null, or hold null or non-finite components, take no
part; integers beyond 2^62 are held there, and scores that 64 bits cannot hold at the
ends of their range; shorter vectors count as padded with zeros; ties go to the smaller
id; with fewer than k candidates all are returned; a row is never its own candidate,
and rows that repeat an id are candidates of one another's queries only under another
id; an id with one score counts once among the k, however many rows hold it; rows with
a null id take no part; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, light_batches
from .vectors import as_matrix, best, integers, kth_best, largest_sum, loaded, pack, same_dims, scores, whole

#: Rows per block of candidates and of queries; dimensions per step.
CANDIDATES, QUERIES, DIMS = 1024, 256, 8
#: Candidate groups per core, blocks in a query group.
GROUPS, QUERY_BLOCKS = 4, 256
#: Candidates from which the first bars come.
PILOT = 2048
#: Share of pairs below which they go on as a list.
FEW = 0.15
#: Query blocks whose bars a task remembers.
BLOCKS_KNOWN = 4096


def first_bars(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """For each query the k-th best score among some candidates."""
    total = scores(*same_dims(q, c))
    i, j = np.nonzero(q_ids[:, None] != c_ids[None])
    at = best(i, c_ids[j], total[i, j], k)
    return kth_best(len(q_ids), i[at], total[i, j][at], k)


def rest_norms(m: np.ndarray) -> np.ndarray:
    """Row s: norms of the columns from dimension s * DIMS on."""
    squares = np.add.reduceat(m.astype(np.float64) ** 2, np.arange(0, max(len(m), 1), DIMS), axis=0) if len(m) else np.zeros((1, m.shape[1]))
    return np.sqrt(np.cumsum(squares[::-1], axis=0)[::-1])


def best_of_blocks(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, bar: np.ndarray, kept: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, candidate id, score): what may be among each query's k best, from one pair of blocks. kept: gets the share of pairs left after each step."""
    q, c = same_dims(q, c)
    none = np.zeros(0, np.int64)
    if largest_sum(q, c) >= 1 << 62:  # sums of a step might not fit: all pairs at once, in wide integers
        total = scores(q, c)
        i, j = np.nonzero((q_ids[:, None] != c_ids[None]) & (total >= bar[:, None]))
        at = best(i, c_ids[j], total[i, j], k)
        return i[at], c_ids[j[at]], total[i, j][at]
    qr, cr = rest_norms(q), rest_norms(c)
    # remaining mass, rounded up so that nothing that could tie is lost
    reach = lambda total, a, b, least: total + a * b * (1 + 1e-9) + 1 >= least
    if not len(q_ids) or not reach(0, qr[0], cr[0].max(initial=0), bar).any():
        return none, none, none
    size = len(q_ids) * len(c_ids)
    left, total, pairs = np.arange(len(c_ids)), np.zeros((len(q_ids), len(c_ids)), np.int64), None
    for s, at in enumerate(range(0, len(q), DIMS)):
        x, y = q[at : at + DIMS], c[at : at + DIMS]
        if pairs is None:
            total += scores(x, y[:, left])
        else:
            i, j, t = pairs
            pairs = i, j, t + (x[:, i] * y[:, j]).sum(axis=0)
        if s + 1 == len(qr):
            break
        if pairs is None:
            keep = reach(total, qr[s + 1][:, None], cr[s + 1, left][None], bar[:, None])
            if keep.mean() * len(left) <= FEW * len(c_ids):
                i, j = np.nonzero(keep)
                pairs = i, left[j], total[i, j]
            else:
                any_of = keep.any(axis=0)
                left, total = left[any_of], total[:, any_of]
        else:
            i, j, t = pairs
            keep = reach(t, qr[s + 1][i], cr[s + 1][j], bar[i])
            pairs = i[keep], j[keep], t[keep]
        if kept is not None:
            kept.append((len(q_ids) * len(left) if pairs is None else len(pairs[0])) / size)
    if pairs is None:
        i, j = np.nonzero(total >= bar[:, None])
        pairs = i, left[j], total[i, j]
    i, j, t = pairs
    ok = (q_ids[i] != c_ids[j]) & (t >= bar[i])
    i, found, t = i[ok], c_ids[j[ok]], t[ok]
    at = best(i, found, t, k)
    return i[at], found[at], t[at]


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", groups: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of each query row. The sample for the bars is drawn when this is called."""
    spark = vectors.sparkSession
    light_batches(spark)
    v = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("embedding"), is_query.alias("query"))
    v = v.where(F.col("id").isNotNull() & whole("embedding"))
    groups = groups or max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), GROUPS * spark.sparkContext.defaultParallelism), 1)
    # at most PILOT vectors, drawn by a task: the driver would get as many from each partition
    drawn = v.orderBy(F.xxhash64("id"), "id").limit(PILOT).select("id", "embedding").repartition(1).toPandas()
    sample = integers(as_matrix(drawn.embedding), scale)
    order = np.argsort(-(sample.astype(np.float64) ** 2).sum(axis=1), kind="stable")  # any order gives right results
    pilot = spark.sparkContext.broadcast((drawn.id.to_numpy(np.int64), sample))
    # blocks are written before they are shuffled, as a task that runs again may see its rows in another order
    scratch = Scratch(spark)
    q = scratch.written(pack(v.where("query").drop("query"), QUERIES, scale))
    shares = max(1, -(-q.count() // QUERY_BLOCKS))
    among = lambda n: F.pmod(F.xxhash64("id", "data"), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    candidates = scratch.written(pack(v.drop("query"), CANDIDATES, scale))
    candidates = candidates.select(among(groups).alias("grp"), each(shares).alias("share"), "id", "dims", "kind", "data")
    q = q.select(each(groups).alias("grp"), among(shares).alias("share"), *[F.col(c).alias(f"q_{c}") for c in ("id", "dims", "kind", "data")])
    pairs = candidates.hint("merge").join(q, ["grp", "share"]).select("q_id", "q_dims", "q_kind", "q_data", "id", "dims", "kind", "data")

    def ordered(m: np.ndarray) -> np.ndarray:
        m = np.pad(m, ((0, max(0, len(order) - len(m))), (0, 0)))
        return np.concatenate([m[order], m[len(order) :]])  # the sample may hold shorter vectors alone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bars: dict[tuple[bytes, bytes], np.ndarray] = {}  # by query block
        for b in batches:
            for at in range(b.num_rows):
                r = b.slice(at, 1).to_pylist()[0]
                q_ids, c_ids = np.frombuffer(r["q_id"], np.int64), np.frombuffer(r["id"], np.int64)
                q, c = (loaded(r[f"{x}data"], r[f"{x}kind"], r[f"{x}dims"]) for x in ("q_", ""))
                key = (r["q_id"], xxhash.xxh128_digest(r["q_data"]))
                if key not in bars:
                    if len(bars) >= BLOCKS_KNOWN:
                        bars.clear()
                    bars[key] = first_bars(q_ids, q, *pilot.value, k)
                i, found, t = best_of_blocks(q_ids, ordered(q), c_ids, ordered(c), k, bars[key])
                bars[key] = np.maximum(bars[key], kth_best(len(q_ids), i, t, k))
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (q_ids[i], found, t)], ["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(run, "query_id long, vec_id long, score long").distinct()
    # a limit on the rank, so that each task passes on at most k rows of a query
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
