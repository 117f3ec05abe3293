"""Vector codes of product quantisation by delta-maintained Lloyd rounds.

Vectors become integers floor(scale * x), cut into equal consecutive parts with a codebook
each. They are packed into blocks once and written bucketed by block; assignments are
written bucketed alike, so that a round joins both without a shuffle, compares each part
with the new codebook and sends on, for parts whose assignment changed alone, the part
added to the new entry's sum and taken from the old one's: one row of sums for each
touched entry and task. The running sums and counts (entries times dimensions integers)
stay on the driver; a lost executor costs its tasks, as all between rounds is in the
shared folder. Codes and errors come from a last pass over the rows themselves.

Defined cases: vectors that are null, or hold null or non-finite components, are dropped;
shorter vectors, and lengths that the number of parts does not divide, count as padded
with zeros; integers beyond 2^40 are held there, errors beyond 64 bits at the largest;
rows that repeat an id are rows of their own, in the first codebook too; rows with a null
id are coded, but are not in the first codebook; with fewer than `entries` vectors the
codebooks are smaller; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, shared_dir, written
from .vectors import HIGH, as_matrix, integers, loaded, stored, whole

#: Vectors in a block; labels whose sums are broadcast.
BLOCK, BROADCAST_LABELS = 4096, 200_000
LIMIT = 1 << 40


def distances(part: np.ndarray, book: np.ndarray) -> np.ndarray:
    """(vectors, entries): exact squared distances of the rows of both, less the vectors' own squares."""
    bound = 4.0 * float(np.abs(part).max(initial=0)) * float(np.abs(book).max(initial=0)) * part.shape[1] + 4.0 * float(np.abs(book).max(initial=0)) ** 2 * part.shape[1]
    kind = np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 62 else object
    a, b = part.astype(kind), book.astype(kind)
    return (b * b).sum(axis=1)[None] - 2 * (a @ b.T)


def nearest(m: np.ndarray, books: np.ndarray) -> np.ndarray:
    """(vectors, parts): the index of the nearest entry, ties to the lower one. m: vectors as rows; books: parts, entries, width."""
    width = books.shape[2]
    return np.stack([np.argmin(distances(m[:, p * width : (p + 1) * width], b), axis=1) for p, b in enumerate(books)], axis=1).astype(np.uint8)


def squared(m: np.ndarray, codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Squared distances to the entries, over all parts; held at the largest long."""
    apart = m - np.concatenate([b[codes[:, p]] for p, b in enumerate(books)], axis=1)
    if float(np.abs(apart).max(initial=0)) ** 2 * apart.shape[1] < 1 << 62:
        return (apart * apart).sum(axis=1)
    return np.minimum((apart.astype(object) ** 2).sum(axis=1), HIGH).astype(np.int64)


def changes(m: np.ndarray, old: np.ndarray | None, new: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, sums) by part and entry: what to add to the running ones."""
    parts, entries, width = books.shape
    counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
    for p in range(parts):
        moved = np.flatnonzero(old[:, p] != new[:, p]) if old is not None else np.arange(len(m))
        part = m[moved, p * width : (p + 1) * width]
        for codes, sign in ((new, 1), *(() if old is None else ((old, -1),))):
            np.add.at(counts[p], codes[moved, p], sign)
            np.add.at(sums[p], codes[moved, p], sign * part)
    return counts, sums


class Bucketed:
    """Tables in the shared folder, bucketed alike by block: joins of them need no shuffle."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.paths = spark, buckets, {}

    def written(self, df: DataFrame) -> str:
        name = f"codes_{uuid.uuid4().hex}"
        self.paths[name] = f"{shared_dir(self.spark)}/{name}"
        df.write.format("parquet").option("path", self.paths[name]).bucketBy(self.buckets, "block").saveAsTable(name)
        return name

    def remove(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def blocks_of(v: DataFrame, dims: int, scale: float, per_block: int) -> DataFrame:
    """(block, kind, data): integers of up to per_block vectors; a block's number is its task's and its place there. Write it before it is shuffled, as a task that runs again may see its rows in another order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, names = [], itertools.count(TaskContext.get().partitionId() << 32)

        def block(vectors: list) -> pd.DataFrame:
            kind, data = stored(integers(as_matrix(vectors, dims), scale, LIMIT))
            return pd.DataFrame([{"block": next(names), "kind": kind, "data": data}])

        for b in batches:
            left += list(b.embedding)
            while len(left) >= per_block:
                yield block(left[:per_block])
                left = left[per_block:]
        if left:
            yield block(left)

    return v.select("embedding").mapInPandas(run, "block long, kind string, data binary")


def train(v: DataFrame, dims: int, parts: int, entries: int, rounds: int, scale: float, per_block: int = BLOCK, moved: list | None = None) -> np.ndarray:
    """Codebooks (parts, entries, width) after so many rounds. moved: gets the parts reassigned in each round."""
    spark, width = v.sparkSession, dims // parts
    first = v.where("id is not null").orderBy("id", "embedding").limit(entries).select("embedding").collect()  # at most `entries` vectors
    books = np.stack(np.split(integers(as_matrix([np.array(r[0]) for r in first], dims), scale, LIMIT).T, parts, axis=1)) if first else np.zeros((parts, 0, width), np.int64)
    if not len(first):
        return books
    tables = Bucketed(spark, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1))
    scratch = Scratch(spark)
    packed = scratch.written(blocks_of(v, dims, scale, per_block))
    blocks = tables.written(packed.repartition(tables.buckets, "block"))
    scratch.remove(packed)
    counts, sums, last = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, object), None
    for _ in range(rounds):
        books_now = books

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for r in b.itertuples():
                    m = loaded(r.data, r.kind, dims).T
                    old = np.frombuffer(r.codes, np.uint8).reshape(len(m), parts) if r.codes is not None else None
                    new = nearest(m, books_now)
                    n, s = changes(m, old, new, books_now)
                    touched = np.flatnonzero((n.ravel() != 0) | s.reshape(-1, width).any(axis=1))
                    changed = new.size if old is None else int((old != new).sum())
                    plus = {"entry": touched.tobytes(), "n": n.ravel()[touched].tobytes(), "sums": s.reshape(-1, width)[touched].tobytes()}
                    yield pd.DataFrame([{"block": r.block, "codes": new.tobytes(), "changed": changed, **plus}])

        data = spark.table(blocks)
        joined = data.withColumn("codes", F.lit(None).cast("binary")) if last is None else data.join(spark.table(last).select("block", "codes"), "block")
        now = tables.written(joined.select("block", "kind", "data", "codes").mapInPandas(assign, "block long, codes binary, changed long, entry binary, n binary, sums binary"))
        codes = spark.table(now)

        def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n, s, any_of = np.zeros(counts.size, np.int64), np.zeros((counts.size, width), object), np.zeros(counts.size, bool)
            for b in batches:
                for r in b.itertuples():
                    at = np.frombuffer(r.entry, np.int64)
                    any_of[at] = True
                    n[at] += np.frombuffer(r.n, np.int64)
                    s[at] += np.frombuffer(r.sums, np.int64).reshape(-1, width)
            at = np.flatnonzero(any_of)
            yield pd.DataFrame({"entry": np.repeat(at, width + 1), "place": np.tile(np.arange(-1, width), len(at)), "v": pd.Series([str(x) for x in np.c_[n[at].astype(object), s[at]].ravel()], dtype=object)})

        delta = codes.select("entry", "n", "sums").mapInPandas(totals, "entry int, place int, v string")
        delta = delta.groupBy("entry", "place").agg(F.sum(F.col("v").cast("decimal(38,0)")).cast("string").alias("v")).toPandas()  # entries times dimensions numbers
        value = np.array([int(x) for x in delta.v], object)
        entry, place = delta.entry.to_numpy(np.int64), delta.place.to_numpy(np.int64)
        own = place < 0
        counts.ravel()[entry[own]] += value[own].astype(np.int64)
        sums.reshape(-1, width)[entry[~own], place[~own]] += value[~own]
        used = counts > 0
        books = books.copy()
        books[used] = (sums[used] // counts[used].astype(object)[:, None]).astype(np.int64)
        if moved is not None:
            moved.append(codes.agg(F.sum("changed")).first()[0])
        if last is not None:
            tables.remove(last)
        last = now
    tables.remove(*tables.paths)
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(
    vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024.0, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", per_block: int = BLOCK
) -> tuple[DataFrame, np.ndarray]:
    """(id, code, error, label_error for each vector; the codebooks). Training runs when this is called."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    v = vectors.select(vectors[id_col].alias("id"), vectors[label_col].alias("label"), vectors[vector_col].cast("array<double>").alias("embedding")).where(whole("embedding"))
    longest = v.agg(F.max(F.size("embedding"))).first()[0] or 0
    dims = max(-(-longest // parts) * parts, parts)
    books = train(v, dims, parts, entries, rounds, scale, per_block)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                s = b.slice(at, BLOCK)
                m = integers(as_matrix([np.array(x) for x in s.column("embedding").to_pylist()], dims), scale, LIMIT).T
                codes = nearest(m, books)
                texts = [x.tobytes().hex() for x in codes]
                yield pa.RecordBatch.from_arrays([s.column("id"), s.column("label"), pa.array(texts, pa.string()), pa.array(squared(m, codes, books), pa.int64())], ["id", "label", "code", "error"])

    kinds = dict(v.dtypes)
    coded = written(v.mapInArrow(code, f"id {kinds['id']}, label {kinds['label']}, code string, error long"))
    by_label = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("e"))
    by_label = by_label.select(F.col("label").alias("of"), F.least("e", F.lit(HIGH).cast("decimal(38,0)")).cast("long").alias("label_error"))
    few = coded.select("label").distinct().limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    out = coded.join(F.broadcast(by_label) if few else by_label, F.col("label").eqNullSafe(F.col("of")), "left")
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error"), books
