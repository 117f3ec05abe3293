"""A store of counts that a repeated batch does not change, and counts of posts that count once.

Each finished epoch of a stream leaves its own counts in a folder named after it; the
store is their sum. A batch that runs again writes the same folder again, so nothing
counts twice. Every `fold` epochs the older folders are added up into one base that
names the last epoch it holds: epochs up to there are finished, and a batch of theirs
that comes again is left out. A base is taken only when its writer has finished, and
the folders it replaces go after that, so a crash at any point loses and repeats
nothing. Epoch numbers belong to a checkpoint: a stream that starts anew gets a store,
or a `stream` name, of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("date", "label")


def folders(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """The finished folders of a store by kind, `base` and `epoch`: a few names, whatever they hold."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    root = at(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    out: dict[str, list[int]] = {"base": [], "epoch": []}
    for f in fs.listStatus(root) if fs.exists(root) else ():
        kind, _, n = f.getPath().getName().partition("-")
        if kind in out and n.isdigit() and fs.exists(at(f"{path}/{kind}-{n}/_SUCCESS")):
            out[kind].append(int(n))
    return {k: sorted(v) for k, v in out.items()}


def place(path: str, kind: str, n: int) -> str:
    return f"{path}/{kind}-{n:012d}"


def drop(spark: SparkSession, folder: str) -> None:
    gone = spark._jvm.org.apache.hadoop.fs.Path(folder)
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def parts(spark: SparkSession, path: str, upto: int | None = None) -> tuple[list[str], int]:
    """The folders whose sum the store is, up to an epoch, and the last epoch of its base (-1 without one)."""
    found = folders(spark, path)
    bases = [n for n in found["base"] if upto is None or n <= upto]
    last = bases[-1] if bases else -1
    epochs = [n for n in found["epoch"] if n > last and (upto is None or n <= upto)]
    return [place(path, "base", n) for n in bases[-1:]] + [place(path, "epoch", n) for n in epochs], last


def read_counts(spark: SparkSession, path: str, keys: Sequence[str] = KEYS, upto: int | None = None) -> DataFrame | None:
    """The stored counts; None if nothing is stored yet."""
    found, _ = parts(spark, path, upto)
    return spark.read.parquet(*found).groupBy(*keys).agg(F.sum("n").alias("n")) if found else None


def counts_to(path: str, keys: Sequence[str] = KEYS, fold: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch step that stores counts of the batch's rows by key. Rows that hold an `n` are added up by it."""

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        _, last = parts(spark, path)
        if epoch <= last:
            return
        n = F.sum("n") if "n" in batch.columns else F.count("*")
        batch.groupBy(*keys).agg(n.cast("long").alias("n")).coalesce(1).write.mode("overwrite").parquet(place(path, "epoch", epoch))
        if epoch - last > fold:
            fold_up(spark, path, epoch - 1, keys)

    return run


def fold_up(spark: SparkSession, path: str, upto: int, keys: Sequence[str] = KEYS) -> None:
    """Add up all epochs up to one of them into a base, then remove what it replaces; the base before stays for readers that have begun."""
    found = folders(spark, path)
    counts = read_counts(spark, path, keys, upto)
    if counts is None or upto in found["base"]:
        return
    counts.coalesce(1).write.mode("overwrite").parquet(place(path, "base", upto))
    for n in found["epoch"]:
        if n <= upto:
            drop(spark, place(path, "epoch", n))
    for n in found["base"][:-1]:
        drop(spark, place(path, "base", n))


def seen_labels(labelled: DataFrame, zone: str = "UTC", late: str = "1 day") -> DataFrame:
    """(date, label) of each post once, however often it is labelled or shown, by its first final label. State goes with the watermark."""
    final = labelled.where("phase = 'final'") if "phase" in labelled.columns else labelled
    once = final.where("post_id is not null").withWatermark("ts", late).dropDuplicatesWithinWatermark(["post_id"])
    return once.select(F.to_date(F.from_utc_timestamp("ts", zone)).alias("date"), "label")


def clear_counts(spark: SparkSession, path: str, keys: Sequence[str] = KEYS) -> None:
    """Forget the counts, but not which epochs are finished."""
    found = folders(spark, path)
    every = found["base"] + found["epoch"]
    if not every:
        return
    fold_up(spark, path, max(every), keys)
    empty = spark.read.parquet(place(path, "base", max(every))).limit(0)
    kinds = ", ".join(f"{c} {t}" for c, t in empty.dtypes)
    spark.createDataFrame([], kinds).coalesce(1).write.mode("overwrite").parquet(place(path, "base", max(every)))
