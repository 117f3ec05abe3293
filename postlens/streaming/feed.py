"""The same operators over streams: seen-once posts, labels, daily counts, keyed upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.decision import decide
from ..operators.features import POST_SCHEMA, extract_features
from ..operators.stores import latest_per_key


def post_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """JSON files of posts with an event time `ts`."""
    return spark.readStream.schema(POST_SCHEMA + ", ts timestamp").option("maxFilesPerTrigger", max_files).json(path)


def seen_once(posts: DataFrame, late: str = "1 day") -> DataFrame:
    """Each post once; the state of older posts goes with the watermark."""
    return posts.withWatermark("ts", late).dropDuplicatesWithinWatermark(["post_id"])


def label_stream(posts: DataFrame) -> DataFrame:
    return decide(extract_features(posts))


def daily_counts(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy(F.window("ts", "1 day").alias("day"), "label").agg(F.count("*").alias("n")).select(F.to_date("day.start").alias("date"), "label", "n")


def versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """Bucket -> the finished versions that hold it, oldest first; from folder names, a few for each bucket."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    out: dict[int, list[int]] = {}
    for v in sorted(f.getPath().getName() for f in (fs.listStatus(root) if fs.exists(root) else ())):
        own = [f.getPath().getName() for f in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{v}"))]
        for name in own if "_SUCCESS" in own else ():
            if name.startswith("bucket="):
                out.setdefault(int(name[7:]), []).append(int(v[1:]))
    return out


def read_upserted(spark: SparkSession, path: str, below: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """The rows of the newest version of each bucket (older than `below`); None if there is none."""
    found = {k: [n for n in v if below is None or n < below] for k, v in versions(spark, path).items() if buckets is None or k in buckets}
    paths = [f"{path}/v{v[-1]:09d}/bucket={k}" for k, v in sorted(found.items()) if v]
    return spark.read.parquet(*paths) if paths else None


def upsert_to(path: str, key: str = "post_id_hash", at: str = "saved_at", buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch step that merges each batch into a table of hash buckets. Only buckets that the batch touches are written, as a new version, so that a repeated batch is harmless; of older ones the last stays."""

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket")
        touched = [r[0] for r in batch.select(bucket).distinct().collect()]  # at most `buckets` numbers
        if not touched:
            return
        stored = read_upserted(spark, path, epoch, touched)
        rows = batch if stored is None else stored.unionByName(batch)
        latest_per_key(rows, key, at).select("*", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v{epoch:09d}")
        for k, own in versions(spark, path).items():
            for old in [n for n in own if n < epoch][:-1] if k in touched else ():
                gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{old:09d}/bucket={k}")
                gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)

    return run


def start(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str = "200 milliseconds") -> DataStreamWriter:
    """A writer whose trigger interval plays the part of a debounce; call start() on it."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=every)
