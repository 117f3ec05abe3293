"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch handed to Python: texts may be very long, so batches stay small.
ARROW_ROWS = 500
#: Bytes per Arrow batch of rows that hold blocks of vectors.
ARROW_BYTES = 8 << 20
#: Bytes of written tables from which shuffle files of finished jobs are worth dropping early.
RELEASE_BYTES = 128 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the Arrow batches of this session, so that a Python worker never holds thousands of long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, rows)


def light_batches(spark: SparkSession, size: int = ARROW_BYTES) -> None:
    """Bound the bytes of Arrow batches of this session: a JVM holds a batch or more for each task, outside its heap. A size with a unit is the user's and stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).removesuffix("b")
    if now.lstrip("-").isdigit() and not 0 < int(now) <= size:
        spark.conf.set(key, size)


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the one the cluster names in spark.checkpoint.dir. Only a local session, as in tests, may go without."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return sc.getCheckpointDir()


def in_files(df: DataFrame, per_core: int = 1) -> DataFrame:
    """In no more files than so many per core, however many partitions a shuffle has: small tables aren't written in crumbs."""
    return df.coalesce(per_core * df.sparkSession.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, where a small input has fewer partitions than there are cores; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of a narrow table with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return in_files(df).checkpoint()


class Scratch:
    """Parquet tables in the shared folder that cut the lineage of larger results, as they are compressed; remove() ends those that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.bytes = spark, {}, 0

    def at(self, path: str) -> tuple:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def written(self, df: DataFrame, per_core: int = 4) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{uuid.uuid4().hex}"
        in_files(df, per_core).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        fs, place = self.at(path)
        self.bytes += fs.getContentSummary(place).getLength()
        return out

    def remove(self, *tables: DataFrame) -> None:
        for t in tables:
            fs, place = self.at(self.paths.pop(id(t))[1])
            fs.delete(place, True)
        self.release()

    def release(self) -> None:
        """release() where the tables were large enough for their shuffles to matter."""
        if self.bytes >= RELEASE_BYTES:
            release(self.spark)


def written(df: DataFrame) -> DataFrame:
    """A table that stays, for results that are read lazily."""
    return Scratch(df.sparkSession).written(df)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs: it does so once nothing on the driver refers to them, late listeners included."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
