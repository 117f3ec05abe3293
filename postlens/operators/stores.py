"""Stores: append log, keyed upsert, daily counts, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicon import LABELS


def latest_per_key(rows: DataFrame, key: str, at: str, tie: str | None = None) -> DataFrame:
    """The last saved row of each key. An aggregate, so that a hot key is reduced before the shuffle."""
    order = F.struct(at, *[tie] if tie else [])
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("row")).select(key, "row.*")


def dataset_upsert(stored: DataFrame | None, new: DataFrame, key: str = "post_id_hash", at: str = "saved_at") -> DataFrame:
    return latest_per_key(new if stored is None else stored.unionByName(new), key, at)


def dataset_records(classified: DataFrame, names: Column | None = None) -> DataFrame:
    """Redacted records for a dataset: hashed id, text without contacts and names, features, predicted label."""
    text = T.redact_contacts(F.col("text")) if names is None else T.anonymize(F.col("text"), names)
    return classified.select(T.sha256_id(F.col("post_id")).alias("post_id_hash"), text.alias("text"), "features", F.col("label").alias("predicted_label"), F.lit("").alias("gold_label"), F.current_timestamp().alias("saved_at"))


def feedback_append(records: DataFrame, path: str) -> None:
    records.write.mode("append").parquet(path)


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All records of a store; none if nothing was stored yet."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)
    return spark.read.schema(schema).parquet(path) if found else spark.createDataFrame([], schema)


def stored_count(spark: SparkSession, path: str, schema: str) -> int:
    """How many records a store holds, from the files' own counts."""
    return stored(spark, path, schema).count()


def clear(path: str, like: DataFrame) -> None:
    like.limit(0).write.mode("overwrite").parquet(path)


def daily_label_counts(seen: DataFrame, at: str = "ts", label: str = "label", zone: str = "UTC") -> DataFrame:
    """Posts per local day and label."""
    return seen.groupBy(F.to_date(F.from_utc_timestamp(F.col(at), zone)).alias("date"), F.col(label).alias("label")).agg(F.count("*").alias("n"))


def wide_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("date").pivot("label", LABELS).agg(F.sum("n")).na.fill(0)


def seen_once(rows: DataFrame, key: str, at: str, tie: str | None = None) -> DataFrame:
    """The first row of each key. An aggregate, so that a hot key is reduced before the shuffle."""
    order = F.struct(at, *[tie] if tie else [])
    return rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("row")).select(key, "row.*")


def today(counts: DataFrame, day: Column | None = None) -> DataFrame:
    """The stored counts of one day (the current one, if none is given)."""
    return counts.where(F.col("date") == (day if day is not None else F.current_date()))


def add_counts(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored (date, label, n) and new ones added up."""
    return stored.unionByName(new).groupBy("date", "label").agg(F.sum("n").alias("n"))


def export_path(folder: str, store: str, day: str) -> str:
    """Where the export of a store goes: a folder dated like 2026-01-31."""
    return f"{folder}/{store}-{day}.jsonl"


def shown(decided: DataFrame, hide_not_hiring: bool = True) -> DataFrame:
    """What a reader sees: with the setting on, no posts that aren't about hiring."""
    return decided.where(F.col("label") != "not_hiring") if hide_not_hiring else decided


def frequency(values: DataFrame, column: str, k: int = 25) -> DataFrame:
    return values.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def write_jsonl(d: DataFrame, path: str) -> None:
    """One JSON object a line."""
    d.write.mode("overwrite").json(path)


def json_lines(d: DataFrame) -> DataFrame:
    return d.select(F.to_json(F.struct("*")).alias("line"))
