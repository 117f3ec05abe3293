"""Settings with a history: merged with the defaults, joined to posts as of their time, decided with.

A version says which settings somebody (`scope`) changed and from when on they hold.
Posts meet the version of their time by an equi-join on scope and day, so a scope with
a third of all posts is split like any skewed join, and no window runs over posts. A
change of settings only decides again: features are stored, and are not made again.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicon as L
from .decision import Thresholds, decide


@dataclass(frozen=True)
class Settings:
    enabled: bool = True
    hide_not_hiring: bool = True
    debug: bool = False
    dataset_mode: bool = False
    hiring: float = L.HIRING_MIN_SCORE
    bait: float = L.BAIT_THRESHOLD
    scam: float = L.SCAM_THRESHOLD


NAMES = [f.name for f in fields(Settings)]
KINDS = {f.name: "boolean" if f.type == "bool" else "double" for f in fields(Settings)}
STORED = "scope string, valid_from timestamp, " + ", ".join(f"{k} {v}" for k, v in KINDS.items())


def load_settings(spark: SparkSession, path: str) -> DataFrame:
    """Stored versions, a JSON object a line; what a line doesn't name is null, what is not a setting is left out."""
    return spark.read.schema(STORED).json(path)


def merged(versions: DataFrame) -> DataFrame:
    """Each version with what earlier ones of its scope set and it doesn't name, and the defaults for what nobody has set.

    Versions of the same scope and time are one: of a setting named twice the larger value holds.
    """
    one = versions.where("valid_from is not null").groupBy(F.coalesce("scope", F.lit("")).alias("scope"), "valid_from").agg(*[F.max(k).alias(k) for k in NAMES])
    history = W.partitionBy("scope").orderBy("valid_from")
    default = Settings()
    return one.select("scope", "valid_from", *[F.coalesce(F.last(k, ignorenulls=True).over(history), F.lit(getattr(default, k))).alias(k) for k in NAMES])


def periods(versions: DataFrame) -> DataFrame:
    """Merged versions with the time they end, null for the last."""
    return merged(versions).withColumn("valid_to", F.lead("valid_from").over(W.partitionBy("scope").orderBy("valid_from")))


def with_settings(posts: DataFrame, versions: DataFrame, ts: str = "ts", scope: str | None = None) -> DataFrame:
    """The posts with a `settings` struct: the version of their scope that holds at their time, else the defaults.

    Every post comes out once. A post without a time, or before the first version, gets the
    defaults; without `scope`, all versions and posts are of one scope.
    """
    default = Settings()
    p = posts.withColumn("_scope", F.coalesce(F.col(scope), F.lit("")) if scope else F.lit("")).withColumn("_day", F.to_date(ts))
    v = periods(versions if scope else versions.withColumn("scope", F.lit("")))
    last = p.groupBy("_scope").agg(F.max("_day").alias("last")) if scope else p.agg(F.max("_day").alias("last")).withColumn("_scope", F.lit(""))
    # a row for each day a version covers, up to the scope's last post
    v = v.join(last, v["scope"] == last["_scope"]).where(F.to_date("valid_from") <= F.col("last"))
    until = F.least(F.coalesce(F.to_date("valid_to"), F.col("last")), F.col("last"))
    days = v.select("scope", F.explode(F.sequence(F.to_date("valid_from"), until)).alias("day"), "valid_from", "valid_to", F.struct(*NAMES).alias("_set"))
    holds = (F.col("_scope") == F.col("scope")) & (F.col("_day") == F.col("day")) & (F.col(ts) >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col(ts) < F.col("valid_to")))
    # of one scope there is a row for each day of its history: few enough to be sent to the posts, in place of a shuffle of these by day
    days = days if scope else F.broadcast(days)
    fallback = F.struct(*[F.lit(getattr(default, k)).alias(k) for k in NAMES])
    return p.join(days, holds, "left").select(*posts.columns, F.coalesce("_set", fallback).alias("settings"))


def thresholds(settings: Column) -> Thresholds:
    return Thresholds(settings["hiring"], settings["bait"], settings["scam"])


def decide_as_of(features: DataFrame, versions: DataFrame, ts: str = "ts", scope: str | None = None) -> DataFrame:
    """Label and reasons by the settings of each row's time, and whether a reader sees the post."""
    return shown_to(decide(with_settings(features, versions, ts, scope), thresholds(F.col("settings"))))


def shown_to(labelled: DataFrame) -> DataFrame:
    return labelled.withColumn("visible", F.col("settings.enabled") & ~(F.col("settings.hide_not_hiring") & (F.col("label") == "not_hiring")))
