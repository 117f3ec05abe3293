"""Labelled JSONL in, JSONL out."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import LABELS
from ..functions.text import stable_split
from ..operators.features import extract_features

META = "struct<ageHours double, comments bigint, reactions bigint, reposts bigint, headline string, links array<struct<href string, text string>>, emails array<string>>"
LABELED = f"text string, gold_label string, split string, meta {META}"


def scan_labeled(spark: SparkSession, path: str) -> DataFrame:
    """Rows with a label; blank lines and rows without one are dropped, an unknown label is an error."""
    rows = spark.read.schema(LABELED).json(path).where(F.coalesce("gold_label", F.lit("")) != "")
    known = F.col("gold_label").isin(LABELS)
    checked = F.when(known, F.col("gold_label")).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), "gold_label")))
    return rows.withColumn("gold_label", checked.cast("string")).withColumn("split", stable_split(F.col("text"), F.col("split")))


def unlabelled_count(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABELED).json(path).where("text is not null").agg(F.count_if(F.coalesce("gold_label", F.lit("")) == "").alias("n"))


def labeled_posts(rows: DataFrame) -> DataFrame:
    """Posts from the stored facts, with defaults where they are missing."""
    m = F.col("meta")
    return rows.select(
        F.sha1("text").alias("post_id"), "text", F.coalesce(m["headline"], F.lit("")).alias("author_headline"), F.lit(None).cast("string").alias("age_text"), m["ageHours"].alias("age_hours"),
        m["reactions"].alias("reactions"), m["comments"].alias("comments"), m["reposts"].alias("reposts"), F.coalesce(m["links"], F.array().cast("array<struct<href:string,text:string>>")).alias("links"),
        F.coalesce(m["emails"], F.array().cast("array<string>")).alias("emails"), "gold_label", "split",
    )


def default_path(folder: str) -> str:
    """The labelled file of a folder: one's own if there is one, else the synthetic one that comes with it."""
    own = Path(folder) / "labeled.jsonl"
    return str(own if own.exists() else own.with_name("synthetic.jsonl"))


def features_or_meta(stored: DataFrame, rows: DataFrame, compose: bool = False) -> DataFrame:
    """For each row, by text, the stored features, else computed ones; stored features of other texts don't come out."""
    known = stored.groupBy("text").agg(F.first("features").alias("features"))
    made = extract_features(labeled_posts(rows.join(known.select("text"), "text", "left_anti")), compose).select("text", "features", "gold_label", "split")
    return rows.select("text", "gold_label", "split").join(known, "text").select("text", "features", "gold_label", "split").unionByName(made)
