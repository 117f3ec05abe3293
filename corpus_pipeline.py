"""Corpus pipeline: language ID, near-duplicate removal, repeated-passage removal, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all
but the last return the columns of `documents`. Documents are taken to have different
ids; rows that repeat an id and text count as one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm.bpe import bpe_encode
from postlens.llm.common import release, table, written
from postlens.llm.decontaminate import decontaminate
from postlens.llm.jaccard import jaccard_components
from postlens.llm.langid import language_id
from postlens.llm.queries import vocab_path
from postlens.llm.repeats import repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents of LETTERS letters or more whose best language lies nearer to chance are rejected, as are those without a letter.
#: On labelled documents of sf0.1 the least margin of so many letters was 0.099, of fewer 0.025: shorter ones stay.
LETTERS, MIN_MARGIN = 16, 0.06
#: Up to so many ids of removed documents (8 bytes each) are broadcast.
BROADCAST_IDS = 2_000_000


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, null texts among them, and longer ones that are like no language learned from the labels.

    Repeated rows are judged alike; an empty table stays empty; with no label at all no language is known and nothing stays.
    """
    scored = language_id(docs, carry=COLUMNS)
    short = F.length(F.regexp_replace("text", r"\P{L}+", "")) < LETTERS
    return scored.where((F.col("lang_pred") != "und") & (short | (F.col("margin") >= MIN_MARGIN))).select(COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingle similarity keep the one with the smallest id.

    Null ids and texts without words are linked with nothing and stay; of rows that repeat id and text one stays; an empty table stays empty.
    """
    found = jaccard_components(docs)
    others = written(found.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct())
    release(spark)
    small = others.count() <= BROADCAST_IDS  # else both sides are shuffled
    kept = docs.select(COLUMNS).join(F.broadcast(others) if small else others, "doc_id", "left_anti")
    keyed = kept.withColumn("text_key", F.xxhash64("text"))
    if keyed.groupBy("doc_id", "text_key").count().where("count > 1").isEmpty():
        return kept
    return keyed.dropDuplicates(["doc_id", "text_key"]).select(COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that a document with a smaller id also holds; whole characters only.

    Null texts become empty ones; rows with a null id lose nothing; rows stay, however little of them is left; an empty table stays empty.
    """
    kept = repeats(docs, kept_text=True, carry=["lang", "source"])
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that overlap with a benchmark item.

    Null and empty texts overlap with nothing and stay; repeated rows go or stay together; with either table empty all stays.
    """
    return decontaminate(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, kept with the text that they decode to. Null texts are empty and have no ids; repeated rows give equal results."""
    encoded = bpe_encode(docs, vocab_path("byte_bpe_50k.json"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language ID", known_language),
    ("n-gram Jaccard join", one_of_each_group),
    ("suffix-array dedup", without_repeats),
    ("benchmark decontamination", without_benchmarks),
    ("BPE encoding and decoding", tokens),
]

#: The stages are not expressible in SQL; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
