"""The registered queries of this subpackage: thin wrappers that apply each operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_digest
from .codes import digest, vector_codes
from .common import crc_mod, table
from .decontaminate import contaminated
from .htmltext import main_text
from .jaccard import jaccard_components
from .langid import language_id
from .lattice import lm_score
from .licenses import default_templates, scan_licenses
from .neardup import near_duplicates
from .negatives import hard_negatives
from .oracle import SQL
from .repeats import repeats
from .topk import exact_top_k
from .urlfilter import RULES, url_filter


def vocab_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = lambda c: F.coalesce(crc_mod(c, 4) == 2, F.lit(False))
    out = language_id(table(spark, sf_dir, "documents"), learn=~held_out("doc_id"))
    return out.withColumn("held_out", held_out("doc_id"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = lambda: F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False))
    return lm_score(table(spark, sf_dir, "documents"), ~held_out(), vocab_path("piece_bpe_32k.model")).withColumn("held_out", held_out())


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` has no paths: a document lies in source/(doc_id div 100), every twentieth as that directory's LICENSE."""
    docs = table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 20 == 0, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    docs = docs.withColumn("path", F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.floor(F.col("doc_id") / 100).cast("string"), name))
    return scan_licenses(docs, default_templates(spark))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(table(spark, sf_dir, "documents"), vocab_path("byte_bpe_50k.json"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), RULES)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    v = v.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(v, F.col("vec_id") % 100 == 0)


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = vector_codes(table(spark, sf_dir, "embeddings"))
    return out.withColumn("codebooks_sha256", F.lit(digest(books)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
