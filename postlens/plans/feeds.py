"""A small invented feed page around each document, as input for the feed reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def feed_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, html): pages as they are, and one feed page per document with its whole text as a post, and a comment on it."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = F.coalesce("doc_id", F.lit(0))  # a null id is no urn either; it keeps its page
    i = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    escaped = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    html = F.concat(
        F.lit('<main><div data-urn="urn:li:activity:'), i, F.lit('"><p>Sam Poster</p><p>Engineer at Somewhere</p><span>'), (F.pmod(n, F.lit(20)) + 1).cast("string"), F.lit('h</span><div class="update-components-text">We are hiring. '), escaped,
        F.lit('</div><button aria-label="Comment">'), F.pmod(n, F.lit(90)).cast("string"), F.lit('</button><div class="comments-comment-item"><p>99 comments here</p></div></div></main>'),
    )
    return pages.unionByName(d.select((-F.col("doc_id") - 1).alias("page_id"), html.alias("html")))
