"""Joins of URLs and email domains with lists of domains of any length.

A host is exploded into its suffixes at dots (`a.b.co`, `b.co`, `co`), a handful of rows,
which are hashed against the list: one equi-join, however long the list. Lists up to a
checked size are broadcast, longer ones shuffled. Path prefixes are tested on the joined
rows, and the first entry in list order wins by an aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U

#: Up to so many entries of a list are broadcast.
BROADCAST_ENTRIES = 100_000


def entry_table(spark: SparkSession, entries: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(domain, prefix, name, ord) of a short list in its order."""
    return spark.createDataFrame([(*e, k) for k, e in enumerate(entries)], "domain string, prefix string, name string, ord long")


def small(entries: DataFrame, most: int = BROADCAST_ENTRIES) -> DataFrame:
    """The list, marked for a broadcast if it is short enough."""
    return F.broadcast(entries) if entries.limit(most + 1).count() <= most else entries


def by_suffix(rows: DataFrame, host: str, *keep: str) -> DataFrame:
    """A row for each suffix of the host; null hosts have none."""
    return rows.select(*keep, F.explode(U.suffixes(F.col(host))).alias("domain"))


def first_entries(urls: DataFrame, entries: DataFrame, key: str = "key", host: str = "host", path: str = "path", most: int = BROADCAST_ENTRIES) -> DataFrame:
    """(key, name, ord): for each key the first entry whose domain holds the host of a URL of that key and whose prefix begins its path; keys without one don't come out."""
    e = small(entries.select("domain", F.lower("prefix").alias("prefix"), "name", "ord"), most)
    found = by_suffix(urls.distinct() if set(urls.columns) == {key, host, path} else urls, host, key, path).join(e, "domain").where(F.lower(F.coalesce(path, F.lit(""))).startswith(F.col("prefix")))
    return found.groupBy(key).agg(F.min_by("name", "ord").alias("name"), F.min("ord").alias("ord"))


def listed(hosts: DataFrame, domains: DataFrame, host: str = "host", most: int = BROADCAST_ENTRIES) -> DataFrame:
    """The distinct hosts that are in a list of domains, subdomains included: for a semi-join or an anti-join."""
    every = hosts.select(F.col(host).alias("_host")).distinct()
    return by_suffix(every, "_host", "_host").join(small(domains.select("domain"), most), "domain", "left_semi").select(F.col("_host").alias(host)).distinct()
