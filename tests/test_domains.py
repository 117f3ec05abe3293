from pyspark.sql import functions as F

from postlens.functions import lexicon as L
from postlens.functions import urls as U
from postlens.operators import domains as D


def plan(d):
    return d._jdf.queryExecution().executedPlan().toString()


def test_joins_equal_the_row_expressions(spark):
    hosts = ["boards.greenhouse.io", "greenhouse.io", "xgreenhouse.io", "www.linkedin.com", "linkedin.com", "a.lever.co", "lever.co.uk", "io", "", None, "mail.yahoo.co.in", "yahoo.co.in", "co.in", "evilgmail.com", "x.gmail.com"]
    rows = [(f"{k}-{p}", h, p) for k, h in enumerate(hosts) for p in ("/", "/jobs/1", "/JOBS", "/x")]
    urls = spark.createDataFrame(rows + rows[:5], "key string, host string, path string")
    got = {r.key: r.name for r in D.first_entries(urls, D.entry_table(spark, L.ATS_DOMAINS)).collect()}
    want = {r.key: r.name for r in urls.select("key", U.find_domain(F.col("host"), F.col("path"), L.ATS_DOMAINS).alias("name")).collect() if r.name is not None}
    assert got == want and len(got) > 8
    free = spark.createDataFrame([(d,) for d in L.FREE_EMAIL_DOMAINS], "domain string")
    assert {r.host for r in D.listed(urls, free).collect()} == {r.host for r in urls.where(U.in_domain_list(F.col("host"), L.FREE_EMAIL_DOMAINS)).collect()} == {"mail.yahoo.co.in", "yahoo.co.in", "x.gmail.com"}


def test_first_entry_wins(spark):
    entries = [("b.co", "/jobs", "one"), ("a.b.co", "", "two"), ("co", "", "three"), ("b.co", "", "four")]
    urls = spark.createDataFrame([("k", "a.b.co", "/x"), ("l", "a.b.co", "/jobs"), ("m", "x.b.co", None), ("m", "c.co", "/"), ("n", "b.com", "/")], "key string, host string, path string")
    assert {r.key: r.name for r in D.first_entries(urls, D.entry_table(spark, entries)).collect()} == {"k": "two", "l": "one", "m": "three"}


def test_a_million_domains(spark):
    entries = spark.range(1_000_000).select(F.concat(F.lit("d"), "id", F.lit(".com")).alias("domain"), F.lit("").alias("prefix"), F.concat(F.lit("n"), "id").alias("name"), F.col("id").alias("ord"))
    urls = spark.range(2000).select(F.col("id").alias("key"), F.concat(F.lit("www."), F.when(F.col("id") % 2 == 0, "d").otherwise("e"), F.col("id") * 499, F.lit(".com")).alias("host"), F.lit("/p").alias("path"))
    d = D.first_entries(urls, entries)
    assert {(r.key, r.name) for r in d.collect()} == {(k, f"n{k * 499}") for k in range(0, 2000, 2)}
    assert "BroadcastHashJoin" not in plan(D.by_suffix(urls, "host", "key").join(D.small(entries).hint("merge"), "domain")) and "CartesianProduct" not in plan(d) and "NestedLoop" not in plan(d)
    assert "BroadcastHashJoin" in plan(D.first_entries(urls, entries.limit(1000)))
