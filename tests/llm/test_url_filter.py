"""The model part of the URL filter against NumPy, and on URLs that it has not learned from."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.llm import urlfilter as U

# written for this test only: none of these hosts is in the labelled table
UNWANTED = """http://online-casino-bonus.com/play https://best-poker-rooms.net/ https://cheap-viagra-pills.org/order/2 http://freeporn.tv/xxx/12 https://hot-escorts.city/
https://crack-serials-warez.ru/keygen https://payday-loan-now.com/apply https://replica-watches.cn/ https://jackpot-slots.io/spins http://nude-camgirls.net/ https://betting-odds.co/bookie""".split()
WANTED = """https://worldnews.com/2020/05/paris https://en.encyclopedia.org/wiki/Rome https://docs.language.org/3/library/re.html https://codehost.com/apache/engine https://www.broadcaster.co.uk/news/uk-12
https://recipes.net/bread http://university.edu/courses/math https://weather.gov/forecast https://city-library.org/hours https://gardening.com/roses/12 http://thestroll.org/about https://inthewood.net/en/3
https://bank.com/login https://railway-museum.org/visit""".split()


def frame(spark, urls):
    return spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, score string")


def test_held_out_urls(spark):
    got = {r.page_id: r.verdict for r in U.url_filter(frame(spark, UNWANTED + WANTED)).collect()}
    blocked = [got[i] == "block" for i in range(len(got))]
    assert sum(blocked[: len(UNWANTED)]) >= 0.8 * len(UNWANTED)
    assert not any(blocked[len(UNWANTED) :])
    assert not {h for h, _ in U.labelled_urls()} & {*UNWANTED, *WANTED}


def test_training_equals_gradient_descent(spark):
    labelled = [(u, k) for u, k in U.labelled_urls()[::9]] + [(None, False), ("http://a.b/", None)]
    got = np.array(U.train(spark.createDataFrame(labelled, "url string, unwanted boolean")))
    host, path = U.url_parts(F.col("url"))
    rows = spark.createDataFrame(labelled, "url string, unwanted boolean").where("unwanted is not null").select(U.buckets(host, path).alias("x"), "unwanted").collect()
    phi = np.zeros((len(rows), U.DIMS + 1))
    for i, r in enumerate(rows):
        phi[i, r.x] = 1 / np.sqrt(len(r.x))
    phi[:, -1] = 1
    y, w = np.array([float(r.unwanted) for r in rows]), np.zeros(U.DIMS + 1)
    for _ in range(U.STEPS):
        e = y - 1 / (1 + np.exp(-phi @ w))
        w = np.r_[w[:-1] + U.RATE * (phi[:, :-1].T @ e - U.RIDGE * w[:-1]), w[-1] + U.BIAS_RATE * e.mean()]
    assert got == pytest.approx(w, abs=1e-9)


def test_defined_cases(spark):
    d = frame(spark, [None, "", "no scheme", "http://x.example.org/" + "a/b" * 20_000, "http://x.example.org/"])
    got = U.url_filter(d, U.RULES).collect()
    assert len(got) == 5 and all(r.verdict in ("allow", "block") and 0 <= r.score <= 1 for r in got)
    assert U.url_filter(d.limit(0), U.RULES).count() == 0
    none = spark.createDataFrame([], "url string, unwanted boolean")
    assert {(r.verdict, r.score) for r in U.url_filter(d, (), none).collect()} == {("allow", 0.5)}


def test_meaningless_hosts_made_otherwise_are_allowed(spark):
    """Names by a Markov chain over running text, not from the table's groups and syllables."""
    import random

    rnd = random.Random(8)
    text = "the quick brown fox jumps over a lazy dog while seven wizards brew potent elixirs near quiet harbours and other thirsty travellers gather there " * 2
    follows = {}
    for a, b in zip(text, text[1:], strict=False):
        follows.setdefault(a, []).append(b)
    names = []
    while len(names) < 300:
        c, name = rnd.choice("thewsaob"), ""
        while len(name) < rnd.randrange(5, 11):
            name += c
            c = rnd.choice([x for x in follows[c] if x != " "] or ["e"])
        names.append(name)
    urls = [rnd.choice(["https://www.{}.com/en/12", "http://m.{}.example.net/de/{}", "https://blog.{}.org/fr/99.html"]).format(n, k) for k, n in enumerate(names)]
    got = U.url_filter(frame(spark, urls)).collect()
    assert len([urls[r.page_id] for r in got if r.verdict == "block"]) <= 3  # of 300


def test_ties_and_repeated_rows(spark):
    rules = [("a.org", "/x", "block"), ("a.org", "/", "allow"), ("org", "/x/y", "block")]
    d = frame(spark, ["https://b.a.org/x/y", "https://b.a.org/x/y", "https://A.ORG/x", "https://za.org/x", "https://a.org"])
    got = [(r.rule, r.verdict) for r in U.url_filter(d.union(d.limit(1)), rules).orderBy("page_id").collect()]
    assert got[:3] == [got[0]] * 3 and got[0] in {("a.org/x", "block"), ("org/x/y", "block")} and got[3:5] == [("a.org/x", "block"), (None, "allow")] and got[5][0] is None
