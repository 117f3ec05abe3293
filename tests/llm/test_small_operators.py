"""Round trips, brute force and defined cases of BPE, language ID, URL filter, HTML text, top-k, licences, decontamination and LM scoring."""

import hashlib
import math
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from postlens.llm import bpe, decontaminate, htmltext, langid, lattice, licenses, topk, urlfilter

TEXTS = [None, "", "a", "  a  b\n\n c\t", "x<|endoftext|>y<|endoftext", "aaaa" * 3000, " 123 don't it's 'S", "😀😀é́ ‍　 zz", "The quick brown fox. " * 400, "abcabc" * 50, "The quick brown fox. " * 400]


def docs(spark, texts=TEXTS, **more):
    rows = [(i if i != 3 else None, t, "spare") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def test_bpe_equals_library(spark):
    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    got = bpe.bpe_digest(docs(spark), path).collect()
    assert len(got) == len(TEXTS)
    want = sorted((len(e.ids), hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()) for e in (lib.encode(t or "", add_special_tokens=False) for t in TEXTS))
    assert sorted(tuple(r)[1:] for r in got) == want
    assert {r.decoded for r in bpe.bpe_encode(docs(spark), path).collect()} == {t or "" for t in TEXTS}
    assert bpe.bpe_encode(docs(spark).limit(0), path).count() == 0


def test_bpe_pairs_agree_with_merging():
    v = bpe.vocabulary(P.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 50256, (2, 1500))
    want = [v.merge(v.bytes_of[x] + v.bytes_of[y]) == [x, y] for x, y in zip(a, b, strict=True)]
    assert v.compatible(a, b).tolist() == want


def test_language_id(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.language_id(d, learn=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2).join(d, "doc_id").collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    odd = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "123 !", "en"), (4, "text", None), (None, "text", None)], "doc_id long, text string, lang string")
    assert {(r.doc_id, r.lang_pred, r.score) for r in langid.language_id(odd).collect()} == {(i, "und", 0.0) for i in (1, 2, 3, 4, None)}
    assert langid.language_id(odd.limit(0)).count() == 0


def test_url_filter(spark):
    cases = {
        None: ("", "", None), "nothing": ("", "", None), "http://A.Example.com/en/x?y": ("a.example.com", "/en/x", "example.com/en/"), "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/"),
        "http://b.com": ("b.com", "", None), "http://x.NET/es/1#f": ("x.net", "/es/1", "net/es/"), "http://net/fr/?q": ("net", "/fr/", "net/fr/"), "http://notcom/": ("notcom", "/", None), "a://b://c.com/d": ("b:", "//c.com/d", None),
    }
    rows = spark.createDataFrame([(i, u, "h") for i, u in enumerate(cases)], "page_id long, url string, host string")
    got = {r.page_id: r for r in urlfilter.url_filter(rows, urlfilter.RULES).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(len(cases))] == list(cases.values())
    assert got[2].verdict == "block" and got[3].verdict == "allow" and got[5].verdict == "block"


def test_url_model(spark):
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(["https://new-casino.example.org/play/2", "https://pills-cheap.example.net/buy", "https://blog.garden.example.net/en/4", None])], "page_id long, url string")
    assert [r.verdict for r in sorted(urlfilter.url_filter(rows).collect())][:3] == ["block", "block", "allow"]


def page(body):
    return f"<html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


def test_html_text(spark):
    article = page('<nav><ul><li>x</ul></nav><div class="ad">AD</div><article><h1>Hi &amp;amp; &lt;b&gt;</h1><p><b>one<br>two  <p>three<div class=notice>N</div><ul><li>x<li>y</ul>tail<form>q</form></article><section id="comments"><article>c</article></section><footer>f')
    plain = [page(f"<div><span>Site</span> links</div><p>Story number {i}</p><script>'<p>no'</script>") for i in range(12)]
    rows = [(1, "http://a/1", article), (2, "http://a/2", None), (3, None, ""), (None, "http://a/3", "just <b>text")] + [(10 + i, f"http://b/{i}", p) for i, p in enumerate(plain)]
    got = {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "Hi &amp; <b>\none two\nthree\nx\ny\ntail"
    assert (got[2], got[3], got[None]) == ("", "", "just text")
    assert [got[10 + i] for i in range(12)] == [f"Story number {i}" for i in range(12)]  # the repeated block is the site's
    joined = htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), broadcast_rows=0)
    assert {r.page_id: r.text for r in joined.collect()} == got


def test_html_copies_are_no_template(spark):
    rows = [(i, "http://c/x", page("<div><div>The whole story</div></div>")) for i in range(30)]
    got = htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).select("text").distinct().collect()
    assert [r.text for r in got] == ["The whole story"]


def test_top_k(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 40)).round(2)
    x[5] = x[6] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 40), (1003, [float("inf")] * 40), (None, [1.0] * 40), (1050, [0.5] * 10)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.exact_top_k(d, F.col("vec_id") % 50 == 0).collect()}
    ids = [*range(700), 1050]
    q = np.floor(256 * np.vstack([x, np.pad([0.5] * 10, (0, 30))])).astype(np.int64)
    want = {}
    for k, i in enumerate(ids):
        if i % 50 == 0:
            for rank, (s, j) in enumerate(sorted((-int(q[k] @ q[m]), j) for m, j in enumerate(ids) if j != i)[:5], 1):
                want[i, rank] = (j, -s)
    assert got == want
    assert topk.exact_top_k(d.limit(0), F.lit(True)).count() == 0
    assert topk.exact_top_k(d.where("vec_id < 3"), F.col("vec_id") == 0).count() == 2


def test_licenses(spark):
    rows = [
        (1, "a/b/LICENSE", "Some words\nLicensed under the Apache License, Version 2.0."), (2, "a/b/c/x.txt", "no notice"), (3, "a/b/y.txt", "Released under the MIT License."), (4, "z/q.txt", "nothing"),
        (5, None, "Licensed under CC BY-NC 4.0."), (6, "a/b/n.txt", None), (None, "a/b/e.txt", ""),
    ]
    d = spark.createDataFrame([(*r, "w") for r in rows], "doc_id long, path string, text string, word string")
    got = {r.doc_id: (r.declared, r.inherited, r.license) for r in licenses.scan_licenses(d, licenses.default_templates(spark)).collect()}
    a = "Apache-2.0"
    assert got == {1: (a, a, a), 2: (None, a, a), 3: ("MIT", a, "MIT"), 4: (None, None, None), 5: ("CC-BY-NC-4.0", None, "CC-BY-NC-4.0"), 6: (None, a, a), None: (None, a, a)}
    assert licenses.scan_licenses(d.limit(0), licenses.default_templates(spark)).count() == 0


def test_decontamination(spark):
    item = "the old river ran past seven mills and a bridge of stone before it met the sea near town"
    w = item.split()
    changed = " ".join("changed" if i in (4, 12) else x for i, x in enumerate(w))
    rows = [(1, f"intro words {item} outro"), (2, changed.upper()), (3, " ".join(w[:8]) + " and then something else entirely happened here"), (4, None), (5, ""), (6, " ".join(reversed(w))), (7, "filler " * 5000 + item), (None, item)]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(9, item), (10, None), (11, "short one")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b).collect()}
    assert got == {(1, 9), (2, 9), (7, 9), (None, 9)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b, seeds_per_block=10).collect()} == got
    assert {r.doc_id for r in decontaminate.decontaminate(d, b).collect()} == {3, 4, 5, 6}
    assert decontaminate.contaminated(d, b.limit(0)).count() == 0 and decontaminate.contaminated(d.limit(0), b).count() == 0


def test_lattice_sums_all_segmentations():
    v = lattice.pieces(P.path("piece_bpe_32k.model"))

    def brute(w):  # over all ways to cut
        p = [1.0] + [0.0] * len(w)
        for e in range(1, len(w) + 1):
            p[e] = sum(p[s] * math.exp(v.first[v.index[w[s:e]]]) for s in range(e) if w[s:e] in v.index)
        return math.log(p[-1])

    words = [b"hello", b"the", "éß".encode(), b"x" * 30, b"internationalization", b"q", b"y" * 60]
    got, _ = lattice.forward(v, v.first, words)
    assert got == pytest.approx([brute(lattice.MARK + w) for w in words])
    _, expected = lattice.forward(v, v.first, words, np.ones(len(words)))
    size = np.array([len(n) for n in v.names] + [0])
    assert (expected * size).sum() == pytest.approx(sum(len(w) + 3 for w in words))  # expected pieces cover every byte once


def test_lm_base_score(spark):
    rows = [(1, "A b b"), (2, "b\tc"), (3, None), (4, "zz A"), (None, "b"), (1, "A b b")]
    d = spark.createDataFrame([(*r, r[0] != 4) for r in rows], "doc_id long, text string, words boolean")
    got = {r.doc_id: r for r in lattice.lm_score(d, F.col("words"), P.path("piece_bpe_32k.model")).collect()}
    n, v, c = 9 + 5, 4, {"a": 2, "b": 6, "c": 1, "$": 5}
    n = sum(c.values())
    want = lambda ws: sum(math.log10((c.get(w, 0) + 1) / (n + v + 1)) for w in [*ws, "$"])
    assert got[4].base_score == pytest.approx(want(["zz", "a"])) and got[3].base_score == pytest.approx(want([])) and got[None].base_score == pytest.approx(want("b"))
    assert (got[4].n_tokens, got[4].n_known, got[4].train_tokens) == (3, 2, n) and all(math.isfinite(r.score) and r.score < 0 for r in got.values())
    assert lattice.lm_score(d.limit(0), F.lit(True), P.path("piece_bpe_32k.model")).count() == 0
