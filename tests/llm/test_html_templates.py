"""Site templates: found by counts where no mark tells, in linear time."""

import time

from postlens.llm import htmltext as H


def site(n, host="s.example.org"):
    """Pages whose site blocks have no telling tag or class, one of them inside the article."""
    rows = []
    for i in range(n):
        story = f"<div><p>Story {i} begins.</p><div class=q7><span>Read on</span> at our site</div><p>Story {i} ends.</p></div>"
        rows.append((i, f"http://{host}/{i}", f"<html><body><div class=k1><div>Home</div><div>Offers</div></div>{story}<div class=z9>All rights kept</div></body></html>", "x"))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string")


def test_counts_decide_where_no_mark_tells(spark):
    pages = frame(spark, site(14))
    got = {r.page_id: r.text for r in H.main_text(pages).collect()}
    assert got == {i: f"Story {i} begins.\nStory {i} ends." for i in range(14)}
    off = {r.page_id: r.text for r in H.main_text(pages, min_pages=1000).collect()}
    assert all("Offers" in t and "Read on" in t and "All rights kept" in t for t in off.values())
    assert {r.page_id: r.text for r in H.main_text(pages, broadcast_rows=0).collect()} == got


def test_blocks_inside_a_marked_article(spark):
    rows = [(i, u, h.replace("<body>", "<body><article>").replace("</body>", "</article></body>"), x) for i, u, h, x in site(14)]
    assert {r.text for r in H.main_text(frame(spark, rows)).collect()} == {f"Story {i} begins.\nStory {i} ends." for i in range(14)}


def test_other_hosts_do_not_count(spark):
    rows = [(k, f"http://h{k}.org/", r[2], "x") for k, r in enumerate(site(14))]
    assert all("Offers" in r.text for r in H.main_text(frame(spark, rows)).collect())


def test_long_and_deep_pages_take_linear_time():
    cases = {"open tags": "<a " * 300_000, "open tags that end": "<a " * 300_000 + ">", "declarations": "<!" * 300_000, "quotes": '<a b="' * 100_000, "deep": "<div>" * 60_000 + "text" + "</div>" * 60_000, "paragraphs": "<p>x" * 100_000, "brackets": "< " * 300_000}
    for name, source in cases.items():
        began = time.time()
        page = H.Page(source)
        page.hashes("h"), page.fingerprint(), page.text(set())
        assert time.time() - began < 20, name
    assert H.Page(cases["deep"]).text(set()) == "text"
    assert H.Page("a <b>c</b> <i").text(set()) == "a c <i"


def test_empty_table_and_clashing_columns(spark):
    assert H.main_text(frame(spark, site(2)).limit(0)).count() == 0
    d = spark.createDataFrame([(1, "http://a/", "<p>x</p>", "t", 3), (1, "http://a/", "<p>x</p>", "t", 3)], "page_id long, url string, html string, text string, id int")
    assert [tuple(r) for r in H.main_text(d).collect()] == [(1, "http://a/", "x")] * 2


def text_of(spark, html):
    return H.main_text(frame(spark, [(1, "http://a.org/", html, "x")])).first().text


def test_article_text_is_not_lost_by_names(spark):
    html = '<article><h1>T</h1><p>a</p><h2 id="related-work">R</h2><p>b</p><section id="social-history"><p>c</p></section><p class="share-price">d</p><div id="menu-design">e</div><div class="share-price">f</div><p class="notice">g</p><h2 class="banner">h</h2><div class="ad">no</div></article>'
    assert text_of(spark, html) == "\n".join(["T", "a", "R", "b", "c", "d", "e", "f", "g", "h"])
    assert text_of(spark, html.replace("article>", "section>")) == "\n".join(["T", "a", "R", "b", "c", "d", "e", "f", "g", "h"])


def test_reader_comments_go(spark):
    body = '<article><p>a</p></article>'
    for c in ('<article class="comment">no</article>', '<div id="comments"><article>no</article></div>', '<ol class="comment-list"><li>no</li></ol>', '<section class="post-comments"><p>no</p></section>', '<article class="comment"><p>no</p><article class="comment">no</article></article>'):
        assert text_of(spark, body + c) == text_of(spark, body.replace("</article>", c + "</article>")) == "a"
    assert text_of(spark, '<article><p>a</p><h2 id="comment-on-birds">b</h2><p class="comment">c</p></article>') == "a\nb\nc"


def varied(n, box):
    """Pages of a host with other words in each box."""
    return [(i, f"http://s.org/{i}", f'<body><div class="x1"><p>Story {i} of the day</p></div>{box.replace("#", f"word{i}")}</body>', "x") for i in range(n)]


def test_boxes_with_other_words_count_by_their_path(spark):
    menu = '<div class="q"><ul class="z"><li><a href="/#">#</a></li><li><a href="/2#">more #</a></li></ul></div>'
    assert {r.text for r in H.main_text(frame(spark, varied(12, menu))).collect()} == {f"Story {i} of the day" for i in range(12)}
    assert all("more" in r.text for r in H.main_text(frame(spark, varied(5, menu))).collect())  # too few pages
    told = [(i, u, f"<article>{h}</article>", x) for i, u, h, x in varied(12, '<div class="main-promo"><p>Buy # now</p></div>')]
    assert {r.text for r in H.main_text(frame(spark, told)).collect()} == {f"Story {i} of the day" for i in range(12)}
    assert all("Buy" in r.text for r in H.main_text(frame(spark, told[:5])).collect())
    lists = [(i, u, f"<article>{h}</article>", x) for i, u, h, x in varied(12, menu)]
    assert all("more" in r.text for r in H.main_text(frame(spark, lists)).collect())  # an article may hold links


def test_counts_equal_a_naive_count(spark):
    import random
    import re as regex

    rnd = random.Random(11)
    rows = []
    for i in range(60):
        host = rnd.choice("ab")
        boxes = [f"<div class=k{rnd.randrange(3)}><div>{rnd.choice(['Home', 'Offers', f'w{i}'])}</div></div>" for _ in range(rnd.randrange(1, 4))]
        rows.append((i, f"http://{host}.org/{i}", "<body>" + "".join(boxes) + f"<div><p>Story {i}</p></div></body>", "x"))
    seen = {}
    for i, u, h, _ in rows:
        for sub in set(regex.findall(r"<div class=k\d><div>\w+</div></div>", h)) | {f"<div>{w}</div>" for w in regex.findall(r"<div>(\w+)</div>", h)} | {f"<div><p>Story {i}</p></div>"}:
            seen.setdefault((u[7], sub), set()).add(h)
    want = {}
    for i, u, h, _ in rows:
        for (host, sub), held in seen.items():
            if host == u[7] and len(held) >= 10:
                h = h.replace(sub, "")
        want[i] = "\n".join(x for x in regex.sub(r"<[^>]*>", "\n", h).split("\n") if x)
    assert {r.page_id: r.text for r in H.main_text(frame(spark, rows)).collect()} == want and any("Home" not in t for t in want.values())
