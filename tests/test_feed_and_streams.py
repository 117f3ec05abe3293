import json

from pyspark.sql import functions as F

from postlens.functions.lexicon import LABELS
from postlens.operators import evaluation as E
from postlens.operators import stores as S
from postlens.operators.decision import decide
from postlens.operators.features import POST_SCHEMA, extract_features
from postlens.operators.scoring import append_cache, interim, read_cache, score_lazily
from postlens.sources.html_feed import layout_frequency, read_posts
from postlens.sources.jsonl import default_path, features_or_meta, labeled_posts, scan_labeled, unlabelled_count
from postlens.streaming import feed

CLASSIC = """<div class="feed-shared-update-v2" data-urn="urn:li:activity:77">
<span class="update-components-actor__title">Mia Poster</span><span class="update-components-actor__description">Recruiter at Nimbus</span>
<span class="update-components-actor__sub-description">5h • Edited</span>
<div class="update-components-text"><p>We are hiring<br>engineers</p><p>Apply <a href="https://boards.greenhouse.io/x">here</a><button>more</button></p></div>
<span class="update-components-article__subtitle">greenhouse.io • 2 min</span><button class="social-details-social-counts__reactions-count">1,204</button>
<a href="mailto:Jobs@nimbus.io?subject=x">mail</a><span>12 comments</span><div class="comments-comment-item"><p>99 comments</p><a href="https://spam.example/">x</a></div></div>"""
BARE = """<main><div><section><p>Ann Author</p><p>Lead at Orchid</p><span>2d</span><div><p>A long enough paragraph about open roles in our team.</p></div>
<button aria-label="Comment">17</button><button>Send</button></section></div><div><section><p>Bob</p><p>3 comments</p><div><p>Second post, also with quite some text in it.</p></div><button>Send</button></section></div></main>"""


HASHED = """<main><div data-view-name="feed-full-update"><a data-view-name="feed-actor-image" href="/in/x"></a><a href="/company/y"><p>Dana Doe</p><p>Follow</p><p>Cook at Tiny Diner</p><p>3d</p></a>
<span dir="ltr">short</span><div><span dir="ltr">A cook is wanted, and <b>pay</b> is good.<br>Really.</span></div><span>Sam and 7 others</span><a href="/in/kim">@Kim Lee</a><a href="#top">up</a></div></main>"""


def test_read_posts(spark):
    pages = spark.createDataFrame([(1, CLASSIC), (2, BARE), (3, "<p>no feed</p>"), (4, None), (5, ""), (6, HASHED), (6, HASHED)], "page_id bigint, html string")
    rows = read_posts(pages).collect()
    got = {(r.page_id, r.post_id if r.page_id == 1 else r.text[:6]): r for r in rows}
    assert (len(rows), len(got)) == (5, 4)  # a repeated page gives its post again
    a = got[1, "urn:li:activity:77"]
    assert (a.text, a.author_headline, a.age_text, a.age_hours, a.reactions, a.comments) == ("We are hiring\nengineers\nApply here", "Recruiter at Nimbus", "5h", 5.0, 1204, 12)
    assert [(x.href, x.text) for x in a.links] == [("https://boards.greenhouse.io/x", "here"), ("mailto:Jobs@nimbus.io?subject=x", "mail"), ("", "greenhouse.io")]
    assert a.emails == ["jobs@nimbus.io"] and "Mia Poster" in a.person_names
    b = got[2, "A long"]
    assert (b.author_headline, b.age_hours, b.comments) == ("Lead at Orchid", 48.0, 17)
    assert got[2, "Second"].comments == 3
    c = got[6, "A cook"]
    assert (c.text, c.author_headline, c.age_hours, c.reactions, c.comments) == ("A cook is wanted, and pay is good.\nReally.", "Cook at Tiny Diner", 72.0, 8, None)
    assert [x.href for x in c.links] == ["/in/x", "/company/y", "/in/kim"] and c.person_names == ["Dana Doe", "Kim Lee"]
    assert decide(extract_features(read_posts(pages))).count() == 5


def test_selectors_need_their_element(spark):
    marked = '<{0} data-view-name="feed-full-update"><div class="update-components-text">Long enough words here</div><{1} data-id="urn:li:comment:1"><span>9 comments</span></{1}></{0}>'
    pages = spark.createDataFrame([(1, marked.format("div", "article")), (2, marked.format("span", "article")), (3, marked.format("div", "div"))], "page_id bigint, html string")
    assert {(r.page_id, r.comments) for r in read_posts(pages).collect()} == {(1, None), (3, 9)}


def test_widest_prose_block(spark):
    """Paragraphs side by side are one text; a box with controls that would add text is not."""
    post = '<div data-urn="urn:li:activity:5"><header><p>Eve</p></header><div id="b"><div><p>First paragraph of a long story about bread.</p><p>And the second.</p></div><div><button>like</button><p>not the text</p></div></div></div>'
    got = read_posts(spark.createDataFrame([(1, post)], "page_id bigint, html string")).first()
    assert got.text == "First paragraph of a long story about bread.\nAnd the second."


def test_deep_and_wide_pages(spark):
    deep = '<div data-urn="urn:li:activity:1">' + "<div>" * 20_000 + "<p>The text at the bottom of it all, long enough.</p>" + "</div>" * 20_001
    wide = "<main>" + "".join(f'<section><div><p>Number {i} of many posts in this feed.</p></div><button>Repost</button></section>' for i in range(300)) + "</main>"
    rows = read_posts(spark.createDataFrame([(1, deep), (2, wide)], "page_id bigint, html string")).collect()
    assert [r.text for r in rows if r.page_id == 1] == ["The text at the bottom of it all, long enough."]
    assert {r.text for r in rows if r.page_id == 2} == {f"Number {i} of many posts in this feed." for i in range(300)}


def test_layout_frequency(spark):
    pages = spark.createDataFrame([(1, CLASSIC), (2, BARE), (2, BARE)], "page_id bigint, html string")
    got = {(r["name"], r["value"]): r.n for r in layout_frequency(pages).collect()}
    assert got["label", "Send"] == 4 and got["label", "Comment"] == 2 and got["label", "more"] == 1


def test_labelled_jsonl(spark, tmp_path):
    rows = [{"text": "We are hiring", "gold_label": "unverified", "meta": {"ageHours": 3, "headline": "HR"}}, {"text": "skip", "gold_label": ""}]
    (tmp_path / "x.jsonl").write_text("\n\n".join(map(json.dumps, rows)) + "\n")
    d = scan_labeled(spark, str(tmp_path / "x.jsonl"))
    assert [(r.text, r.split in ("dev", "test")) for r in d.collect()] == [("We are hiring", True)]
    assert decide(extract_features(labeled_posts(d))).first().label == "unverified"


def test_stream(spark, tmp_path):
    post = {"post_id": "1", "text": "Hiring, pay the training fee", "age_hours": 1.0, "comments": 1, "links": [], "emails": [], "ts": "2026-01-01T10:00:00Z"}
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps(post | {"post_id": i}) for i in ("1", "1", "2")))
    seen = []
    labelled = feed.label_stream(feed.seen_once(feed.post_stream(spark, str(tmp_path / "in"))))
    q = feed.start(labelled, lambda b, n: seen.extend(r.label for r in b.select("label").collect()), str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert seen == ["scam_risk", "scam_risk"]


def test_upsert_step(spark, tmp_path):
    step = feed.upsert_to(str(tmp_path / "t"), buckets=3)
    rows = lambda *x: spark.createDataFrame(list(x), "post_id_hash string, saved_at int, v string")
    stored = lambda: {(r.post_id_hash, r.v) for r in feed.read_upserted(spark, str(tmp_path / "t")).collect()}
    step(rows(*((k, 1, "x") for k in "abcdefgh")), 0)
    for _ in range(2):  # a batch that is tried again
        step(rows(("a", 2, "z")), 1)
    assert stored() == {(k, "z" if k == "a" else "x") for k in "abcdefgh"}
    assert len(list((tmp_path / "t/v000000001").glob("bucket=*"))) == 1  # only the bucket of the key
    step(rows(("a", 3, "w")), 2)
    step(rows(), 3)
    assert stored() == {(k, "w" if k == "a" else "x") for k in "abcdefgh"}
    assert {len(v) for v in feed.versions(spark, str(tmp_path / "t")).values()} == {1, 2}  # older ones are gone


def test_daily_counts_stream(spark, tmp_path):
    post = {"post_id": "1", "text": "Hiring, pay the training fee", "age_hours": 1.0, "comments": 1, "links": [], "emails": [], "ts": "2026-01-01T10:00:00Z"}
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps(post | {"post_id": i, "ts": f"2026-01-0{d}T10:00:00Z"}) for i, d in (("1", 1), ("2", 1), ("3", 2))))
    q = feed.daily_counts(feed.label_stream(feed.post_stream(spark, str(tmp_path / "in")))).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((str(r.date), r.label, r.n) for r in spark.table("counts").collect()) == [("2026-01-01", "scam_risk", 2), ("2026-01-02", "scam_risk", 1)]


def test_stored_features_or_meta(spark, tmp_path):
    rows = [{"text": "We are hiring", "gold_label": "unverified", "meta": {"ageHours": 3}}, {"text": "A story", "gold_label": "not_hiring", "meta": {}}, {"text": "x", "gold_label": ""}]
    assert default_path(str(tmp_path)).endswith("synthetic.jsonl")
    (tmp_path / "labeled.jsonl").write_text("\n".join(map(json.dumps, rows)))
    path = default_path(str(tmp_path))
    assert path.endswith("labeled.jsonl") and unlabelled_count(spark, path).first().n == 1
    d = scan_labeled(spark, path)
    made = extract_features(labeled_posts(d)).select("text", "features", "gold_label", "split")
    other = made.where("text = 'A story'").unionByName(made.where("text = 'A story'").withColumn("text", F.lit("not asked for")))
    got = features_or_meta(other, d)
    assert {(r.text, r.gold_label) for r in got.collect()} == {("We are hiring", "unverified"), ("A story", "not_hiring")}
    judged = decide(got.withColumn("text_units", F.length("text"))).select("text", F.col("gold_label").alias("gold"), F.col("label").alias("pred"))
    assert E.accuracy(judged).first().accuracy == 1 and E.mistakes(judged.withColumn("gold", F.lit("crowded"))).count() == 2
    assert {r.label for r in E.report(judged).collect()} == set(LABELS)
    assert E.model_call_count(spark.createDataFrame([(["hiring"],), (["bait", "scam"],)], "questions array<string>")).first().calls == 3


def test_stores_and_exports(spark, tmp_path):
    day = spark.createDataFrame([("2026-01-01", "crowded", 2)], "date string, label string, n bigint").withColumn("date", F.to_date("date"))
    both = S.add_counts(day, day.unionByName(day.withColumn("label", F.lit("scam_risk"))))
    assert {(r.label, r.n) for r in S.today(both, F.lit("2026-01-01").cast("date")).collect()} == {("crowded", 4), ("scam_risk", 2)} and S.today(both).count() == 0
    wide = S.wide_counts(both).first()
    assert (wide.crowded, wide.scam_risk, wide.apply_early) == (4, 2, 0)
    S.feedback_append(both, str(tmp_path / "f"))
    S.feedback_append(both, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 4
    S.clear(str(tmp_path / "f"), both)
    assert spark.read.parquet(str(tmp_path / "f")).count() == 0
    out = S.export_path(str(tmp_path), "dataset", "2026-01-31")
    S.write_jsonl(both, out)
    assert out.endswith("dataset-2026-01-31.jsonl") and spark.read.json(out).count() == 2 and json.loads(S.json_lines(both).first().line)["n"] in (2, 4)
    labelled = decide(extract_features(spark.createDataFrame([("p1", "Ring Ole Lund: ole@lund.org", "", None, 1.0, 1, 1, 1, [], []), ("p2", "We are hiring", "", None, 1.0, 1, 1, 1, [], [])], POST_SCHEMA)))
    records = {r.text: r for r in S.dataset_records(labelled, F.array(F.lit("Ole Lund"))).collect()}
    assert set(records) == {"Ring [name]: [email:company]", "We are hiring"} and len(records["We are hiring"].post_id_hash) == 64
    assert [r.post_id for r in S.shown(labelled).collect()] == ["p2"] and S.shown(labelled, False).count() == 2


def test_cache_and_interim_labels(spark, tmp_path):
    f = extract_features(spark.createDataFrame([("p", "We are hiring many people, please repost and tag a friend of yours", "", None, 1.0, 1, 1, 1, [], [])], POST_SCHEMA))
    first = interim(f).first()
    assert first.pending and first.shown is None and first.label == "unverified"
    path = str(tmp_path / "cache")

    class Scorer:
        def score(self, question, texts):
            return [0.9] * len(texts)

    class Failing:
        def score(self, question, texts):
            from postlens.operators.scoring import ScorerFailed

            raise ScorerFailed

    _, answers = score_lazily(f, Scorer(), cache=read_cache(spark, path))
    append_cache(answers, read_cache(spark, path), path)
    append_cache(answers, read_cache(spark, path), path)
    assert read_cache(spark, path).count() == 2
    again, _ = score_lazily(f, Failing(), cache=read_cache(spark, path))  # answered by the store
    assert again.first().scores.hiring == 0.9
    other, _ = score_lazily(f, Failing(), cache=read_cache(spark, path), model="another")
    assert other.first().scores.hiring is None


def test_schema_is_readable(spark):
    assert spark.createDataFrame([], POST_SCHEMA).select(F.count("*")).first()[0] == 0
