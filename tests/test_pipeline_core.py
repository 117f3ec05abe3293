import json

import pytest
from pyspark.sql import functions as F

from postlens.functions.lexicon import LABELS
from postlens.operators import decision as D
from postlens.operators import evaluation as E
from postlens.operators import reasons as R
from postlens.operators import scoring
from postlens.operators import stores as S
from postlens.operators.features import POST_SCHEMA, extract_features


def post(text, links=(), headline="", age=5.0, comments=12, emails=()):
    return ("p", text, headline, "5h", age, 10, comments, 0, [{"href": h, "text": t} for h, t in links], list(emails))


def decide(spark, *posts):
    d = D.decide(extract_features(spark.createDataFrame([(f"{i}", *p[1:]) for i, p in enumerate(posts)], POST_SCHEMA)))
    return [(r.label, r.line) for r in d.select("post_id", "label", R.reason_line(F.col("reasons")).alias("line")).orderBy("post_id").collect()]


ATS = [("https://boards.greenhouse.io/acme/jobs/1", "Apply")]


def test_labels_and_lines(spark):
    got = decide(
        spark,
        post("We are hiring an engineer", ATS),
        post("We are hiring an engineer", ATS, age=168.0, comments=199),
        post("We are hiring an engineer", ATS, age=169.0, comments=None),
        post("Hiring! Comment interested and follow me", comments=1),
        post("Hiring, pay the registration fee, no interview"),
        post("Hiring a writer, DM me", age=None),
        post("#OpenToWork I lost my job"),
        post("Pay a security deposit for this job"),
        post("A story about trees"),
    )
    assert got == [
        ("apply_early", "Apply link on Greenhouse · posted 5h ago · 12 comments"),
        ("real_opening", "Apply link on Greenhouse · posted 1w ago · 199 comments"),
        ("crowded", "Apply link on Greenhouse · posted 1w ago"),
        ("engagement_bait", 'Asks you to "comment interested" · Asks you to "follow me" · no apply link · 1 comment'),
        ("scam_risk", "Mentions registration fee · Says no interview needed"),
        ("unverified", 'Only "DM me"'),
        ("not_hiring", "Job seeker post (#OpenToWork)"),
        ("scam_risk", "Mentions security deposit"),
        ("not_hiring", "No hiring keywords"),
    ]


def test_exposure_borders(spark):
    got = decide(spark, *[post("Hiring", ATS, age=a, comments=c) for a, c in ((24.0, 49), (24.0, 50), (30.0, 200), (24.0, 480), (None, None))])
    assert [g[0] for g in got] == ["apply_early", "real_opening", "crowded", "crowded", "real_opening"]


def test_features_hold_no_text(spark):
    p = post("Zanzibar secret: hiring at Quagmire, mail bob@quagmire.com", [("https://quagmire.com/careers", "Quagmire careers")], headline="Bob of Quagmire")
    row = extract_features(spark.createDataFrame([p], POST_SCHEMA)).select(F.to_json("features").alias("f")).first().f
    assert not [w for w in ("Zanzibar", "Bob", "quagmire", "Quagmire") if w in row]
    f = json.loads(row)
    assert f["careers_page"] and f["corporate_email"] and f["corporate_email_matches_company"] and f["poster_at_company"]


def Fake(**scores):  # noqa: N802
    class Scorer:  # a local class travels to the workers by value
        def score(self, question, texts):
            if question not in scores:
                raise scoring.ScorerFailed
            return [scores[question]] * len(texts)

    return Scorer()


def test_lazy_scores(spark):
    posts = spark.createDataFrame([post("We are hiring many people, please repost and tag a friend of yours")], POST_SCHEMA)
    f = extract_features(posts)
    scored, cache = scoring.score_lazily(f, Fake(hiring=0.9, bait=0.99))
    assert D.decide(scored).first().label == "engagement_bait"
    assert {(r.question, r.score) for r in cache.collect()} == {("hiring", 0.9), ("bait", 0.99)}
    low, _ = scoring.score_lazily(f, Fake(hiring=0.1))
    assert D.decide(low).first().label == "not_hiring"
    failing, _ = scoring.score_lazily(f, Fake())  # a scorer that fails leaves the rules alone
    assert D.decide(failing).first().label == "unverified"


def test_evaluation(spark):
    d = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "gold string, pred string")
    assert E.accuracy(d).first().accuracy == 0.5
    got = {r.label: (r.support, r.precision, r.recall, round(r.f1, 4)) for r in E.per_label(d, ["a", "b", "c", "d"]).collect()}
    assert got == {"a": (2, 0.5, 0.5, 0.5), "b": (1, 0.5, 1.0, 0.6667), "c": (1, 0.0, 0.0, 0.0), "d": (0, 0.0, 0.0, 0.0)}
    assert E.macro_f1(d, ["a", "b", "c", "d"]).first()[0] == pytest.approx((0.5 + 2 / 3) / 3)
    assert {(r.gold, r.a, r.b) for r in E.confusion_matrix(d, ["a", "b"]).collect()} == {("a", 1, 1), ("b", 0, 1), ("c", 1, 0)}
    empty = d.limit(0)
    assert E.accuracy(empty).first().accuracy == 0 and E.macro_f1(empty).first()[0] == 0


def test_stores(spark):
    rows = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("j", 1, "one")], "post_id_hash string, saved_at int, label string")
    assert {(r[0], r.label) for r in S.dataset_upsert(None, rows).collect()} == {("k", "new"), ("j", "one")}
    assert {(r.post_id_hash, r.label) for r in S.seen_once(rows, "post_id_hash", "saved_at").collect()} == {("k", "old"), ("j", "one")}


def test_all_labels_occur(spark):
    from postlens.plans.queries import QUERIES

    assert {r.label for r in QUERIES["label_counts"](spark, "/root/testdata/sf0.001").collect()} == set(LABELS)
