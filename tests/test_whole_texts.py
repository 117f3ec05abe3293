import re

from postlens.functions import lexicon as L
from postlens.plans.posts import TEMPLATES
from postlens.plans.queries import QUERIES


def documents(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id bigint, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def phrases(text, own):
    flat = " " + re.sub(r"[^a-z0-9+]+", " ", text.lower()).strip() + " "
    return "|".join(p for p in own if f" {p} " in flat)


def test_posts_hold_whole_texts(spark, tmp_path):
    filler = "plain words about rivers and hills " * 2000
    tail = "we are hiring, pay the training fee, follow me for more, see https://boards.greenhouse.io/acme/jobs/9 or mail to jobs@quagmire.com"
    rows = [(27, "s", filler + tail), (64, "s", filler), (-10, "s", filler + tail), (None, "s", filler + tail), (28, "s", None), (29, "s", "")]
    d = documents(spark, tmp_path, rows)
    text = {i: TEMPLATES[0 if i is None else i % len(TEMPLATES)][0] + " " + (t or "") for i, _, t in rows}
    got = {r.doc_id: r for r in QUERIES["phrase_hits"](spark, d).collect()}
    lists = {"hiring": L.HIRING_KEYWORDS, "seeker": L.SEEKER_PHRASES, "not_hiring": L.NOT_HIRING_PHRASES, "bait": L.BAIT_PHRASES, "weak_bait": L.WEAK_BAIT_WORDS, "scam": L.SCAM_PHRASES}
    assert {i: {k: r[k] for k in lists} for i, r in got.items()} == {i: {k: phrases(t, v) for k, v in lists.items()} for i, t in text.items()}
    assert "training fee" in got[27].scam and "training fee" not in got[64].scam
    kinds = {r.doc_id: r.kinds.split("|") for r in QUERIES["url_kinds"](spark, d).collect()}
    assert {i for i, k in kinds.items() if "ats" in k} == {27, -10, None}
    labels = {r.doc_id: r.label for r in QUERIES["post_labels"](spark, d).collect()}
    assert (labels[27], labels[64], labels[-10], len(labels)) == ("scam_risk", "not_hiring", "scam_risk", len(rows))
