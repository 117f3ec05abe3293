import re

from postlens.plans.queries import QUERIES


def test_feed_posts_hold_whole_texts(spark, tmp_path):
    filler = "plain words about rivers & hills, 1 < 2, &amp; no <b>tags</b>.\n" * 400
    rows = [(5, filler + "mail to jobs@quagmire.com"), (-3, filler), (None, filler), (7, None), (8, "")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r for r in QUERIES["feed_posts"](spark, str(tmp_path)).collect()}
    line = lambda t: re.sub(r" *\n *", "\n", "We are hiring. " + (t or "")).strip()
    assert {k: r.text for k, r in got.items()} == {None if i is None else -i - 1: line(t) for i, t in rows}
    assert (got[-6].post_id, got[-6].age_hours, got[-6].comments) == ("urn:li:activity:5", 6.0, 5)
