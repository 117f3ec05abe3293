"""What labels cost: the posts are read and their features made once, and only those that labels need."""

import pytest
from pyspark.sql import functions as F

from postlens.functions import text as T
from postlens.functions import urls as U
from postlens.operators import decision as D
from postlens.operators import evaluation as E
from postlens.operators.features import extract_features
from postlens.plans.posts import derived_posts
from postlens.plans.queries import QUERIES, judged_gold, judged_posts

SMALL = "/root/testdata/sf0.001"


def plan(spark, name):
    return QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()


def test_labels_without_names_of_companies(spark):
    assert "poster_at_company" not in plan(spark, "label_counts")
    posts = derived_posts(spark, SMALL)
    both = [{r.doc_id: r.label for r in d.select("doc_id", "label").collect()} for d in (D.decide(extract_features(posts)), D.decide_labels(extract_features(posts, label_only=True)))]
    assert both[0] == both[1] and len(set(both[0].values())) > 3


def test_accuracy_reads_the_posts_once(spark):
    assert plan(spark, "label_accuracy").count(" AS _flat#") == 1


def test_settings_need_no_features(spark):
    assert plan(spark, "labels_as_of").count(" AS _flat#") == 1


def test_accuracy_and_f1_as_apart(spark):
    some = [("crowded", "crowded"), ("crowded", "scam_risk"), ("scam_risk", None), (None, "crowded"), ("unverified", "unverified"), ("other", "other")]
    for rows in (some, some[:1], some[2:4], []):
        d = spark.createDataFrame(rows, "gold string, pred string")
        got = E.accuracy_and_f1(d).first()
        one, f1 = E.accuracy(d).first(), E.macro_f1(d).first()[0]
        assert (got.accuracy, got.n, got.macro_f1) == (pytest.approx(one.accuracy), one.n, pytest.approx(f1))


def test_addresses_and_links_as_by_the_plain_patterns(spark):
    from postlens.functions import lexicon as L

    cases = ["a@b.com1@c.de", "x@@y.org z.@q.in,w@v", "é.a+b@c-d.co.uk%x@y.zz", "_foo-bar.com/x -baz.io/ www.a http://b", "a.b.c.com/(d) e..com/ f-.g.in/h", "1@c.de@d.com a@b.c0m2@d.net", ""]
    rows = spark.createDataFrame([(c,) for c in cases], "t string")
    t = F.col("t")
    plain = lambda p: F.regexp_extract_all(t, F.lit(f"({T.java(p)})"), F.lit(1))
    for a, b, c, d in rows.select(U.text_emails(t), plain(L.EMAIL), U.bare_urls(t), plain(L.URL)).collect():
        assert (a, c) == (b, d)
    flat = spark.createDataFrame([(c,) for c in ["a  b\t c", " -a- b -", "é ß +1", "   ", "a\n\nb", ", , x"]], "t string")
    old = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower("t"), r"[^\p{L}\p{N}+]+", " ")), F.lit(" "))
    assert all(a == b for a, b in flat.select(T.flatten(t), old).collect())


def test_phrases_are_sought_by_their_rarest_word(spark):
    phrases = ["we are hiring", "i am looking for a new role", "to get the link", "hiring", "c++", "a b", "b a"]
    by_key = T.key_words(phrases)
    assert by_key["hiring"] == ["we are hiring", "hiring"] and "i" not in by_key and "we" not in by_key
    flat = spark.createDataFrame([(" we are hiring c++ ",), (" i am looking for a new role a b a ",), (" hirings ",), (None,)], "t string")
    assert [r[0] and set(r[0]) for r in flat.select(T.phrases_in(F.col("t"), phrases)).collect()] == [{"we are hiring", "hiring", "c++"}, {"i am looking for a new role", "a b", "b a"}, [], None]


def test_tokens_are_made_only_where_they_may_hold_the_label(spark):
    rows = spark.createDataFrame([("Acme-1", " the acme 1 team "), ("acme", " a cm e x "), ("acme", " acne me "), ("abc", " a b c d "), ("ab", " ab ")], "l string, f string")
    may, found = zip(*rows.select(T.may_be_in_tokens(F.col("l"), F.col("f")), T.label_in_tokens(F.col("l"), T.tokens(F.col("f")))).collect(), strict=True)
    assert may == (True, True, False, True, True) and found == (True, True, False, True, False)


def test_domains_of_a_list_as_by_suffixes(spark):
    from postlens.functions import lexicon as L

    hosts = ["gmail.com", "x.gmail.com", "xgmail.com", "gmail.com.", "gmailxcom", "gmail.com\n", "", "a.zohomail.in", None, ".me.com"]
    rows = spark.createDataFrame([(h,) for h in hosts], "h string")
    for got, want in rows.select(U.in_domain_list(F.col("h"), L.FREE_EMAIL_DOMAINS), F.arrays_overlap(U.suffixes(F.col("h")), T.strings(L.FREE_EMAIL_DOMAINS))).collect():
        assert got == want
    entries = [("b.com", "/jobs", "First"), ("a.b.com", "", "Second"), ("b.com", "", "Third")]
    urls = spark.createDataFrame([("x.a.b.com", "/JOBS/1"), ("a.b.com", "/"), ("b.com", "/"), ("cb.com", "/jobs"), ("b.com", "/jobs")], "h string, p string")
    assert [r[0] for r in urls.select(U.find_domain(F.col("h"), F.col("p"), entries)).collect()] == ["First", "Second", "Third", None, "First"]


def test_gold_labels_search_plainly(spark):
    gold = judged_posts(spark, SMALL).select("gold")
    assert "rlike" not in gold._jdf.queryExecution().optimizedPlan().toString().lower()
    texts = ["DEPOSIT", "paid per  day", "9/Day", "comment Interested", "comment  yes", "apply", "vacanc", "join our team"]
    rows = spark.createDataFrame([(t, 1.0, 0, None) for t in texts], "text string, age_hours double, comments bigint, href string")
    assert [r[0] for r in rows.select(judged_gold()).collect()] == ["scam_risk", "not_hiring", "scam_risk", "engagement_bait", "not_hiring", "unverified", "not_hiring", "unverified"]


def general_flatten(low):
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}+]+", " ")), F.lit(" "))


def test_blanked_text_as_by_the_pattern(spark):
    # each character of the first planes alone, between letters and beside a space; then runs and mixtures of them
    points = [*range(0xD800), *range(0xE000, 0x1F800)]
    rows = [("".join(f"a{chr(c)}b {chr(c)}" for c in points[i : i + 1]),) for i in range(0, 0x3400)]
    rows += [("".join(f"x{chr(c)}y {chr(c)}{chr(c)} " for c in points[i : i + 8]),) for i in range(0, len(points), 8)]
    rows += [("a,  b\n\n \t c...d",), (" ,; ",), ("",), (None,), ("c++ , x\uA7FA+",), ("c++ , +x + ,+, y",), ("²  a -- é",), ("ab" + " . " * 50 + "c",)]
    t = spark.createDataFrame(rows, "t string").repartition(8).select(F.lower("t").alias("t"))
    assert t.where(~T.flatten_low(F.col("t")).eqNullSafe(general_flatten(F.col("t")))).count() == 0


def test_labels_are_found_without_lists_of_tokens(spark):
    assert "_tokens" not in plan(spark, "label_counts") and "arrays_zip(_plain" not in plan(spark, "label_counts")
    flats = [" the acme 1 team ", " a cm e x ", " acne me ", " a b c d ", " ab ", " a a aa aa a ", " xacme acmex ", " ac me 1 ", "  ", " é acme ñ ", " a c m e ", None, " aab aa b aab ", " " + "q" * 70 + " "]
    labels = ["Acme-1", "acme", "abc", "ab", "aaaa", "aaaaaa", "aab", "", None, "+a.b(c", "q" * 70, "q" * 35 + "-" + "q" * 35]
    rows = spark.createDataFrame([(x, f) for x in labels for f in flats], "l string, f string")
    for label, f, got, want in rows.select("l", "f", T.label_in_flat(F.col("l"), F.col("f")), T.label_in_tokens(F.col("l"), T.tokens(F.col("f")))).collect():
        assert got == want, (label, f)


def test_posts_are_spread_over_several_tasks_a_core(spark):
    assert derived_posts(spark, SMALL).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_phrases_of_text_that_is_not_flattened(spark):
    phrases = ["apply", "apply now", "we are hiring", "hiring", "c++", "comment below", "comment below for referral", "for referral", "now", "a b", "sde", "sde 1", "sde1", "1 a b", "node", "next js"]
    texts = ["Apply -- NOW, we\n\tare   hiring!", "reapply nowhere hirings", "c++, (c++) c+++ c", "comment below: for a referral", "#comment below; for.referral", "sde 1 sde1 sde-1", "éapply applyé apply_é", "a, b a b", "1 a b", "next.js nodé", " apply now​", "\U0001d400apply apply\U0001f600now", "apply", " ", "", None, "x " * 30000 + "now"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.lower("t").alias("low"))
    for got, want in rows.select(T.phrases_in_low(F.col("low"), phrases), T.phrases_in(T.flatten_low(F.col("low")), phrases)).collect():
        assert got == want or (len(got) == len(set(got)) and set(got) == set(want))


def test_contacts_are_cut_out_word_by_word(spark):
    from postlens.functions import lexicon as L

    texts = ["Mail a@b.com, c@d.de/x or www.q.com/(y) end", "x@y.com/jobs z@w.io@v.com", "WWW.Q and http://a b", "no contacts . at all @ / here", "a@b.com\nwww.c\thttp://d.com/e f", "  a@b.co  ", "bit.ly/x-foo.com/y", ""]
    t = F.col("t")
    plain = F.regexp_replace(F.regexp_replace(t, T.java(L.EMAIL), " "), T.java(L.URL), " ")
    assert all(a == b for a, b in spark.createDataFrame([(x,) for x in texts], "t string").select(U.without_contacts(t), plain).collect())


def test_text_is_flattened_for_labels_only_where_it_may_hold_one(spark):
    rows = spark.createDataFrame([("Acme-1", "the ac, me 1 team"), ("acme", "x a-c\nm e"), ("acme", "acne me"), ("abc", "abcd"), ("ab", "ab"), ("a" * 70, "b"), ("acme", "acém e"), (None, "acme")], "l string, t string")
    may, found = zip(*rows.select(T.may_be_in_text(F.col("l"), F.col("t")), T.label_in_flat(F.col("l"), T.flatten(F.col("t")))).collect(), strict=True)
    assert all(m for m, f in zip(may, found, strict=True) if f) and found[0] and may == (True, True, False, True, False, True, False, None)


def test_not_hiring_needs_no_companies(spark):
    assert "poster_at_company" not in plan(spark, "not_hiring_reasons")


def test_other_features_than_wanted_are_not_made(spark):
    assert "poster_at_company" not in plan(spark, "channels")


def test_evaluation_makes_lower_case_once(spark):
    assert plan(spark, "label_report").count("lower(text#") == 1
