"""The registered queries of the engine: each applies its operators to whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..functions import urls as U
from ..operators import decision as D
from ..operators import domains as DM
from ..operators import evaluation as E
from ..operators import reasons as R
from ..operators import settings as ST
from ..operators import stores as S
from ..operators.features import SPECIFIC, classify_urls, collect_urls, exposure, extract_features, specificity
from .posts import derived_posts, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", *columns))


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.decide(extract_features(derived_posts(spark, sf_dir)))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels without reasons, from the features that labels need."""
    return D.decide_labels(extract_features(derived_posts(spark, sf_dir), label_only=True))


def joined(c: Column) -> Column:
    return F.array_join(c, "|")


@query
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))


@query
def label_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).groupBy("source", "label").agg(F.count("*").alias("n"))


@query
def post_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, f = labelled(spark, sf_dir), F.col("features")
    return d.select("doc_id", "label", D.stage1(f).alias("stage1"), D.has_genuine_channel(f).alias("genuine"), D.weak_scam_count(f).cast("int").alias("weak_scam"), D.has_strong_scam(f).alias("strong_scam"))


@query
def phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derived_posts(spark, sf_dir).select("doc_id", T.flatten(F.col("text")).alias("flat"))
    lists = {"hiring": L.HIRING_KEYWORDS, "seeker": L.SEEKER_PHRASES, "not_hiring": L.NOT_HIRING_PHRASES, "bait": L.BAIT_PHRASES, "weak_bait": L.WEAK_BAIT_WORDS, "scam": L.SCAM_PHRASES}
    d = d.select("doc_id", T.phrases_in(F.col("flat"), [p for v in lists.values() for p in v]).alias("found"))
    return d.select("doc_id", *[joined(T.among(F.col("found"), v)).alias(k) for k, v in lists.items()])


@query
def phrase_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derived_posts(spark, sf_dir).select(T.flatten(F.col("text")).alias("flat"))
    lists = (L.HIRING_KEYWORDS, L.BAIT_PHRASES, L.SCAM_PHRASES)
    d = d.select(T.phrases_in(F.col("flat"), [p for v in lists for p in v]).alias("found"))
    hits = F.concat(*[T.among(F.col("found"), v) for v in lists])
    return S.frequency(d.select(F.explode(hits).alias("phrase")), "phrase", 25)


@query
def specificity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derived_posts(spark, sf_dir).select("doc_id", "text", F.lower("text").alias("low"), T.phrases_in(T.flatten(F.col("text")), SPECIFIC).alias("found"))
    return d.select("doc_id", specificity(F.col("text"), "low", F.col("found")).alias("s")).select("doc_id", "s.*")


@query
def exposure_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derived_posts(spark, sf_dir).select("doc_id", F.struct(exposure().alias("exposure")).alias("f"))
    return d.select("doc_id", D.exposure_label(F.col("f")).alias("exposure_label"), F.round("f.exposure.comments_per_hour", 6).alias("per_hour"))


@query
def url_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derived_posts(spark, sf_dir).select("doc_id", classify_urls(collect_urls(F.col("links"), F.col("text"))).alias("u"))
    count = lambda k: F.size(F.filter("u", lambda u: u["kind"] == k)).cast("int")
    names = F.array_distinct(F.transform(F.filter("u", lambda u: u["kind"] == "ats"), lambda u: u["name"]))
    return d.select("doc_id", joined(F.transform("u", lambda u: u["kind"])).alias("kinds"), joined(names).alias("ats_names"), count("opaque").alias("opaque_links"), count("shortener").alias("shortener_links"))


@query
def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = ("careers_page", "google_form", "whatsapp", "telegram", "corporate_email", "free_email_provider", "dm_only")
    d = extract_features(derived_posts(spark, sf_dir), only=(*same, "corporate_email_matches_company"))
    return d.select("doc_id", *[F.col(f"features.{c}").alias(c) for c in same], F.col("features.corporate_email_matches_company").alias("corporate_matches"))


@query
def pending_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = extract_features(derived_posts(spark, sf_dir), label_only=True).withColumn("scores", D.no_scores())
    # as if the hiring question had been left open: the reference point of a first round
    return d.select("doc_id", joined(D.pending_questions(F.col("features"), F.col("scores"), F.col("text_units"))).alias("questions"))


@query
def not_hiring_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the only reason of this label: it needs no more features than the label does
    return labelled(spark, sf_dir).where("label = 'not_hiring'").select("doc_id", R.reason_line(R.parts(R.not_hiring_reason(F.col("features")))).alias("line"))


@query
def bait_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir).where("label = 'engagement_bait'").select("doc_id", R.reason_line(F.col("reasons")).alias("line"))


@query
def reason_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir).select("doc_id", R.label_text(F.col("label")).alias("label"), R.reason_line(F.col("reasons")).alias("line"))


@query
def company_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = extract_features(derived_posts(spark, sf_dir))
    return d.select("doc_id", joined(U.company_candidates(F.col("text"))).alias("companies"), F.col("features.poster_at_company").alias("poster_at_company"))


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", U.parse_url(F.col("url")).alias("u"))


@query
def careers_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_urls(spark, sf_dir).select("page_id", "u.host", "u.path", U.is_careers_link(F.col("u")).alias("careers"))


@query
def url_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_urls(spark, sf_dir).groupBy(U.url_key(F.col("u")).alias("key")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


@query
def registrable_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_urls(spark, sf_dir).select("u.host").distinct().select("host", U.registrable_label(F.col("host")).alias("label"))


@query
def email_domain_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir, "text").select("doc_id", F.explode(U.email_domains(F.lit(None).cast("array<string>"), F.col("text"))).alias("domain"))
    return d.select("doc_id", "domain", U.in_domain_list(F.col("domain"), L.FREE_EMAIL_DOMAINS).alias("free"), U.registrable_label(F.col("domain")).alias("label"))


@query
def url_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct URLs of all posts, joined with the lists of job sites and forms by host suffix."""
    d = derived_posts(spark, sf_dir).select(F.explode(collect_urls(F.col("links"), F.col("text"))).alias("u")).select("u.host", "u.path").distinct()
    urls = d.select(F.concat("host", "path").alias("key"), "host", "path")
    found = DM.first_entries(urls, DM.entry_table(spark, [*L.ATS_DOMAINS, *L.FORM_DOMAINS]))
    return found.select("key", "name", F.col("ord").cast("int").alias("ord"))


@query
def corporate_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, domain) of email domains that are not in the list of free providers: an anti-join."""
    d = documents(spark, sf_dir, "text").select("doc_id", F.explode(U.email_domains(F.lit(None).cast("array<string>"), F.col("text"))).alias("domain"))
    free = spark.createDataFrame([(x,) for x in L.FREE_EMAIL_DOMAINS], "domain string")
    return d.join(DM.listed(d, free, "domain"), "domain", "left_anti").select("doc_id", "domain")


@query
def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, "text").select("doc_id", T.redact_contacts(F.col("text")).alias("text"))


@query
def redact_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir, "text").where(T.matches(F.col("text"), L.EMAIL))
    return d.select("doc_id", F.sha2(T.redact_emails(F.col("text")), 256).alias("digest"))


@query
def flatten_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, "text").select("doc_id", F.sha2(T.flatten(F.col("text")), 256).alias("digest"))


@query
def text_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.sha256_id(F.col("doc_id")).alias("id_hash"), F.sha1(t).alias("text_sha1"), T.stable_split(t).alias("split"))


@query
def post_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, "text").select("doc_id", T.hash_text(F.col("text")).alias("hash"))


@query
def age_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = ["s", " secs", "m", " minutes ago", "h", " hours", "d", " days", "w", " wks", "mo", " months ago", "y", " years", " x"]
    i = F.col("event_id")
    raw = F.concat((i % 40).cast("string"), F.element_at(F.array(*map(F.lit, units)), (i % 15 + 1).cast("int")))
    d = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    return d.select("event_id", "raw", F.round(T.parse_age_hours(F.col("raw")), 6).alias("hours"))


@query
def age_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", T.format_age((F.col("event_id") * 37 % 20000) / 8.0).alias("age"))


@query
def count_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    raw = F.when(i % 4 == 0, F.format_number(i, 0)).when(i % 4 == 1, F.concat((i % 100).cast("string"), F.lit(".5K"))).when(i % 4 == 2, F.concat((i % 9).cast("string"), F.lit("M"))).otherwise(F.concat(i.cast("string"), F.lit(" comments")))
    d = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    return d.select("event_id", "raw", T.parse_count(F.col("raw")).alias("n"))


@query
def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.daily_label_counts(table(spark, sf_dir, "events"), "ts", "event_type")


@query
def seen_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.seen_once(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", "ts", "event_id").drop("ts")


@query
def dataset_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"), "ts")
    return S.latest_per_key(e, "user_id", "ts", "event_id").drop("ts")


@query
def score_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.scoring import cache_misses

    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_key"))
    wanted = d.withColumn("question", F.explode(F.array(F.lit("hiring"), F.lit("bait"), F.lit("scam"))))
    cache = d.where("text_key % 3 = 0").withColumn("question", F.explode(F.array(F.lit("hiring"), F.lit("bait"))))
    return cache_misses(wanted, cache).select(F.col("text_key").alias("doc_id"), "question")


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a simple prediction from their length."""
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    word = lambda c: F.when(c, "good").otherwise("bad")
    return d.select("doc_id", word(F.col("quality") == 1).alias("gold"), word(F.col("n_chars") >= 1500).alias("pred"), F.least(F.col("n_chars") / 5000, F.lit(1.0)).alias("score"))


GRADES = ["good", "bad", "none"]


@query
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.accuracy(graded(spark, sf_dir)).select(F.round("accuracy", 6).alias("accuracy"), "n")


@query
def per_label_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.per_label(graded(spark, sf_dir), GRADES).select("label", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.macro_f1(graded(spark, sf_dir), GRADES).select(F.round("macro_f1", 6).alias("macro_f1"))


@query
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confusion_matrix(graded(spark, sf_dir), GRADES[:2])


def swept(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = E.threshold_grid(spark, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6], [0.7, 0.8, 0.9], [0.95])
    pred = F.when((F.col("score") >= F.col("t_hiring")) & (F.col("score") < F.col("t_bait")), "good").otherwise("bad")
    return E.sweep(graded(spark, sf_dir), grid, pred, GRADES[:2])


def shown(d: DataFrame) -> DataFrame:
    return d.select("grid_ord", "t_hiring", "t_bait", "t_scam", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


@query
def threshold_sweep_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(E.sweep_top(swept(spark, sf_dir), 8))


@query
def best_per_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(E.best_per_hiring(swept(spark, sf_dir)))


def text_score(which: int) -> Column:
    """A made-up score in [0, 1] that follows from the whole text: four hexadecimal digits of its hash."""
    return F.conv(F.substring(F.sha1("text"), 4 * which + 1, 4), 16, 10).cast("double") / 65535


def judged_gold(low: Column | None = None) -> Column:
    """Gold labels by a rule of their own: as somebody might label posts at a glance. low: a column of the text in lower case, so that it is made once and not for each word."""
    low = F.lower("text") if low is None else low
    # plain searches: a pattern of alternatives tries each of them at every place of the text
    has = lambda *words: reduce(or_, [F.contains(low, F.lit(w)) for w in words])
    fresh = F.coalesce(F.col("age_hours") <= 24, F.lit(False)) & (F.coalesce("comments", F.lit(0)) < 50)
    return (
        F.when(has("deposit", "bank details", "registration fee", "per day", "/day", "payout"), "scam_risk").when(has("comment yes", "comment interested", "repost", "follow me"), "engagement_bait")
        .when(~has("hiring", "apply", "vacancy", "resume", "join our team"), "not_hiring").when(F.col("href").isNull(), "unverified").when(fresh, "apply_early")
        .when(F.coalesce("comments", F.lit(0)) >= 200, "crowded").otherwise("real_opening")
    )


def judged_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posts relation with `_low`, `gold` and `scores`."""
    posts = derived_posts(spark, sf_dir).withColumns({"href": F.get("links", F.lit(0))["href"], "_low": F.lower("text")})
    return posts.withColumn("gold", judged_gold(F.col("_low"))).withColumn("scores", F.struct(text_score(0).alias("hiring"), text_score(1).alias("bait"), text_score(2).alias("scam")))


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, gold, features, text_units, scores) of the posts relation."""
    return extract_features(judged_posts(spark, sf_dir), label_only=True).select("doc_id", "text", "gold", "features", "text_units", "scores")


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, gold, pred, calls): labels in two rounds with the thresholds in use."""
    return E.in_rounds(evaluated(spark, sf_dir)).select("doc_id", "text", "gold", "pred", "calls")


@query
def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicted(spark, sf_dir).select("doc_id", "gold", "pred", F.col("calls").cast("int").alias("calls"))


@query
def label_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    # both come from the counts of (gold, pred): the posts are labelled once
    return E.accuracy_and_f1(predicted(spark, sf_dir)).select(F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"), "n")


@query
def label_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.per_label(predicted(spark, sf_dir)).select("label", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query
def label_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confusion_matrix(predicted(spark, sf_dir))


@query
def label_mistakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = predicted(spark, sf_dir)
    return d.where(F.col("gold") != F.col("pred")).select("doc_id", "gold", "pred", F.substring("text", 1, 110).alias("text"))


@query
def label_model_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicted(spark, sf_dir).agg(F.coalesce(F.sum("calls"), F.lit(0)).cast("long").alias("calls"), F.count_if(F.col("calls") > 0).alias("posts"))


def label_swept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.swept_labels(evaluated(spark, sf_dir), E.GRID["hiring"], E.GRID["bait"], E.GRID["scam"])


@query
def label_sweep_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(E.sweep_top(label_swept(spark, sf_dir), 8))


@query
def label_sweep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(E.best_per_hiring(label_swept(spark, sf_dir)))


@query
def label_sweep_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(E.current_row(label_swept(spark, sf_dir)))


@query
def labels_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by the settings of a post's day, from a short history of settings; days follow from the texts' lengths."""
    versions = spark.createDataFrame([("2026-01-10 00:00:00", None, 0.5, None, 0.4), ("2026-02-01 12:00:00", False, None, 0.6, None), ("2026-03-01 00:00:00", True, 0.9, None, None)], "at string, hide_not_hiring boolean, hiring double, bait double, scam double")
    versions = versions.select(F.lit("").alias("scope"), F.to_timestamp("at").alias("valid_from"), "hide_not_hiring", "hiring", "bait", "scam", *[F.lit(None).cast("boolean").alias(c) for c in ("enabled", "debug", "dataset_mode")])
    posts = judged_posts(spark, sf_dir).withColumn("ts", F.timestamp_seconds(F.lit(1767225600) + F.pmod(F.length("text"), F.lit(90)) * 86400 + 43200))
    # settings first: the last post's day is looked up over the posts as they are, not over their features
    d = extract_features(ST.with_settings(posts, versions), label_only=True)
    d = ST.shown_to(D.decide_labels(d, ST.thresholds(F.col("settings"))))
    return d.select("doc_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("settings.hiring").alias("t_hiring"), F.col("settings.bait").alias("t_bait"), F.col("settings.scam").alias("t_scam"), "label", "visible")


@query
def tag_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.regexp_extract_all(F.lower("html"), F.lit("<([a-z][a-z0-9]*)"), F.lit(1))
    return S.frequency(table(spark, sf_dir, "pages").select(F.explode(tags).alias("tag")), "tag", 25)


@query
def feed_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts read from rendered feed markup: every page's own html, and an invented feed page built around the whole text of each document."""
    from ..sources.html_feed import read_posts
    from .feeds import feed_markup

    return read_posts(feed_markup(spark, sf_dir)).select("page_id", "post_id", "text", "author_headline", "age_hours", "comments")
