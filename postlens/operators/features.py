"""Posts to features: explainable signals from text, links, emails and engagement counts.

A post is a row of post_id, text, author_headline, age_text, age_hours, reactions,
comments, reposts, links (array of href and text) and emails. The features hold no
text, name, address or link of the post. Everything is a Column expression in staged
selects, so that Catalyst evaluates each intermediate once per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..functions import urls as U
from ..functions.compose import nfkc

POST_SCHEMA = "post_id string, text string, author_headline string, age_text string, age_hours double, reactions bigint, comments bigint, reposts bigint, links array<struct<href string, text string>>, emails array<string>"

FEATURES = [
    "hiring_keyword_hits", "job_context_hits", "seeker_hits", "not_hiring_hits", "ats_names", "careers_page", "google_form",
    "opaque_links", "shortener_links", "whatsapp", "telegram", "corporate_email", "corporate_email_matches_company",
    "free_email_provider", "dm_only", "bait_hits", "weak_bait_hits", "scam_hits", "pay_claim_hits", "poster_at_company",
    "specificity", "exposure", "age_text",
]


#: Features that are shown, or stored, but decide nothing.
NOT_FOR_LABELS = {"corporate_email_matches_company", "poster_at_company", "age_text"}

SPECIFIC = [*L.ROLE_TERMS, *L.TECH_TERMS, *L.LOCATION_TERMS]
WHATSAPP, TELEGRAM = ["whatsapp", "whats app"], ["telegram"]
PHRASES = [
    *L.HIRING_KEYWORDS, *L.JOB_CONTEXT_WORDS, *L.SEEKER_PHRASES, *L.NOT_HIRING_PHRASES, *L.BAIT_PHRASES, *L.WEAK_BAIT_WORDS, *L.SCAM_PHRASES, *L.DM_PHRASES, *WHATSAPP, *TELEGRAM, *SPECIFIC,
]


def one_row(c: Column) -> Column:
    """The same value by way of a one-element array: filters on it stay above, in place of repeating its whole expression below."""
    return F.explode(F.array(c))


def collect_urls(links: Column, text: Column, low: Column | None = None) -> Column:
    """Distinct parsed URLs of link targets, link texts and bare URLs in the text, first seen first."""
    listed = F.flatten(F.transform(F.coalesce(links, F.array().cast("array<struct<href:string,text:string>>")), lambda x: F.array(x["href"], x["text"])))
    parsed = F.filter(F.transform(F.concat(listed, U.bare_urls(text, low)), U.parse_url), lambda u: u.isNotNull())
    keyed = F.transform(parsed, lambda u: F.struct(U.url_key(u).alias("key"), u["host"].alias("host"), u["path"].alias("path")))
    return T.let(keyed, lambda k: T.let(F.transform(k, lambda u: u["key"]), lambda keys: F.filter(k, lambda u, i: F.array_position(keys, u["key"]) == i + 1)))


def classify_urls(urls: Column, matches_company: Column | None = None) -> Column:
    """Per URL: struct(kind, name, label); kind is ats, internal, form, whatsapp, telegram, opaque, shortener, careers or other."""

    def one(u: Column) -> Column:
        host, path = u["host"], u["path"]
        ats = U.find_domain(host, path, L.ATS_DOMAINS)
        kind = (
            F.when(ats.isNotNull(), "ats").when(U.host_matches(host, "linkedin.com"), "internal").when(U.find_domain(host, path, L.FORM_DOMAINS).isNotNull(), "form")
            .when(U.in_domain_list(host, L.WHATSAPP_DOMAINS), "whatsapp").when(U.in_domain_list(host, L.TELEGRAM_DOMAINS), "telegram")
            .when(U.in_domain_list(host, L.OPAQUE_LINK_DOMAINS), "opaque").when(U.in_domain_list(host, L.SHORTENER_DOMAINS), "shortener")
            .when(U.is_careers_link(u), "careers").otherwise("other")
        )
        return F.struct(kind.alias("kind"), ats.alias("name"), U.registrable_label(host).alias("label"))

    return F.transform(urls, one)


def specificity(text: Column, low: Column | str, found: Column) -> Column:
    """low: the text in lower case; found: phrases_in() of SPECIFIC at least."""
    parts = {
        "role_title": T.any_among(found, L.ROLE_TERMS), "experience": T.matches_any_if(text, low, L.EXPERIENCE), "tech_stack": T.any_among(found, L.TECH_TERMS),
        "location": T.any_among(found, L.LOCATION_TERMS), "salary": T.matches_any_if(text, low, L.SALARY),
    }
    score = sum((c.cast("int") for c in parts.values()), F.lit(0))
    return F.struct(*[c.alias(k) for k, c in parts.items()], score.cast("int").alias("score"))


def exposure() -> Column:
    per_hour = F.when(F.col("comments").isNotNull() & F.col("age_hours").isNotNull(), F.col("comments") / F.greatest("age_hours", F.lit(1.0)))
    return F.struct("age_hours", "comments", "reactions", "reposts", per_hour.alias("comments_per_hour"))


@T.once_a_session
def stages(compose: bool, label_only: bool = False, only: tuple[str, ...] = ()) -> list[dict[str, Column]]:
    """The columns that each step adds; the last holds the features (those of `only`, if there are any)."""
    text, low = F.col("text"), F.col("_low")
    # only labels are looked up there
    labelled = (F.size("_careers") > 0) | (F.size("_corporate") > 0)
    in_headline = lambda label: T.label_in_flat(label, F.col("_headline"))
    of_company = lambda label: in_headline(label) | T.label_in_flat(label, F.col("_flat"))
    free = lambda h: U.in_domain_list(h, L.FREE_EMAIL_DOMAINS)
    any_url = lambda kind: F.exists("_urls", lambda u: u["kind"] == kind)
    count = lambda kind: F.size(F.filter("_urls", lambda u: u["kind"] == kind))
    phrases = lambda words: T.among(F.col("_found"), words)
    has = lambda words: T.any_among(F.col("_found"), words)
    external = F.size(F.filter("_urls", lambda u: u["kind"] != "internal"))
    headline_label = lambda x: F.coalesce(F.exists(x, in_headline), F.lit(False))
    # a headline without a word (two spaces) holds no company
    companies = F.when(F.length("_headline") > 2, F.exists(U.company_candidates(text, low), lambda c: F.contains(F.col("_headline"), T.flatten(c))))
    made = {
        "hiring_keyword_hits": phrases(L.HIRING_KEYWORDS),
        "job_context_hits": phrases(L.JOB_CONTEXT_WORDS),
        "seeker_hits": phrases(L.SEEKER_PHRASES),
        "not_hiring_hits": phrases(L.NOT_HIRING_PHRASES),
        "ats_names": F.array_distinct(F.transform(F.filter("_urls", lambda u: u["kind"] == "ats"), lambda u: u["name"])),
        "careers_page": F.exists("_careers", of_company),
        "google_form": any_url("form"),
        "opaque_links": count("opaque"),
        "shortener_links": count("shortener"),
        "whatsapp": any_url("whatsapp") | has(WHATSAPP),
        "telegram": any_url("telegram") | has(TELEGRAM),
        "corporate_email": F.size("_corporate") > 0,
        "corporate_email_matches_company": F.exists("_corporate", of_company),
        "free_email_provider": F.get("_free", F.lit(0)),
        "dm_only": has(L.DM_PHRASES) & (external == 0) & (F.size("_domains") == 0),
        "bait_hits": phrases(L.BAIT_PHRASES),
        "weak_bait_hits": phrases(L.WEAK_BAIT_WORDS),
        "scam_hits": phrases(L.SCAM_PHRASES),
        "pay_claim_hits": F.array_compact(F.array(*[F.when(T.matches_if(text, "_low", p), F.lit(r)) for p, r in L.PAY_CLAIMS])),
        "poster_at_company": headline_label(F.col("_careers")) | headline_label(F.col("_corporate")) | F.coalesce(companies, F.lit(False)),
        "specificity": specificity(text, "_low", F.col("_found")),
        "exposure": exposure(),
        "age_text": F.col("age_text"),
    }
    if label_only:
        counts = any_url("form") | (count("opaque") > 0)
        made["specificity"] = F.when(counts, made["specificity"])
    names = [k for k in only or FEATURES if not (label_only and k in NOT_FOR_LABELS)]
    return [
        {"_low": F.lower("text")},
        {"_headline": T.flatten(F.coalesce("author_headline", F.lit("")), compose), "_found": T.phrases_in_low(nfkc(low) if compose else low, PHRASES), "_urls": classify_urls(collect_urls(F.col("links"), text, low)), "_domains": U.email_domains(F.col("emails"), text, low)},
        {
            "_careers": F.transform(F.filter("_urls", lambda u: u["kind"] == "careers"), lambda u: u["label"]),
            "_free": F.filter("_domains", free),
            "_corporate": F.transform(F.filter("_domains", lambda h: ~free(h)), lambda h: F.coalesce(U.registrable_label(h), F.lit(""))),
        },
        {"_bare": F.when(labelled, F.when(U.has_contacts(text, low), F.lower(U.without_contacts(text, low))).otherwise(low))},
        {"_flat": F.when(F.lit(compose) | F.exists(F.concat("_careers", "_corporate"), lambda label: T.may_be_in_text(label, F.col("_bare"))), T.flatten_low(F.col("_bare"), compose))},
        {"text_units": T.utf16_length(text), "features": one_row(F.struct(*[made[k].alias(k) for k in names]))},
    ]


def extract_features(posts: DataFrame, compose: bool = False, label_only: bool = False, only: Sequence[str] = ()) -> DataFrame:
    """All columns of the posts, with `features` and `text_units` (the text's length in UTF-16 units).

    compose applies Unicode compatibility composition before matching. label_only leaves out what
    no label or question to a model depends on: NOT_FOR_LABELS, and specificity where there is neither a form nor an opaque link.
    only: the features that are wanted, where that is not all. Posts may bring their text in lower case as `_low`.
    """
    d, steps = posts, stages(compose, label_only, tuple(only))
    for step in steps["_low" in posts.columns : -1]:
        d = d.select("*", *[c.alias(k) for k, c in step.items()])
    return d.select(*posts.columns, *[c.alias(k) for k, c in steps[-1].items()])
