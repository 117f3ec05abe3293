"""Reason lines, from templates only: at most four short parts per label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import format_age
from .decision import Thresholds, over, some


def parts(*cs: Column) -> Column:
    """An array of what is not null or empty."""
    return F.filter(F.array(*cs), lambda c: c.isNotNull() & (c != ""))


def nth(a: Column, i: int) -> Column:
    return F.get(a, F.lit(i))


def age_reason(f: Column) -> Column:
    age = format_age(f["exposure"]["age_hours"])
    return F.when(age == "just now", "posted just now").when(age.isNotNull(), F.concat(F.lit("posted "), age, F.lit(" ago")))


def comments_reason(f: Column) -> Column:
    c = f["exposure"]["comments"]
    return F.when(c.isNotNull(), F.concat(F.format_number(c, 0), F.when(c == 1, " comment").otherwise(" comments")))


def channel_reason(f: Column) -> Column:
    return (
        F.when(some(f["ats_names"]), F.concat(F.lit("Apply link on "), nth(f["ats_names"], 0))).when(f["careers_page"], "Links to company careers page")
        .when(f["corporate_email"], F.when(f["corporate_email_matches_company"], "Company email address").otherwise("Work email address"))
        .when(f["google_form"], "Google Form with role details").when(f["opaque_links"] > 0, "Apply link with role details")
    )


def scam_reason(hit: Column) -> Column:
    out = F.concat(F.lit("Mentions "), hit)
    for phrase, reason in L.SCAM_REASONS.items():
        out = F.when(hit == phrase, F.lit(reason)).otherwise(out)
    return out


def scam_reasons(f: Column, scores: Column, t: Thresholds) -> Column:
    said = F.slice(F.array_distinct(F.transform(f["scam_hits"], scam_reason)), 1, 2)
    rest = parts(
        nth(f["pay_claim_hits"], 0), F.when(f["whatsapp"], "WhatsApp contact"), F.when(f["telegram"], "Telegram contact"), F.when(f["shortener_links"] > 0, "Shortened link"),
        F.when(f["free_email_provider"].isNotNull() & ~f["corporate_email"], F.concat(f["free_email_provider"], F.lit(" address"))), F.when(over(scores["scam"], t.scam), "Reads like a pay-to-join offer"),
    )
    return F.concat(said, rest)


def bait_reasons(f: Column, scores: Column, t: Thresholds) -> Column:
    asks = F.transform(F.slice(f["bait_hits"], 1, 2), lambda h: F.concat(F.lit('Asks you to "'), h, F.lit('"')))
    model = F.when(~some(f["bait_hits"]) & over(scores["bait"], t.bait), "Reads like engagement bait")
    return F.concat(asks, parts(model, F.when(f["dm_only"], 'Only "DM me"').when(channel_reason(f).isNull(), "no apply link"), comments_reason(f)))


def not_hiring_reason(f: Column) -> Column:
    return (
        F.when(F.array_contains(f["seeker_hits"], "opentowork"), "Job seeker post (#OpenToWork)").when(some(f["seeker_hits"]), "Job seeker post").when(some(f["not_hiring_hits"]), "Personal career update")
        .when(~some(f["hiring_keyword_hits"]), "No hiring keywords").otherwise("Reads like a story, advice or update")
    )


def unverified_reasons(f: Column) -> Column:
    first = (
        F.when(f["dm_only"], 'Only "DM me"').when(f["google_form"], "Google Form, few role details").when(f["opaque_links"] > 0, "Link destination hidden, few role details")
        .when(f["free_email_provider"].isNotNull(), F.concat(f["free_email_provider"], F.lit(" address only"))).otherwise("No apply link or company email")
    )
    return parts(first, F.when(f["whatsapp"], "WhatsApp contact"), F.when(f["telegram"], "Telegram contact"), age_reason(f))


def reasons_for(label: Column, f: Column, scores: Column, t: Thresholds = Thresholds()) -> Column:
    fast = F.when(F.coalesce(f["exposure"]["comments_per_hour"] >= L.CROWDED_PER_HOUR, F.lit(False)), "comments piling up fast")
    every = (
        F.when(label == "not_hiring", parts(not_hiring_reason(f))).when(label == "scam_risk", scam_reasons(f, scores, t)).when(label == "engagement_bait", bait_reasons(f, scores, t))
        .when(label == "unverified", unverified_reasons(f)).when(label == "crowded", parts(channel_reason(f), age_reason(f), comments_reason(f), fast))
        .otherwise(parts(channel_reason(f), age_reason(f), comments_reason(f), F.when(f["poster_at_company"], "poster works there")))
    )
    return F.slice(every, 1, L.MAX_REASONS)


def reason_line(reasons: Column) -> Column:
    return F.concat_ws(" · ", reasons)


def label_text(label: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in L.LABEL_TEXT.items():
        out = F.when(label == k, F.lit(v)).otherwise(out)
    return out
