"""Features (and optional scores) to one of seven labels: ordered rules as one CASE expression each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import once_a_session

SCORES = "struct<hiring double, bait double, scam double>"


@dataclass(frozen=True)
class Thresholds:
    """Least scores; each may be a number or a Column (as in a sweep)."""

    hiring: float | Column = L.HIRING_MIN_SCORE
    bait: float | Column = L.BAIT_THRESHOLD
    scam: float | Column = L.SCAM_THRESHOLD


def some(c: Column) -> Column:
    return F.size(c) > 0


def no_scores() -> Column:
    """Nothing was asked: all scores null."""
    return F.lit(None).cast(SCORES)


def has_strong_scam(f: Column) -> Column:
    return some(f["scam_hits"]) | some(f["pay_claim_hits"])


def stage1(f: Column) -> Column:
    """hiring, not_hiring or ask_model, by rules alone."""
    keyword = some(f["hiring_keyword_hits"])
    return (
        F.when(some(f["seeker_hits"]) | some(f["not_hiring_hits"]), "not_hiring").when(has_strong_scam(f) & (keyword | some(f["job_context_hits"])), "hiring")
        .when(~keyword, "not_hiring").when(some(f["ats_names"]) | f["careers_page"], "hiring").otherwise("ask_model")
    )


def weak_scam_count(f: Column) -> Column:
    signals = (f["whatsapp"] | f["telegram"], f["shortener_links"] > 0, f["free_email_provider"].isNotNull() & ~f["corporate_email"])
    return sum((s.cast("int") for s in signals), F.lit(0))


def has_genuine_channel(f: Column) -> Column:
    score = f["specificity"]["score"]
    return some(f["ats_names"]) | f["careers_page"] | f["corporate_email"] | (f["google_form"] & (score >= L.FORM_MIN_SPECIFICITY)) | ((f["opaque_links"] > 0) & (score >= L.OPAQUE_MIN_SPECIFICITY))


def is_hiring(f: Column, scores: Column, t: Thresholds) -> Column:
    first = stage1(f)
    return F.when(first != "ask_model", first == "hiring").otherwise(F.coalesce(scores["hiring"] >= t.hiring, F.lit(True)))


def pending_questions(f: Column, scores: Column, text_units: Column, t: Thresholds = Thresholds()) -> Column:
    """The questions that are still worth asking, given what is known."""
    weak = weak_scam_count(f)
    ask_scam = (weak > 0) & (weak < L.WEAK_SCAM_SIGNALS) & scores["scam"].isNull()
    ask_bait = ~has_genuine_channel(f) & ~some(f["bait_hits"]) & (some(f["weak_bait_hits"]) | f["dm_only"]) & scores["bait"].isNull()
    none = F.array().cast("array<string>")
    return (
        F.when(text_units < L.MIN_MODEL_TEXT, none).when((stage1(f) == "ask_model") & scores["hiring"].isNull(), F.array(F.lit("hiring")))
        .when(~is_hiring(f, scores, t) | has_strong_scam(f), none).otherwise(F.array_compact(F.array(F.when(ask_scam, "scam"), F.when(ask_bait, "bait"))))
    )


def exposure_label(f: Column) -> Column:
    e = f["exposure"]
    comments = F.coalesce(e["comments"], F.lit(0))
    early = F.coalesce(e["age_hours"] <= L.EARLY_MAX_HOURS, F.lit(False)) & (comments < L.EARLY_MAX_COMMENTS)
    crowded = (comments >= L.CROWDED_COMMENTS) | F.coalesce(e["age_hours"] > L.CROWDED_HOURS, F.lit(False)) | F.coalesce(e["comments_per_hour"] >= L.CROWDED_PER_HOUR, F.lit(False))
    return F.when(early, "apply_early").when(crowded, "crowded").otherwise("real_opening")


def over(score: Column, least: float | Column) -> Column:
    return F.coalesce(score >= least, F.lit(False))


def decide_label(f: Column, scores: Column, t: Thresholds = Thresholds()) -> Column:
    """The first rule that holds; a null score means "not asked"."""
    genuine = has_genuine_channel(f)
    return (
        F.when(~is_hiring(f, scores, t), "not_hiring")
        .when(has_strong_scam(f) | (weak_scam_count(f) >= L.WEAK_SCAM_SIGNALS) | over(scores["scam"], t.scam), "scam_risk")
        .when((some(f["bait_hits"]) & ~genuine) | over(scores["bait"], t.bait), "engagement_bait").when(genuine, exposure_label(f)).otherwise("unverified")
    )


def decision(t: Thresholds) -> tuple[Column, Column]:
    """Label and reasons, over columns features, scores and label."""
    from .reasons import reasons_for

    return decide_label(F.col("features"), F.col("scores"), t), reasons_for(F.col("label"), F.col("features"), F.col("scores"), t)


@once_a_session
def usual_decision(*least: float) -> tuple[Column, Column]:
    return decision(Thresholds(*least))


def with_scores(features: DataFrame) -> DataFrame:
    return features if "scores" in features.columns else features.withColumn("scores", no_scores())


def decide_labels(features: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Adds the label alone; features of labels only will do."""
    return with_scores(features).withColumn("label", decide_label(F.col("features"), F.col("scores"), t))


def decide(features: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Adds label and reasons; reads `scores` where the rows have it."""
    d = with_scores(features)
    numbers = all(isinstance(x, float) for x in (t.hiring, t.bait, t.scam))
    label, reasons = usual_decision(t.hiring, t.bait, t.scam) if numbers else decision(t)
    return d.withColumn("label", label).withColumn("reasons", reasons)
