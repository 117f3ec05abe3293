"""Optional scores for the questions that rules leave open, with a cache table.

A scorer is any object with score(question, texts) -> probabilities. No model is
shipped: without a scorer the rules decide alone, and a null score means "not asked".
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import score_key
from .decision import SCORES, Thresholds, decide, pending_questions

CACHE = "text_key string, question string, score double"
#: Per question the hypothesis that counts, and the one against it.
QUESTIONS = {
    "hiring": ("announces open jobs that people can apply for", "shares a story, advice, opinion or news"),
    "bait": ("requires readers to comment or follow in order to be considered for a job", "gives a direct way to apply for a job"),
    "scam": ("asks candidates to pay money or share sensitive personal documents", "describes a normal job application process"),
}


#: Seconds for which a task leaves a failing scorer alone.
PAUSE = 30.0


class Scorer(Protocol):
    def score(self, question: str, texts: Sequence[str]) -> Sequence[float | None]: ...


class ScorerFailed(Exception):
    """Raised by a scorer whose model can't answer: the rules then stand alone. Any other exception is an error and fails the job."""


@dataclass(frozen=True)
class ScorerFactory:
    """Makes a scorer where it is needed: `make` runs once in each worker process, under this name."""

    name: str
    make: Callable[[], Scorer]


_HOSTS: dict[str, Scorer] = {}


def hosted(factory: ScorerFactory) -> Scorer:
    """This process's scorer. One that can't be made (ScorerFailed) is tried again with the next call."""
    if factory.name not in _HOSTS:
        _HOSTS[factory.name] = factory.make()
    return _HOSTS[factory.name]


def answered(scorer: Scorer, texts: Sequence[str], questions: Sequence[Sequence[str]]) -> list[dict[str, float | None]]:
    """For each text, the scores of its questions: in one call, if the scorer has score_questions(texts, questions), else a call for each question."""
    if hasattr(scorer, "score_questions"):
        return [dict(x) for x in scorer.score_questions(texts, questions)]
    out: list[dict[str, float | None]] = [{} for _ in texts]
    for q in dict.fromkeys(q for own in questions for q in own):
        at = [k for k, own in enumerate(questions) if q in own]
        for k, s in zip(at, scorer.score(q, [texts[k] for k in at]), strict=True):
            out[k][q] = s
    return out


def ask_together(open_posts: DataFrame, factory: ScorerFactory, pause: float = PAUSE) -> DataFrame:
    """(text_key, scores) for (text_key, text, questions): all open questions of a text go to the scorer together, which each worker process makes once.

    Equal texts are asked once, with all their questions; null and empty lists of questions ask
    nothing and come out with null scores; a question that the scorer does not answer is null,
    and so are all of a batch while it fails and for the pause after that.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        again = 0.0
        for b in batches:
            texts, questions = [(t or "")[: L.MODEL_TEXT] for t in b.text], [list(q) for q in b.questions]
            got: list[dict] = [{} for _ in texts]
            at = [k for k, q in enumerate(questions) if q]
            if at and time.monotonic() >= again:
                try:
                    for k, x in zip(at, answered(hosted(factory), [texts[k] for k in at], [questions[k] for k in at]), strict=True):
                        got[k] = x
                except ScorerFailed:
                    again = time.monotonic() + pause
            yield pd.DataFrame({"text_key": b.text_key, **{q: pd.Series([x.get(q) for x in got], dtype="float64") for q in QUESTIONS}})

    none = F.array().cast("array<string>")
    once = open_posts.groupBy("text_key").agg(F.first("text").alias("text"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("questions", none))))).alias("questions"))
    asked = once.mapInPandas(run, "text_key string, hiring double, bait double, scam double")
    number = lambda q: F.when(~F.isnan(q), F.col(q)).alias(q)
    return asked.select("text_key", F.struct(*[number(q) for q in QUESTIONS]).cast(SCORES).alias("scores"))


def ask(open_questions: DataFrame, scorer: Scorer | ScorerFactory, pause: float = PAUSE) -> DataFrame:
    """(text_key, question, score) for (text_key, question, text), each distinct one once; null where the scorer fails, and for so many seconds after it has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        again = 0.0  # when the scorer may be asked again
        for b in batches:
            for question, part in b.groupby("question"):
                texts = [t[: L.MODEL_TEXT] for t in part.text]
                got = [None] * len(texts)
                if time.monotonic() >= again:
                    try:
                        got = list((hosted(scorer) if isinstance(scorer, ScorerFactory) else scorer).score(question, texts))
                    except ScorerFailed:
                        again = time.monotonic() + pause
                yield pd.DataFrame({"text_key": part.text_key.to_numpy(), "question": question, "score": pd.Series(got, dtype="float64").to_numpy()})

    once = open_questions.dropDuplicates(["text_key", "question"])
    return once.select("text_key", "question", "text").mapInPandas(run, "text_key string, question string, score double")


def cache_misses(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """What is wanted and not in the cache yet, by (text_key, question)."""
    return wanted.join(cache.select("text_key", "question"), ["text_key", "question"], "left_anti")


def with_scores(posts: DataFrame, answers: DataFrame) -> DataFrame:
    """The posts (with text_key) and a `scores` struct from the long form."""
    wide = answers.groupBy("text_key").agg(*[F.max(F.when(F.col("question") == q, F.col("score"))).alias(q) for q in QUESTIONS])
    joined = posts.drop("scores").join(wide, "text_key", "left")
    return joined.withColumn("scores", F.struct("hiring", "bait", "scam").cast(SCORES)).drop("hiring", "bait", "scam")


def interim(features: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """The rules' label at once, and whether a question is still open; while that is the hiring question, no label is shown."""
    d = decide(features.withColumn("scores", F.lit(None).cast(SCORES)))
    questions = pending_questions(F.col("features"), F.col("scores"), F.col("text_units"), t)
    d = d.withColumn("pending", F.size(questions) > 0)
    return d.withColumn("shown", F.when(~F.array_contains(questions, "hiring"), F.col("label")))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored answers; none if nothing is stored yet."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)
    return spark.read.schema(CACHE).parquet(path) if found else spark.createDataFrame([], CACHE)


def append_cache(answers: DataFrame, cache: DataFrame, path: str) -> None:
    """Store the answers that the cache doesn't hold yet; what is stored stays as it is."""
    cache_misses(answers, cache).select("text_key", "question", "score").write.mode("append").parquet(path)


def score_lazily(features: DataFrame, scorer: Scorer | ScorerFactory, t: Thresholds = Thresholds(), cache: DataFrame | None = None, model: str = "model", kind: str = "") -> tuple[DataFrame, DataFrame]:
    """Two rounds: the hiring question, then what is still open. Only rows with open questions reach the scorer.

    Returns the features with `scores`, and all answers (the new cache). Answers are kept
    by model, kind and text. Both results are persisted: unpersist() them after use.
    """
    spark = features.sparkSession
    known = cache if cache is not None else spark.createDataFrame([], CACHE)
    # persisted: each round reads the features and the answers more than once; what a later frame holds is released
    d = features.withColumn("text_key", score_key(model, kind, F.col("text"))).withColumn("scores", F.lit(None).cast(SCORES)).persist()
    held, asked = [], None
    for _ in range(2):
        wanted = d.select("text_key", "text", F.explode(pending_questions(F.col("features"), F.col("scores"), F.col("text_units"), t)).alias("question"))
        new = ask(cache_misses(wanted, known), scorer)
        known = known.unionByName(new.where("score is not null")).persist()
        known.count()
        used = known.join(wanted.select("text_key", "question").distinct(), ["text_key", "question"], "left_semi")
        asked = used if asked is None else asked.unionByName(used).distinct()
        d, before = with_scores(d, asked).persist(), d
        d.count()
        before.unpersist()
        if held:
            held.pop().unpersist()
        held.append(known)
    return d, known
