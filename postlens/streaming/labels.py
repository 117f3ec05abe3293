"""Labels of a stream in rounds: the rules' label at once, the final one when the model's scores are known.

State is held per lane, a share of the posts by the hash of their id: posts that wait
for scores, a first-in-first-out cache of finished results by id, and the time before
which a failing model is left alone. Features, open questions, labels and reasons stay
Column expressions: the state operator only keeps what belongs to a post, asks, and
says which scores count. It gives rows with a phase:

* `interim`: the rules' label, while questions are open; none while one of them is the
  hiring question, as the post may turn out not to be about hiring;
* `rules`: the model failed (or never answered), the rules' label stands for now;
* `final`: all questions are answered, or there were none; it replaces earlier rows of
  the post (a larger `seq`).

Posts that a failure has skipped are asked again by a processing-time timer when the
pause is over. A post that comes again gets its cached result and is not asked again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions import lexicon as L
from ..operators.decision import SCORES, Thresholds, decide, no_scores, pending_questions
from ..operators.features import extract_features
from ..operators.scoring import QUESTIONS, ScorerFactory, ScorerFailed, hosted

#: Results that a lane remembers, milliseconds for which a failing scorer is left alone, and after which unanswered posts are given up.
REMEMBERED, PAUSE_MS, PATIENCE_MS = 2000, 30_000, 600_000
#: Texts that a scorer gets together.
AT_ONCE = 1024
EVENTS = ["lane", "kind", "post_id", "ts", "text", "text_units", "features", "open_first", "open_then", "question", "score"]
EMITTED = "post_id string, seq long, phase string, cached boolean, ts timestamp, text_units long, features string, hiring double, bait double, scam double"
ANSWERS = ("hiring", "bait", "scam")


class Fifo:
    """Results by id in a lane's state, the oldest entry dropped first. A result that is stored again keeps its place."""

    def __init__(self, handle, name: str, values: str, capacity: int):
        self.capacity = capacity
        self.rows = handle.getMapState(f"{name}_rows", "id string", values)
        self.order = handle.getMapState(f"{name}_order", "n long", "id string")
        self.ends = handle.getValueState(f"{name}_ends", "head long, tail long")

    def get(self, key: str) -> tuple | None:
        return self.rows.getValue((key,)) if self.rows.containsKey((key,)) else None

    def put(self, key: str, value: tuple) -> None:
        new = not self.rows.containsKey((key,))
        self.rows.updateValue((key,), value)
        if not new:
            return
        head, tail = self.ends.get() or (0, 0)
        self.order.updateValue((tail,), (key,))
        tail += 1
        while tail - head > self.capacity:
            self.rows.removeKey(self.order.getValue((head,)))
            self.order.removeKey((head,))
            head += 1
        self.ends.update((head, tail))


class Post:
    """A waiting post: what to ask, what was answered."""

    KEPT = "ts long, text string, text_units long, features string, open_first string, open_then string, asked string, hiring double, bait double, scam double, seq long, shown boolean, since long"

    def __init__(self, post_id: str, values: tuple):
        self.id = post_id
        (self.ts, self.text, self.text_units, self.features, self.first, self.then, self.asked, *scores, self.seq, self.shown, self.since) = values
        self.scores = dict(zip(ANSWERS, scores, strict=True))

    def values(self) -> tuple:
        return (self.ts, self.text, self.text_units, self.features, self.first, self.then, self.asked, *(self.scores[q] for q in ANSWERS), self.seq, self.shown, self.since)

    def open(self, least: float) -> list[str]:
        """The questions still to ask: the first ones, then those that a passed hiring question leaves."""
        asked, first = set(filter(None, self.asked.split(","))), list(filter(None, self.first.split(",")))
        left = [q for q in first if q not in asked]
        if left or "hiring" not in first:
            return left
        hiring = self.scores["hiring"]
        return [q for q in self.then.split(",") if q and q not in asked] if hiring is None or hiring >= least else []

    def answer(self, question: str, score: float | None) -> None:
        self.asked = f"{self.asked},{question}"
        self.scores[question] = None if score is None or score != score else float(score)


class LabelRounds(StatefulProcessor):
    """factory: makes the scorer, once a worker process; None: answers come as rows of the stream."""

    def __init__(self, factory: ScorerFactory | None = None, least: float = L.HIRING_MIN_SCORE, remembered: int = REMEMBERED, pause_ms: int = PAUSE_MS, patience_ms: int = PATIENCE_MS):
        self.factory, self.least, self.remembered, self.pause_ms, self.patience_ms = factory, least, remembered, pause_ms, patience_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "id string", Post.KEPT)
        self.results = Fifo(handle, "results", "ts long, text_units long, features string, hiring double, bait double, scam double, seq long", self.remembered)
        self.early = Fifo(handle, "early", "hiring double, bait double, scam double, asked string", self.remembered)
        self.retry = handle.getValueState("retry", "at long")

    def row(self, post_id: str, seq: int, phase: str, ts: int | None, units: int, features: str, scores: tuple, cached: bool = False) -> tuple:
        return (post_id, seq, phase, cached, ts, units, features, *scores)

    def emitted(self, p: Post, phase: str) -> tuple:
        p.seq += 1
        return self.row(p.id, p.seq, phase, p.ts, p.text_units, p.features, tuple(p.scores[q] for q in ANSWERS))

    def settled(self, p: Post) -> list[tuple]:
        """The final row if nothing is open any more; else the post is kept."""
        if p.open(self.least):
            self.waiting.updateValue((p.id,), p.values())
            return []
        out = self.emitted(p, "final")
        self.results.put(p.id, (p.ts, p.text_units, p.features, *(p.scores[q] for q in ANSWERS), p.seq))
        if self.waiting.containsKey((p.id,)):
            self.waiting.removeKey((p.id,))
        return [out]

    def arrived(self, r, now: int, retry_at: int) -> list[tuple]:
        known = self.results.get(r.post_id)
        if known is not None:
            ts, units, features, hiring, bait, scam, seq = known
            return [self.row(r.post_id, seq, "final", ts, units, features, (hiring, bait, scam), True)]
        if self.waiting.containsKey((r.post_id,)):
            return []
        p = Post(r.post_id, (r.ts, r.text, r.text_units, r.features, r.open_first, r.open_then, "", None, None, None, 0, False, now))
        if (before := self.early.get(r.post_id)) is not None:
            p.scores = dict(zip(ANSWERS, before[:3], strict=True))
            p.asked = before[3]
        asks = p.open(self.least)
        if not asks:
            return self.settled(p)
        out = []
        if now < retry_at:  # the model is left alone: the rules stand for now
            out, p.shown = [self.emitted(p, "rules")], True
        elif "hiring" not in asks:
            out, p.shown = [self.emitted(p, "interim")], True
        self.waiting.updateValue((p.id,), p.values())
        return out

    def answered(self, r) -> list[tuple]:
        if self.waiting.containsKey((r.post_id,)):
            p = Post(r.post_id, self.waiting.getValue((r.post_id,)))
            if r.question in set(p.asked.split(",")):
                return []
            p.answer(r.question, r.score)
            return self.settled(p)
        if self.results.get(r.post_id) is None:  # before its post: kept as if it had been cached
            h, b, s, asked = self.early.get(r.post_id) or (None, None, None, "")
            known = dict(zip(ANSWERS, (h, b, s), strict=True)) | {r.question: None if r.score is None or r.score != r.score else r.score}
            self.early.put(r.post_id, (*(known[q] for q in ANSWERS), f"{asked},{r.question}"))
        return []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        retry_at = (self.retry.get() or (0,))[0]
        out, posts = [], 0
        for b in rows:
            for r in plain(b):
                if r.kind == "post":
                    out += self.arrived(r, now, retry_at)
                    posts += 1
                elif r.question in ANSWERS:
                    out += self.answered(r)
        if posts:
            # the next batch asks, so that interim labels go out first
            self.handle.registerTimer(now + self.patience_ms if self.factory is None else max(now, retry_at) + 1)
        yield frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        retry_at = (self.retry.get() or (0,))[0]
        if self.factory is not None and now < retry_at:
            return
        ids = [k[0] for k in self.waiting.keys()]
        failed = False
        for at in range(0, len(ids), AT_ONCE):
            posts = [Post(x, self.waiting.getValue((x,))) for x in ids[at : at + AT_ONCE]]
            if self.factory is None:
                yield frame(self.given_up(posts, now))
                continue
            failed = failed or not self.asked(posts)
            yield frame(self.after_asking(posts))
        if failed:
            self.retry.update((now + self.pause_ms,))
            self.handle.registerTimer(now + self.pause_ms)

    def given_up(self, posts: list[Post], now: int) -> list[tuple]:
        out = []
        for p in posts:
            if now >= p.since + self.patience_ms:
                out.append(self.emitted(p, "rules"))
                self.waiting.removeKey((p.id,))
        return out

    def asked(self, posts: list[Post]) -> bool:
        """Two rounds of questions, those of each round together; whether the scorer answered."""
        try:
            for _ in range(2):
                wanted = [(p, q) for p in posts for q in p.open(self.least)]
                scorer = hosted(self.factory) if wanted else None
                for q in dict.fromkeys(q for _, q in wanted):
                    own = [p for p, x in wanted if x == q]
                    for p, s in zip(own, list(scorer.score(q, [p.text for p in own])), strict=True):
                        p.answer(q, s)
        except ScorerFailed:
            return False
        return True

    def after_asking(self, posts: list[Post]) -> list[tuple]:
        """Final rows, and for posts that are still open the rules' label, if it was not shown yet."""
        out = []
        for p in posts:
            if p.open(self.least) and not p.shown:
                out.append(self.emitted(p, "rules"))
                p.shown = True
            out += self.settled(p)
        return out

    def close(self) -> None:
        pass


class plain:
    """Rows of a batch with None for what is missing, whole numbers and milliseconds as int."""

    def __init__(self, b: pd.DataFrame):
        self.b = b.assign(ts=b.ts.astype("datetime64[ms]").astype("int64").where(b.ts.notna(), None).astype(object)) if "ts" in b else b

    def __iter__(self):
        for r in self.b.itertuples(index=False):
            yield r._replace(**{f: None for f, x in zip(r._fields, r, strict=True) if x is None or x is pd.NaT or x is pd.NA or x != x}) if any(x is None or x is pd.NA or x != x for x in r) else r


def frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in EMITTED.split(", ")]
    d = pd.DataFrame(rows, columns=names)
    d["ts"] = pd.to_datetime(d.ts, unit="ms")
    return d.astype({"seq": "int64", "cached": "bool", "text_units": "int64", "hiring": "float64", "bait": "float64", "scam": "float64"})


def lane_of(post_id: Column, lanes: int) -> Column:
    return F.pmod(F.xxhash64(post_id), F.lit(lanes)).cast("int")


def post_events(posts: DataFrame, lanes: int = 64, t: Thresholds = Thresholds()) -> DataFrame:
    """Events of posts: features, what the rules leave open, and what a passed hiring question would leave open. Posts without an id have no state and are dropped."""
    d = extract_features(posts.where("post_id is not null"))
    passed = F.struct(F.lit(1.0).alias("hiring"), F.lit(None).cast("double").alias("bait"), F.lit(None).cast("double").alias("scam"))
    asks = lambda scores: F.array_join(pending_questions(F.col("features"), scores, F.col("text_units"), t), ",")
    d = d.select("*", asks(no_scores()).alias("open_first"), asks(passed).alias("open_then"))
    made = {"lane": lane_of(F.col("post_id"), lanes), "kind": F.lit("post"), "text": F.substring("text", 1, L.MODEL_TEXT), "features": F.to_json("features"), "question": F.lit(None).cast("string"), "score": F.lit(None).cast("double")}
    return d.select(*[made.get(c, F.col(c)).alias(c) for c in EVENTS])


def answer_events(answers: DataFrame, lanes: int = 64) -> DataFrame:
    """Events of (post_id, question, score) rows: scores that come from elsewhere, and late."""
    own = {"lane": lane_of(F.col("post_id"), lanes), "kind": F.lit("answer"), "post_id": F.col("post_id"), "question": F.col("question"), "score": F.col("score").cast("double")}
    kinds = {"ts": "timestamp", "text_units": "long"}
    return answers.where("post_id is not null").select(*[own.get(c, F.lit(None).cast(kinds.get(c, "string"))).alias(c) for c in EVENTS])


def label_rounds(events: DataFrame, processor: LabelRounds) -> DataFrame:
    """The emitted rows. Needs the RocksDB state store."""
    return events.groupBy("lane").transformWithStateInPandas(statefulProcessor=processor, outputStructType=EMITTED, outputMode="Append", timeMode="ProcessingTime")


def decided(emitted: DataFrame, features_schema: str, t: Thresholds = Thresholds()) -> DataFrame:
    """Label and reasons of emitted rows; features_schema: the type of the features, as in `dtypes`."""
    d = emitted.withColumn("features", F.from_json("features", features_schema)).withColumn("scores", F.struct(*[F.col(q) for q in QUESTIONS]).cast(SCORES)).drop(*QUESTIONS)
    return decide(d, t)
