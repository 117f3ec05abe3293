"""Label rounds: with a hand-driven clock against plain simulations, then as real streams."""

import json
import random
import sys
import time
import uuid

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from postlens.operators.features import POST_SCHEMA, extract_features
from postlens.operators.scoring import ScorerFactory, ScorerFailed
from postlens.streaming import labels as S

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers do not see the tests' folder


class Value:
    def __init__(self):
        self.v = None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v


class Map(dict):
    def getValue(self, k):
        return self[k]

    def containsKey(self, k):
        return k in self

    def updateValue(self, k, v):
        self[k] = v

    def removeKey(self, k):
        del self[k]


class Clock:
    """A lane's state and timers in memory, with a clock that the test sets."""

    def __init__(self, processor):
        self.now, self.timers, self.maps, self.p = 0, set(), {}, processor
        processor.init(self)

    def getMapState(self, name, *_):
        return self.maps.setdefault(name, Map())

    def getValueState(self, name, *_):
        return Value()

    def registerTimer(self, at):
        self.timers.add(at)

    def getCurrentProcessingTimeInMs(self):
        return self.now

    def rows(self, frames):
        return [r for f in frames for r in f.itertuples(index=False)]

    def send(self, *events):
        base = dict.fromkeys(S.EVENTS)
        d = pd.DataFrame([base | {"lane": 0, "text_units": 99, "features": "{}", "ts": pd.Timestamp(0)} | e for e in events], columns=S.EVENTS)
        return self.rows(self.p.handleInputRows((0,), iter([d]), self)) if events else []

    def tick(self, now):
        self.now, out = now, []
        for at in sorted(t for t in self.timers if t <= now):
            self.timers.discard(at)
            out += self.rows(self.p.handleExpiredTimer((0,), self, None))
        return out


def post(i, first="", then="", text="t"):
    return {"kind": "post", "post_id": i, "open_first": first, "open_then": then, "text": text}


def answer(i, question, score):
    return {"kind": "answer", "post_id": i, "question": question, "score": score}


def phases(rows):
    return [(r.post_id, r.seq, r.phase) for r in rows]


class Model:
    """Scores by question; fails while `down`."""

    down = False
    asked: list = []

    def score(self, question, texts):
        if Model.down:
            raise ScorerFailed
        Model.asked += [(question, t) for t in texts]
        return [{"hiring": 0.9, "bait": 0.2, "scam": 0.99}[question] if t != "story" else 0.1 for t in texts]


@pytest.fixture
def factory():
    Model.down, Model.asked = False, []
    return ScorerFactory(uuid.uuid4().hex, Model)


def test_late_scores_replace_the_interim_label_once():
    c = Clock(S.LabelRounds())
    assert phases(c.send(post("a"), post("b", "scam,bait"), post("c", "hiring", "bait"))) == [("a", 1, "final"), ("b", 1, "interim")]
    assert c.send(answer("b", "scam", 0.97)) == []
    done = c.send(answer("b", "bait", 0.1), answer("b", "bait", 0.9))
    assert phases(done) == [("b", 2, "final")] and (done[0].scam, done[0].bait) == (0.97, 0.1)
    assert c.send(answer("c", "hiring", 0.6)) == [] and phases(c.send(answer("c", "bait", 0.3))) == [("c", 1, "final")]
    assert phases(c.send(post("d", "hiring", "bait"))) == [] and phases(c.send(answer("d", "hiring", 0.1))) == [("d", 1, "final")]
    assert c.send(answer("e", "scam", 0.5)) == [] and phases(c.send(post("e", "scam"))) == [("e", 1, "final")]  # the score came first
    again = c.send(post("b", "scam,bait"))
    assert phases(again) == [("b", 2, "final")] and again[0].cached and again[0].scam == 0.97
    assert not c.maps["waiting"]


def test_unanswered_posts_are_given_up():
    c = Clock(S.LabelRounds(patience_ms=100))
    c.send(post("a", "hiring"), post("b", "scam"))
    assert c.tick(99) == [] and phases(c.tick(100)) == [("a", 1, "rules"), ("b", 2, "rules")] and not c.maps["waiting"]


def test_failing_model_is_left_alone_and_every_skipped_post_is_asked_again(factory):
    c = Clock(S.LabelRounds(factory))
    assert phases(c.send(post("a", "hiring", "scam"), post("b", "scam"))) == [("b", 1, "interim")]
    Model.down = True
    assert phases(c.tick(1)) == [("a", 1, "rules")]
    assert phases(c.send(post("c", "hiring", text="story"), post("d"))) == [("c", 1, "rules"), ("d", 1, "final")]  # within the pause: rules at once
    Model.down = False
    assert c.tick(30_000) == [] and not Model.asked
    done = c.tick(30_001)
    assert sorted(phases(done)) == [("a", 2, "final"), ("b", 2, "final"), ("c", 2, "final")]
    assert {r.post_id: (r.hiring, r.scam) for r in done if r.post_id != "b"}["a"] == (0.9, 0.99)
    assert sorted(Model.asked) == [("hiring", "story"), ("hiring", "t"), ("scam", "t"), ("scam", "t")] and not c.maps["waiting"]


def test_random_outages_end_with_every_score(factory):
    rnd = random.Random(7)
    c = Clock(S.LabelRounds(factory, pause_ms=50))
    last, sent = {}, {}
    for now in range(0, 3000, 10):
        Model.down = rnd.random() < 0.4 and now < 2500
        rows = c.tick(now)
        for _ in range(rnd.randrange(4) if now < 2500 else 0):
            i = f"p{rnd.randrange(300)}"
            sent.setdefault(i, rnd.choice(["", "scam", "bait", "scam,bait", "hiring"]))
            rows += c.send(post(i, sent[i], "scam" if sent[i] == "hiring" else ""))
        for r in rows:
            assert r.cached or r.seq == last.get(r.post_id, (0,))[0] + 1
            last[r.post_id] = (r.seq, r)
    assert set(last) == set(sent) and not c.maps["waiting"] and c.p.retry.get()
    for i, (_, r) in last.items():
        assert r.phase == "final"
        assert all((getattr(r, q) == getattr(r, q)) == (q in sent[i] or q == "scam" and sent[i] == "hiring") for q in S.ANSWERS)


def test_result_cache_is_first_in_first_out():
    rnd = random.Random(3)
    c = Clock(S.LabelRounds(remembered=20))
    plain: dict = {}
    for k in range(2000):
        i = f"p{int(rnd.expovariate(0.05))}"
        row = c.send(post(i))[0]
        assert row.cached == (i in plain)
        if i not in plain:
            plain[i] = k
            if len(plain) > 20:
                del plain[next(iter(plain))]
        assert len(c.maps["results_rows"]) == len(c.maps["results_order"]) == len(plain)
    assert {k[0] for k in c.maps["results_rows"]} == set(plain)


TEXTS = {
    "ask": "We are hiring great people, tell your friends about this wonderful place to be",  # the hiring question
    "scam": "We are hiring an assistant, apply on https://boards.greenhouse.io/x/1 or on WhatsApp for this wonderful place",  # the scam question
    "none": "A story about trees and the birds that live in them, with nothing else to tell at all",
}


def posts(folder, n, *names):
    rows = [json.dumps({"post_id": k, "text": TEXTS[k], "author_headline": "", "links": [], "emails": [], "ts": "2026-01-01T00:00:00Z"}) for k in names]
    (folder / f"{n}.json").write_text("\n".join(rows))


@pytest.fixture
def stores(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def until(query, done, seconds=90):
    end = time.time() + seconds
    while time.time() < end and query.exception() is None:
        if done():
            return
        time.sleep(0.3)
    assert query.exception() is None, query.exception()
    assert done()


def running(spark, tmp_path, events, processor, name):
    schema = dict(extract_features(spark.createDataFrame([], POST_SCHEMA)).dtypes)["features"]
    out = S.decided(S.label_rounds(events, processor), schema).select("post_id", "seq", "phase", "label", "scores.scam", "scores.hiring")
    return out.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(processingTime="200 milliseconds").start()


def test_stream_of_late_scores(spark, stores, tmp_path):
    (a := tmp_path / "posts").mkdir(), (b := tmp_path / "answers").mkdir()
    incoming = spark.readStream.schema(POST_SCHEMA + ", ts timestamp").json(str(a))
    late = spark.readStream.schema("post_id string, question string, score double").json(str(b))
    query = running(spark, tmp_path, S.post_events(incoming, 2).unionByName(S.answer_events(late, 2)), S.LabelRounds(), "late_scores")
    try:
        rows = lambda: sorted(map(tuple, spark.table("late_scores").select("post_id", "seq", "phase", "label").collect()))
        posts(a, 1, "ask", "scam", "none")
        until(query, lambda: len(rows()) >= 2)
        first = [("none", 1, "final", "not_hiring"), ("scam", 1, "interim", "real_opening")]
        assert rows() == first  # nothing of the post whose hiring question is open
        (b / "1.json").write_text('{"post_id":"scam","question":"scam","score":0.99}\n{"post_id":"ask","question":"hiring","score":0.1}\n{"post_id":"scam","question":"scam","score":0.1}')
        until(query, lambda: len(rows()) >= 4)
        assert rows() == sorted([*first, ("scam", 2, "final", "scam_risk"), ("ask", 1, "final", "not_hiring")])
    finally:
        query.stop()


class Flaky:
    """Fails for its first two calls."""

    def __init__(self):
        self.calls = 0

    def score(self, question, texts):
        self.calls += 1
        if self.calls <= 2:
            raise ScorerFailed
        return [0.99] * len(texts)


def test_stream_recovers_from_a_failing_model(spark, stores, tmp_path):
    (a := tmp_path / "posts").mkdir()
    incoming = spark.readStream.schema(POST_SCHEMA + ", ts timestamp").json(str(a))
    factory = ScorerFactory(uuid.uuid4().hex, Flaky)
    query = running(spark, tmp_path, S.post_events(incoming, 1), S.LabelRounds(factory, pause_ms=500), "flaky")
    try:
        posts(a, 1, "ask", "scam", "none")
        rows = lambda: spark.table("flaky").orderBy("post_id", "seq").collect()
        until(query, lambda: sum(r.phase == "final" for r in rows()) == 3)
        assert [(r.post_id, r.phase) for r in rows()] == [("ask", "rules"), ("ask", "final"), ("none", "final"), ("scam", "interim"), ("scam", "final")]
        assert {r.post_id: (r.label, r.scam, r.hiring) for r in rows() if r.phase == "final"} == {"ask": ("unverified", None, 0.99), "scam": ("scam_risk", 0.99, None), "none": ("not_hiring", None, None)}
        assert spark.table("flaky").where(F.col("label").isNull()).isEmpty()
    finally:
        query.stop()
