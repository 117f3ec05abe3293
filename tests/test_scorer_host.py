import os
import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import functions as F

from postlens.operators import scoring as S

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers do not see the tests' folder
SCHEMA = "text_key string, text string, questions array<string>"


def factory(folder, **more):
    """Leaves a file for each scorer that is made, and for each call."""

    class Counting:
        def __init__(self):
            (folder / f"made-{os.getpid()}-{uuid.uuid4().hex}").touch()

        def score_questions(self, texts, questions):
            if more.get("fails"):
                raise S.ScorerFailed
            (folder / f"call-{os.getpid()}-{uuid.uuid4().hex}").write_text(str(len(texts)))
            return [{q: len(t) / 100 + len(q) for q in own} for t, own in zip(texts, questions, strict=True)]

    return S.ScorerFactory(uuid.uuid4().hex, Counting)


def test_one_scorer_a_worker_and_one_call_for_all_questions(spark, tmp_path):
    rows = [(f"k{i}", "x" * (i % 7), [["hiring"], ["bait", "scam"], [], None][i % 4]) for i in range(200)] + [("k1", "x", ["hiring"])]
    d = spark.createDataFrame(rows, SCHEMA).repartition(8, "text_key")
    f = factory(tmp_path)
    got = [{r.text_key: r.scores for r in S.ask_together(d, f).collect()} for _ in range(2)][1]
    made = [p.name.split("-")[1] for p in tmp_path.glob("made-*")]
    calls = list(tmp_path.glob("call-*"))
    assert len(made) == len(set(made)) and {p.name.split("-")[1] for p in calls} == set(made)
    assert sum(int(p.read_text()) for p in calls) == 2 * 100  # a text once, whatever it is asked
    assert len(got) == 200
    for i in range(200):
        n, asked = (i % 7) / 100, {"hiring", "bait", "scam"} if i == 1 else set(rows[i][2] or ())
        assert got[f"k{i}"].asDict() == {q: n + len(q) if q in asked else None for q in S.QUESTIONS}


def test_scorers_without_the_method_and_failing_ones(spark, tmp_path):
    class Plain:
        def score(self, question, texts):
            return [0.5 if question == "bait" else None for _ in texts]

    d = spark.createDataFrame([("a", None, ["bait", "scam"]), ("b", "", None)], SCHEMA)
    got = {r.text_key: tuple(r.scores) for r in S.ask_together(d, S.ScorerFactory(uuid.uuid4().hex, Plain)).collect()}
    assert got == {"a": (None, 0.5, None), "b": (None, None, None)}
    got = {r.text_key: tuple(r.scores) for r in S.ask_together(d, factory(tmp_path, fails=True)).collect()}
    assert set(got.values()) == {(None, None, None)}
    assert S.ask_together(d.limit(0), factory(tmp_path)).count() == 0
    open_questions = d.select("text_key", "text", F.explode("questions").alias("question")).na.fill("")
    assert {(r.question, r.score) for r in S.ask(open_questions, S.ScorerFactory(uuid.uuid4().hex, Plain)).collect()} == {("bait", 0.5), ("scam", None)}
