import json
import random
from datetime import date

from postlens.operators import stores
from postlens.streaming import ledger

SCHEMA = "date date, label string"


def batch(spark, *labels):
    return spark.createDataFrame([(date(2026, 1, 1 + k % 2), x) for k, x in enumerate(labels)], SCHEMA)


def held(spark, path):
    d = ledger.read_counts(spark, path)
    return {} if d is None else {(r.date.day, r.label): r.n for r in d.collect()}


def test_repeated_batches_change_nothing(spark, tmp_path):
    path, rnd = str(tmp_path / "counts"), random.Random(5)
    step, want = ledger.counts_to(path, fold=4), {}
    assert held(spark, path) == {}
    batches = [[rnd.choice("abc") for _ in range(rnd.randrange(6))] for _ in range(11)]
    for epoch, rows in enumerate(batches):
        step(batch(spark, *rows), epoch)
        for k, x in enumerate(rows):
            want[1 + k % 2, x] = want.get((1 + k % 2, x), 0) + 1
        assert held(spark, path) == want
        for again in (epoch, rnd.randrange(epoch + 1)):  # the last one, and any finished one
            step(batch(spark, *batches[again]), again)
            assert held(spark, path) == want
    found = ledger.folders(spark, path)
    assert len(found["base"]) <= 2 and len(found["epoch"]) <= 5


def test_an_unfinished_base_or_epoch_does_not_count(spark, tmp_path):
    path = str(tmp_path / "counts")
    step = ledger.counts_to(path)
    step(batch(spark, "a"), 0), step(batch(spark, "a", "b"), 1)
    (tmp_path / "counts" / "epoch-000000000001" / "_SUCCESS").unlink()  # as if its writer had died
    assert held(spark, path) == {(1, "a"): 1}
    step(batch(spark, "a", "b"), 1)
    before = held(spark, path)
    ledger.fold_up(spark, path, 0)
    (tmp_path / "counts" / "base-000000000007").mkdir()  # begun, not finished
    assert held(spark, path) == before == {(1, "a"): 2, (2, "b"): 1}
    ledger.clear_counts(spark, path)
    assert held(spark, path) == {}
    step(batch(spark, "a", "b"), 1)
    assert held(spark, path) == {}  # finished before
    step(batch(spark, "c"), 2)
    assert held(spark, path) == {(1, "c"): 1}


def test_stream_counts_each_post_once_across_a_crash(spark, tmp_path):
    source, store, checkpoint = tmp_path / "in", str(tmp_path / "counts"), tmp_path / "ck"
    source.mkdir()

    def put(n, *posts):
        rows = [json.dumps({"post_id": i, "label": x, "phase": p, "ts": f"2026-01-0{d}T10:00:00Z"}) for i, x, p, d in posts]
        (source / f"{n}.json").write_text("\n".join(rows))

    def run():
        d = spark.readStream.schema("post_id string, label string, phase string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(source))
        q = ledger.seen_labels(d).writeStream.foreachBatch(ledger.counts_to(store)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    put(1, ("p", "crowded", "interim", 1), ("p", "scam_risk", "final", 1), ("q", "crowded", "final", 1), ("p", "scam_risk", "final", 1))
    run()
    assert held(spark, store) == {(1, "scam_risk"): 1, (1, "crowded"): 1}
    put(2, ("p", "scam_risk", "final", 1), ("r", "crowded", "final", 2))
    run()
    want = {(1, "scam_risk"): 1, (1, "crowded"): 1, (2, "crowded"): 1}
    assert held(spark, store) == want
    last = max((f for f in (checkpoint / "commits").iterdir() if f.name.isdigit()), key=lambda f: int(f.name))
    last.unlink()  # the sink had finished, the engine does not know: the batch runs again
    (checkpoint / "commits" / f".{last.name}.crc").unlink(missing_ok=True)
    run()
    assert held(spark, store) == want


def test_stored_records(spark, tmp_path):
    path = str(tmp_path / "feedback")
    assert stores.stored_count(spark, path, SCHEMA) == 0 and stores.stored(spark, path, SCHEMA).collect() == []
    for _ in range(2):
        stores.feedback_append(batch(spark, "a", "b"), path)
    assert stores.stored_count(spark, path, SCHEMA) == 4 and len(stores.stored(spark, path, SCHEMA).collect()) == 4
    stores.clear(path, batch(spark, "a"))
    assert stores.stored_count(spark, path, SCHEMA) == 0
