import random
from itertools import combinations
from math import ceil

from pyspark.sql import functions as F

from postlens.llm import decontaminate as C


def test_every_allowed_pattern_has_a_seed():
    for n in range(1, C.WINDOW + 1):
        for wrong in range(n - ceil(n * C.SHARE) + 1):
            for gone in combinations(range(n), wrong):
                assert any(all(at + i not in gone for i in m) for m in C.masks(n) for at in range(n - m[-1])), (n, gone)


def brute(doc, item):
    length = min(C.WINDOW, len(item), max(len(doc), C.LEAST_STRETCH))
    best = 0
    for shift in range(-len(doc), len(item)):
        same = [0 <= i + shift < len(item) and doc[i] == item[i + shift] for i in range(len(doc))]
        best = max(best, *(sum(same[s : s + length]) for s in range(len(doc))))
    return best if length and best >= ceil(length * C.SHARE) else 0


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(3)
    text = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    items = {k: text(n) for k, n in enumerate([13, 13, 20, 8, 5, 10, 12, 3, 30])}
    docs = {}
    for k, item in items.items():
        docs[len(docs)] = item
        for _ in range(30):
            own = list(item)
            for i in rng.sample(range(len(own)), min(len(own), rng.randrange(5))):
                own[i] = "other"
            docs[len(docs)] = text(rng.choice([0, 0, 1, 6, 20])) + own[rng.randrange(3) :] + text(rng.choice([0, 0, 1, 6, 20]))
    make = lambda x, name: spark.createDataFrame([(k, " ".join(v)) for k, v in x.items()], f"{name} long, text string")
    got = {(r.doc_id, r.item_id): r.matched for r in C.contaminated(make(docs, "doc_id"), make(items, "item_id")).collect()}
    assert got == {(i, k): m for i, d in docs.items() for k, t in items.items() if (m := brute(d, t))}


def test_defined_cases(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [(1, item), (1, item), (2, "filler " * 60_000 + item + " filler" * 60_000), (3, None), (None, item), (None, "")]
    docs = spark.createDataFrame([(*r, "w", 5, 7) for r in rows], "doc_id long, text string, w string, n int, item_id int")
    items = spark.createDataFrame([(7, item, "a"), (7, item, "b"), (8, item + " " + item, "c"), (None, None, "d")], "item_id long, text string, key string")
    got = {(r.doc_id, r.item_id, r.matched) for r in C.contaminated(docs, items).collect()}
    assert got == {(i, k, 13) for i in (1, 2, None) for k in (7, 8)}
    assert sorted((r.doc_id or 0, r.text or "") for r in C.decontaminate(docs, items).collect()) == [(0, ""), (3, "")]


def test_hits_hold_few_words(spark):
    sizes = [0, 1, 12, 13, 63, 64, 65, 200, 5000]
    rows = spark.createDataFrame([(k, [k * 10_000 + i for i in range(n)]) for k, n in enumerate(sizes)], "id long, w array<long>").withColumn("n", F.size("w"))
    got = C.windows(rows, F.col("n") != 12).select("id", "n", "w", "at", C.context().alias("context")).collect()
    assert max(len(r.w) for r in got) <= C.CHUNK + 2 * (C.WINDOW - 1)
    around = range(1 - C.WINDOW, C.WINDOW)
    assert sorted((r.id, r.n, *[-1 if x is None else x for x in r.context]) for r in got) == [(k, n, *[k * 10_000 + i + j if 0 <= i + j < n else -1 for j in around]) for k, n in enumerate(sizes) if n != 12 for i in range(n)]


def test_benchmark_of_many_blocks(spark, monkeypatch):
    rng = random.Random(4)
    items = [[f"w{rng.randrange(400)}" for _ in range(n)] for n in (13, 20, 30, 15)]
    rows = [(100 * k + i, " ".join(w)) for i, w in enumerate(items) for k in range(30)]  # 30 copies of each
    docs = {0: items[0] * 10, 1: items[1][:11], 2: items[2] + items[3], 3: ["other"] * 40}
    d = spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "doc_id long, text string")
    b = spark.createDataFrame(rows, "item_id long, text string")
    written, made = [], C.Scratch.written
    monkeypatch.setattr(C.Scratch, "written", lambda self, df, *a: written.append(df) or made(self, df, *a))
    whole = C.contaminated(d, b)
    assert not written  # copies add no seeds: one pass
    rest = C.contaminated(d, b, seeds_per_block=500)
    plans = [t._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") for t in written]
    assert len(plans) > 3 and max(plans) == 1 and "BroadcastExchange" not in rest._jdf.queryExecution().executedPlan().toString()
    pairs = {(r.doc_id, r.item_id): (r.matched, r.stretch, r.hits) for r in whole.collect()}
    assert pairs == {(r.doc_id, r.item_id): (r.matched, r.stretch, r.hits) for r in rest.collect()}
    assert {k: m for k, (m, _, _) in pairs.items()} == {(i, 100 * k + j): m for i, w in docs.items() for j, t in enumerate(items) if (m := brute(w, t)) for k in range(30)}
