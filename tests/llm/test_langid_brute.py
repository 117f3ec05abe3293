"""Language ID against kernel ridge regression on whole sets of n-grams, solved in its dual form."""

import random

import numpy as np
from pyspark.sql import functions as F

from postlens.llm import langid as G

LETTERS = {"aa": "aeiklmnst", "bb": "bdgouvwxz", "cc": "абвгдеж"}
SCHEMA = "doc_id long, text string, lang string, id string, label string, h long, score string, bits string"


def texts(n, seed):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        lang = "aabbcc"[2 * (k % 3) :][:2]
        mixed = LETTERS[lang] + rnd.choice(["", "rh"])
        out.append((k, " ".join("".join(rnd.choice(mixed) for _ in range(rnd.randrange(2, 8))) for _ in range(rnd.randrange(3, 30))), lang))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, "z", "w") for r in rows], SCHEMA)


def grams(text):
    t = text.lower()
    return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}


def brute(rows, learn):
    sets = [grams(t) for _, t, _ in rows]
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b)) + 1
    own = [k for k, (i, _, y) in enumerate(rows) if learn(i) and y]
    langs = sorted({rows[k][2] for k in own})
    y = np.array([[rows[k][2] == lang for lang in langs] for k in own], float)
    count = y.sum(axis=0)[y.argmax(axis=1)]
    a = np.linalg.solve(np.array([[kernel(sets[i], sets[j]) for j in own] for i in own]) + G.RIDGE * np.diag(count), y)
    f = np.array([[kernel(s, sets[j]) for j in own] for s in sets]) @ a
    return [(langs[k], float(np.clip(v[k], 0, 1))) for k, v in zip(f.argmax(axis=1), f, strict=True)]


def test_equals_kernel_ridge_regression(spark):
    rows = texts(180, 1)
    got = {r.doc_id: r for r in G.language_id(frame(spark, rows), learn=F.col("doc_id") % 4 != 2).collect()}
    want = brute(rows, lambda i: i % 4 != 2)
    assert [got[i].lang_pred for i, _, _ in rows] == [w for w, _ in want]
    assert np.abs(np.array([got[i].score for i, _, _ in rows]) - np.array([s for _, s in want])).max() < 0.05


def test_defined_cases(spark):
    rows = texts(60, 2)
    odd = [(100, None, "aa"), (101, "12 !", "aa"), (102, rows[0][1], None), (103, rows[0][1] * 5000, None), (None, rows[1][1], "bb"), (0, rows[0][1], "aa")]
    out = G.language_id(frame(spark, rows + odd)).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert len(out) == len(rows) + len(odd) and by[100] == by[101] == [("und", 0.0)]
    assert by[0][0] == by[0][1] == by[102][0] and by[103][0][0] == "aa" and by[None][0][0] == "bb"
    assert G.language_id(frame(spark, [])).count() == 0
    assert {r.lang_pred for r in G.language_id(frame(spark, [(1, "abc", None)])).collect()} == {"und"}
    tied = G.language_id(frame(spark, [(1, "same text", "zz"), (2, "same text", "bb")])).collect()
    assert {r.lang_pred for r in tied} == {"bb"}
