"""Trained scores of the lattice model against expectation maximisation by enumeration."""

import math
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from postlens.llm import lattice as M

PATH = P.path("piece_bpe_32k.model")


def cuts(w, index):
    """All segmentations of a word into pieces."""
    if not w:
        yield ()
    for k in range(1, len(w) + 1):
        if w[:k] in index:
            for rest in cuts(w[k:], index):
                yield (w[:k], *rest)


def brute(texts, train, rounds):
    v = M.pieces(PATH)
    p = dict(zip([*v.names, "end"], map(math.exp, v.first), strict=True))
    prior = dict.fromkeys(p, M.PRIOR)
    words = Counter(w for t, own in zip(texts, train, strict=True) if own for w in t.encode().lower().split())
    ends, before = sum(train), -math.inf
    ways = {w: list(cuts(M.MARK + w, v.index)) for t in texts for w in t.encode().lower().split()}
    chance = lambda w: sum(math.prod(p[x] for x in c) for c in ways[w])
    for _ in range(rounds):
        mass = defaultdict(float, prior)
        for w, n in words.items():
            whole = chance(w)
            for c in ways[w]:
                for x in c:
                    mass[x] += n * math.prod(p[y] for y in c) / whole
        now = sum(n * math.log(chance(w)) for w, n in words.items()) + ends * math.log(p["end"])
        mass["end"] += ends
        total = sum(mass.values())
        p = {x: y / total for x, y in mass.items()}
        if now - before < M.TOLERANCE * abs(now):
            break
        before = now
    return [sum(math.log10(chance(w)) for w in t.encode().lower().split()) + math.log10(p["end"]) for t in texts]


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_scores_equal_enumeration(spark, rounds):
    texts = ["the cat sat", "The mat and the hat", "éa xq", "", "cat cat hats", "unseen zebra"]
    train = [True, True, True, True, True, False]
    d = spark.createDataFrame([(i, t, k, "x") for i, (t, k) in enumerate(zip(texts, train, strict=True))], "doc_id long, text string, own boolean, score string")
    got = [r.score for r in M.lm_score(d, F.col("own"), PATH, rounds=rounds).orderBy("doc_id").collect()]
    assert got == pytest.approx(brute(texts, train, rounds))


def test_training_raises_the_likelihood(spark):
    """Score a token on held-out documents: near the word model's, which knows each frequent word by heart (figures in the README)."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    mean = lambda rounds: M.lm_score(d, ~held, PATH, rounds=rounds).join(d.where(held).select("doc_id"), "doc_id").agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
    (none, base), (one, _), (three, _) = mean(0), mean(1), mean(3)
    print("log10 a token: start", none, "one round", one, "three", three, "word base", base)
    assert none < one < three


def test_long_texts_and_words(spark):
    d = spark.createDataFrame([(1, "word " * 200_000), (2, "y" * 20_000), (2, "y" * 20_000)], "doc_id long, text string")
    got = M.lm_score(d, F.lit(True), PATH, rounds=1).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == [200_001, 2, 2] and all(math.isfinite(r.score) and r.score < 0 for r in got)
