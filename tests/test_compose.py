import random
import unicodedata

from pyspark.sql import functions as F

from postlens.functions.compose import marks, nfkc, pairs


def composed(spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(8)
    out = d.select("k", nfkc(F.col("t")).alias("t"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString() and "Arrow" not in out._jdf.queryExecution().executedPlan().toString()
    return [r.t for r in sorted(out.collect())]


def test_every_code_point(spark):
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and (unicodedata.category(chr(c)) != "Cn")]
    # in texts of 40 each with letters between, so that neighbours don't join; private use and plain ideographs thinned out, as nothing happens to them
    chars = [c for c in chars if unicodedata.normalize("NFKC", c) != c or unicodedata.combining(c) or ord(c) % 37 == 0]
    texts = ["a".join(chars[k : k + 40]) for k in range(0, len(chars), 40)]
    got = composed(spark, texts)
    assert [(t, g) for t, g in zip(texts, got, strict=True) if unicodedata.normalize("NFKC", t) != g] == []


def test_random_strings(spark):
    rnd = random.Random(6)
    pools = [list(marks()), [c for p in pairs() for c in p], [chr(c) for c in range(0x1100, 0x1200)], [chr(c) for c in range(0xAC00, 0xAC00 + 600)], list("aeiou AZ09"), ["ﬁ", "①", "㎏", "Å", "½", "ſ", "ẛ̣", "가", "각"]]
    texts = ["".join(rnd.choice(rnd.choice(pools)) for _ in range(rnd.randrange(1, 25))) for _ in range(1500)] + ["", "plain", "été", "été", "x" * 5000 + "ﬁ"]
    got = composed(spark, [*texts, None])
    assert got[-1] is None
    assert [(t, g) for t, g in zip(texts, got, strict=False) if unicodedata.normalize("NFKC", t) != g][:3] == []
