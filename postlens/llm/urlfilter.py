"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

All of it is DataFrame operations. The model is trained from a small labelled URL
table by full-batch gradient descent, in dual form: weights stay combinations of the
labelled rows, so a step needs only the kernel of these rows, which a join on
buckets counts, and all steps are one higher-order expression. The bias has a rate of its own,
so that few steps are enough. The fitted weights are a vector of fixed length (DIMS + 1).

Defined cases: a null url, or one without `://`, has an empty host and path, fits no
rule, and is judged by the model on empty strings; repeated rows are judged
independently; the longest fitting rule wins; extra columns are ignored; a null id is
passed through; an empty labelled table gives zero weights, hence `allow`; very long urls
are read as a whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let, once_a_session
from .common import ascii_lower

DIMS, GRAMS, STEPS, RATE, BIAS_RATE, RIDGE = 16384, (3, 4, 5), 40, 0.4, 2.0, 0.003

#: The rules of the registered query, as (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: The score from which the model blocks: over one half, as names without a meaning come near it by chance.
BLOCK_AT = 0.55

# The small labelled table by which the default model is trained is built from these words:
# unwanted topics in pairs, wanted topics in pairs, and names without a meaning, which are wanted.
UNWANTED_WORDS = """
casino slots roulette blackjack jackpot betting bets poker bookie lottery spins bonus winners viagra cialis tramadol xanax steroids
slimming pills pharmacy porn xxx adult nude hentai escort camgirls erotic milf fetish hookup warez keygen cracked serials nulled cheats payday lending forex pyramid
binary-options airdrop giveaway counterfeit replica fakeid diplomas hacked carding followers-cheap botnet adserver adclick ads tracker
popunder spam spammer linkfarm clickbait
""".split()
WANTED_WORDS = """
library museum school college journal gazette weather climate garden kitchen recipes history physics biology geology atlas railway
harbour council parliament clinic dentist nursing orchestra theatre cinema gallery poetry novels grammar dictionary archive forum manual
handbook release download support careers cycling football chess hiking camping birdwatch furniture carpentry textiles astronomy
mathematics economics insurance banking energy software compiler database network robotics festival tourism hotel bakery coffee
news article paper report lecture science nature water mountain bridge street market letters country people family friends travel
summer winter thesis theory thermal
""".split()
# Names without a meaning come from frequent letter groups, and from syllables with an ending.
GROUPS = "th he in er an re nd at on nt ha es st en ed to it ou ea hi is or ti as te et ng of al de se le sa si ar ve ra ld ur ion tion ble ing ly and the ent for".split()
ONSETS, VOWELS, CODAS = ("b c d f g h k l m n p r s t v w th sh st tr nd nt ng ch pl gr br".split(), "a e i o u ai ea ou io".split(), "er ing ion ed ly le al is en or ar us on es".split())


def nonsense(k: int) -> str:
    """The k-th name without a meaning."""
    at = lambda items, x: items[(k * x + k * k // 7) % len(items)]
    if k % 2:
        return "".join(at(ONSETS, 5 + 2 * n) + at(VOWELS, 2 + n) for n in range(1 + k % 3)) + at(CODAS, 3)
    return "".join(at(GROUPS, x) for x in (1, 3, 7, 11)[: 2 + k // 2 % 3])


def labelled_urls() -> list[tuple[str, bool]]:
    """(url, unwanted); forms of hosts and paths take turns, alike for wanted and unwanted ones."""
    forms = ["http://{a}{b}.org/{b}/index.php", "https://www.{a}-{b}.net/", "https://{a}.{b}.info/{a}/page-{n}", "http://{b}{n}.biz/{a}.html", "https://shop.{b}{a}.co.uk/item?id={n}", "https://{a}-{n}.io/blog/{n}/{b}-{a}"]
    out = []
    for words, unwanted, turns in ((UNWANTED_WORDS, True, 3), (WANTED_WORDS, False, 1)):
        for turn in range(turns):
            out += [(forms[(k + turn) % len(forms)].format(a=a, b=words[(k * 7 + 3 + 5 * turn) % len(words)], n=k * 37 % 100), unwanted) for k, a in enumerate(words)]
    return out + [(forms[k % len(forms)].format(a=nonsense(k), b=nonsense(k + 1001), n=k % 97), False) for k in range(140)]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty without `://`."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return ascii_lower(part(1)), part(2)


def buckets(host: Column, path: Column) -> Column:
    """Distinct hashed n-grams of both parts."""

    def grams(tag: str, chars: Column, n: int) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(chars) - n, F.lit(0)))
        gram = lambda i: F.concat(*[F.coalesce(F.get(chars, i + k), F.lit("")) for k in range(n)])
        return F.transform(at, lambda i: F.pmod(F.xxhash64(F.lit(tag), gram(i)), F.lit(DIMS)).cast("int"))

    def every(tag: str) -> Callable[[Column], Column]:
        return lambda c: F.concat(*[grams(tag, c, n) for n in GRAMS])

    # characters as an array, so that long paths take linear time
    chars = lambda s: F.regexp_extract_all(F.concat(F.lit("^"), s, F.lit("$")), F.lit("(?s)."), F.lit(0))
    return F.array_distinct(F.concat(*[let(chars(s), every(t)) for t, s in (("h", host), ("p", path))]))


def train(labelled: DataFrame) -> list[float]:
    """DIMS weights and a bias from (url string, unwanted boolean); the table must be small, as its kernel is one row."""
    host, path = url_parts(F.col("url"))
    rows = labelled.where("unwanted is not null").select(buckets(host, path).alias("x"), F.col("unwanted").cast("double").alias("y"))
    rows = rows.agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("rows")).select(F.posexplode("rows").alias("i", "r")).select("i", "r.x", "r.y")
    n = F.size("x")
    # bucket -1, of all rows, so that each pair has an entry
    entries = rows.select("i", n.alias("n"), F.explode(F.array_append("x", F.lit(-1))).alias("f"))
    other = entries.select(F.col("i").alias("j"), F.col("n").alias("m"), "f")
    kernel = entries.join(other, "f").groupBy("i", "n", "j", "m").agg((F.count("*") - 1).alias("both"))
    kernel = kernel.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", (F.col("both") / F.sqrt(F.col("n") * F.col("m"))).alias("k")))).alias("near")).select("i", F.col("near.k").alias("near"))
    packed = rows.join(kernel, "i").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y", "near"))).alias("rows")).where(F.size("rows") > 0)
    start = F.struct(F.transform("rows", lambda r: F.lit(0.0)).alias("alpha"), F.lit(0.0).alias("b"))

    def step(at: Column, _: Column) -> Column:
        margin = lambda r: F.aggregate(F.zip_with(r["near"], at["alpha"], lambda k, a: k * a), at["b"], lambda acc, x: acc + x)
        errors = F.transform("rows", lambda r: r["y"] - 1 / (1 + F.exp(-margin(r))))
        moved = lambda e: F.struct(
            F.zip_with(at["alpha"], e, lambda a, x: a + RATE * (x - RIDGE * a)).alias("alpha"), (at["b"] + BIAS_RATE * F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x) / F.size(e)).alias("b")
        )
        return let(errors, moved)

    fitted = packed.select("rows", F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step).alias("fit"))
    each = fitted.select(F.explode(F.arrays_zip("rows", F.col("fit.alpha").alias("alpha"))).alias("z"), "fit.b").select("z.rows.x", "z.rows.i", "z.alpha", "b")
    # bucket DIMS is the bias
    shares = each.select(F.explode("x").alias("f"), (F.col("alpha") / F.sqrt(n)).alias("w")).unionByName(each.where("i = 0").select(F.lit(DIMS).alias("f"), F.col("b").alias("w")))
    total = {r.f: r.w for r in shares.groupBy("f").agg(F.sum("w").alias("w")).collect()}  # at most DIMS + 1 rows
    return [total.get(f, 0.0) for f in range(DIMS + 1)]


@once_a_session
def default_weights() -> list[float]:
    """Of the default labelled table, fitted once a session."""
    return train(default_labels(SparkSession.active()))


def default_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_urls(), "url string, unwanted boolean")


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]] = (), labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, score (probability of being unwanted) and verdict."""
    weights = train(labelled) if labelled is not None else default_weights()
    w = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # folded into one literal
    host, path = url_parts(pages[url_col].cast("string"))
    parts = pages.select(pages[id_col].alias("id"), host.alias("host"), path.alias("path"))
    fits = [(h + p, v, ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)) for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1]))]
    rule = F.coalesce(*[F.when(ok, F.lit(r)) for r, _, ok in fits], F.lit(None).cast("string"))
    said = F.coalesce(*[F.when(ok, F.lit(v)) for _, v, ok in fits], F.lit(None).cast("string"))
    margin = F.aggregate("x", F.lit(0.0), lambda acc, f: acc + F.get(w, f)) / F.sqrt(F.size("x")) + F.get(w, F.lit(DIMS))
    out = parts.withColumn("x", buckets(F.col("host"), F.col("path"))).select("id", "host", "path", rule.alias("rule"), said.alias("said"), (1 / (1 + F.exp(-margin))).alias("score"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", "score", F.coalesce("said", F.when(F.col("score") > BLOCK_AT, "block").otherwise("allow")).alias("verdict"))
