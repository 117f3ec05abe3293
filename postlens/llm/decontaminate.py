"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Texts become words (runs of letters and digits, lower case). A document and an item
overlap if, aligned in some way, at least SHARE of the words of some stretch agree in
place, so substituted words are tolerated. A stretch has WINDOW words, or all words of
a shorter item; a document of fewer than WINDOW words has a stretch of its own words,
but of LEAST_STRETCH at least (of which it can fill a part), unless the item is shorter.
For each length of a stretch there is a set of masks, which keep some positions of a
window and ignore the others: any allowed pattern of substitutions leaves the kept
positions of one mask untouched somewhere in the stretch, so that no overlap is lost.
Windows of texts and items that agree on a mask's kept positions are joined by hash,
and the texts are compared word by word around each hit. Texts go through the join in
chunks of CHUNK positions, so that a hit holds the words around it, not the whole text.
Seeds of the benchmark are broadcast in blocks of at most SEEDS_PER_BLOCK rows; a larger
benchmark takes one more pass per block, one pass after the other. Items of equal words
have the same seeds, which are made once.

Defined cases: null and empty texts have no words and never match; an item of very few
words matches each text that holds them; very long texts are compared as a whole; repeated rows of a document merge by id (a null
id is an id of its own); a benchmark item with a null id is kept as such, the texts of
one that repeats an id count together; extra columns are ignored; with either table
empty the result is empty.
"""

from __future__ import annotations

from functools import cache, reduce
from itertools import combinations
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, checkpointed, release, spread

WINDOW, LEAST_STRETCH, SHARE = 13, 9, 0.75
#: Kept positions of a mask, and masks of one length, at most.
WEIGHT, MASKS = 6, 8
SEEDS_PER_BLOCK = 200_000
#: Seeds of finished blocks after which executors are told to drop them.
SEEDS_HELD = 1_000_000
#: Positions of a text that go through the join together.
CHUNK = 64
#: Up to so many keys of overlapping documents (8 bytes each) are broadcast.
BROADCAST_KEYS = 2_000_000


@cache
def masks(length: int) -> tuple[tuple[int, ...], ...]:
    """Kept positions of masks that hit every pattern of allowed substitutions in a stretch: the heaviest set of at most MASKS that a greedy choice finds."""
    wrong = length - ceil(length * SHARE)
    patterns = [set(c) for c in combinations(range(length), wrong)]
    for weight in range(min(WEIGHT, length - wrong), 0, -1):
        hit = {}
        for rest in combinations(range(1, length), weight - 1):
            kept = (0, *rest)
            hit[kept] = {n for n, p in enumerate(patterns) if any(p.isdisjoint(at + i for i in kept) for at in range(length - kept[-1]))}
        chosen, left = [], set(range(len(patterns)))
        while left and len(chosen) < MASKS:
            best = max(hit, key=lambda m: len(hit[m] & left))
            chosen.append(best)
            left -= hit[best]
        if not left:
            break
    return tuple(chosen)


def words(text: Column) -> Column:
    """Hashes of the words of a text."""
    split = F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.array_remove(split, ""), lambda w: F.xxhash64(w))


def windows(rows: DataFrame, fits: Column) -> DataFrame:
    """A row for each word position of the (id, w, n) that fit, with n words in w. After that w holds the words of the position's chunk and WINDOW - 1 more on both sides, and the position in it is `at`."""
    around, others = WINDOW - 1, [c for c in rows.columns if c != "w"]

    def piece(start: Column) -> Column:
        before = F.least(start, F.lit(around))
        return F.struct(before.alias("at"), F.least(F.col("n") - start, F.lit(CHUNK)).alias("own"), F.slice("w", start - before + 1, before + CHUNK + around).alias("w"))

    # a function of arrays in the explode: pieces are then passed on one by one, not all that a text gives
    pieces = F.when(fits & (F.col("n") > 0), F.transform(F.sequence(F.lit(0), F.col("n") - 1, F.lit(CHUNK)), piece))
    return rows.select(*others, F.explode(pieces).alias("piece")).select(*others, "piece.w", F.explode(F.sequence(F.col("piece.at"), F.col("piece.at") + F.col("piece.own") - 1)).alias("at"))


def keys(length: int) -> Column:
    """One hash for each mask of the length at `at`; null where the mask ends beyond the text."""
    key = lambda k, own: F.xxhash64(F.lit(length), F.lit(k), *[F.get("w", F.col("at") + i) for i in own])
    return F.array(*[F.when(F.col("at") + own[-1] < F.size("w"), key(k, own)) for k, own in enumerate(masks(length))])


def keys_of(lengths: dict[int, Column]) -> Column:
    """The keys of all lengths whose condition holds."""
    none = F.array().cast("array<bigint>")
    return F.flatten(F.array(*[F.when(fits, keys(n)).otherwise(none) for n, fits in lengths.items()]))


def context() -> Column:
    """The word at `at` and WINDOW - 1 more on both sides; null beyond the text."""
    return F.transform(F.sequence(F.lit(1 - WINDOW), F.lit(WINDOW - 1)), lambda i: F.when(F.col("at") + i >= 0, F.get("w", F.col("at") + i)))


def agreement() -> Column:
    """The most words that agree in place in a WINDOW-word stretch that holds the word at `at`.

    Of one element, to be exploded: a filter on it then stays above the join, whose generated code is small enough to be compiled.
    """
    same = F.zip_with("context", "item_context", lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0)))
    return F.array(F.array_max(F.transform(F.sequence(F.lit(1), F.lit(WINDOW)), lambda s: F.aggregate(F.slice(same, s, F.lit(WINDOW)), F.lit(0), lambda x, y: x + y))))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", seeds_per_block: int = SEEDS_PER_BLOCK) -> DataFrame:
    """A row for each overlapping pair: document id, item id, matched (words that agree in the best stretch), stretch (its words) and hits."""
    d = spread(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))).select("id", words(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    texts = spread(benchmark.select(benchmark[item_col].alias("item"), benchmark[item_text_col].alias("text"))).select("item", words(F.col("text")).alias("w"))
    items = checkpointed(texts.select("item", F.xxhash64("w").alias("same"), "w", F.size("w").alias("n")).where("n > 0"))
    b = items.drop("item").dropDuplicates(["same"])
    n = F.col("n")
    short = sorted(r.n for r in b.where(n < WINDOW).select("n").distinct().collect())  # at most WINDOW - 1 numbers
    middle = range(LEAST_STRETCH, WINDOW)
    of_item = {k: n == k for k in short if k < LEAST_STRETCH} | {k: n >= k for k in middle}
    at = windows(b, F.lit(True)).select("same", F.col("n").alias("item_n"), "n", "w", "at", context().alias("item_context"))
    made = [at.select("same", "item_n", "item_context", F.lit(full).alias("full"), F.explode(x).alias("key")) for full, x in ((True, keys(WINDOW)), (False, keys_of(of_item)))]
    seeds = checkpointed(reduce(DataFrame.unionByName, made).where("key is not null").distinct())
    blocks = {r.full: -(-r["count"] // seeds_per_block) for r in seeds.groupBy("full").count().collect()}
    # most documents need the masks of one length only; the others are apart, as their longer code is not compiled
    whole = F.greatest("n", F.lit(LEAST_STRETCH))
    of_short = {k: (whole == k) | ((whole > k) if k in short else F.lit(False)) for k in sorted({*short, *middle})}
    few = F.lit(True) if short else n < WINDOW
    scratch = Scratch(docs.sparkSession)
    d_few = scratch.written(d.where(few)) if blocks.get(False, 0) > 1 and not short else d
    starts = {True: windows(d, n >= WINDOW).select("id", "n", "w", "at", F.explode(keys(WINDOW)).alias("key")), False: windows(d_few, few).select("id", "n", "w", "at", F.explode(keys_of(of_short)).alias("key"))}

    def matches(full: bool, k: int) -> DataFrame:
        own = seeds.where(F.col("full") == full).drop("full")
        own = own.where(F.pmod(F.hash("key"), F.lit(blocks[full])) == k) if blocks[full] > 1 else own
        stretch = F.least(F.lit(WINDOW), "item_n", whole).alias("stretch")
        hits = starts[full].join(F.broadcast(own), "key").select("id", "same", stretch, context().alias("context"), "item_context")
        return hits.select("id", "same", "stretch", F.explode(agreement()).alias("matched")).where(F.col("matched") >= F.ceil(F.col("stretch") * SHARE))

    def merged(found: DataFrame, *by: str, hits: Column) -> DataFrame:
        return found.groupBy(*by).agg(F.max("matched").alias("matched"), F.max("stretch").alias("stretch"), hits.alias("hits"))

    passes = [(full, k) for full in (True, False) for k in range(blocks.get(full, 0))] or [(True, 0)]
    blocks.setdefault(True, 1)
    if max(blocks.values()) == 1:
        found = merged(reduce(DataFrame.unionByName, [matches(*x) for x in passes]), "id", "same", hits=F.count("*"))
    else:  # one block at a time is in memory
        parts = []
        for done, x in enumerate(passes, 1):
            parts.append(scratch.written(merged(matches(*x), "id", "same", hits=F.count("*"))))
            if done % max(1, SEEDS_HELD // seeds_per_block) == 0:
                release(docs.sparkSession)
        found = merged(reduce(DataFrame.unionByName, parts), "id", "same", hits=F.sum("hits"))
    out = merged(found.hint("merge").join(items.select("item", "same").distinct(), "same"), "id", "item", hits=F.sum("hits"))
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "matched", "stretch", "hits")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that overlap with a benchmark item. Rows are judged by id and text, so a clean one stays even if its id, or none, is shared."""
    key = "row_key"
    while key in docs.columns:
        key += "_"
    keyed = docs.withColumn(key, F.xxhash64(docs[id_col], docs[text_col].cast("string")))
    bad = checkpointed(contaminated(keyed, benchmark, key, text_col).select(key).distinct())
    small = bad.count() <= BROADCAST_KEYS  # else both sides are shuffled
    return keyed.join(F.broadcast(bad) if small else bad, key, "left_anti").select(*[keyed[c] for c in docs.columns])
