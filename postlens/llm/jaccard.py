"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct SHINGLE-word shingles, as 64-bit hashes. Sizes
fall into bands such that any pair over the threshold shares a band. In each band the
hash universe is cut into blocks, and a set's sketch holds, per block, the XOR of its
hashes: two sketches differ in at most as many blocks as the sets have different
elements. A pair over the threshold differs in at most D blocks, so of a set's
non-empty blocks at least (their number - D) agree, and, with all block values in one
global order by frequency, the D + 1 rarest ones of both must meet (pigeonhole).
Frequencies come from an exchange between document parts and key buckets. Candidates
that also pass the sizes and the Hamming distance of a 256-bit parity sketch are
verified on the whole sets.

Equal sets form one class. Values that up to SMALL classes share yield all pairs.
Larger groups are compared with three of their members first; where that leaves more
than one component in a group, the sketches of all members of different components are
compared in tiles of bounded size and what passes is verified, so no link between
components is lost and no large group yields all its pairs.

Defined cases: documents with no words (or null text) have an empty set and are linked
with nothing; with fewer than SHINGLE words the whole sequence is one shingle; repeated
rows are members of one class; documents with the same id and other text keep their
own classes; the component of a null id ignores that id; extra columns are ignored; very
long texts have all their shingles; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, checkpointed
from .parts import PART_BYTES, ascii_words, bucket_count, bucket_edges, in_parts, mix, part_count

SHINGLE, SMALL = 5, 8
#: The threshold is UP / DOWN = 75 / 100.
UP, DOWN = 75, 100
#: In bands of sets of up to so many elements, every element is a block of its own.
SINGLE = 150
#: Bits of the sketch that is compared where the narrow one passes.
WIDE = 1024
#: Members of a key that meet in one tile, on either side.
TILE = 1024
#: Rows of a pivot's groups that are dealt together.
SHARE = 4096
#: Pairs that a task of tiles holds back, so as not to emit them again.
KNOWN_PAIRS = 500_000


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    words = ascii_words(text)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if not len(h):
        return h
    size = min(size, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += h[i : len(h) - size + 1 + i]
    out = mix(out)
    out.sort()
    return out[np.r_[True, out[1:] != out[:-1]]]


def four_bytes(x: np.ndarray) -> bytes:
    """The low half of each value: enough within a bucket, where it only has to tell frequencies apart."""
    return x.astype(np.uint32).tobytes()


def levels(largest: int) -> list[int]:
    """Level j holds sizes from out[j] to out[j + 1] - 1; a partner of a set of level j is of level j - 1, j or j + 1."""
    out = [1]
    while out[-1] <= largest:
        out.append(out[-1] * DOWN // UP + 1)
    return out


def band_of(n: int) -> list[tuple[int, int, int]]:
    """(band, most elements that a pair of the band differs in, blocks or 0) for each band of a set of n elements."""
    edge = levels(n)
    level = len(edge) - 2
    out = []
    for j in (level - 1, level):
        if j >= 0:
            most = edge[j + 1] - 1
            # |A ^ B| <= (|A| + |B|) * (1 - t) / (1 + t), the smaller of level j
            d = (most + most * DOWN // UP) * (DOWN - UP) // (DOWN + UP)
            out.append((j, d, 0 if most <= SINGLE else math.ceil(1.5 * d + 8 * math.sqrt(d) + 8)))
    return out


def block_values(s: np.ndarray, band: int, blocks: int, salt: int) -> np.ndarray:
    """The non-empty blocks of a set's sketch, as one number for each that holds band, block and XOR."""
    tag = np.uint64((band * 1_000_003 + salt * 7_919 + 1) & 0xFFFFFFFF)
    if not blocks:
        return np.unique(mix(s + (tag << np.uint64(20))))
    at = (mix(s ^ (tag << np.uint64(32))) >> np.uint64(33)) % np.uint64(blocks)
    order = np.argsort(at.astype(np.uint16 if blocks < 1 << 16 else np.uint32), kind="stable")
    at = at[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return mix(np.bitwise_xor.reduceat(s[order], first) + mix(at[first] * np.uint64(0x632BE59BD9B4E019) + (tag << np.uint64(20))))


def pack_times(f: np.ndarray) -> tuple[bytes, bytes]:
    """Which numbers are over 1, and these."""
    return np.packbits(f > 1).tobytes(), f[f > 1].astype(np.int32).tobytes()


def unpack_times(n: int, common: bytes, times: bytes) -> np.ndarray:
    out = np.ones(n, np.int64)
    out[np.flatnonzero(np.unpackbits(np.frombuffer(common, np.uint8))[:n])] = np.frombuffer(times, np.int32)
    return out


def distinct(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As np.unique of all values together, with inverse and counts, in about half its memory; empties the list."""
    values = np.concatenate([np.zeros(0, np.uint64), *found])
    found.clear()
    order = np.argsort(values)
    values = values[order]
    first = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=first[1:])
    back = np.empty(len(values), np.int32)
    back[order] = np.cumsum(first, dtype=np.int32) - 1
    del order
    values = values[first]
    return values, back, np.bincount(back, minlength=len(values))


def part_values(texts: pd.Series, buckets: int, salts: dict[int, int]) -> tuple[list, np.ndarray, np.ndarray, list[int]]:
    """Per text (set, [(band, D, places of its values)]); the part's distinct values, sorted; in how many classes each is; where each bucket begins."""
    docs, found, known, total = [], [], {}, 0
    for t in texts:
        s = shingles(t)
        key = xxhash.xxh128_digest(s.tobytes())
        if key not in known:  # a class counts once
            own = []
            for j, d, k in band_of(len(s)) if len(s) else []:
                v = block_values(s, j, k * (1 + salts.get(j, 0)), salts.get(j, 0))
                found.append(v)
                own.append((j, d, total, total + len(v)))
                total += len(v)
            known[key] = own
        docs.append((s, known[key]))
    values, back, times = distinct(found)
    return [(s, [(j, d, back[x:y]) for j, d, x, y in own]) for s, own in docs], values, times, bucket_edges(values, buckets)


def sketches(docs: DataFrame, id_col: str, text_col: str, salts: dict[int, int], part_bytes: int) -> DataFrame:
    """A row for each document: id, n, cid (class), weak; and for possible members of a pair: keys, set, s0..s3."""
    n = part_count(docs, text_col, part_bytes)
    buckets = bucket_count(n)
    parts = in_parts(docs, n, id_col, text_col)

    def send(g: pd.DataFrame) -> pd.DataFrame:
        _, values, times, cut = part_values(g.text, buckets, salts)
        rows = [(b, int(g.pid.iloc[0]), four_bytes(values[x:y]), *pack_times(times[x:y])) for b, (x, y) in enumerate(zip(cut, cut[1:], strict=False)) if y > x]
        return pd.DataFrame(rows, columns=["bucket", "pid", "values", "common", "times"])

    def count(g: pd.DataFrame) -> pd.DataFrame:
        own = [np.frombuffer(x, np.uint32) for x in g["values"]]
        _, back = np.unique(np.concatenate(own), return_inverse=True)
        each = np.concatenate([unpack_times(len(x), c, t) for x, c, t in zip(own, g.common, g.times, strict=True)])
        times, rows, at = np.minimum(np.bincount(back, each), 1 << 30).astype(np.int64)[back], [], 0
        for pid, x in zip(g.pid, own, strict=True):
            rows.append((pid, int(g.bucket.iloc[0]), *pack_times(times[at : at + len(x)])))
            at += len(x)
        return pd.DataFrame(rows, columns=["pid", "bucket", "common", "times"])

    def choose(own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        docs, values, times, cut = part_values(own.text, buckets, salts)
        for b, common, f in zip(told.bucket, told.common, told.times, strict=True):
            times[cut[b] : cut[b + 1]] = unpack_times(cut[b + 1] - cut[b], common, f)
        rows = []
        for i, (s, bands) in zip(own.id, docs, strict=True):
            keys, weak = [], []
            for band, d, at in bands:
                f = times[at]
                if len(at) <= d:
                    weak.append(band)
                if np.count_nonzero(f > 1) >= len(at) - d:  # else no partner can agree in enough blocks
                    rare = np.lexsort((at, f))[: d + 1]  # places are in the order of values
                    keys.append(values[at[rare[f[rare] > 1]]])
            digest = np.frombuffer(xxhash.xxh128_digest(s.tobytes()), np.int64)
            keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            row = [i, len(s), int(digest[0]) if len(s) else None, weak, None, None, None, None, None, None, None]
            if len(keys):
                bits = np.packbits((np.bincount((s & np.uint64(255)).astype(np.int64), minlength=256) & 1).astype(np.uint8)).view(np.int64)
                wide = np.packbits((np.bincount((s >> np.uint64(20) & np.uint64(WIDE - 1)).astype(np.int64), minlength=WIDE) & 1).astype(np.uint8))
                row[4:] = [keys.view(np.int64), s.view(np.int64), *map(int, bits), wide.tobytes()]
            rows.append(row)
        names = ["id", "n", "cid", "weak", "keys", "set", "s0", "s1", "s2", "s3", "wide"]
        whole = {"cid", "s0", "s1", "s2", "s3"}  # 64-bit numbers or none: never by way of floats
        return pd.DataFrame({c: pd.array(x, "Int64") if c in whole else pd.Series(x, dtype="int64" if c == "n" else None if c == "id" else object) for c, x in zip(names, zip(*rows, strict=True), strict=True)})

    answers = parts.groupBy("pid").applyInPandas(send, "bucket int, pid int, values binary, common binary, times binary").groupBy("bucket").applyInPandas(count, "pid int, bucket int, common binary, times binary")
    kind = docs.schema[id_col].dataType.simpleString()
    return parts.groupBy("pid").cogroup(answers.groupBy("pid")).applyInPandas(choose, f"id {kind}, n long, cid long, weak array<int>, keys array<long>, set array<long>, s0 long, s1 long, s2 long, s3 long, wide binary")


def verified(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold; classes has a row for each cid."""
    facts = classes.select("cid", "n", "s0", "s1", "s2", "s3")
    side = lambda df, x: df.toDF(*[x if c == "cid" else f"{x}_{c}" for c in df.columns])
    p = pairs.join(side(facts, "a"), "a").join(side(facts, "b"), "b")
    apart = sum((F.bit_count(F.col(f"a_s{k}").bitwiseXOR(F.col(f"b_s{k}"))) for k in range(4)), F.lit(0))
    small, large = F.least("a_n", "b_n"), F.greatest("a_n", "b_n")
    p = checkpointed(p.where((large * UP <= small * DOWN) & (apart * (DOWN + UP) <= (F.col("a_n") + F.col("b_n")) * (DOWN - UP))).select("a", "b"))
    involved = p.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    sets = classes.select("cid", "set").join(involved, "cid", "left_semi")  # only these sets travel
    p = p.join(side(sets, "a"), "a").join(side(sets, "b"), "b")
    both = F.size(F.array_intersect("a_set", "b_set"))
    return p.where(both * DOWN >= (F.size("a_set") + F.size("b_set") - both) * UP).select("a", "b")


def tiles(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of a key's members in different components whose sizes and sketches allow a link.

    A key's members are dealt into blocks of about TILE; every two blocks meet in a
    tile of bounded size, where sketches are compared as arrays. Only the pairs that
    pass leave a tile.
    """
    blocks = F.ceil(F.col("size") / TILE).cast("int")
    own = members.withColumn("own", F.pmod(F.xxhash64("cid"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = own.select("p1", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cid", "comp", "n", "s0", "s1", "s2", "s3", "wide")
    # groups with one pivot have members in common: together, they repeat few pairs; a pivot of many groups has several shares
    shares = dealt.groupBy("p1").agg(F.ceil(F.count("*") / SHARE).alias("shares"))
    dealt = dealt.join(shares, "p1").withColumn("share", F.pmod(F.xxhash64("key"), F.col("shares")))
    dealt = dealt.repartition("p1", "share", "i", "j").sortWithinPartitions("p1", "key", "i", "j")

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        i, j = int(g.i.iloc[0]), int(g.j.iloc[0])
        x, y = (g, g) if i == j else (g[g.own == i], g[g.own == j])
        apart = sum(np.bitwise_count(x[c].to_numpy(np.int64).view(np.uint64)[:, None] ^ y[c].to_numpy(np.int64).view(np.uint64)[None]).astype(np.int64) for c in ("s0", "s1", "s2", "s3"))
        n, m = x.n.to_numpy()[:, None], y.n.to_numpy()[None]
        ok = (x.comp.to_numpy()[:, None] != y.comp.to_numpy()[None]) & (np.maximum(n, m) * UP <= np.minimum(n, m) * DOWN) & (apart * (DOWN + UP) <= (n + m) * (DOWN - UP))
        a, b = np.nonzero(ok)
        if len(a):  # the wide sketch, only where the narrow one passes
            one, two = (np.frombuffer(b"".join(z.wide), np.uint64).reshape(len(z), -1) for z in (x, y))
            wide = np.concatenate([np.bitwise_count(one[a[k : k + 65536]] ^ two[b[k : k + 65536]]).sum(axis=1, dtype=np.int64) for k in range(0, len(a), 65536)])
            fine = wide * (DOWN + UP) <= (x.n.to_numpy()[a] + y.n.to_numpy()[b]) * (DOWN - UP)
            a, b = a[fine], b[fine]
        a, b = x.cid.to_numpy()[a], y.cid.to_numpy()[b]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        left = None  # the rows of the tile that may go on in the next batch
        for batch in batches:
            if left is not None:
                batch = pd.concat([left, batch], ignore_index=True)
            tile = batch.groupby(["key", "i", "j"], sort=False).ngroup().to_numpy()
            cut = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
            left = batch.iloc[cut[-1] :]
            known = pd.concat([known, *(compare(batch.iloc[x:y]) for x, y in zip(cut, cut[1:], strict=False))]).drop_duplicates()
            if len(known) > KNOWN_PAIRS:
                yield known
                known = known.iloc[:0]
        if left is not None and len(left):
            known = pd.concat([known, compare(left)]).drop_duplicates()
        yield known

    return dealt.mapInPandas(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(cid, comp): the smallest cid that each one reaches, by neighbours' minima and pointer jumps."""
    both = checkpointed(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = checkpointed(both.groupBy("a").agg(F.least("a", F.min("b")).alias("comp")).select(F.col("a").alias("cid"), "comp"))
    while True:
        near = both.join(label.select(F.col("cid").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        step = label.join(near.withColumnRenamed("a", "cid"), "cid").select("cid", "comp", F.least("comp", "near").alias("low"))
        jump = label.select(F.col("cid").alias("low"), F.col("comp").alias("far"))
        new = checkpointed(step.join(jump, "low", "left").select("cid", F.col("comp").alias("old"), F.least("low", F.coalesce("far", "low")).alias("comp")))
        if new.where("old <> comp").isEmpty():
            return new.select("cid", "comp")
        label = new.select("cid", "comp")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id of its component). Links are made when this is called."""
    salts: dict[int, int] = {}
    scratch = Scratch(docs.sparkSession)
    while True:
        made = scratch.written(sketches(docs, id_col, text_col, salts, part_bytes), 16)
        scratch.release()
        weak = [r[0] for r in made.select(F.explode("weak")).distinct().collect()]  # bands: a few dozen at most
        if not weak:
            break
        for band in weak:  # a set fills too few blocks for the pigeonhole: deal this band's into more blocks
            salts[band] = salts.get(band, 0) + 1
        scratch.remove(made)
    rows = Scratch(docs.sparkSession).written(made.select("id", "n", "cid"))  # stays: the result reads it
    possible = made.where("keys is not null")
    classes = scratch.written(possible.groupBy("cid").agg(*[F.first(c).alias(c) for c in ("n", "set", "keys", "s0", "s1", "s2", "s3", "wide")]))
    scratch.remove(made)  # and the shuffles of both
    entries = classes.select("cid", F.explode("keys").alias("key"))
    marks = [F.bit_xor(F.xxhash64("cid", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    groups = entries.groupBy("key").agg(F.count("*").alias("size"), *marks).where("size > 1")
    groups = groups.groupBy("size", "x1", "x2").agg(F.min("key").alias("key")).select("size", "key")  # one of the groups with equal members
    member = scratch.written(entries.join(groups, "key"))
    # pivots: members that share most of their values, as the text that others were copied from does
    large = member.where(F.col("size") > SMALL).join(classes.select("cid", F.size("keys").alias("shared")), "cid")
    pivots = [F.max_by("cid", F.struct("shared", x)).alias(p) for p, x in (("p1", F.col("cid")), ("p2", -F.col("cid")), ("p3", F.xxhash64("cid")))]
    large = scratch.written(large.select("key", "size", "cid").join(large.groupBy("key").agg(*pivots), "key"))
    tiny = member.where(F.col("size") <= SMALL).select("key", "cid")
    pairs = tiny.alias("x").join(tiny.alias("y"), "key").where("x.cid < y.cid").select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"))
    star = large.select("cid", F.explode(F.array_distinct(F.array("p1", "p2", "p3"))).alias("p")).where("cid <> p").select(F.least("cid", "p").alias("a"), F.greatest("cid", "p").alias("b"))
    pairs = checkpointed(pairs.unionByName(star).distinct())
    scratch.release()
    edges = checkpointed(verified(pairs, classes))
    label = components(edges)
    # large groups that still hold several components: all pairs across them
    named = large.select("key", "size", "p1", "cid").join(label, "cid", "left").select("key", "size", "p1", "cid", F.coalesce("comp", "cid").alias("comp"))
    split = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    named = named.join(split, "key")
    across = tiles(named.join(classes.select("cid", "n", "s0", "s1", "s2", "s3", "wide"), "cid")).distinct()
    more = checkpointed(verified(across.join(pairs, ["a", "b"], "left_anti"), classes))
    if not more.isEmpty():
        label = components(edges.unionByName(more))
    scratch.remove(classes, member, large)
    rows = rows.join(label, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    low = rows.where("comp is not null").groupBy("comp").agg(F.min("id").alias("low"))
    own: Column = F.coalesce("low", "id")
    return rows.join(low, "comp", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))
