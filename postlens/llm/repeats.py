"""Removal of long repeated substrings by merging shard Burrows-Wheeler transforms.

A string of SPAN bytes that also starts in a document with a smaller id is a repeat;
every byte that a repeat covers is removed. Candidates first: each SPAN-byte window
has one anchor, the minimal hash of its ANCHOR-byte strings, so equal windows have
equal anchors. An exchange between document parts and hash buckets tells which
anchors several documents hold. Around these, the stretch of windows with one anchor
(its context) goes once per part to the anchor's bucket. There the distinct contexts
that may share a window form shards; each shard gets a suffix order and its
Burrows-Wheeler transform, and transforms are merged by refining their interleave, two
symbols of depth at a time: after SPAN symbols the blocks of the interleave are the
intervals of suffixes with a common prefix of SPAN bytes. Each interval's smallest
document id goes back to the parts, which mark the covered bytes. An anchor with very
many contexts would fill its bucket: in its place the hash of each of its windows goes
to the bucket of that hash, where it is one entry per part.

Defined cases: ids are integers; null text counts as empty; shorter texts than SPAN lose
nothing; very long texts are scanned slice by slice; rows with equal ids don't count as
smaller to each other; rows with a null id neither lose bytes nor make others lose any;
extra columns are ignored; an empty table gives no rows; strings are judged on the
input texts, and matches never cross documents.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .parts import PART_BYTES, bucket_count, bucket_edges, five_bytes, from_five, in_parts, mix, part_count

SPAN, ANCHOR = 50, 16
WIDTH = SPAN - ANCHOR + 1
#: Windows whose anchors lie in one of STEP places have CORE bytes in common.
STEP = 7
CORE = SPAN - STEP + 1
#: A part's texts are worked on in chunks of about so many bytes, longer texts in slices.
CHUNK, SLICE = 1 << 16, 1 << 20
#: An anchor is frequent if it has about so many contexts.
FREQUENT = 1 << 14
#: Contexts are dealt into shards of about so many bytes, at least two; so many bytes of contexts are merged at a time.
SHARD_BYTES, MERGE_BYTES = 4 << 20, 16 << 20
FACTOR = 0x9E3779B97F4A7C15


def eight_bytes(b: np.ndarray) -> np.ndarray:
    """The 8 bytes that start at each position, as one number; zeros beyond the end."""
    padded = np.concatenate([b, np.zeros(16, np.uint8)])
    out = np.empty(len(b) + 8, np.uint64)
    for k in range(8):
        n = (len(padded) - k) // 8
        own = out[k::8]
        own[:] = padded[k : k + 8 * n].view("<u8")[: len(own)]
    return out[: len(b)]


def hashes(joined: bytes) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """64-bit hashes of the strings with these starts and sizes."""
    up, down = (np.cumprod(np.r_[np.uint64(1), np.full(len(joined), f, np.uint64)]) for f in (FACTOR, pow(FACTOR, -1, 1 << 64)))  # modulo 2 ** 64
    total = np.r_[np.uint64(0), np.cumsum(mix(np.frombuffer(joined, np.uint8) + np.uint64(1)) * up[:-1])]
    return lambda start, size: (total[start + size] - total[start]) * down[start]


class Chunk:
    """Slices of texts, and their stretches: slice number, first and last window (within the joined slices), place of the anchor in the stretch, its hash."""

    def __init__(self, slices: list[tuple[int, int, bytes]]):
        #: (row, offset within the row's text, bytes)
        self.slices = slices
        self.joined = b"".join(x[2] for x in slices)
        self.doc = self.first = self.last = self.offset = np.zeros(0, np.int64)
        self.anchor = np.zeros(0, np.uint64)
        if len(self.joined) >= SPAN:
            self._find()

    def _find(self) -> None:
        b = np.frombuffer(self.joined, np.uint8)
        sizes = np.array([len(x[2]) for x in self.slices])
        ends = np.cumsum(sizes)
        x = eight_bytes(b)
        h = x[: len(b) - ANCHOR + 1] * np.uint64(FACTOR)
        h ^= h >> np.uint64(32)
        h += x[8 : len(b) - ANCHOR + 9] * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(30)
        # 32 bits of hash, then the place: equal hashes go to the first place, in any text
        low = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= WIDTH:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < WIDTH:
            low = np.minimum(low[: len(low) - (WIDTH - width)], low[WIDTH - width :])
        place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)  # of each window's anchor
        window = np.arange(len(place))
        doc = np.repeat(np.arange(len(sizes)), sizes)[: len(place)]
        fits = window + SPAN <= ends[doc]
        differs = place[1:] != place[:-1]
        first, last = fits.copy(), fits.copy()
        first[1:] &= differs | ~fits[:-1] | (doc[1:] != doc[:-1])
        last[:-1] &= differs | ~fits[1:] | (doc[1:] != doc[:-1])
        self.first, self.last = np.flatnonzero(first), np.flatnonzero(last)
        self.doc, at = doc[self.first], place[self.first]
        self.offset, self.anchor = at - self.first, mix(h[at])  # minimal hashes are small: mixed, they spread over buckets

    def contexts(self, common: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the common anchors: slice number, first window, size, offset, key for the bucket, name, and whether it is a lone window of a frequent anchor."""
        at = np.minimum(np.searchsorted(common, self.anchor), max(len(common) - 1, 0))
        ok = common[at] == self.anchor if len(common) else np.zeros(len(self.anchor), bool)
        lone = frequent[at[ok]] if len(common) else np.zeros(0, bool)
        doc, first, last, offset, key = self.doc[ok], self.first[ok], self.last[ok], self.offset[ok], self.anchor[ok]
        hashed = hashes(self.joined)
        if lone.any():
            times = np.where(lone, last - first + 1, 1)
            begin = np.cumsum(times) - times
            step = np.arange(times.sum()) - np.repeat(begin, times)
            doc, first, last, offset, key, lone = (np.repeat(x, times) for x in (doc, first, last, offset, key, lone))
            first = first + step
            last = np.where(lone, first, last)
        size = last + SPAN - first
        name = mix(hashed(first, size) + size.astype(np.uint64))
        return doc, first, size, offset, np.where(lone, mix(name), key), name, lone


def chunks(texts: list[str]) -> Iterator[Chunk]:
    """All texts, by row number; slices of a long text overlap, so that each window lies in one of them."""
    own, size = [], 0
    for row, t in enumerate(texts):
        raw = t.encode("utf-8", "surrogatepass")
        for at in range(0, max(len(raw) - SPAN + 1, 1), SLICE):
            own.append((row, at, raw[at : at + SLICE + SPAN - 1]))
            size += len(own[-1][2])
            if size >= CHUNK:
                yield Chunk(own)
                own, size = [], 0
    if own:
        yield Chunk(own)


def part_anchors(ids: np.ndarray, scanned: list[Chunk]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct anchors of a part, sorted; whether documents of several ids in it hold each; the base-2 logarithm of its stretches, 15 at most."""
    h = np.concatenate([np.zeros(0, np.uint64), *(c.anchor for c in scanned)])
    own = np.concatenate([np.zeros(0, np.int64), *(ids[np.array([x[0] for x in c.slices], np.int64)[c.doc]] for c in scanned)])
    order = np.argsort(h)
    h, own = h[order], own[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
    if not len(first):
        return h, np.zeros(0, bool), np.zeros(0, np.uint8)
    times = np.minimum(np.log2(np.diff(np.r_[first, len(h)])), 15).astype(np.uint8)
    return h[first], np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first), times


def part_contexts(ids: np.ndarray, scanned: list[Chunk], common: np.ndarray, frequent: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, list]:
    """Distinct contexts (lone windows: their names), offsets of their anchors, keys and smallest ids; and per chunk (slice number, first window, context) of all occurrences.

    Contexts are told apart by a 64-bit hash of their bytes, mixed with their length.
    """
    found, keep = [], []
    for c in scanned:
        doc, first, size, offset, key, name, lone = c.contexts(common, frequent)
        found.append((name, key, ids[np.array([x[0] for x in c.slices], np.int64)[doc]], offset, lone))
        keep.append((c, doc, first, size))
    name, key, own, offset, lone = (np.concatenate([np.zeros(0, kind), *(x[k] for x in found)]) for k, kind in enumerate((np.uint64, np.uint64, np.int64, np.int64, bool)))
    values, one, number = np.unique(name, return_index=True, return_inverse=True)
    low = np.full(len(values), np.iinfo(np.int64).max)
    np.minimum.at(low, number, own)
    contexts: list = [None] * len(values)
    for k in np.flatnonzero(lone[one]).tolist():
        contexts[k] = values[k].tobytes()
    seen, base = [], 0
    for c, doc, first, size in keep:
        mine = number[base : base + len(first)]
        new = np.flatnonzero((one[mine] == np.arange(base, base + len(first))) & ~lone[base : base + len(first)])
        for k, s, e in zip(mine[new].tolist(), first[new].tolist(), (first + size)[new].tolist(), strict=True):
            contexts[k] = c.joined[s:e]
        seen.append((c, doc, first, mine))
        base += len(first)
    return contexts, offset[one], key[one], low, seen


def windows_in(contexts: list[bytes]) -> np.ndarray:
    """Of each context; the name of a lone window is shorter than any context."""
    return np.maximum(np.array(list(map(len, contexts)), np.int64) - SPAN + 1, 1)


def suffix_order(t: np.ndarray) -> np.ndarray:
    """Positions of t by their first 64 bytes, cyclically; ties by position."""
    n = len(t)
    big = eight_bytes(np.concatenate([t, np.resize(t, 8)])).byteswap()[:n]
    _, rank = np.unique(big, return_inverse=True)
    width = 8
    while width < 64:
        pair = rank.astype(np.int64) * (n + 1) + np.roll(rank, -(width % n))
        _, rank = np.unique(pair, return_inverse=True)
        width *= 2
    return np.argsort(rank, kind="stable")


def transform(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of a shard, and its Burrows-Wheeler transform with the two symbols before each suffix."""
    order = suffix_order(t)
    return order, t[order - 2].astype(np.uint16) << np.uint16(8) | t[order - 1]


def merge(one: np.ndarray, two: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of two transforms, refined to `depth` symbols (an even number), two in a round: for each merged suffix whether it is of the second, and its block of equal prefixes.

    A round looks at each suffix's preceding symbols in the present order: sorting
    stably by them gives the order by two more symbols. Two neighbours stay in one
    block as long as they have these in common and came from one block.
    """
    z = np.zeros(len(one) + len(two), bool)
    z[len(one) :] = True
    block = np.zeros(len(z), np.int32)
    symbol = np.empty(len(z), np.uint16)
    for _ in range(depth // 2):
        symbol[~z], symbol[z] = one, two
        order = np.argsort(symbol, kind="stable")
        z, came, symbol = z[order], block[order], symbol[order]
        block[0] = 0
        np.cumsum((symbol[1:] != symbol[:-1]) | (came[1:] != came[:-1]), out=block[1:])
    return z, block


def intervals(shards: list[np.ndarray], depth: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For the positions of each shard, the block of positions (over all shards) with the same `depth` bytes ahead."""
    level = []
    for k, t in enumerate(shards):
        order, bwt = transform(t)
        level.append((np.full(len(t), k, np.int32), order, bwt))
    block = np.zeros(0, np.int32)
    while len(level) > 1 or not len(block):
        if len(level) == 1:  # a single shard is merged with an empty one
            level.append((np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint16)))
        merged = []
        for x, y in zip(level[::2], level[1::2], strict=False):
            z, block = merge(x[2], y[2], depth)
            out = []
            for a, b in zip(x, y, strict=True):
                m = np.empty(len(z), a.dtype)
                m[~z], m[z] = a, b
                out.append(m)
            merged.append(tuple(out))
        level = merged + level[len(level) // 2 * 2 :]
    shard, place, _ = level[0]
    found = [np.empty(len(t), np.int32) for t in shards]
    for k, own in enumerate(found):
        mine = shard == k
        own[place[mine]] = block[mine]
    return found, block


def smallest_ids(contexts: list[bytes], offsets: np.ndarray, anchor: np.ndarray, ids: np.ndarray) -> dict[int, np.ndarray]:
    """For contexts that may share a window with another: for each window, the smallest id of the contexts that hold its string."""
    out: dict[int, np.ndarray] = {}
    sizes = np.array(list(map(len, contexts)), np.int64)
    begin = np.cumsum(sizes) - sizes
    hashed = hashes(b"".join(contexts))
    cores, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for left in range(0, WIDTH, STEP):
        k = np.flatnonzero((sizes >= SPAN) & (offsets >= left) & (offsets - left + CORE <= sizes))
        cores.append(mix(mix(hashed(begin[k] + offsets[k] - left, np.full(len(k), CORE)) + np.uint64(left)) + anchor[k]))
        owner.append(k)
    cores, owner = np.concatenate(cores), np.concatenate(owner)
    _, back, times = np.unique(cores, return_inverse=True, return_counts=True)
    chosen = np.unique(owner[times[back] > 1])
    # anchors have no window in common: merged one batch of anchors after the other
    chosen = chosen[np.argsort(anchor[chosen], kind="stable")]
    full = np.cumsum(sizes[chosen] + 1) // MERGE_BYTES
    a = anchor[chosen]
    edge = np.flatnonzero(np.r_[True, a[1:] != a[:-1]][: len(a)])
    cut = edge[np.r_[True, np.diff(full[edge]) > 0][: len(edge)]].tolist()  # where an anchor begins and another batch is full
    for x, y in zip(cut, [*cut[1:], len(chosen)], strict=False):
        merge_batch(contexts, chosen[x:y], ids, out)
    return out


def merge_batch(contexts: list[bytes], chosen: np.ndarray, ids: np.ndarray, out: dict[int, np.ndarray]) -> None:
    sizes = np.array([len(contexts[c]) + 1 for c in chosen])
    n = max(2, -(-int(sizes.sum()) // SHARD_BYTES))
    dealt = [chosen[s::n] for s in range(n)]
    dealt = [d for d in dealt if len(d)]
    shards = [np.frombuffer(b"\x00".join([*(contexts[c] for c in d), b""]), np.uint8) for d in dealt]
    blocks, _ = intervals(shards, SPAN)
    lengths = [np.array([len(contexts[c]) for c in d]) for d in dealt]
    where, owner = [], []
    for d, own, n_bytes in zip(dealt, blocks, lengths, strict=True):
        begin = np.cumsum(n_bytes + 1) - n_bytes - 1
        windows = n_bytes - SPAN + 1
        at = np.repeat(begin - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
        where.append(own[at])
        owner.append(np.repeat(d, windows))
    where, owner = np.concatenate(where), np.concatenate(owner)
    order = np.argsort(where, kind="stable")
    cut = np.flatnonzero(np.r_[True, where[order][1:] != where[order][:-1]])
    low = np.empty(len(where), np.int64)
    low[order] = np.repeat(np.minimum.reduceat(ids[owner][order], cut), np.diff(np.r_[cut, len(where)]))
    for c, x in zip(np.concatenate(dealt), np.split(low, np.cumsum(np.concatenate(lengths) - SPAN + 1)[:-1]), strict=True):
        out[int(c)] = x


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def whole_characters(raw: bytes, mask: np.ndarray) -> str:
    """What is left when only characters go of which all bytes are removed."""
    b = np.frombuffer(raw, np.uint8)
    head = np.flatnonzero((b & 0xC0) != 0x80)
    if not len(b):
        return ""
    gone = np.logical_and.reduceat(mask, head)
    return b[~np.repeat(gone, np.diff(np.r_[head, len(b)]))].tobytes().decode("utf-8", "replace")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES, kept_text: bool = False, carry: list[str] | None = None) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, spans (removed byte ranges), kept_sha256; with kept_text also kept, without partly removed characters lost; then the columns of carry."""
    n = part_count(docs, text_col, part_bytes)
    buckets = bucket_count(n)
    carry = carry or []
    parts = in_parts(docs, n, id_col, text_col, **{f"c{k}": docs[c] for k, c in enumerate(carry)})

    def whole(g: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, list[Chunk]]:
        g = g[g.id.notna()].sort_values(["id", "text"])  # shuffled rows come in any order; contexts are numbered in this one
        return g, g.id.to_numpy(np.int64), list(chunks(g.text.tolist()))

    def bits(x: np.ndarray) -> bytes:
        return np.packbits(x).tobytes()

    def flags(blob: bytes, size: int) -> np.ndarray:
        return np.unpackbits(np.frombuffer(blob, np.uint8))[:size].astype(bool)

    def send_anchors(g: pd.DataFrame) -> pd.DataFrame:
        values, several, times = part_anchors(*whole(g)[1:])
        cut = bucket_edges(values, buckets)
        halves = lambda x: (x[::2] | np.pad(x[1::2], (0, len(x) % 2)) << 4).astype(np.uint8).tobytes()
        rows = [(b, int(g.pid.iloc[0]), five_bytes(values[x:y]), bits(several[x:y]), halves(times[x:y])) for b, (x, y) in enumerate(zip(cut, cut[1:], strict=False)) if y > x]
        return pd.DataFrame(rows, columns=["bucket", "pid", "anchors", "several", "times"])

    def common_anchors(g: pd.DataFrame) -> pd.DataFrame:
        own = [from_five(x) for x in g.anchors]
        _, back, parts_with = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        several = np.bincount(back, np.concatenate([flags(s, len(x)) for s, x in zip(g.several, own, strict=True)])) > 0
        logs = [np.frombuffer(t, np.uint8) for t in g.times]
        times = np.concatenate([np.stack([t & 15, t >> 4], axis=1).ravel()[: len(x)] for t, x in zip(logs, own, strict=True)])
        common = ((parts_with > 1) | several)[back]
        frequent = (np.bincount(back, 2.0**times) >= FREQUENT)[back]
        rows, at = [], 0
        for pid, x in zip(g.pid, own, strict=True):
            rows.append((pid, int(g.bucket.iloc[0]), bits(common[at : at + len(x)]), bits(frequent[at : at + len(x)])))
            at += len(x)
        return pd.DataFrame(rows, columns=["pid", "bucket", "common", "frequent"])

    def contexts_of(own: pd.DataFrame, told: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, tuple, list[int], np.ndarray]:
        """The part's rows and ids, what part_contexts gives, and the order of contexts by bucket with where each begins."""
        own, ids, scanned = whole(own)
        values, _, _ = part_anchors(ids, scanned)
        cut = bucket_edges(values, buckets)
        keep, often = np.zeros(len(values), bool), np.zeros(len(values), bool)
        for b, c, f in zip(told.bucket, told.common, told.frequent, strict=True):
            keep[cut[b] : cut[b + 1]], often[cut[b] : cut[b + 1]] = flags(c, cut[b + 1] - cut[b]), flags(f, cut[b + 1] - cut[b])
        found = part_contexts(ids, scanned, values[keep], often[keep])
        order = np.argsort(found[2], kind="stable")
        return own, ids, found, bucket_edges(found[2][order], buckets), order

    def send_contexts(own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        pid = own.pid.iloc[0] if len(own) else -1
        _, _, (contexts, offset, key, low, _), cut, order = contexts_of(own, told)
        rows = []
        for b, (x, y) in enumerate(zip(cut, cut[1:], strict=False)):
            if y > x:
                at = order[x:y]
                c = [contexts[k] for k in at.tolist()]
                size = np.array(list(map(len, c)), np.uint8)
                facts = [size.tobytes(), offset[at].astype(np.uint8).tobytes(), np.where(size < SPAN, 0, key[at]).tobytes(), low[at].tobytes()]
                rows.append((b, int(pid), zlib.compress(b"".join(c), 1), zlib.compress(b"".join(facts), 1)))
        return pd.DataFrame(rows, columns=["bucket", "pid", "contexts", "facts"])

    def answer(g: pd.DataFrame) -> pd.DataFrame:
        known: dict[bytes, int] = {}
        low, offsets, keys, own = [], [], [], []
        for blob, facts in zip(g.contexts, g.facts, strict=True):
            blob, facts = zlib.decompress(blob), zlib.decompress(facts)
            m = len(facts) // 18
            size, offset = np.frombuffer(facts, np.uint8, m), np.frombuffer(facts, np.uint8, m, m)
            key, ids = np.frombuffer(facts, np.uint64, m, 2 * m), np.frombuffer(facts, np.int64, m, 10 * m)
            numbers, at = [], 0
            for s, o, h, i in zip(size.tolist(), offset.tolist(), key.tolist(), ids.tolist(), strict=True):
                c = blob[at : at + s]
                at += s
                k = known.setdefault(c, len(known))
                if k == len(low):
                    low.append(i)
                    offsets.append(o)
                    keys.append(h)
                elif i < low[k]:
                    low[k] = i
                numbers.append(k)
            own.append(numbers)
        found = smallest_ids(list(known), np.array(offsets, np.int64), np.array(keys, np.uint64), np.array(low, np.int64))
        steps = [(1, b"\x00", i) for i in np.array(low, np.int64).astype("V8").tolist()] if low else []
        for k, x in found.items():  # the windows at which the smallest id changes, and these ids
            at = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
            steps[k] = (len(at), at.astype(np.uint8).tobytes(), x[at].tobytes())
        rows = []
        for pid, numbers in zip(g.pid, own, strict=True):
            mine = [steps[k] for k in numbers]
            rows.append((pid, int(g.bucket.iloc[0]), zlib.compress(bytes(s[0] for s in mine), 1), zlib.compress(b"".join(s[1] for s in mine), 1), zlib.compress(b"".join(s[2] for s in mine), 1)))
        return pd.DataFrame(rows, columns=["pid", "bucket", "changes", "places", "lows"])

    def cut(own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        first, second = told[told.common.notna()], told[told.changes.notna()]
        known, ids, (contexts, _, _, _, seen), edge, order = contexts_of(own, first)
        # of all contexts, by number: their changes as rows of one table
        number, place, low = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        until = windows_in(contexts)
        for b, changes, places, lows in zip(second.bucket, second.changes, second.places, second.lows, strict=True):
            number.append(np.repeat(order[edge[b] : edge[b + 1]], np.frombuffer(zlib.decompress(changes), np.uint8)))
            place.append(np.frombuffer(zlib.decompress(places), np.uint8).astype(np.int64))
            low.append(np.frombuffer(zlib.decompress(lows), np.int64))
        number, place, low = map(np.concatenate, (number, place, low))
        stop = np.where(np.r_[number[1:] == number[:-1], False], np.r_[place[1:], 0], until[number]) if len(number) else place
        by = np.argsort(number, kind="stable")
        number, place, low, stop = (x[by] for x in (number, place, low, stop))
        begin = np.searchsorted(number, np.arange(len(until) + 1))
        texts = known.text.tolist()
        rows: list = [None] * len(texts)
        masks: dict[int, np.ndarray] = {}  # of texts in several slices
        for c, doc, at, which in seen:
            times = begin[which + 1] - begin[which]
            step = np.repeat(begin[which] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            owner, start = np.array([x[0] for x in c.slices], np.int64)[np.repeat(doc, times)], np.repeat(at, times)
            bad = low[step] < ids[owner] if len(step) else np.zeros(0, bool)
            opened = np.bincount((start + place[step])[bad], minlength=len(c.joined) + 1)
            closed = np.bincount((start + stop[step] + SPAN - 1)[bad], minlength=len(c.joined) + 1)
            gone, base = np.cumsum(opened - closed)[:-1] > 0, 0
            for r, offset, raw in c.slices:
                mine = gone[base : base + len(raw)]
                base += len(raw)
                if offset or len(raw) > SLICE:
                    if r not in masks:
                        masks[r] = np.zeros(len(texts[r].encode("utf-8", "surrogatepass")), bool)
                    masks[r][offset : offset + len(raw)] |= mine
                else:
                    rows[r] = row(int(ids[r]), raw, mine)
        for r, mask in masks.items():
            rows[r] = row(int(ids[r]), texts[r].encode("utf-8", "surrogatepass"), mask)
        lone = own[own.id.isna()]
        for t in lone.text:
            t = t.encode("utf-8", "surrogatepass")
            rows.append(row(None, t, np.zeros(len(t), bool)))
        out = pd.DataFrame(rows, columns=["id", "n_bytes", "n_removed", "starts", "ends", "kept_sha256", *["kept"] * kept_text])
        carried = pd.concat([known, lone])[[f"c{k}" for k in range(len(carry))]].reset_index(drop=True)
        return pd.concat([out.assign(id=pd.array(out.id, "Int64")), carried], axis=1)

    def row(i: int | None, t: bytes, gone: np.ndarray) -> tuple:
        span = runs(gone)
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes() if span else t
        more = [whole_characters(t, gone) if span else t.decode("utf-8", "replace")] if kept_text else []
        return (i, len(t), int(gone.sum()), [s for s, _ in span], [e for _, e in span], hashlib.sha256(kept).hexdigest(), *more)

    sent = parts.groupBy("pid").applyInPandas(send_anchors, "bucket int, pid int, anchors binary, several binary, times binary")
    common = sent.groupBy("bucket").applyInPandas(common_anchors, "pid int, bucket int, common binary, frequent binary")
    contexts = parts.groupBy("pid").cogroup(common.groupBy("pid")).applyInPandas(send_contexts, "bucket int, pid int, contexts binary, facts binary")
    answers = contexts.groupBy("bucket").applyInPandas(answer, "pid int, bucket int, changes binary, places binary, lows binary")
    told = common.unionByName(answers, allowMissingColumns=True)
    out = parts.groupBy("pid").cogroup(told.groupBy("pid")).applyInPandas(cut, "id long, n_bytes long, n_removed long, starts array<long>, ends array<long>, kept_sha256 string" + ", kept string" * kept_text + "".join(f", c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(carry)))
    kind = docs.schema[id_col].dataType
    return out.select(F.col("id").cast(kind).alias(id_col), "n_bytes", "n_removed", F.arrays_zip("starts", "ends").alias("spans"), "kept_sha256", *["kept"] * kept_text, *[F.col(f"c{k}").alias(c) for k, c in enumerate(carry)])
