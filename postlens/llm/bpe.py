"""Byte-level BPE encoding and decoding by speculation and verification.

Every distinct word (a match of the vocabulary's pre-tokenising pattern) is first
split greedily into the longest vocabulary entries. A sequence of entries is the
true BPE result exactly when no two neighbours could have been merged differently,
so all neighbouring pairs of a batch of words are tested at once with array
operations; only words with a failing pair go through exact merging.

Defined cases: null text counts as empty; an empty text has no ids; the special
strings of the vocabulary file are single ids wherever they occur; repeated rows
are encoded independently; extra columns are ignored; a null id is passed through; very
long texts, and words without any break, are encoded as a whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import small_batches

#: The public pre-tokenising pattern of byte-level BPE.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct words that a worker remembers; the memory is emptied when full.
MEMORY_WORDS = 300_000
NONE = 1 << 40
#: Words of up to so many bytes are merged by scanning; longer ones with a heap.
SHORT = 48


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file, as letter -> byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary with what speculation and verification need."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for b, i in self.ids.items():
            self.bytes_of[i] = b
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.longest: dict[bytes, int] = {}  # the longest entry for each start of one or two bytes
        for b in self.ids:
            self.longest[b[:2]] = max(self.longest.get(b[:2], 0), len(b))
        # age[i]: 0 for a byte, else 1 + the rank of the merge that makes entry i; parts: what it is merged from
        self.age = np.zeros(size, np.int64)
        self.first, self.last = np.arange(size), np.arange(size)
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = map(raw, pair if isinstance(pair, list) else pair.split(" "))
            i, j, k = self.ids[a], self.ids[b], self.ids[a + b]
            self.rank.setdefault((i, j), (r, k))
            if not self.age[k]:
                self.age[k], self.first[k], self.last[k] = r + 1, i, j
        codes = np.array([i * size + j for i, j in self.rank], np.int64)
        order = np.argsort(codes)
        self.size, self.codes = size, codes[order]
        self.merged_at = np.array([r + 1 for r, _ in self.rank.values()], np.int64)[order]
        self.words = regex.compile(WORD_PATTERN)
        self.cut = regex.compile("|".join(f"({regex.escape(s)})" for s in sorted(self.special, key=len, reverse=True))) if self.special else None

    def propose(self, word: bytes) -> list[int]:
        """Longest matches from left to right; every single byte is an entry."""
        ids, longest, out, at, n = self.ids, self.longest, [], 0, len(word)
        if word in ids:
            return [ids[word]]
        while at < n:
            end = at + longest.get(word[at : at + 2], 1)
            while (i := ids.get(word[at:end])) is None:  # a slice may end before `end`: then it is looked up again, once
                end = min(end, n) - 1
            out.append(i)
            at = min(end, n)
        return out

    def joint_age(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """When the pairs (a, b) merge; NONE if never."""
        codes = a * self.size + b
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.merged_at[at], NONE)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of neighbours stays apart under exact merging.

        The pair is taken apart along its border, undoing the younger of the two
        merges each time; it fails if, at some moment in between, the pieces that
        then touched would have merged before the next merge that was assumed.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        until = np.full(len(a), NONE)  # a border merge counts if it comes before this age
        while len(live):
            x, y = a[live], b[live]
            bad = self.joint_age(x, y) < until[live]
            ok[live[bad]] = False
            done = bad | ((self.age[x] == 0) & (self.age[y] == 0))
            live, x, y = live[~done], x[~done], y[~done]
            left = self.age[x] > self.age[y]  # of two equally old pieces the left one was merged first
            until[live] = np.where(left, self.age[x], self.age[y] + 1)
            a[live] = np.where(left, self.last[x], x)
            b[live] = np.where(left, y, self.first[y])
        return ok

    def merge(self, word: bytes) -> list[int]:
        """Exact merging, lowest rank first and leftmost among equals."""
        parts = [self.ids[word[i : i + 1]] for i in range(len(word))]
        n = len(parts)
        if n <= SHORT:
            get, never = self.rank.get, (NONE, 0)
            ranks = [get(p, never) for p in zip(parts, parts[1:])]
            while ranks and (best := min(ranks))[0] != NONE:
                i = ranks.index(best)
                parts[i : i + 2] = [best[1]]
                del ranks[i]
                if i:
                    ranks[i - 1] = get((parts[i - 1], parts[i]), never)
                if i < len(ranks):
                    ranks[i] = get((parts[i], parts[i + 1]), never)
            return parts
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(*self.rank[p], i, p) for i in range(n - 1) if (p := (parts[i], parts[i + 1])) in self.rank]
        heap = [(r, i, k, p) for r, k, i, p in heap]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            _, i, k, p = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or (parts[i], parts[j]) != p:
                continue
            parts[i], gone[j], after[i] = k, 1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (q := (parts[x], parts[y])) in self.rank:
                    r, made = self.rank[q]
                    heapq.heappush(heap, (r, x, made, q))
        return [p for p, g in zip(parts, gone, strict=True) if not g]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        out = [self.propose(w) for w in raw]
        flat = np.fromiter((i for ids in out for i in ids), np.int64)
        owner = np.repeat(np.arange(len(out)), [len(ids) for ids in out])
        near = np.flatnonzero(owner[:-1] == owner[1:]) if len(owner) else np.zeros(0, np.int64)
        pairs, back = np.unique(flat[near] * self.size + flat[near + 1], return_inverse=True)
        ok = self.compatible(pairs // self.size, pairs % self.size)
        for w in np.unique(owner[near[~ok[back]]]):
            out[w] = self.merge(raw[w])
        return out


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes whole texts, remembering distinct words up to a bound."""

    def __init__(self, path: str, memory: int = MEMORY_WORDS):
        self.v, self.known, self.memory = vocabulary(path), {}, memory

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = []
        for t in texts:
            pieces = self.v.cut.split(t) if self.v.cut and self.v.cut.search(t) else [t]
            split.append([(p, self.v.words.findall(p) if p not in self.v.special else None) for p in pieces if p])
        if len(self.known) > self.memory:
            self.known.clear()
        new = list({w for doc in split for _, words in doc for w in words or () if w not in self.known})
        for w, ids in zip(new, self.v.encode_words(new), strict=True):
            self.known[w] = np.array(ids, "<u4").tobytes()
        get = self.known.__getitem__
        return [b"".join(b"".join(map(get, words)) if words is not None else np.array([self.v.special[p]], "<u4").tobytes() for p, words in doc) for doc in split]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.v.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def bpe_encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, ids (array of int) and the decoded text."""
    small_batches(docs.sparkSession, 200)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(vocab_path)
        for b in batches:
            blobs = enc.encode([t or "" for t in b.column(1).to_pylist()])
            ends = np.cumsum([0, *(len(x) // 4 for x in blobs)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(blobs), "<u4").astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), ids, pa.array([enc.decode(x) for x in blobs])], ["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def bpe_digest(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As bpe_encode, but with the counts and digests of ids and decoded text in their place."""
    small_batches(docs.sparkSession, 200)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(vocab_path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            blobs = enc.encode([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) // 4 for x in blobs], pa.int64()), pa.array([sha(x) for x in blobs]), pa.array([sha(enc.decode(x).encode()) for x in blobs])],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
