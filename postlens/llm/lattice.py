"""Language-model scoring by a subword lattice.

The pieces of an existing subword vocabulary (with its byte pieces) get unigram
probabilities: first by the vocabulary's own scores over TEMPERATURE, then by rounds of
expectation maximisation over the word counts of all training documents, until the log
likelihood of these rises by less than TOLERANCE of its size. A text's probability is
the product over its words, and over one end mark, of the sum over all segmentations
of "word mark + word" into pieces, by a forward recursion in log space.

Word counts are gathered per bucket of words from all parts of the corpus; buckets
also run the recursion once per distinct word and answer each part with counts and
log probabilities of its words.

Defined cases: null text counts as empty: no words, one end mark; a null `train` flag
is no; with no training document pieces keep their first probabilities and every
count is 0; bytes outside the vocabulary are covered by byte pieces, so a score is
always finite; repeated rows are counted and scored as often as they occur; very long
texts and words are scored as a whole; an empty table gives no rows; extra columns are
ignored; a null id is passed through.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .parts import ascii_words, in_parts, part_count

#: Bytes of text in a part: large, as distinct words grow more slowly than texts.
PART_BYTES = 8 << 20
MARK = "▁".encode()
#: Rounds of expectation maximisation at most, the gain at which they end, and the mass that each piece has besides its expected count.
ROUNDS, TOLERANCE, PRIOR = 3, 0.002, 0.1
#: The scores count ranks downwards from 0: e ** (score / TEMPERATURE) makes them weights; the last is that of bytes without a piece, then of the end.
TEMPERATURE, BYTE_WEIGHT, END_WEIGHT = 6000.0, 1e-3, 1.0
#: Words of up to so many bytes (with the mark) go through array operations, longer ones one by one.
ARRAY_LENGTH = 40
SLOTS = 20
#: Words of several buckets that go through array operations together: a bucket alone is too few of a length.
TOGETHER = 50_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The vocabulary: pieces as bytes, and a hash table over all of them."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        found: dict[bytes, float] = {}
        for i in range(m.get_piece_size()):
            if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i)):
                found.setdefault(m.id_to_piece(i).encode(), max(math.exp(m.get_score(i) / TEMPERATURE), BYTE_WEIGHT))  # a few have no rank, but a huge negative score
        for b in range(256):
            found.setdefault(bytes([b]), BYTE_WEIGHT)
        self.names = list(found)
        p = np.array([*found.values(), END_WEIGHT])  # the last is the end mark
        self.first = np.log(p / p.sum())
        self.index = {b: i for i, b in enumerate(self.names)}
        self.longest = max(map(len, self.names))
        hashes = np.array([self.hash(b) for b in self.names], np.uint64)
        self.tables, left = [], np.arange(len(self.names))
        while len(left):  # pieces whose slot is taken go to the next table
            slots = (hashes[left] >> np.uint64(64 - SLOTS)).astype(np.int64)
            _, first = np.unique(slots, return_index=True)
            key, value = np.zeros(1 << SLOTS, np.uint64), np.full(1 << SLOTS, -1, np.int32)
            key[slots[first]], value[slots[first]] = hashes[left[first]], left[first]
            self.tables.append((key, value))
            left = np.delete(left, first)
        by_length = sorted({len(b) for b in self.names})
        self.lengths = [n for n in by_length if n <= ARRAY_LENGTH]

    @staticmethod
    def hash(b: bytes) -> int:
        h = 0
        for c in b:
            h = (h * int(FACTOR) + c + 1) & 0xFFFFFFFFFFFFFFFF
        return (h ^ (len(b) * 0x632BE59BD9B4E019)) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece of each hash, or -1."""
        slots = (h >> np.uint64(64 - SLOTS)).astype(np.int64)
        out = np.full(len(h), -1, np.int32)
        for key, value in self.tables:
            hit = (key[slots] == h) & (value[slots] >= 0)
            out[hit] = value[slots[hit]]
        return out


@lru_cache(1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def edges(v: Pieces, m: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, end, rows, pieces) of the lattice of equally long words, the rows of m."""
    n, length = m.shape
    h = np.zeros((length + 1, n), np.uint64)
    for i in range(length):
        h[i + 1] = h[i] * FACTOR + m[:, i].astype(np.uint64) + np.uint64(1)
    out = []
    for size in v.lengths:
        if size > length:
            break
        power = np.uint64(pow(int(FACTOR), size, 1 << 64))
        mix = np.uint64(size * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
        for start in range(length - size + 1):
            found = v.find(((h[start + size] - h[start] * power) ^ mix) * np.uint64(0xD6E8FEB86659FD93))
            rows = np.flatnonzero(found >= 0)
            if len(rows):
                out.append((start, start + size, rows, found[rows]))
    return out


def forward(v: Pieces, logp: np.ndarray, words: list[bytes], counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Natural log probability of each word; with counts, also the expected number of each piece."""
    out, expected = np.zeros(len(words)), np.zeros(len(logp))
    by_length = defaultdict(list)
    for i, w in enumerate(words):
        by_length[len(w) + len(MARK)].append(i)
    for length, own in by_length.items():
        for at in range(0, len(own), 20_000):
            part = own[at : at + 20_000]
            if length > ARRAY_LENGTH:
                for i in part:
                    out[i] = long_word(v, logp, MARK + words[i], None if counts is None else counts[i], expected)
                continue
            m = np.frombuffer(b"".join(MARK + words[i] for i in part), np.uint8).reshape(len(part), length)
            lattice = edges(v, m)
            a = np.full((length + 1, len(part)), -np.inf)
            a[0] = 0
            for start, end, rows, piece in sorted(lattice, key=lambda e: e[1]):
                a[end, rows] = np.logaddexp(a[end, rows], a[start, rows] + logp[piece])
            out[part] = a[length]
            if counts is not None:
                b = np.full((length + 1, len(part)), -np.inf)
                b[length] = np.log(np.maximum(counts[part], 1e-300)) - a[length]
                for start, end, rows, piece in sorted(lattice, key=lambda e: -e[0]):
                    path = b[end, rows] + logp[piece]
                    np.add.at(expected, piece, np.exp(a[start, rows] + path))
                    b[start, rows] = np.logaddexp(b[start, rows], path)
    return out, expected


def long_word(v: Pieces, logp: np.ndarray, w: bytes, count: float | None, expected: np.ndarray) -> float:
    n, get = len(w), v.index.get
    a = np.full(n + 1, -np.inf)
    a[0] = 0
    found: list[list[tuple[int, int]]] = []
    for end in range(1, n + 1):
        own = [(s, i) for s in range(max(0, end - v.longest), end) if (i := get(w[s:end])) is not None]
        found.append(own)
        x = [a[s] + logp[i] for s, i in own]
        top = max(x)
        a[end] = top + math.log(sum(math.exp(y - top) for y in x))
    if count:
        b = np.full(n + 1, -np.inf)
        b[n] = math.log(count) - a[n]
        for end in range(n, 0, -1):
            for s, i in found[end - 1]:
                path = b[end] + logp[i]
                expected[i] += math.exp(a[s] + path)
                b[s] = np.logaddexp(b[s], path)
    return float(a[n])


def squeeze(words: list[bytes]) -> bytes:
    return zlib.compress(b" ".join(words), 1)


def spread(blob: bytes) -> list[bytes]:
    return zlib.decompress(blob).split(b" ") if blob else []


def together(items: Iterable, size: Callable) -> Iterator[list]:
    """The items in lists of TOGETHER words or a little more, so that neither memory nor the number of array operations grows with a task's buckets."""
    held, n = [], 0
    for x in items:
        held.append(x)
        n += size(x)
        if n >= TOGETHER:
            yield held
            held, n = [], 0
    if held:
        yield held


def by_bucket(words: list[bytes], buckets: int) -> dict[int, list[bytes]]:
    out = defaultdict(list)
    key = xxhash.xxh64_intdigest
    for w in words:
        out[key(w) % buckets].append(w)
    return out


def lm_score(docs: DataFrame, train: Column, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per document: id, n_tokens, n_known, train_tokens, base_score, score. Word counts and weights are made when this is called."""
    spark = docs.sparkSession
    n = part_count(docs, text_col, part_bytes)
    parts = in_parts(docs, n, id_col, text_col, train=F.coalesce(train, F.lit(False)))

    def send(g: pd.DataFrame) -> pd.DataFrame:
        counts: Counter = Counter()
        seen: set = set()
        for text, t in zip(g.text, g.train, strict=True):
            (counts if t else seen).update(ascii_words(text))
        rows = []
        for bucket, own in by_bucket(sorted(seen | counts.keys()), n).items():
            rows.append((bucket, int(g.pid.iloc[0]), squeeze(own), np.array([counts[w] for w in own], np.int64).tobytes()))
        return pd.DataFrame(rows, columns=["bucket", "pid", "words", "counts"])

    def gather(g: pd.DataFrame) -> pd.DataFrame:
        index: dict[bytes, int] = {}
        places, numbers = [], []
        for words, counts in zip(g.words, g.counts, strict=True):
            places.append(np.array([index.setdefault(w, len(index)) for w in spread(words)], np.int32))
            numbers.append(np.frombuffer(counts, np.int64))
        total = np.zeros(len(index), np.int64)
        for at, c in zip(places, numbers, strict=True):
            total[at] += c
        return pd.DataFrame({"bucket": [int(g.bucket.iloc[0])], "words": [squeeze(list(index))], "counts": [total.tobytes()], "pids": [g.pid.tolist()], "places": [[zlib.compress(x.tobytes(), 1) for x in places]], "tokens": [int(total.sum())], "kinds": [int((total > 0).sum())]})

    sent = parts.groupBy("pid").applyInPandas(send, "bucket int, pid int, words binary, counts binary")
    vocabulary = checkpointed(sent.groupBy("bucket").applyInPandas(gather, "bucket int, words binary, counts binary, pids array<int>, places array<binary>, tokens long, kinds long"))
    tokens, kinds = vocabulary.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    ends = parts.where("train").count()
    tokens, kinds = tokens + ends, kinds + (ends > 0)

    logp, before = pieces(vocab_path).first, -math.inf
    for _ in range(rounds if ends else 0):
        model = spark.sparkContext.broadcast(logp)  # one number per piece of the vocabulary

        def expect(batches):
            total = None
            for held in together(((b.words.iloc[i], b.counts.iloc[i]) for b in batches for i in range(len(b))), lambda x: len(x[1]) // 8):
                words, known = [], []
                for blob, counts in held:
                    c = np.frombuffer(counts, np.int64)
                    own, w = np.flatnonzero(c), spread(blob)
                    words += [w[i] for i in own]
                    known.append(c[own])
                c = np.concatenate(known)
                lp, e = forward(pieces(vocab_path), model.value, words, c.astype(float))
                e = np.append(e, lp @ c)  # behind the pieces: the log likelihood
                total = e if total is None else total + e
            if total is not None:
                at = np.flatnonzero(total)
                yield pd.DataFrame({"piece": at.astype(np.int32), "n": total[at]})

        sums = vocabulary.select("words", "counts").mapInPandas(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        mass = np.append(np.full(len(logp), PRIOR), ends * logp[-1])
        mass[sums.piece.to_numpy()] += sums.n.to_numpy()
        likelihood, mass = mass[-1], mass[:-1]
        mass[-1] += ends
        logp = np.log(mass / mass.sum())
        if likelihood - before < TOLERANCE * abs(likelihood):
            break
        before = likelihood
    model = spark.sparkContext.broadcast(logp)

    def answer(batches):
        rows = (b.iloc[i] for b in batches for i in range(len(b)))
        for held in together(rows, lambda r: len(r.counts) // 8):
            words = [spread(r.words) for r in held]
            every, _ = forward(pieces(vocab_path), model.value, [w for own in words for w in own])
            ends_at = np.cumsum([len(own) for own in words])
            for r, lp in zip(held, np.split(every, ends_at[:-1]), strict=True):
                c = np.frombuffer(r.counts, np.int64)
                told = []
                for pid, at in zip(r.pids, r.places, strict=True):
                    at = np.frombuffer(zlib.decompress(at), np.int32)
                    told.append((pid, r.bucket, zlib.compress(c[at].tobytes(), 1), lp[at].tobytes()))
                yield pd.DataFrame(told, columns=["pid", "bucket", "counts", "logp"])

    answers = vocabulary.select("bucket", "words", "counts", "pids", "places").mapInPandas(answer, "pid int, bucket int, counts binary, logp binary")
    below = math.log10(tokens + kinds + 1)
    end_base = math.log10(ends + 1) - below
    end_score = float(logp[-1]) / math.log(10)

    def score(own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        words: set = set()
        split = [ascii_words(t) for t in own.text]
        words.update(*split)
        place: dict[bytes, int] = {}
        counts, logs = [np.zeros(0, np.int64)], [np.zeros(0)]
        buckets = by_bucket(sorted(words), n)
        for bucket, c, lp in zip(told.bucket, told.counts, told.logp, strict=True):
            at = len(place)
            place.update(zip(buckets[bucket], range(at, at + len(buckets[bucket])), strict=True))
            counts.append(np.frombuffer(zlib.decompress(c), np.int64))
            logs.append(np.frombuffer(lp) / math.log(10))
        known, base, log10 = np.concatenate(counts) > 0, np.log10(np.concatenate(counts) + 1.0) - below, np.concatenate(logs)
        rows = []
        for i, own_words in zip(own.id, split, strict=True):
            at = np.fromiter(map(place.__getitem__, own_words), np.int64, len(own_words))
            rows.append((i, len(at) + 1, int(known[at].sum()) + (ends > 0), math.fsum(base[at].tolist()) + end_base, math.fsum(log10[at].tolist()) + end_score))
        return pd.DataFrame(rows, columns=["id", "n_tokens", "n_known", "base_score", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = parts.select("pid", "id", "text").groupBy("pid").cogroup(answers.groupBy("pid")).applyInPandas(score, f"id {kind}, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
