"""Brute force for the Jaccard join, repeated substrings and the pipeline."""

import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from postlens.llm import jaccard, repeats


def sets_of(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    rows = [(i, t) for i, t in rows if i is not None]
    s = [(i, sets_of(t)) for i, t in rows]
    up = {i: i for i, _ in s}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(s):
        for j, b in s[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return sorted((i, len(a), top(i)) for i, a in s)


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    rows, shared = [], " ".join(word() for _ in range(60))
    for base in range(6):
        w = [word() for _ in range(rng.choice((30, 90, 300)))]
        for copy in range(14):
            own = list(w)
            for _ in range(copy % 7):
                own[rng.randrange(len(own))] = word()
            rows.append(" ".join(own))
    rows += [shared + " " + " ".join(word() for _ in range(rng.randint(20, 40))) for _ in range(15)]
    rows += [None, "", "  ", "one", "ONE", "one two", "a b c d e", "a b c d e f", "é ü ß", rows[0], rows[0]]
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("tile", [1024, 3])
def test_jaccard(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)  # by 3, groups fill many tiles
    monkeypatch.setattr(jaccard, "SHARE", 4 * tile)
    rows = corpus()
    rows.append((len(rows), " ".join(f"w{i * 7919 % 3001}" for i in range(40_000))))  # a very long text
    d = spark.createDataFrame([(i, t, 0) for i, t in rows] + [(None, rows[0][1], 0)], "doc_id long, text string, n int")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(d, part_bytes=4000).collect() if r.doc_id is not None)
    assert got == components(rows)
    assert jaccard.jaccard_components(d.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 5, 40, 149, 160, 700, 5000])
def test_partners_share_a_band(n):
    """Any size that may link shares a band, and the band's bound covers the most that such sets differ in."""
    for m in range(n, n * 100 // 75 + 1):
        both = {j: d for j, d, _ in jaccard.band_of(n)}
        shared = [d for j, d, _ in jaccard.band_of(m) if j in both]
        assert max(shared) >= (n + m) * 25 // 175


def removed(rows):
    out, seen = {}, set()
    for i, t in sorted((i, t) for i, t in rows):
        b = (t or "").encode()
        mask, new = np.zeros(len(b), bool), set()
        for p in range(len(b) - 49):
            if b[p : p + 50] in seen:
                mask[p : p + 50] = True
            new.add(b[p : p + 50])
        seen |= new
        out[i] = (len(b), int(mask.sum()), len(repeats.runs(mask)), hashlib.sha256(np.frombuffer(b, np.uint8)[~mask].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("frequent", [1 << 14, 2, 16])
def test_repeats(spark, monkeypatch, frequent):
    monkeypatch.setattr(repeats, "FREQUENT", frequent)  # by 2 every common anchor is a frequent one
    rows = [(i, t) for i, t in corpus()] + [(500, "z" * 400), (501, "y" + "z" * 120 + "é" * 70), (502, "x" * 49), (503, "x" * 49), (504, "é" * 70)]
    d = spark.createDataFrame([(i, t, "s") for i, t in rows] + [(None, rows[3][1], "s")], "doc_id long, text string, spans string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in repeats.repeats(d, part_bytes=3000).collect()}
    lone = got.pop(None)
    assert got == removed(rows)
    assert lone[1] == 0
    assert repeats.repeats(d.limit(0)).count() == 0


def test_slices_and_batches_change_nothing(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab ") for _ in range(n)) for n in (3000, 10, 49, 50, 700)] + ["x" * 500]
    texts.append(texts[0][100:900] + "é" * 90)

    def windows():
        out = {}
        for c in repeats.chunks(texts):
            for d, first, last, offset, anchor in zip(c.doc, c.first, c.last, c.offset, c.anchor, strict=True):
                row, at, _ = c.slices[d]
                base = sum(len(x[2]) for x in c.slices[:d])
                out |= {(row, at + w - base): (int(anchor), int(first + offset - w)) for w in range(first, last + 1)}
        return out

    whole = windows()
    monkeypatch.setattr(repeats, "SLICE", 64)
    assert windows() == whole and len(whole) == sum(max(len(t.encode()) - 49, 0) for t in texts)
    ids = np.arange(len(texts))
    scanned = list(repeats.chunks(texts))
    every = np.unique(np.concatenate([c.anchor for c in scanned]))
    args = repeats.part_contexts(ids, scanned, every, np.zeros(len(every), bool))[:4]
    args = args[0], args[1], args[2], np.arange(len(args[0]))
    found = repeats.smallest_ids(*args)
    monkeypatch.setattr(repeats, "MERGE_BYTES", 300)
    again = repeats.smallest_ids(*args)
    assert found.keys() == again.keys() and all((found[k] == again[k]).all() for k in found)


def test_interleave_equals_sorting():
    rng = np.random.default_rng(0)
    shards = [np.frombuffer(b"\0".join(bytes(rng.integers(97, 100, size=80, dtype=np.uint8)) for _ in range(20)) + b"\0", np.uint8) for _ in range(5)]
    blocks, _ = repeats.intervals(shards, 6)
    named = {}
    for t, b in zip(shards, blocks, strict=True):
        twice = np.concatenate([t, t])
        for p in range(len(t)):
            assert named.setdefault(twice[p : p + 6].tobytes(), b[p]) == b[p]
    assert len(set(named.values())) == len(named)
    order = [named[k] for k in sorted(named)]
    assert order == sorted(order)  # blocks are in the order of their prefixes


def test_whole_characters():
    raw = "aéb".encode()
    assert repeats.whole_characters(raw, np.array([False, True, False, True])) == "aé"
    assert repeats.whole_characters(raw, np.array([False, True, True, False])) == "ab"


def test_pipeline(spark, tmp_path):
    rng = random.Random(5)
    word = lambda: rng.choice("the of and in house river stone bridge walks under over seven bright morning evening mill garden letter old new".split()) + rng.choice(["", "s", "ed", "ing", "er"])
    text = lambda n: " ".join(word() for _ in range(n))
    item, passage = text(30), text(60)
    rows = [(i, text(80), "en") for i in range(40)]
    rows += [(100, rows[0][1], "en"), (101, rows[1][1] + " more", "en"), (102, "12345 !!", "en"), (103, None, "en"), (104, text(40) + " " + item + " " + text(40), "en"), (105, text(50) + " " + passage, "en"), (106, text(50) + " " + passage, "en")]
    rows += [(107, "Yes.", "en"), (None, text(70), "en"), (7, rows[7][1], "en")]
    spark.createDataFrame([(*r, "src", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {*range(40), 105, 106, 107, None}
    for i in range(40):  # clean documents stay whole
        assert got[i].decoded == rows[i][1] and len(got[i].ids) == got[i].n_tokens
    assert passage in got[105].decoded and passage[60:-60] not in got[106].decoded
    assert [k for k, _ in corpus_pipeline.STAGES] and 3 < len(corpus_pipeline.STAGES) < 6


def test_language_stage(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = {-3: "12 !", -4: None, -5: "Oui.", -6: "the house of the river"}
    rows = spark.createDataFrame([(i, t, None, "s", 0) for i, t in odd.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.known_language(spark, d.unionByName(rows), "").collect()}
    assert {i for i in kept if i < 0} == {-5, -6}
    assert kept >= {r.doc_id for r in d.where("lang is not null").collect()}  # clean documents stay


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Each stage again in plain Python, but for language ID, which is told to keep all."""
    rows = [(i, t, "en") for i, t in corpus()]
    item = rows[5][1] or "none"
    rng = random.Random(8)
    items = [(1, " ".join(f"w{rng.randrange(900)}" for _ in range(20))), (2, None)]
    rows += [(900, "some words before " + items[0][1] + " and after", "en"), (901, item + " extra", "en")]
    d = spark.createDataFrame([(*r, "src", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    lettered = [(i, t) for i, t, _ in rows if t and any(c.isalpha() for c in t)]
    kept = stages["language ID"](spark, d, str(tmp_path))
    assert {r.doc_id for r in kept.collect()} <= {i for i, _ in lettered}
    now = {r.doc_id: r.text for r in kept.collect()}
    docs = corpus_pipeline.written(stages["n-gram Jaccard join"](spark, kept, str(tmp_path)))
    now = {i: t for i, t in now.items() if i in {c for _, _, c in components(list(now.items()))}}
    assert {r.doc_id: r.text for r in docs.collect()} == now
    docs = corpus_pipeline.written(stages["suffix-array dedup"](spark, docs, str(tmp_path)))
    cut = {i: (n, gone) for i, (n, gone, _, _) in removed(list(now.items())).items()}
    now = {r.doc_id: r.text for r in docs.collect()}
    assert now.keys() == cut.keys() and all(len(now[i].encode()) >= n - gone and (gone or len(now[i].encode()) == n) for i, (n, gone) in cut.items())
    docs = corpus_pipeline.written(stages["benchmark decontamination"](spark, docs, str(tmp_path)))
    now = {i: t for i, t in now.items() if items[0][1] not in t}
    assert {r.doc_id: r.text for r in docs.collect()} == now
    last = stages["BPE encoding and decoding"](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id: r.decoded for r in last} == now
    empty = d.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
