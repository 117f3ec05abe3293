"""Licence scan against a plain computation, on whole licence files, and in its defined cases."""

import math
import re
from collections import Counter

import pytest

from postlens.llm import licenses as L

TEXTS = {f.stem: f.read_text() for f in sorted(L.TEXTS.glob("*.txt"))}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "w") for r in rows], "doc_id long, path string, text string, word string")


def words(t):
    return [w for w in re.split(r"[\W_]+", t.lower()) if w]


def cosine(unit, template, df, total):
    idf = lambda w: math.log((total + 1) / (df[w] + 1)) + 1
    a, b = ({w: n * idf(w) for w, n in Counter(x).items()} for x in (unit, template))
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    return round(sum(x * b.get(w, 0) for w, x in a.items()) / (norm(a) * norm(b)), 9)


def units(text, path):
    """(large, words) of header, whole file, lines and windows."""
    w, out = words(text), []
    if m := re.match(L.HEADER.replace("(?s:.*?)", r"[\s\S]*?"), text):
        out.append((True, words(m[0])))
    if re.match(L.LICENSE_FILE, path.rpartition("/")[2]):
        out.append((True, w))
    out += [(False, words(x)) for x in re.split(r"[\r\n]+", text)]
    for n in L.WINDOWS:
        step = -(-n // L.STEP)
        out += [(False, w[at : at + n]) for at in range(0, len(w), step)]
    return [u for u in out if u[1]]


def brute(rows, templates):
    df, total = Counter(), len(rows)
    for _, _, t in rows:
        df.update(set(words(t)))
    found = {}
    for i, path, t in rows:
        hits = []
        for large, u in units(t, path):
            hits += [(not whole, -c, k) for k, n, whole in templates if (large or not whole) and (c := cosine(u, words(n), df, total)) >= L.LEAST]
        found[i] = (min(hits)[2], -min(hits)[1]) if hits else (None, None)
    return found


def test_equals_plain_computation(spark):
    para = "Some words first, as there often are, then this: Licensed under the Apache License, Version 2.0. And further words of no weight follow it here."
    rows = [
        (1, "a/x.py", "# Released under\n# the MIT License.\n\ncode = 1\n"), (2, "a/y.c", "/* " + TEXTS["ISC"] + " */\nint main;"), (3, "b/LICENSE", TEXTS["MIT"]), (4, "b/z.txt", para),
        (5, "c/q.txt", "the license of a public work is free, version two"), (6, "c/r.txt", "This Source Code Form is subject to the terms of the\nMozilla Public License, v. 2.0."), (7, "c/s.txt", "plain words\n" * 30),
    ]
    templates = [*((k, n, False) for k, n in L.NOTICES), *((k, TEXTS[k], True) for k in ("MIT", "ISC", "BSD-3-Clause"))]
    t = spark.createDataFrame(templates, "license string, notice string, whole boolean")
    got = {r.doc_id: (r.declared, r.cosine) for r in L.scan_licenses(frame(spark, rows), t).collect()}
    want = brute(rows, templates)
    assert {i: k for i, (k, _) in got.items()} == {i: k for i, (k, _) in want.items()}
    assert [got[i][1] for i in got if got[i][0]] == pytest.approx([want[i][1] for i in got if got[i][0]])
    assert (got[1][0], got[2][0], got[3][0], got[4][0], got[6][0]) == ("MIT", "ISC", "MIT", "Apache-2.0", "MPL-2.0") and got[5][0] is None


def test_whole_files_and_versions(spark):
    rows = [(n, f"p{n}/LICENSE", "Copyright (C) 2020 Some One\n\n" + t) for n, t in enumerate(TEXTS.values())]
    got = {r.doc_id: r.declared for r in L.scan_licenses(frame(spark, rows), L.default_templates(spark)).collect()}
    assert [got[n] for n in range(len(TEXTS))] == list(TEXTS)


def test_defined_cases(spark):
    long = "filler words of no kind " * 30_000 + "Released under the MIT License."
    rows = [(1, "a/LICENSE", "Released under the MIT License."), (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b", long), (3, "q/COPYING", "both:\nLicensed under CC BY 4.0.\nReleased under the MIT License."), (4, "/x", "none"), (5, "", "none")]
    d = frame(spark, rows)
    got = sorted((r.doc_id, r.declared, r.license) for r in L.scan_licenses(d, L.default_templates(spark)).collect())
    assert got == [(1, "MIT", "MIT"), (1, "MIT", "MIT"), (2, "MIT", "MIT"), (3, "CC-BY-4.0", "CC-BY-4.0"), (4, None, None), (5, None, None)]  # of equal cosines the first name
    none = L.scan_licenses(d, L.default_templates(spark).limit(0)).collect()
    assert len(none) == 6 and {r.license for r in none} == {None}
    two = spark.createDataFrame([("Own", "my very own permission notice")], "license string, notice string")  # a table of notices only
    assert {r.license for r in L.scan_licenses(frame(spark, [(1, "a", "My very own permission notice!")]), two).collect()} == {"Own"}
