"""Licence scan: TF-IDF cosine of headers, licence files and notices to templates, then inheritance from the nearest ancestor directory.

Templates are short notices and whole licence texts. Units of a document are sparse
TF-IDF vectors over their words: its leading comment block (the header) and, for a file
named like a licence file, the whole of it are compared with both kinds of templates;
its lines, and windows of a few lengths over the running text (so that a notice may be
wrapped, or stand within a paragraph) with notices. Document frequencies of all words
are counted over all documents. Only lines and windows that hold a word without which no
notice is reached are looked at; this leaves out nothing. A whole text that is reached
decides before notices do. A file named like a licence file licenses its directory; a
document that declares nothing itself inherits from the nearest ancestor directory (its
own included) that has a licence.

Defined cases: null and empty texts declare nothing; a null path has no directory and
inherits nothing; ties between licences go to the higher cosine, then to the
alphabetically first; repeated rows give equal results and count in the document
frequencies; very long texts are read as a whole; extra columns are ignored; an empty
template table declares nothing; an empty table of documents gives no rows.
"""

from __future__ import annotations

import math
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: Notices by which widely used licences announce themselves.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Folder of whole licence texts, in files named after the licence.
TEXTS = Path(__file__).parent / "licence_texts"
#: Least cosine.
LEAST = 0.7
LICENSE_FILE = r"(?i)^(licen[sc]e|copying|notice)(\..*)?$"
#: A leading comment block, or the leading lines of a file that begins as a comment.
HEADER = r"^\s*(?:/\*(?s:.*?)\*/|<!--(?s:.*?)-->|(?:[ \t]*(?://|#|--|;|%)[^\n]*(?:\n|$))+)"
#: Lengths of windows in words; they begin at every STEP-th part of their length.
WINDOWS, STEP = (6, 9, 14, 20, 28, 44), 4
#: Shares into which the directories below one licence file are dealt.
SALT = 16


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def needed_words(notices: list[list[str]], df: dict[str, int], total: int, least: float) -> list[str]:
    """Words of which a line must hold one to reach the least cosine with any notice.

    The lightest words of a notice are left out as long as their share of its norm
    stays below the least cosine: a line that holds only these cannot reach it.
    """
    needed: set[str] = set()
    for w in notices:
        weight = {x: (w.count(x) * (math.log((total + 1) / (df.get(x, 0) + 1)) + 1)) ** 2 for x in w}
        left, most = 0.0, least * least * (1 - 1e-9) * sum(weight.values())
        for x in sorted(weight, key=lambda x: (weight[x], x)):
            left += weight[x]
            if left >= most:
                needed.add(x)
    return sorted(needed)


def default_templates(spark: SparkSession) -> DataFrame:
    """(license, notice, whole): the notices, and the texts of the folder."""
    rows = [(k, n, False) for k, n in NOTICES] + [(f.stem, f.read_text(encoding="utf-8"), True) for f in sorted(TEXTS.glob("*.txt"))]
    return spark.createDataFrame(rows, "license string, notice string, whole boolean")


def units_of(base: DataFrame, needed: Column) -> DataFrame:
    """(row, unit, large, w): words of headers and licence files (large), and of lines and windows that hold a needed word."""
    split = F.split("text", r"[\r\n]+")
    header = base.select("row", F.regexp_extract("text", HEADER, 0).alias("said")).where("said <> ''").select("row", F.lit("header").alias("unit"), F.lit(True).alias("large"), words(F.col("said")).alias("w"))
    file = base.where(F.col("file").rlike(LICENSE_FILE)).select("row", F.lit("file").alias("unit"), F.lit(True).alias("large"), words(F.col("text")).alias("w"))
    holds = base.select("row", "text", words(F.col("text")).alias("w")).where(F.arrays_overlap("w", needed))
    lines = holds.select("row", F.posexplode(split).alias("at", "said")).select("row", F.concat(F.lit("line "), "at").alias("unit"), F.lit(False).alias("large"), words(F.col("said")).alias("w"))
    places = F.filter(F.transform("w", lambda x, i: F.when(F.array_contains(needed, x), i)), lambda i: i.isNotNull())

    def starts(n: int) -> Column:
        """(at, n) of the windows of n words that hold a needed word."""
        step = -(-n // STEP)
        begin = lambda p: F.sequence(F.greatest(F.lit(0), F.ceil((p - n + 1) / step) * step).cast("int"), (F.floor(p / step) * step).cast("int"), F.lit(step))
        return F.transform(F.array_distinct(F.flatten(F.transform("places", begin))), lambda i: F.struct(i.alias("at"), F.lit(n).alias("n")))

    windows = holds.select("row", "w", places.alias("places")).select("row", "w", F.explode(F.concat(*map(starts, WINDOWS))).alias("x"))
    windows = windows.select("row", F.concat_ws(" ", F.lit("window"), "x.n", "x.at").alias("unit"), F.lit(False).alias("large"), F.slice("w", F.col("x.at") + 1, F.col("x.n")).alias("w"))
    return lines.unionByName(windows).where(F.arrays_overlap("w", needed)).unionByName(header).unionByName(file).where(F.size("w") > 0).dropDuplicates(["row", "unit"])  # of repeated rows; whole texts don't travel


def scan_licenses(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", least: float = LEAST) -> DataFrame:
    """One row per document: id, path, declared, cosine, inherited, inherited_from, license. Document frequencies are counted when this is called."""
    spark = docs.sparkSession
    base = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), docs[path_col].cast("string").alias("path"))
    base = base.withColumn("row", F.xxhash64("id", "path", "text")).withColumn("file", F.regexp_extract("path", r"([^/]*)$", 1))  # a row key, since ids may repeat
    whole = F.col("whole") if "whole" in templates.columns else F.lit(False)
    notices = templates.where("license is not null and notice is not null").select("license", words(F.col("notice")).alias("w"), F.coalesce(whole, F.lit(False)).alias("whole"), F.xxhash64("license", "notice").alias("notice")).where(F.size("w") > 0)
    counts = written(base.select(F.explode(F.array_distinct(words(F.col("text")))).alias("word")).groupBy("word").agg(F.count("*").alias("df")))
    total = base.count()
    of_notices = F.broadcast(notices.select(F.explode("w").alias("word")).distinct())  # the words of a small template table
    df = {r.word: r.df for r in counts.join(of_notices, "word", "left_semi").collect()}
    own = needed_words([r.w for r in notices.where(~F.col("whole")).collect()], df, total, least)  # of a small template table
    needed = F.array(*map(F.lit, own)) if own else F.array().cast("array<string>")

    units = written(units_of(base, needed))
    tf = units.select("row", "unit", "large", F.explode("w").alias("word")).groupBy("row", "unit", "large", "word").agg(F.count("*").alias("tf"))
    idf = lambda df: F.log((total + 1) / (F.coalesce(df, F.lit(0)) + 1)) + 1
    tf = tf.join(counts, "word", "left").select("row", "unit", "large", "word", (F.col("tf") * idf(F.col("df"))).alias("x"))
    t = notices.select("license", "notice", "whole", F.explode("w").alias("word")).groupBy("license", "notice", "whole", "word").agg(F.count("*").alias("tf"))
    known = spark.createDataFrame(list(df.items()), "word string, df long")
    t = t.join(F.broadcast(known), "word", "left").withColumn("y", F.col("tf") * idf(F.col("df")))  # as long as the templates
    t = t.join(t.groupBy("notice").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("t_norm")), "notice").select("license", "notice", "whole", "word", (F.col("y") / F.col("t_norm")).alias("y"))
    tf = written(tf)
    norm = tf.groupBy("row", "unit").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    fits = F.col("large") | ~F.col("whole")
    dot = tf.join(F.broadcast(t), "word").where(fits).groupBy("row", "unit", "license", "notice", "whole").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    near = dot.join(norm, ["row", "unit"]).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 9)).where(F.col("cosine") >= least)
    best = F.min(F.struct((~F.col("whole")).alias("w"), (-F.col("cosine")).alias("c"), "license")).alias("best")
    declared = near.groupBy("row").agg(best).select("row", F.col("best.license").alias("declared"), (-F.col("best.c")).alias("cosine"))

    out = base.select("id", "path", "row", "file", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir")).join(declared, "row", "left")
    own = out.where(F.col("declared").isNotNull() & F.col("file").rlike(LICENSE_FILE)).groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "declared")).alias("best")).select(F.col("dir").alias("from"), F.col("best.declared").alias("inherited"))
    own = own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    parts = F.split("dir", "/")
    above = out.where("path is not null").select("dir").distinct().select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("from")).distinct()
    above = above.withColumn("salt", F.pmod(F.hash("dir"), F.lit(SALT)))  # the root and other high directories have very many below
    nearest = above.join(own, ["from", "salt"]).groupBy("dir").agg(F.max(F.struct(F.length("from").alias("depth"), F.col("from").alias("at"), "inherited")).alias("best")).select("dir", F.col("best.inherited").alias("inherited"), F.col("best.at").alias("inherited_from"))
    out = out.withColumn("dir", F.when(F.col("path").isNotNull(), F.col("dir"))).join(nearest, "dir", "left")
    return out.select(F.col("id").alias(id_col), "path", "declared", "cosine", "inherited", "inherited_from", F.coalesce("declared", "inherited").alias("license"))
