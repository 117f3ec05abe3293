"""Language identification with a blended-spectrum string kernel.

A text is the set of its character 1-, 2- and 3-grams (lower case), hashed into
DIMS presence bits; the kernel of two texts is the cosine of their presence bits.
A bounded sample of labelled texts gives Nyström landmarks and the rows for
one-versus-rest kernel ridge regression. As the kernel is linear in the presence
bits, landmark coefficients fold into one DIMS x languages matrix, and a batch of
texts is scored by a single matrix product with it.

Defined cases: a null text, or one without a letter, is `und` with score 0; with no
labelled row at all every other text is `und` too; a null label is not learned from;
repeated rows are scored independently; ties go to the alphabetically first language;
very long texts are read as a whole; an empty table gives no rows; extra columns are
ignored; a null id is passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, small_batches

#: Presence bits for 1-, 2- and 3-grams.
BITS = (1 << 10, 1 << 12, 1 << 14)
DIMS = sum(BITS)
#: Bounds of the labelled sample per language, of landmarks per language, and of languages (the model has DIMS x MAX_LANGS numbers at most); rows that are let through of each language.
SAMPLE_PER_LANG, LANDMARKS_PER_LANG, MAX_LANGS, LEAST = 600, 64, 1000, 8
#: Bounds of both over all languages.
MAX_SAMPLE, MAX_LANDMARKS = 6000, 512
RIDGE = 1e-3
LETTER = r"\p{L}"
BLOCK = 64


def presence(texts: list[str]) -> np.ndarray:
    """A row of 0 and 1 for each text."""
    out = np.zeros((len(texts), DIMS), np.float32)
    for i, t in enumerate(texts):
        c = np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        h, base = np.zeros(len(c), np.uint32), 0
        for n, bits in enumerate(BITS):
            if len(c) <= n:
                break
            h = (h[: len(c) - n] + c[n:] + np.uint32(1)) * np.uint32(2654435761)
            h ^= h >> np.uint32(15)
            out[i, base + (h & np.uint32(bits - 1))] = 1
            base += bits
    return out


def unit(p: np.ndarray) -> np.ndarray:
    return p / np.sqrt(np.maximum(p.sum(axis=1, keepdims=True), 1))


def unpack(packed: np.ndarray) -> np.ndarray:
    return np.unpackbits(packed, axis=1)[:, :DIMS].astype(np.float32)


def fit(packed: np.ndarray, labels: np.ndarray, ids: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Languages and their (DIMS + 1) x languages matrix from packed presence bits of labelled rows."""
    order = np.lexsort((ids, labels))
    packed, labels = packed[order], labels[order]
    langs = sorted(set(labels.tolist()))
    each = max(1, min(LANDMARKS_PER_LANG, MAX_LANDMARKS // len(langs)))
    m = unit(unpack(packed[np.concatenate([np.flatnonzero(labels == k)[:each] for k in langs])]))
    kernel = np.vstack([unit(unpack(packed[i : i + 256])) @ m.T for i in range(0, len(packed), 256)]).astype(np.float64)
    value, vector = np.linalg.eigh((m @ m.T).astype(np.float64))
    keep = value > 1e-5 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])  # Nyström map of landmark kernels
    phi = np.hstack([kernel @ root, np.ones((len(kernel), 1))])
    y = (labels[:, None] == np.array(langs)[None]).astype(np.float64)
    weight = 1 / y.sum(axis=0)[y.argmax(axis=1)]  # languages count alike
    a = (phi * weight[:, None]).T @ phi + RIDGE * np.eye(phi.shape[1])
    beta = np.linalg.solve(a, (phi * weight[:, None]).T @ y)
    return langs, np.vstack([m.T @ (root @ beta[:-1]).astype(np.float32), beta[-1:]]).astype(np.float32)


def margin(score: np.ndarray, langs: int) -> np.ndarray:
    """With a single language there is no chance to compare with: the score itself."""
    return (score - 1 / langs) / (1 - 1 / langs) if langs > 1 else score


def sample(rows: DataFrame, per_lang: int) -> DataFrame:
    """About per_lang rows (id, text, label) of each language, fewer if there are many languages, chosen by a hash of the id."""
    counts = checkpointed(rows.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(MAX_LANGS))
    each = max(1, min(per_lang, MAX_SAMPLE // max(1, counts.count())))
    draw = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 40)) / F.lit(1 << 40)
    # of few rows more are let through, so that no language is missed
    chosen = rows.join(F.broadcast(counts), "label").where(draw < F.greatest(F.lit(each), F.lit(LEAST)) / F.col("n"))  # at most MAX_LANGS counts
    return chosen.select("id", "text", "label").limit(2 * MAX_SAMPLE)


def language_id(docs: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_lang: int = SAMPLE_PER_LANG, carry: list[str] | None = None) -> DataFrame:
    """One row per document: the id (or the columns of carry in its place), lang_pred, score and margin (how far the score lies from chance, at 0, to 1).

    learn: which rows may be learned from (all, if None); null labels never are.
    The model is fitted when this function is called; prediction is lazy.
    """
    spark = docs.sparkSession
    small_batches(spark, 256)
    base = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), docs[label_col].cast("string").alias("label"), F.coalesce(learn if learn is not None else F.lit(True), F.lit(False)).alias("learn"))
    lettered = F.coalesce(F.col("text").rlike(LETTER), F.lit(False))
    labelled = base.where(F.col("learn") & F.col("label").isNotNull() & lettered).select("id", "text", "label")

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.packbits(presence(b.column("text").to_pylist()).astype(bool), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in p], pa.binary()), b.column("label"), b.column("h")], ["bits", "label", "h"])

    drawn = sample(labelled, per_lang).withColumn("h", F.xxhash64("id")).mapInArrow(bits, "bits binary, label string, h long").toPandas()
    langs, matrix = [], np.zeros((DIMS + 1, 0), np.float32)
    if len(drawn):
        langs, matrix = fit(np.frombuffer(b"".join(drawn.bits), np.uint8).reshape(len(drawn), -1), drawn.label.to_numpy(str), drawn.h.to_numpy())
    model = spark.sparkContext.broadcast((langs, matrix))  # DIMS x at most MAX_LANGS numbers

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, matrix = model.value
        for b in batches:
            texts, ok = b.column("text").to_pylist(), b.column("ok").to_pylist()
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            for at in range(0, len(texts) if langs else 0, BLOCK):
                part = [t or "" for t in texts[at : at + BLOCK]]
                f = unit(presence(part)) @ matrix[:-1] + matrix[-1]
                best = f.argmax(axis=1)
                for i, k in enumerate(best):
                    if ok[at + i]:
                        lang[at + i], score[at + i] = langs[k], min(1.0, max(0.0, float(f[i, k])))
            own = b.column_names[:-2]
            yield pa.RecordBatch.from_arrays([*map(b.column, own), pa.array(lang), pa.array(score), pa.array(margin(score, len(langs)))], [*own, "lang_pred", "score", "margin"])

    carry = carry or [id_col]
    names = [f"c{i}" for i in range(len(carry))]
    kinds = [T.StructField(n, docs.schema[c].dataType) for n, c in zip(names, carry, strict=True)]
    text = docs[text_col].cast("string")
    rows = docs.select(*[docs[c].alias(n) for n, c in zip(names, carry, strict=True)], text.alias("text"), F.coalesce(text.rlike(LETTER), F.lit(False)).alias("ok"))
    out = rows.mapInArrow(predict, T.StructType([*kinds, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType())]))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, carry, strict=True)], "lang_pred", "score", "margin")
