"""Exchange of per-key facts between document parts and key buckets.

Documents are dealt into parts of bounded text size by a hash of id and text. A part
sends each of its distinct keys once, with what it knows of it, to the key's bucket;
the bucket answers each part. So a key that a third of all documents hold costs one
entry per part, and no task sees more than its share of parts or keys. A part's message
to a bucket holds about (keys of a part) / (number of buckets) keys.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a part, and parts for each bucket.
PART_BYTES, PARTS_PER_BUCKET = 4 << 20, 2
LOW40 = np.uint64((1 << 40) - 1)


def part_count(docs: DataFrame, text_col: str = "text", part_bytes: int = PART_BYTES) -> int:
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    return max(1, -(-total // part_bytes))


def bucket_count(parts: int) -> int:
    return -(-parts // PARTS_PER_BUCKET)


def in_parts(docs: DataFrame, n: int, id_col: str, text_col: str, **more) -> DataFrame:
    """(pid, id, text, ...) with texts that are never null."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(F.pmod(F.xxhash64(docs[id_col], text), F.lit(n)).cast("int").alias("pid"), docs[id_col].alias("id"), text.alias("text"), *[c.alias(k) for k, c in more.items()])


def ascii_words(text: str) -> list[bytes]:
    """Runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lowered."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def five_bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray((x & LOW40).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def from_five(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def bucket_edges(values: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket, an equal range of 64-bit numbers, begins among sorted values."""
    return np.searchsorted(values, np.array([k * (1 << 64) // buckets for k in range(buckets)], np.uint64)).tolist() + [len(values)]
