"""A live feed as a streaming source: a folder of growing files, a rendered page or fragment a line.

    spark.dataSource.register(LiveFeed)
    spark.readStream.format("live_feed").option("path", folder).load()

Rows are (page_id, html, file, at), page_id being the file's name and the place of the
line in it. An offset is the number of bytes taken of each file, always at the end of
a line: a line that is still being written waits for its rest. A batch takes at most
`max_bytes` (but at least one line that waits), spread over the files, and is read in
splits of `split_bytes`, each on an executor; the driver only looks for line ends. With
`progress`, a folder of the stream's own beside its checkpoint, admission also holds for
the first batch after a start (Spark asks for the latest offset before it tells where
the stream stands); without it that batch takes all there is. Files may only grow; a shorter file is an error, one
that has gone is left alone. `path` and `progress` may be any address that Arrow's
filesystems open (local, hdfs://, s3:// ...).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "page_id string, html string, file string, at long"
MAX_BYTES, SPLIT_BYTES, CHUNK = 64 << 20, 8 << 20, 1 << 16


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def listed(path: str) -> dict[str, int]:
    """Size by name of the folder's files, hidden ones left out."""
    fs, at = opened(path)
    found = fs.get_file_info(pafs.FileSelector(at, allow_not_found=True))
    return {f.base_name: f.size for f in found if f.type == pafs.FileType.File and f.base_name[0] not in "._"}


def last_line_end(f: pa.NativeFile, begin: int, end: int, size: int) -> int:
    """The last line end in (begin, end]; if there is none, the first one behind; else begin."""
    at = end
    while at > begin:
        low = max(begin, at - CHUNK)
        f.seek(low)
        found = f.read(at - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    at = end
    while at < size:
        f.seek(at)
        chunk = f.read(min(CHUNK, size - at))
        found = chunk.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(chunk)
    return begin


class Split(InputPartition):
    def __init__(self, name: str, begin: int, end: int, first: bool):
        self.name, self.begin, self.end, self.first = name, begin, end, first


class LiveReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.max_bytes, self.split_bytes = int(options.get("max_bytes", MAX_BYTES)), int(options.get("split_bytes", SPLIT_BYTES))
        self.progress = options.get("progress")
        self.taken: dict[str, int] | None = None

    def initialOffset(self) -> dict:
        self.taken = {}
        return {}

    def remembered(self) -> dict[str, int] | None:
        if self.progress is None:
            return None
        fs, at = opened(self.progress)
        if fs.get_file_info(f"{at}/taken.json").type != pafs.FileType.File:
            return {}  # a new stream
        with fs.open_input_stream(f"{at}/taken.json") as f:
            return json.loads(f.read())

    def remember(self) -> None:
        if self.progress is None:
            return
        fs, at = opened(self.progress)
        fs.create_dir(at)
        name = f"{at}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(name) as f:
            f.write(json.dumps(self.taken).encode())
        fs.move(name, f"{at}/taken.json")

    def latestOffset(self) -> dict:
        sizes = listed(self.path)
        before = self.taken if self.taken is not None else self.remembered()
        room = None if before is None else self.max_bytes
        taken = dict(before or {})
        waiting = [n for n in sorted(sizes) if sizes[n] > taken.get(n, 0)]
        for n, begin in taken.items():
            if n in sizes and sizes[n] < begin:
                raise ValueError(f"{n} is shorter than what was read of it: {sizes[n]} of {begin} bytes")
        fs, at = opened(self.path)
        for k, n in enumerate(waiting):
            begin, size = taken.get(n, 0), sizes[n]
            share = size - begin if room is None else max(1, room // (len(waiting) - k)) if room > 0 else 0
            if not share:
                break
            with fs.open_input_file(f"{at}/{n}") as f:
                end = last_line_end(f, begin, min(size, begin + share), size)
            if end > begin:
                taken[n] = end
                room = None if room is None else room - (end - begin)
        self.taken = taken
        self.remember()
        return taken

    def partitions(self, start: dict, end: dict) -> list[Split]:
        if any(at > end.get(n, 0) for n, at in start.items()):
            raise ValueError(f"the stream has gone further than {self.progress} says: {start}, {end}")
        self.taken = {n: max(end.get(n, 0), (self.taken or {}).get(n, 0)) for n in {*end, *(self.taken or {})}}
        out = []
        for n, stop in sorted(end.items()):
            begin = start.get(n, 0)
            out += [Split(n, at, min(at + self.split_bytes, stop), at == begin) for at in range(begin, stop, self.split_bytes)]
        return out

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        """The lines that begin in the split."""
        fs, at = opened(self.path)
        with fs.open_input_file(f"{at}/{split.name}") as f:
            begin = split.begin
            if not split.first:  # a line that runs into this split belongs to the one before
                begin = split.begin - 1
                f.seek(begin)
                while True:
                    chunk = f.read(CHUNK)
                    found = chunk.find(b"\n")
                    if found >= 0 or not chunk:
                        begin += found + 1 if found >= 0 else 0
                        break
                    begin += len(chunk)
            f.seek(begin)
            rows, held, left = [], 0, b""
            while begin < split.end:
                chunk = f.read(CHUNK)
                if not chunk:
                    break
                *lines, left = (left + chunk).split(b"\n")
                for line in lines:
                    if begin >= split.end:
                        break
                    if line.strip():
                        rows.append((f"{split.name}:{begin}", line.decode("utf-8", "replace"), split.name, begin))
                        held += len(line)
                    begin += len(line) + 1
                if held > SPLIT_BYTES:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)

    def commit(self, end: dict) -> None:
        pass


def batch(rows: list[tuple]) -> pa.RecordBatch:
    ids, html, files, at = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(html), pa.array(files), pa.array(at, pa.int64())], ["page_id", "html", "file", "at"])


class LiveFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "live_feed"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LiveReader:
        return LiveReader(dict(self.options))


def live_pages(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(LiveFeed)
    reader = spark.readStream.format("live_feed").option("path", path)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def posts_to(sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch step that reads the posts of a batch of pages and hands them on."""
    from .html_feed import read_posts

    return lambda pages, epoch: sink(read_posts(pages.select(F.xxhash64("page_id").alias("page_id"), "html")), epoch)
