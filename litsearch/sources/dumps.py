"""Article dumps as a data source of their own, read in batch or as a stream.

``spark.read.format("article_dumps")`` gives one row per ``<article>`` record
with the ``file``, when it ``arrived`` and the byte ``offset`` where it starts, so a record can be
named, reported and read again. Files are planned as byte ranges of
``splitBytes``; a record belongs to the range in which the record before it
has ended, so ranges are read side by side, each record once. A filter on
``file`` leaves out other files before anything is opened; for that ``register``
sets ``spark.sql.python.filterPushdown.enabled``.

As a stream, files count as arrived in the order of (modification time, name).
A micro-batch takes all files behind the last offset that are older than
``settleSeconds``, so a file that shares its time stamp with one already taken
is not missed. Files must be complete when they appear, as for Spark's own file
streams. Names that start with ``_`` or ``.`` are left out. The offset is one time
stamp and one name, whatever the number of files.

Options: ``path`` (a folder or a file, any file system that pyarrow opens),
``splitBytes``, ``settleSeconds``. A missing record end at the end of a file gives a truncated
record, which the decoder rejects. A folder without files gives no rows.
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In,
                                    InputPartition)

from litsearch.sources.xml import RECORD_END

END = RECORD_END.encode()
START = re.compile(rb"<article[\s>]")
SPLIT_BYTES = 64 << 20
READ_BYTES = 4 << 20
SETTLE_SECONDS = 2


@dataclass
class ByteRange(InputPartition):
    file: str
    arrived: int
    start: int
    end: int

    def __post_init__(self):
        super().__init__(None)


def opened(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_below(path: str) -> list[tuple[int, str, int]]:
    """(modification time in ns, name, size) of the files, in order of arrival."""
    from pyarrow import fs
    system, base = opened(path)
    info = system.get_file_info(base)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(
        fs.FileSelector(base, recursive=True, allow_not_found=True))
    return sorted((f.mtime_ns or 0, f.path, f.size) for f in found
                  if f.type == fs.FileType.File and f.base_name[0] not in "_.")


def records_in(source, start: int, end: int):
    """(offset, bytes) of the records of an open file whose predecessor ends in [start, end)."""
    at = max(0, start - len(END))  # a record end just before the range still counts
    source.seek(at)
    held, done = bytearray(), False

    def find(frm: int) -> int:
        """Where in ``held`` the next record end stops, or -1 at the end of the file."""
        nonlocal done
        while True:
            hit = held.find(END, frm)
            if hit >= 0:
                return hit + len(END)
            frm = max(frm, len(held) - len(END) + 1)
            more = b"" if done else source.read(READ_BYTES)
            if not more:
                done = True
                return -1
            held.extend(more)

    here = 0
    if start:
        here = find(0)
        if here < 0:
            return
    while at + here < end:
        stop = find(here)
        body = bytes(held[here:stop] if stop >= 0 else held[here:])
        tag = START.search(body)
        if tag:
            yield at + here + tag.start(), body[tag.start():]
        if stop < 0:
            return
        here = stop
        if here > READ_BYTES:
            del held[:here]
            at, here = at + here, 0


def ranges(files, split_bytes: int) -> list[ByteRange]:
    return [ByteRange(name, arrived, at, min(at + split_bytes, size))
            for arrived, name, size in files for at in range(0, size, split_bytes)]


class _Reading:
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split_bytes = int(options.get("splitBytes", SPLIT_BYTES))
        self.settle = float(options.get("settleSeconds", SETTLE_SECONDS))

    def read(self, partition: ByteRange | None):
        if partition is None:  # there is no file
            return
        system, _ = opened(self.path)
        with system.open_input_file(partition.file) as source:
            for offset, body in records_in(source, partition.start, partition.end):
                yield partition.file, partition.arrived, offset, body.decode("utf-8", "replace")


class ArticleReader(_Reading, DataSourceReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.wanted: set[str] | None = None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("file",):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = names if self.wanted is None else self.wanted & names
            else:
                yield f

    def partitions(self):
        files = files_below(self.path)
        return ranges([f for f in files if self.wanted is None or f[1] in self.wanted], self.split_bytes)


class ArticleStreamReader(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"time": -1, "file": ""}

    def latestOffset(self) -> dict:
        newest = time.time_ns() - int(self.settle * 1e9)
        last = max(((t, name) for t, name, _ in files_below(self.path) if t <= newest), default=(-1, ""))
        return {"time": last[0], "file": last[1]}

    def partitions(self, start: dict, end: dict):
        low, high = (start["time"], start["file"]), (end["time"], end["file"])
        return ranges([f for f in files_below(self.path) if low < f[:2] <= high], self.split_bytes)

    def commit(self, end: dict) -> None:
        pass


class ArticleDumps(DataSource):
    @classmethod
    def name(cls) -> str:
        return "article_dumps"

    def schema(self) -> str:
        return "file string, arrived long, offset long, article_xml string"

    def reader(self, schema) -> DataSourceReader:
        return ArticleReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ArticleStreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArticleDumps)
