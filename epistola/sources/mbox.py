"""MBOX files of any size as a data source: each task reads a range of bytes, and what begins in it."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range, and of a read.
RANGE, CHUNK = 64 << 20, 1 << 20
_MARK = b"\nFrom "


def message(data: bytes | bytearray) -> bytes:
    """What lies between two From lines, without the empty line at its end and with the marks before From lines taken away."""
    return re.sub(rb"(?m)^>(>*From )", rb"\1", bytes(data[:-1] if data.endswith(b"\n\n") else data))


def messages(read: Callable[[int], bytes], start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of each message whose From line begins in [start, end).

    read goes on from the byte before start, or from the file's beginning where start is 0. A From line counts if it follows a
    line's end or begins the file, and is ended itself. What is held is one message and a read.
    """
    buf, base = (b"", start - 1) if start else (b"\n", -1)
    now: bytearray | None = None
    began, lead = 0, 0  # lead: bytes of buf that are not of the message
    while True:
        i = buf.find(_MARK)
        stop = buf.find(b"\n", i + len(_MARK)) if i >= 0 else -1
        if stop >= 0:
            if now is not None:
                now += buf[lead : i + 1]
                yield began, message(now)
                now = None
            mark = base + i + 1
            if mark >= end:
                return
            if mark >= start:
                now, began = bytearray(), mark
            # The end of this line may be the one before the next From line.
            buf, base, lead = buf[stop:], base + stop, 1
            continue
        if now is None and base >= end:
            return
        more = read(CHUNK)
        if not more:
            if now is not None:
                now += buf[lead:]
                yield began, message(now)
            return
        keep = i if i >= 0 else max(lead, len(buf) - len(_MARK) + 1)
        if keep > lead:
            if now is not None:
                now += buf[lead:keep]
            buf, base, lead = buf[keep:], base + keep, 0
        buf += more


@dataclass
class Range(InputPartition):
    uri: str
    name: str
    start: int
    end: int


class MboxReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[InputPartition]:
        where, base = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        base = base.rstrip("/")
        own = where.get_file_info(base)
        found = [own] if own.is_file else where.get_file_info(fs.FileSelector(base, recursive=True))
        top = base.rpartition("/")[0] if own.is_file else base
        hidden = lambda path: any(p.startswith("_") for p in path[len(base) + 1 :].split("/"))
        files = sorted((x.path, x.size) for x in found if x.is_file and x.size and not hidden(x.path))
        return [Range(self.path, path[len(top) + 1 :], at, min(size, at + self.size)) for path, size in files for at in range(0, size, self.size)] or [Range("", "", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.uri:
            return
        where, base = fs.FileSystem.from_uri(partition.uri) if "://" in partition.uri else (fs.LocalFileSystem(), partition.uri)
        base = base.rstrip("/")
        path = base if where.get_file_info(base).is_file else f"{base}/{partition.name}"
        with where.open_input_file(path) as file:
            file.seek(max(0, partition.start - 1))
            for at, raw in messages(file.read, partition.start, partition.end):
                yield partition.name, at, raw


class MboxSource(DataSource):
    """spark.read.format("mbox").load(path): name, below the path, offset and raw. Option range: bytes of a task."""

    @classmethod
    def name(cls) -> str:
        return "mbox"

    def schema(self) -> str:
        return "name string, at long, raw binary"

    def reader(self, schema) -> MboxReader:
        return MboxReader(self.options["path"], int(self.options.get("range", RANGE)))
