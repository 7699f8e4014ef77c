"""Marked records of large text files, read in parts of a file.

A feed of a gigabyte is one document; as one row it is one task's work and one array of items. This source cuts files into
ranges of bytes and gives one row a record, wherever the cuts fall.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, kind string, at long, text string"
# The longest mark is shorter than this, folds included.
REACH = 128


def _folded(mark: str) -> bytes:
    """A calendar's mark, which a continuation line may split anywhere."""
    return rb"(?:\r?\n[ \t])?".join(re.escape(c).encode() for c in mark)


# Kind: opening mark, closing mark.
MARKS = {
    "item": (rb"(?i:<item\b)", rb"(?i:</item>)"),
    "entry": (rb"(?i:<entry\b)", rb"(?i:</entry>)"),
    "vevent": (_folded("BEGIN:VEVENT"), _folded("END:VEVENT")),
    "vtimezone": (_folded("BEGIN:VTIMEZONE"), _folded("END:VTIMEZONE")),
}


@dataclass
class Ranges(InputPartition):
    """(path, name, start, end) of a task: one part of a large file, or several small files."""

    parts: list[tuple[str, str, int, int]]


def _opened(path: str) -> tuple[Any, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


class RecordReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.kinds = [k.strip() for k in options.get("kinds", "item,entry").split(",")]
        unknown = set(self.kinds) - set(MARKS)
        if unknown:
            raise ValueError(f"Unknown kind: {sorted(unknown)}")
        self.part_bytes = int(options.get("part_bytes", 32 << 20))
        self.back_bytes = int(options.get("back_bytes", 1 << 20))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, root = _opened(self.path)
        info = files.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(root, recursive=True))
        out, small, room = [], [], 0
        for f in sorted(found, key=lambda f: f.path):
            hidden = any(p.startswith(("_", ".")) for p in f.path[len(info.path):].split("/"))
            if f.type != fs.FileType.File or hidden or not f.size:
                continue
            name = f.path[len(info.path):].lstrip("/") or f.base_name
            if f.size > self.part_bytes:
                out += [Ranges([(f.path, name, s, min(s + self.part_bytes, f.size))]) for s in range(0, f.size, self.part_bytes)]
                continue
            if small and room + f.size > self.part_bytes:
                out.append(Ranges(small))
                small, room = [], 0
            small.append((f.path, name, 0, f.size))
            room += f.size
        return out + [Ranges(small)] if small or not out else out

    def read(self, partition: Ranges) -> Iterator[tuple]:
        files, _ = _opened(self.path)
        for path, name, start, end in partition.parts:
            with files.open_input_file(path) as f:
                for kind in self.kinds:
                    for at, text in records(f, kind, start, end, self.back_bytes):
                        yield name, kind, at, text.decode("utf-8", "replace")


def _marks(f: Any, kind: str, start: int, end: int) -> Iterator[tuple[bool, int, int]]:
    """(closing, begin, end) of the marks that end in (start, end], in order."""
    opening, closing = MARKS[kind]
    low = max(0, start - REACH)
    data = f.read_at(min(end + REACH, f.size()) - low, low)
    for m in re.finditer(b"(%b)|%b" % (opening, closing), data):
        if start < low + m.end() <= end:
            yield m.group(1) is None, low + m.start(), low + m.end()


def records(f: Any, kind: str, start: int, end: int, back_bytes: int) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the records whose closing mark ends in (start, end].

    A record runs from the first opening mark after the last closing mark to the next closing mark, as a pattern that
    is not greedy finds it in the whole text; text without both marks is no record. What a range cannot know, the opening mark of its first
    closing mark, is looked up backwards, block by block, so a file without closing marks is read once.
    """
    opened, sure = None, start == 0
    for closes, begin, stop in _marks(f, kind, start, end):
        if not closes:
            opened = begin if opened is None else opened
            continue
        if not sure:
            earlier = _open_before(f, kind, start, back_bytes)
            opened, sure = opened if earlier is None else earlier, True
        if opened is not None:
            yield opened, f.read_at(stop - opened, opened)
        opened = None


def _open_before(f: Any, kind: str, start: int, back_bytes: int) -> int | None:
    """The first opening mark after the last closing mark that ends at or before ``start``."""
    opened = None
    while start > 0:
        low = max(0, start - back_bytes)
        here, closed = None, False
        for closes, begin, _ in _marks(f, kind, low, start):
            if closes:
                here, closed = None, True
            elif here is None:
                here = begin
        if here is not None:
            opened = here
        if closed:
            return opened
        start = low
    return opened


class RecordSource(DataSource):
    """Options: ``path`` (a file or a folder), ``kinds`` of ``MARKS``, ``part_bytes``, ``back_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "marked_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> DataSourceReader:
        return RecordReader(dict(self.options))


def read_records(spark: SparkSession, path: str, kinds: list[str], **options: Any) -> DataFrame:
    """(file, kind, at, text) of the marked records of a file or of all files below a folder.

    ``file`` is the path below the folder, ``at`` the byte the record begins at. Files are UTF-8 and not compressed;
    bytes that are no UTF-8 become U+FFFD. Names that begin with ``_`` or ``.`` are left out.
    """
    spark.dataSource.register(RecordSource)
    return spark.read.format("marked_records").options(kinds=",".join(kinds), **options).load(path)
