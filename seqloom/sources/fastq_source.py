"""FASTQ as a data source of its own: `spark.read.format("fastq")` and `spark.readStream.format("fastq")`.

Files are read in byte ranges of `splitBytes`, each by one task in one pass; nothing is stored and nothing
is numbered. A record belongs to the range its first byte lies in. A range that begins inside a file
finds its first record by the pattern of four lines: a header with `@`, a third line with `+`, and as
many signs of quality as bases. A quality line may itself begin with `@`, so all four phases are held
against the lines that follow until one is left; should several hold for `LOOK_AHEAD` lines or up to the end of
the file, the search begins further back, at the beginning of the file at last.

Columns: file, offset (of the record in the file; with the file it names the read), name, seq, quality.
A last record that breaks off has nulls for what is missing. Paths may be any that the Arrow file systems
open (local, hdfs://, s3://, ...).

As a stream, each file is read once, when it has appeared whole (moved in under its name, as Spark's own
file streams ask). The offset holds the names of the files read so far, so a restarted query goes on
with the next file.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, offset long, name string, seq string, quality string"
COLUMNS = ("file", "offset", "name", "seq", "quality")
BLOCK = 1 << 20
ROWS = 4096
LOOK_AHEAD = 256
# Bytes of text in one batch; long reads make batches of few rows.
BATCH_BYTES = 8 << 20


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


def listed(path: str) -> list[tuple[str, int]]:
    """(file, size) of the file or of the files in the folder `path`, hidden ones left out, by name."""
    system, inside = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    head = path[: len(path) - len(inside)] if "://" in path and path.endswith(inside) else ""
    info = system.get_file_info(inside)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = system.get_file_info(fs.FileSelector(inside))
    files = [(head + f.path, f.size) for f in found if f.type == fs.FileType.File]
    return sorted((name, size) for name, size in files if posixpath.basename(name)[:1] not in "._")


def opened(file: str) -> pa.NativeFile:
    system, inside = fs.FileSystem.from_uri(file) if "://" in file else (fs.LocalFileSystem(), file)
    return system.open_input_file(inside)


def lines_from(source: pa.NativeFile, at: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line without its end) of all lines from the one that begins at `at`."""
    source.seek(at)
    pieces: list[bytes] = []
    begin = at
    while block := source.read(BLOCK):
        last = 0
        while (end := block.find(b"\n", last)) >= 0:
            pieces.append(block[last:end])
            line = b"".join(pieces)
            yield begin, line
            begin += len(line) + 1
            pieces, last = [], end + 1
        pieces.append(block[last:])
    rest = b"".join(pieces)
    if rest:
        yield begin, rest


def fits(record: list[bytes]) -> bool:
    """Whether up to four lines can be the beginning of a record."""
    if not record[0].startswith(b"@"):
        return False
    if len(record) > 2 and not record[2].startswith(b"+"):
        return False
    if len(record) < 4 or len(record[3]) == len(record[1]):
        return True
    return len(record[3].decode("utf-8", "replace")) == len(record[1].decode("utf-8", "replace"))


def first_record(source: pa.NativeFile, start: int, back: int = 1 << 16) -> Iterator[tuple[int, bytes]]:
    """Lines from the first record that begins at or after `start`."""
    if start == 0:
        yield from lines_from(source, 0)
        return
    lines = lines_from(source, start - 1)
    next(lines, None)  # the end of the line that reaches into the range
    held: list[tuple[int, bytes]] = []
    phases = {0: 0, 1: 0, 2: 0, 3: 0}  # possible places of a header, and how many lines behind are checked
    ended = False
    while len(phases) > 1 and not ended and len(held) < LOOK_AHEAD:
        line = next(lines, None)
        ended = line is None
        if not ended:
            held.append(line)
        for phase, done in list(phases.items()):
            while phase + done + 4 <= len(held) or (ended and phase + done < len(held)):
                if not fits([text for _, text in held[phase + done : phase + done + 4]]):
                    del phases[phase]
                    break
                phases[phase] = done = done + 4
    if not held:
        return
    if len(phases) == 1:
        yield from held[next(iter(phases)) :]
        yield from lines
        return
    # Nothing tells the phases apart here (or nothing fits): lines before the range do.
    begun = False
    for number, (at, line) in enumerate(first_record(source, max(0, start - back), 4 * back)):
        begun = begun or (number % 4 == 0 and at >= start)
        if begun:
            yield at, line


def records(file: str, start: int, end: int) -> Iterator[tuple[int, list[bytes]]]:
    """(offset, lines) of the records that begin in [start, end) of a file."""
    with opened(file) as source:
        offset, held = 0, []
        for at, line in first_record(source, start):
            if not held:
                if at >= end:
                    return
                offset = at
            held.append(line)
            if len(held) == 4:
                yield offset, held
                held = []
        if any(held):
            yield offset, held


def batches(part: Range) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    size = 0
    text = lambda lines, i: lines[i].decode("utf-8", "replace") if len(lines) > i else None
    for offset, lines in records(part.file, part.start, part.end):
        rows.append((part.file, offset, text(lines, 0), text(lines, 1), text(lines, 3)))
        size += sum(map(len, lines))
        if len(rows) == ROWS or size >= BATCH_BYTES:
            yield _batch(rows)
            rows, size = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], COLUMNS)


def ranges(files: list[tuple[str, int]], split: int) -> list[Range]:
    return [Range(name, at, min(at + split, size)) for name, size in files for at in range(0, size, split)]


class FastqReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Range]:
        return ranges(listed(self.path), self.split) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return batches(partition) if partition.end else iter(())


class FastqStream(DataSourceStreamReader):
    """Offsets are {"files": {name: size}}: all files up to there."""

    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        return {"files": dict(listed(self.path))}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        new = sorted((name, size) for name, size in end["files"].items() if name not in start["files"])
        return ranges(new, self.split)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return batches(partition)


class FastqSource(DataSource):
    """Options: path (a file or folder), splitBytes (64 MB)."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def _wanted(self) -> tuple[str, int]:
        if "path" not in self.options:
            raise ValueError("the fastq source needs a path")
        return self.options["path"].removeprefix("file://"), max(1, int(self.options.get("splitBytes", 64 << 20)))

    def reader(self, schema) -> FastqReader:
        return FastqReader(*self._wanted())

    def streamReader(self, schema) -> FastqStream:
        return FastqStream(*self._wanted())


def register(spark: SparkSession) -> None:
    """Make the format known to the session."""
    spark.dataSource.register(FastqSource)
