"""A splitting reader of FASTQ files, as a Python data source.

A file is cut into byte ranges, each of which is a task.  A record belongs to the range in which its header line starts.  A header is a line
that begins with `@` and has a line that begins with `+` two lines on: a quality line may begin with `@` too, but two lines on from it stands
a sequence.  So every range finds its first record by itself, and lines need no numbering and no shuffle.  Compressed files are one task each.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PACKED = {".gz": "gzip", ".bz2": "bz2", ".zst": "zstd"}
SCHEMA = pa.schema([("id", pa.string()), ("seq", pa.string()), ("qual", pa.string())])


def list_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(URI, bytes) of the files of a path, folder or glob, as Spark's file system lists them; hidden files are left out."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    system, out = where.getFileSystem(conf), []
    todo = list(system.globStatus(where) or [])
    if not todo:
        raise FileNotFoundError(path)
    while todo:
        s = todo.pop()
        if s.isDirectory():
            todo += [c for c in system.listStatus(s.getPath()) if not c.getPath().getName().startswith(("_", "."))]
        else:
            out.append((s.getPath().toUri().toString(), s.getLen()))
    return sorted(out)


class Range(InputPartition):
    def __init__(self, uri: str, start: int, end: int | None):
        self.uri, self.start, self.end = uri, start, end


def opened(uri: str, start: int):
    """The file from `start`; decompressed if its name says so."""
    system, path = fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    for end, codec in PACKED.items():
        if path.endswith(end):
            return system.open_input_stream(path, compression=codec)
    stream = system.open_input_file(path)
    stream.seek(start)
    return stream


def lines_from(stream, at: int, chunk: int = 1 << 22) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of whole lines, each with the place of its first line."""
    rest = b""
    while data := stream.read(chunk):
        data = rest + data
        cut = data.rfind(b"\n") + 1
        if cut:
            yield at, data[: cut - 1].split(b"\n")
            at += cut
        rest = data[cut:]
    if rest:
        yield at, [rest]


def records(stream, start: int, end: int | None) -> Iterator[tuple[list[bytes], list[bytes], list[bytes]]]:
    """Ids, sequences and qualities of the records whose headers start in [start, end); the stream stands one byte before start, or at 0."""
    at, lines, found = max(start - 1, 0), [], start == 0
    first = start > 0  # what is left of the line that the range cuts
    for begin, more in lines_from(stream, at):
        if first:
            at, more, first = begin + len(more[0]) + 1, more[1:], False
        elif not lines:
            at = begin
        lines += more
        if not found:
            while len(lines) > 2 and not (lines[0][:1] == b"@" and lines[2][:1] == b"+"):
                at += len(lines.pop(0)) + 1
            found = len(lines) > 2
            if not found:
                continue
        n = len(lines) // 4
        if end is not None:
            place = at
            for i in range(n):
                if place >= end:
                    n = i
                    break
                place += sum(map(len, lines[4 * i : 4 * i + 4])) + 4
        if n:
            of = lambda k, n=n: [x[:-1] if x[-1:] == b"\r" else x for x in lines[k : 4 * n : 4]]
            yield [h[1:].split()[0] if h[1:].split() else b"" for h in of(0)], of(1), of(3)
        if n < len(lines) // 4:
            return
        at += sum(map(len, lines[: 4 * n])) + 4 * n
        lines = lines[4 * n :]
        if end is not None and at >= end:
            return
    if any(x.strip() for x in lines) and (found or not end):
        raise ValueError(f"a record is cut off at byte {at}")


class FastqReader(DataSourceReader):
    def __init__(self, options):
        self.files, self.size = json.loads(options["files"]), int(options["split"])

    def partitions(self) -> list[Range]:
        out = []
        for uri, size in self.files:
            if uri.endswith(tuple(PACKED)):
                out.append(Range(uri, 0, None))
            else:
                out += [Range(uri, a, min(a + self.size, size)) for a in range(0, size, self.size)]
        return out or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.uri:
            return
        with opened(part.uri, max(part.start - 1, 0)) as stream:
            for ids, seqs, quals in records(stream, part.start, part.end):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()).cast(pa.string()) for x in (ids, seqs, quals)], schema=SCHEMA)


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq_ranges"

    def schema(self) -> str:
        return "id string, seq string, qual string"

    def reader(self, schema) -> FastqReader:
        return FastqReader(self.options)
