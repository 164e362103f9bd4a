"""Text lines with their file and line number, as a data source over byte ranges.

Files are cut into ranges. A line belongs to the range it starts in, and a range knows the number of its
first line because the line starts of the earlier ranges of its file were counted before; files of one
range, compressed ones among them, need no count. Reading is a plain scan: no line is exchanged.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import is_int, require
from .artifacts import open_file

SCHEMA = "path string, line_number long, value string"
_BLOCK = 8 * 1024 * 1024
_ROWS = 4096
_LF, _CR = 10, 13


def line_starts(before: bytes, block: bytes, first: bool) -> list[int]:
    """Places in ``block`` at which a line starts; ``before`` is the byte in front of it, if any.

    Lines end with a line feed, a carriage return, or both in this order.
    """
    import numpy as np

    here = np.frombuffer(block, np.uint8)
    if not len(here):
        return []
    ahead = np.empty_like(here)
    ahead[1:] = here[:-1]
    ahead[0] = before[0] if before else 0
    starts = (ahead == _LF) | ((ahead == _CR) & (here != _LF))
    if not before:
        starts[0] = first
    return np.flatnonzero(starts).tolist()


def _blocks(stream, start: int, end: int, more: bool) -> Iterator[tuple[bytes, bytes]]:
    """(byte before, block) of a range; with ``more`` also what follows it, block by block."""
    at = max(start - 1, 0)
    stream.seek(at)
    before = stream.read(1) if start else b""
    at = start
    while at < end or more:
        block = stream.read(min(_BLOCK, end - at) if at < end else 65_536)
        if not block:
            return
        yield before, block
        before, at = block[-1:], at + len(block)


def count_starts(path: str, start: int, end: int) -> int:
    with open_file(path) as stream:
        return sum(len(line_starts(b, block, start == 0)) for b, block in _blocks(stream, start, end, False))


def read_range(path: str, start: int, end: int) -> Iterator[bytes]:
    """The lines that start in a range, without their ends; one block and one line are held."""
    with open_file(path) as stream:
        at, held, begun = start, [], False
        for before, block in _blocks(stream, start, end, True):
            ends = line_starts(before, block, start == 0)
            low = 0
            for place in ends:
                if begun:
                    yield _bare(b"".join([*held, block[low:place]]))
                    held = []
                if at + place >= end:
                    return
                begun, low = True, place
            if begun:
                held.append(block[low:])
            elif at + len(block) >= end:
                return
            at += len(block)
        if begun:
            yield _bare(b"".join(held))


def read_packed(path: str) -> Iterator[bytes]:
    """All lines of a bz2 file, unpacked block by block."""
    import bz2

    with open_file(path) as raw, bz2.BZ2File(raw) as stream:
        before, held, first = b"", [], True
        while block := stream.read(_BLOCK):
            low = 0
            for place in line_starts(before, block, first):
                if not first:
                    yield _bare(b"".join([*held, block[low:place]]))
                    held = []
                first, low = False, place
            held.append(block[low:])
            before = block[-1:]
        if not first:
            yield _bare(b"".join(held))


def _bare(line: bytes) -> bytes:
    if line.endswith(b"\r\n"):
        return line[:-2]
    return line[:-1] if line.endswith((b"\n", b"\r")) else line


def _source():
    """The data source class; built here so that it travels to executors by value."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Reader(DataSourceReader):
        def __init__(self, ranges: list):
            self.ranges = ranges

        def partitions(self) -> list:
            return [InputPartition(r) for r in self.ranges]

        def read(self, partition) -> Iterator[pa.RecordBatch]:
            path, start, end, number, packed = partition.value
            held: list[bytes] = []

            def batch() -> pa.RecordBatch:
                # a line that is not UTF-8 stops the read here
                text = pa.array(held, pa.binary()).cast(pa.string())
                numbers = pa.array(range(number, number + len(held)), pa.int64())
                return pa.RecordBatch.from_arrays([pa.array([path] * len(held)), numbers, text], ["path", "line_number", "value"])

            size = 0
            for line in read_packed(path) if packed else read_range(path, start, end):
                held.append(line)
                size += len(line)
                if len(held) == _ROWS or size > _BLOCK:
                    yield batch()
                    number, held, size = number + len(held), [], 0
            if held:
                yield batch()

    class NumberedLines(DataSource):
        @classmethod
        def name(cls) -> str:
            return "numbered_lines"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> Reader:
            return Reader(json.loads(self.options["ranges"]))

    return NumberedLines


def _range_bytes(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.files.maxPartitionBytes").removesuffix("b"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        counts = [count_starts(r["path"], r["low"], r["high"]) for r in rows]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], [*batch.schema.names, "lines"])


def numbered_lines(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """(path, line_number, value) of plain or bz2 text, numbered from 1 in file order.

    Blank lines are rows too; an end of line at the end of a file starts no further one. The list of
    ranges is planned on the driver, as Spark does for its own file splits.
    """
    size = range_bytes or _range_bytes(spark)
    require(is_int(size) and size >= 1, "a range has at least one byte")
    files = spark.read.format("binaryFile").load(path).select("path", "length").collect()
    whole = [(f.path, 0, f.length, f.path.endswith(".bz2")) for f in files if f.length]
    ranges = [
        (name, low, length if packed else min(low + size, length), packed)
        for name, _, length, packed in whole
        for low in (range(0, length, size) if not packed else [0])
    ]
    lengths = {name: length for name, _, length, _ in whole}
    many = [r[:3] for r in ranges if not r[3] and r[2] - r[1] < lengths[r[0]]]
    found: dict[tuple[str, int], int] = {}
    if many:
        task = spark.createDataFrame(many, "path string, low long, high long").repartition(len(many))
        counted = task.mapInArrow(_counted, "path string, low long, high long, lines long")
        found = {(r.path, r.low): r.lines for r in counted.collect()}
    planned, number = [], {}
    for name, low, high, packed in ranges:
        first = number.setdefault(name, 1)
        planned.append((name, low, high, first, packed))
        number[name] = first + found.get((name, low), 0)
    if not planned:
        return spark.createDataFrame([], SCHEMA)
    spark.dataSource.register(_source())
    return spark.read.format("numbered_lines").option("ranges", json.dumps(planned)).load()
