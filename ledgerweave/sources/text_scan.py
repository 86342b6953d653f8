"""Text files of any charset as lines, read in parallel by ranges of bytes.

A range owns the lines that begin in it. Its task reads on past the end until
the last of them is whole, so lines are the same at every size of the ranges.
Characters of two or four bytes are looked at as units, never as bytes.

Line numbers need no order over a file: each range counts its lines, and a
running sum over the counts of a file's ranges gives each its first number.
Whether a file is UTF-8 is what its ranges say together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerweave.sources.stage import saved

RANGE_BYTES = 32 << 20
#: So many tasks, if there are as many ranges, whatever their size.
LEAST_TASKS = 64
#: Byte order marks (the longer ones first) with codec and bytes of a unit.
MARKS = [(b"\xff\xfe\x00\x00", "utf-32-le", 4), (b"\x00\x00\xfe\xff", "utf-32-be", 4), (b"\xef\xbb\xbf", "utf-8", 1), (b"\xff\xfe", "utf-16-le", 2), (b"\xfe\xff", "utf-16-be", 2)]


def byte_ranges(spark: SparkSession, path: str | list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """file_id, length, at: a row for each range of each file below the path, dealt over the tasks; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file_id"), "length")
    ranges = files.withColumn("at", F.explode(F.expr(f"transform(sequence(0L, greatest(cast(ceil(length / {range_bytes}) AS BIGINT) - 1, 0L)), i -> i * {range_bytes}L)")))
    found = ranges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.least(F.col("length"), F.lit(range_bytes))), F.lit(0))).first()
    # Small ranges share a task, as tasks go by bytes.
    tasks = max(math.ceil(found[1] / RANGE_BYTES) * 4, LEAST_TASKS, spark.sparkContext.defaultParallelism)
    return ranges.repartition(max(1, min(found[0], tasks)))


def opened(path: str):
    """A file that can be read at any place: local, or in any store that Arrow knows."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path.replace("file:///", "/").replace("file:/", "/"))
    return store.open_input_file(name)


def line_starts(units: np.ndarray) -> np.ndarray:
    """Whether a line begins at each unit but the first: after a line feed, or after a carriage return that none follows."""
    return (units[:-1] == 10) | ((units[:-1] == 13) & (units[1:] != 10))


def owned(file, length: int, at: int, end: int, step: int = 1 << 20) -> tuple[bytes, str | None]:
    """The lines that begin in the bytes from at to end, whole, and the codec that a byte order mark tells."""
    head = file.read_at(min(4, length), 0)
    mark, codec, unit = next((m for m in MARKS if head.startswith(m[0])), (b"", None, 1))
    kind = np.dtype({"be": ">", "le": "<"}.get((codec or "")[-2:], "|") + f"u{unit}")
    first = len(mark)
    whole = length - (length - first) % unit  # a last unit that is cut off is no character
    place = lambda x: min(whole, max(first, first + -(-(x - first) // unit) * unit))
    start, stop = place(at), place(end)
    if start >= stop:
        return b"", codec
    back = start - unit if start > first else start
    data = file.read_at(min(stop + unit, whole) - back, back)  # one unit before to see a line's beginning, one behind to see its end
    units = np.frombuffer(data, kind)
    begins = np.flatnonzero(np.r_[start == first, line_starts(units)][: (stop - back) // unit])
    begins = begins[begins >= (start - back) // unit]
    if not len(begins):
        return b"", codec
    reached = back + len(data)
    parts = [data[begins[0] * unit :]]
    seen, tail = stop, data[stop - back - unit :]  # from one unit before; the open line ends where the next one begins, at stop or later
    while True:
        look = np.frombuffer(tail, kind)
        hit = np.flatnonzero(line_starts(look))
        if len(hit):
            cut = seen + int(hit[0]) * unit  # tail begins one unit before seen
            return b"".join(parts)[: cut - back - begins[0] * unit], codec
        if reached >= whole:
            return b"".join(parts), codec
        more = file.read_at(min(step // unit * unit, whole - reached), reached)
        parts.append(more)
        seen, tail = reached, parts[-2][-unit:] + more
        reached += len(more)


def split_lines(data: bytes) -> pa.Array:
    """The lines of bytes in which a character below 128 is one byte, without their ends."""
    if not data:
        return pa.array([], pa.large_binary())
    raw = np.frombuffer(data, np.uint8)
    start = np.flatnonzero(np.r_[True, line_starts(raw)])
    stop = np.r_[start[1:], len(raw)]
    feed = raw[stop - 1] == 10
    returned = np.where(feed, (stop - 2 >= start) & (raw[np.maximum(stop - 2, 0)] == 13), raw[stop - 1] == 13)
    size = stop - start - feed - returned
    edge = np.zeros(len(raw) + 1, np.int8)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + size, -1)
    kept = raw[np.cumsum(edge[:-1]).astype(bool)]
    offsets = np.r_[0, np.cumsum(size)].astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])


def raw_lines(ranges: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """file_id, at, nth, charset, raw: the lines of each range; charset where a byte order mark tells it, and raw is then UTF-8."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with opened(row["file_id"]) as file:
                    data, codec = owned(file, row["length"], row["at"], row["at"] + range_bytes)
                if codec not in (None, "utf-8"):
                    data = data.decode(codec, "replace").encode("utf-8", "replace")
                found = split_lines(data)
                for a in range(0, len(found), 10_000):
                    part = found.slice(a, 10_000).cast(pa.binary())
                    n = len(part)
                    yield pa.RecordBatch.from_arrays([pa.array([row["file_id"]] * n), pa.array(np.full(n, row["at"])), pa.array(np.arange(a, a + n)), pa.array([codec] * n, pa.string()), part], names=["file_id", "at", "nth", "charset", "raw"])

    return ranges.select("file_id", "length", "at").mapInArrow(read, "file_id string, at long, nth long, charset string, raw binary")


def is_utf8(data: bytes) -> bool:
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def counted_lines(ranges: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """file_id, at, n, told, valid: how many lines each range owns, the charset that a byte order mark tells, and whether they are UTF-8; ranges without lines are left out. No line leaves its task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                with opened(row["file_id"]) as file:
                    data, codec = owned(file, row["length"], row["at"], row["at"] + range_bytes)
                valid = codec not in (None, "utf-8") or is_utf8(data)
                if codec not in (None, "utf-8"):
                    data = data.decode(codec, "replace").encode("utf-8", "replace")
                if data:
                    rows.append((row["file_id"], row["at"], 1 + int(np.count_nonzero(line_starts(np.frombuffer(data, np.uint8)))), codec, valid))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["file_id", "at", "n", "told", "valid"])

    return ranges.select("file_id", "length", "at").mapInArrow(count, "file_id string, at long, n long, told string, valid boolean")


def surveyed(counted: DataFrame) -> DataFrame:
    """file_id, at, base, n, charset of counted_lines: each range's first line number and number of lines, and its file's charset."""
    file = Window.partitionBy("file_id")
    before = F.coalesce(F.sum("n").over(file.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    charset = F.coalesce(F.max("told").over(file), F.when(F.bool_and("valid").over(file), "utf-8").otherwise("iso-8859-1"))
    return counted.select("file_id", "at", before.alias("base"), "n", charset.alias("charset"))


def charsets(spark: SparkSession, path: str | list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """file_id, charset, lines: by the byte order mark, else UTF-8 where all of the file is valid, else Latin-1."""
    found = surveyed(counted_lines(byte_ranges(spark, path, range_bytes), range_bytes))
    return found.groupBy("file_id").agg(F.max("charset").alias("charset"), F.sum("n").alias("lines"))


def numbered_lines(spark: SparkSession, path: str | list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """file_id, row_no (from 0), line of every line, blank ones too, in the charset that charsets() tells.

    The files are read twice: for the counts, then for the lines. A file
    without content gives no rows; a line may be of any length. Counts are a
    row a range; they are written once and sent to the lines, which stay where
    they were read.
    """
    ranges = byte_ranges(spark, path, range_bytes)
    raw = raw_lines(ranges, range_bytes)
    found = saved(surveyed(counted_lines(ranges, range_bytes)), "ranges").select("file_id", "at", "base", (F.col("charset") == "iso-8859-1").alias("latin"))
    line = F.when(F.col("latin"), F.expr("decode(raw, 'ISO-8859-1')")).otherwise(F.expr("decode(raw, 'UTF-8')"))
    return raw.join(F.broadcast(found), ["file_id", "at"]).select("file_id", (F.col("base") + F.col("nth")).alias("row_no"), line.alias("line"))
