"""Lines of large files, read by byte ranges in the tasks that need them.

Files are cut into pieces of ``PIECE_BYTES``; a line belongs to the piece in which it starts, and its place
is its byte offset, so nothing is numbered, sorted or shuffled afterwards. What travels is the list of pieces.
A last line without line feed is still being written and is left out, a line that isn't UTF-8 is dropped.

Tasks open files by themselves: local or mounted ones, and whatever Arrow's file systems reach (``reachable``
tells). A file that can't be opened or read to its end is skipped and noted in ``Failures``, which the driver
can read once the rows have been made.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import AccumulatorParam, SparkContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE_BYTES = 64 << 20
READ_BYTES = 4 << 20
#: Pieces that one task aims at, in bytes.
TASK_BYTES = 128 << 20
LINES = "path string, mtime long, pos long, value string"
#: A byte order mark, which is no part of a file's first line.
MARK = b"\xef\xbb\xbf"
#: Characters that aren't ASCII but have ASCII in their lower case, and escapes that JSON may write ASCII with.
ODD = re.compile(rb"\xe2\x84\xaa|\xc4\xb0|\\u(?:00[2-7]|212a|0130)", re.IGNORECASE)


class _Union(AccumulatorParam):
    def zero(self, value: frozenset) -> frozenset:
        return frozenset()

    def addInPlace(self, value1: frozenset, value2: frozenset) -> frozenset:
        return value1 | value2


class Failures:
    """Paths that tasks could not read; a task that is run twice adds nothing."""

    def __init__(self, sc: SparkContext):
        self._paths = sc.accumulator(frozenset(), _Union())

    def add(self, path: str) -> None:
        self._paths.add(frozenset([path]))

    @property
    def paths(self) -> frozenset:
        return self._paths.value


def _local(path: str) -> str | None:
    plain = re.sub(r"^file:(//)?(?=/)", "", path)
    return None if re.match(r"^\w[\w+.-]+:", plain) else plain


def opened(path: str):
    """A file to read and seek in."""
    if (plain := _local(path)) is not None:
        return open(plain, "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def reachable(root: str) -> bool:
    """Whether tasks can open files below ``root`` without Hadoop."""
    if _local(root) is not None:
        return True
    from pyarrow import fs

    try:
        fs.FileSystem.from_uri(root)
    except (OSError, ValueError, pa.ArrowException):
        return False
    return True


def pieces(files: DataFrame) -> DataFrame:
    """``path``, ``mtime``, ``size``, ``start``, ``stop`` of the pieces of files, dealt evenly over tasks."""
    sc = files.sparkSession.sparkContext
    total = files.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    cuts = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(PIECE_BYTES).cast("long"))
    rows = files.where("size > 0").select("path", "mtime", "size", F.explode(cuts).alias("start"))
    rows = rows.withColumn("stop", F.least(F.col("start") + PIECE_BYTES, F.col("size")))
    return rows.repartition(max(2 * sc.defaultParallelism, -(-total // TASK_BYTES)))


def stretches(path: str, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(offset, complete lines) of one piece, a few megabytes at a time; longer where a line is."""
    with opened(path) as f:
        at = max(0, start - 1)
        f.seek(at)
        skip, parts, done = start > 0, [], False
        while not done and (chunk := f.read(READ_BYTES)):
            cut = chunk.rfind(b"\n") + 1
            if not cut:
                parts.append(chunk)
                continue
            block = b"".join([*parts, chunk[:cut]])
            parts = [chunk[cut:]]
            if skip:  # what began before this piece
                first = block.find(b"\n") + 1
                at, block, skip = at + first, block[first:], False
            if at >= stop:
                return
            if at + len(block) >= stop:
                block, done = block[: block.find(b"\n", stop - 1 - at) + 1], True
            yield at, block
            at += len(block)


def _utf8(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


def rows(path: str, mtime: int, at: int, block: bytes) -> pa.RecordBatch:
    """The lines of a stretch that are UTF-8 and not blank."""
    raw = block[:-1].split(b"\n")
    pos = at + np.cumsum([0, *(len(x) + 1 for x in raw[:-1])])
    if at == 0:
        raw[0] = raw[0].removeprefix(MARK)
    keep = [i for i, x in enumerate(raw) if x.strip()]
    try:
        value = pa.array([raw[i] for i in keep], pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        keep = [i for i in keep if _utf8(raw[i])]
        value = pa.array([raw[i] for i in keep], pa.binary()).cast(pa.string())
    n = len(keep)
    return pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(np.full(n, mtime, np.int64)), pa.array(pos[keep].astype(np.int64)), value], ["path", "mtime", "pos", "value"])


def _each(batches: Iterator[pa.RecordBatch], failures: Failures | None) -> Iterator[tuple[dict, int, bytes]]:
    for batch in batches:
        for piece in batch.to_pylist():
            try:
                for at, block in stretches(piece["path"], piece["start"], piece["stop"]):
                    yield piece, at, block
            except OSError:
                if failures is not None:
                    failures.add(piece["path"])


def lines(files: DataFrame, failures: Failures | None = None) -> DataFrame:
    """Complete lines of ``files`` (``path``, ``mtime``, ``size``): ``path``, ``mtime``, ``pos``, ``value``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, at, block in _each(batches, failures):
            yield rows(piece["path"], piece["mtime"], at, block)

    return pieces(files).mapInArrow(read, LINES)


def plain_needle(query: str) -> bytes | None:
    """The bytes by which a literal is known in raw JSON lines in lower case; None if it may be written in several ways."""
    if not query or re.search(r'[^\x20-\x7e]|["\\/]', query):
        return None
    return query.lower().encode()


def may_hold(block: bytes, needle: bytes) -> bool:
    """Whether raw lines can hold a needle: they have its bytes, or characters or escapes that can stand for some."""
    return needle in block.lower() or ((b"\\u" in block.lower() or not block.isascii()) and ODD.search(block) is not None)


def holding(files: DataFrame, needle: bytes, failures: Failures | None = None) -> DataFrame:
    """Those of ``files`` whose raw bytes can hold a needle; a piece is read up to its first find, and no line is parsed."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for piece in batch.to_pylist():
                try:
                    if piece["path"] not in found and any(may_hold(block, needle) for _, block in stretches(piece["path"], piece["start"], piece["stop"])):
                        found.add(piece["path"])
                except OSError:
                    if failures is not None:
                        failures.add(piece["path"])
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["path"])

    return files.join(pieces(files).mapInArrow(look, "path string").distinct(), "path", "left_semi")
