"""A streaming source of growing JSONL files: complete lines appended since the last batch.

Spark's file source reads a file once; transcripts grow. The offset of this source is the number of
complete bytes (up to the last line feed) of every file by inode, so a restart resumes where the
checkpoint says, a torn last line is neither delivered nor counted, and a renamed file isn't read again.
Files are seen through the machine's file system (local or mounted by every executor); what was appended is
read by byte ranges, so a large file is no single task's.
"""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from colloquy.sources import ranges

SCHEMA = "path string, mtime long, pos long, value string"


def complete_bytes(path: str, size: int, known: int) -> int:
    """Where the last complete line of a file ends, looking back from its end."""
    step = 1 << 16
    with open(path, "rb") as f:
        at = size
        while at > known:
            low = max(known, at - step)
            f.seek(low)
            cut = f.read(at - low).rfind(b"\n")
            if cut >= 0:
                return low + cut + 1
            at = low
    return known


class Piece(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class AppendedReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.seen = options["path"], {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        found, there = dict(self.seen), set()
        for path in sorted(Path(self.root).rglob("*.jsonl")):
            try:
                stat = os.stat(path)
                key = str(stat.st_ino)
                known = found.get(key, ["", 0])[1]
                if stat.st_size < known:  # written anew under the same inode
                    known = 0
                    found[key] = [str(path), 0]
                if stat.st_size > known:
                    found[key] = [str(path), complete_bytes(str(path), stat.st_size, known)]
                there.add(key)
            except OSError:  # gone meanwhile; it is looked at again in the next batch
                continue
        # files that are gone need no offset any more
        self.seen = {k: v for k, v in found.items() if k in there}
        return self.seen

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        out = []
        for k, (path, stop) in end.items():
            known = start.get(k, ["", 0])[1]
            low = 0 if stop < known else known
            out += [Piece(path, at, min(stop, at + ranges.PIECE_BYTES)) for at in range(low, stop, ranges.PIECE_BYTES)]
        return out

    def read(self, piece: Piece):
        """Lines of one piece, as Arrow batches; a file that went since the batch was planned has none any more."""
        try:
            mtime = int(os.stat(piece.path).st_mtime * 1000)
            for at, block in ranges.stretches(piece.path, piece.start, piece.stop):
                yield ranges.rows(piece.path, mtime, at, block)
        except OSError:
            return


class Appended(DataSource):
    """``spark.readStream.format("appended_jsonl").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "appended_jsonl"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> AppendedReader:
        return AppendedReader(self.options)


def watch(rows, write, checkpoint: str, every: str = "250 milliseconds"):
    """Start a stream that hands every batch of appended lines to ``write``.

    Each batch lists the folder anew, so nothing depends on notices that may get lost; a batch that
    fails is run again from its checkpoint when the stream is started again.
    """
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def lines(spark, folder: str):
    """The stream of appended lines, in the columns the transcript parser takes."""
    spark.dataSource.register(Appended)
    return spark.readStream.format("appended_jsonl").option("path", folder).load()
