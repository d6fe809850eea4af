"""Which files can hold a literal, told from a stored filter of each file instead of the file.

A row for each piece of a file holds a bit for every four neighbouring bytes of its lines in lower case (as
many bits as a quarter of the bytes, at most 2 ** ``MOST_BITS``). A literal of four or more bytes can only be
where all its bits are set. Rows are keyed by path, size and time: ``renew`` reads new and changed files alone,
and a row of an older state of a file is never asked. The test itself is Spark columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.sources import ranges
from colloquy.sources.versions import Versions

LEAST_BITS, MOST_BITS = 12, 24
#: Bytes of a gram, the multiplier of its hash, and grams of a literal that are tested.
GRAM, FACTOR, TESTED = 4, 2654435761, 32
#: Parts of the table from which it is written anew as one.
PARTS = 8
FILTER = "path string, mtime long, size long, start long, k int, odd boolean, bits binary"


def _grams(block: bytes) -> np.ndarray:
    """Hashes of all neighbouring bytes, in 32 bits."""
    b = np.frombuffer(block, np.uint8).astype(np.uint32)
    if len(b) < GRAM:
        return np.zeros(0, np.uint32)
    return (b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24) * np.uint32(FACTOR)


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in batch.to_pylist():
            k = min(MOST_BITS, max(LEAST_BITS, (piece["stop"] - piece["start"]).bit_length() - 2))
            bits, odd = np.zeros(1 << k, bool), False
            try:
                for _, block in ranges.stretches(piece["path"], piece["start"], piece["stop"]):
                    odd = odd or ranges.ODD.search(block) is not None
                    bits[_grams(block.lower()) >> np.uint32(32 - k)] = True
            except OSError:
                continue  # without a filter it is read whenever it can be
            row = piece | {"k": k, "odd": odd, "bits": np.packbits(bits, bitorder="little").tobytes()}
            names = ["path", "mtime", "size", "start", "k", "odd", "bits"]
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([row[n]], t) for n, t in zip(names, types, strict=True)], names)


def _holds(needle: bytes) -> Column:
    """Whether all bits of a needle are set in ``bits``."""
    keep = F.lit(True)
    for h in sorted(set(_grams(needle).tolist()))[:TESTED]:
        at = f"shiftright(cast({h} as bigint), 32 - k)"
        byte = f"cast(conv(hex(substring(bits, cast(shiftright({at}, 3) as int) + 1, 1)), 16, 10) as int)"
        keep = keep & F.expr(f"(shiftright({byte}, cast({at} & 7 as int)) & 1) = 1")
    return keep


class Filters:
    """A table of filters under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.versions = spark, Versions(spark, root)

    def _rows(self, state: dict) -> DataFrame:
        parts = [self.versions.data(name) for name in state.get("parts", {})]
        return self.spark.read.schema(FILTER).parquet(*parts) if parts else self.spark.createDataFrame([], FILTER)

    def renew(self, files: DataFrame) -> int:
        """Add filters of the files (``path``, ``mtime``, ``size``) that have none as they are now; how many were read."""
        key = ["path", "mtime", "size"]

        def step(base: int, state: dict) -> dict | None:
            nonlocal read
            known = self._rows(state)
            new = files.where("size > 0").join(known.select(*key).distinct(), key, "left_anti")
            read = new.count()
            if not read:
                return None
            name = self.versions.folder("filters")
            ranges.pieces(new).select("path", "mtime", "size", "start", "stop").mapInArrow(_filters, FILTER).write.parquet(self.versions.data(name))
            parts = state.get("parts", {}) | {name: read}
            if len(parts) > PARTS:  # once and again, without the rows of files that are gone or have changed
                whole = self.versions.folder("filters")
                self._rows({"parts": parts}).join(files.select(*key), key, "left_semi").coalesce(PARTS).write.parquet(self.versions.data(whole))
                parts = {whole: sum(parts.values())}
            return state | {"parts": parts}

        read = 0
        self.versions.change(step)
        return read

    def candidates(self, files: DataFrame, needle: bytes | None) -> DataFrame:
        """Those of ``files`` that can hold a needle, and all whose filter isn't there."""
        if needle is None or len(needle) < GRAM:
            return files
        key = ["path", "mtime", "size"]
        known = self._rows(self.versions.read()[1])
        may = known.groupBy(*key).agg(F.max(F.col("odd") | _holds(needle)).alias("_may"))
        return files.join(may, key, "left").where(F.coalesce("_may", F.lit(True))).select(files.columns)
