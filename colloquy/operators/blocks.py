"""Postings in blocks that carry bounds, so that a search for the best few reads only blocks that can hold one.

A block has up to ``ENTRIES`` turns of one token, with their positions by column. The turns of a token are
ordered by falling count of the token, then by length, and cut: so a block's greatest count and least length
bound the rank of all in it closely, whatever the mean length grows to. Blocks are dealt by range over token,
count and length, so a common token is spread over as many files as it fills. ``files`` names the first and
last token of each file; a search opens no other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import fts

ENTRIES = 128
#: Entries that a file aims at; blocks of a page, the least that a reader can skip.
FILE_ENTRIES = 2_000_000
PAGE_BLOCKS = 16
ENTRY = "struct<session_id:string,seq:bigint,length:bigint,tf:int,plain:int,text:array<int>,thinking:array<int>,tool_calls:array<int>>"
BLOCK = f"token string, n int, n_plain int, max_tf int, max_plain int, min_length long, entries array<{ENTRY}>"
_ENTRIES = "token string, session_id string, seq long, length long, text array<int>, thinking array<int>, tool_calls array<int>, tf int, plain int"
#: Tokens that are put in order at once, but for a longer turn.
BATCH_TOKENS = 1 << 20
#: Counts of a token that are told apart when blocks are skipped by count and length.
CLASSES = 16


def _entered(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The entries of some turns: their tokens, put in order turn by turn."""
    row, pos, column, words = [], [], [], []
    for k, name in enumerate(fts.COLUMNS):
        size = pc.list_value_length(batch[name]).to_numpy(zero_copy_only=False).astype(np.int64)
        row.append(np.repeat(np.arange(len(size)), size))
        pos.append(np.arange(len(row[-1])) - np.repeat(np.cumsum(size) - size, size))
        column.append(np.full(len(row[-1]), k, np.int8))
        words.append(batch[name].flatten())
    known = pa.concat_arrays(words).dictionary_encode()
    row, pos, column, code = np.concatenate(row), np.concatenate(pos), np.concatenate(column), known.indices.to_numpy()
    key = row * max(1, len(known.dictionary)) + code
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    # by column and position within a token of a turn, as they were
    pos, column = pos[order].astype(np.int32), column[order]
    lists, many = [], []
    for k in range(len(fts.COLUMNS)):
        mine = column == k
        many.append(np.add.reduceat(mine, first, dtype=np.int32) if len(first) else np.zeros(0, np.int32))
        lists.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(many[-1])].astype(np.int32)), pa.array(pos[mine])))
    turn, tf = pa.array(row[order[first]]), sum(many)
    keys = [known.dictionary.take(pa.array(code[order[first]])), *[batch[c].take(turn) for c in ("session_id", "seq", "length")]]
    return pa.RecordBatch.from_arrays([*keys, *lists, pa.array(tf), pa.array(tf - many[fts.COLUMNS.index("thinking")])], [c.split()[0] for c in _ENTRIES.split(", ")])


def _enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        full = np.cumsum(batch["length"].to_numpy()) // BATCH_TOKENS
        cuts = np.r_[0, np.flatnonzero(np.diff(full)) + 1, len(full)]
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if high > low:
                yield _entered(batch.slice(low, high - low))


def entries(indexed: DataFrame) -> DataFrame:
    """One row for each token of each turn: positions by column, ``tf`` over all columns and ``plain`` without thinking.

    A turn has all its tokens in one row, so they are put together where they are, with no shuffle. Turns with
    an unknown column have no entries.
    """
    whole = indexed.where(" and ".join(f"{c} is not null" for c in (*fts.COLUMNS, "length")))
    rows = whole.select("session_id", F.col("seq").cast("long").alias("seq"), F.col("length").cast("long").alias("length"), *fts.COLUMNS)
    return rows.mapInArrow(_enter, _ENTRIES)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted entries as blocks, without moving a value: a block is a stretch of the batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        token, tf, plain, length = batch["token"], batch["tf"].to_numpy(), batch["plain"].to_numpy(), batch["length"].to_numpy()
        codes = token.dictionary_encode().indices.to_numpy()
        runs = np.r_[0, np.flatnonzero(np.diff(codes)) + 1, len(codes)]
        at = np.concatenate([np.arange(a, b, ENTRIES) for a, b in zip(runs[:-1], runs[1:], strict=True)])
        ends = np.r_[at, len(codes)].astype(np.int32)
        names = ["session_id", "seq", "length", "tf", "plain", *fts.COLUMNS]
        inner = pa.StructArray.from_arrays([batch[c] for c in names], names)
        columns = [token.take(pa.array(at)), np.diff(ends), np.add.reduceat(plain > 0, at, dtype=np.int32), np.maximum.reduceat(tf, at), np.maximum.reduceat(plain, at), np.minimum.reduceat(length, at)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.ListArray.from_arrays(pa.array(ends), inner)], ["token", "n", "n_plain", "max_tf", "max_plain", "min_length", "entries"])


def write(rows: DataFrame, folder: str, n_entries: int) -> None:
    """Blocks of ``entries`` under ``folder``: ``postings`` and ``files``."""
    spark = rows.sparkSession
    order = ["token", F.desc("tf"), F.asc("length"), "session_id", "seq"]
    parts = max(1, -(-n_entries // FILE_ENTRIES))
    rows = rows.select("token", "session_id", "seq", F.col("length").cast("long").alias("length"), "tf", "plain", *fts.COLUMNS)
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt.mapInArrow(_cut, BLOCK).write.option("parquet.page.row.count.limit", PAGE_BLOCKS).parquet(f"{folder}/postings")
    found = spark.read.schema(BLOCK).parquet(f"{folder}/postings").select(F.col("_metadata.file_name").alias("file"), "token")
    found.groupBy("file").agg(F.min("token").alias("first"), F.max("token").alias("last"), F.count(F.lit(1)).alias("blocks")).coalesce(1).write.parquet(f"{folder}/files")


def read(spark: SparkSession, folders: list[str], token: str) -> DataFrame:
    """Blocks of a token in the files that can hold it, with the name of their folder (``segment``)."""
    paths = []
    if folders:
        listed = spark.read.schema("file string, first string, last string, blocks long").parquet(*[f"{f}/files" for f in folders])
        segment = F.regexp_extract(F.col("_metadata.file_path"), "/([^/]+)/files/[^/]+$", 1)
        by_name = {f.rsplit("/", 1)[1]: f for f in folders}
        for r in listed.where((F.col("first") <= token) & (F.col("last") >= token)).select("file", segment.alias("segment")).collect():
            paths.append(f"{by_name[r.segment]}/postings/{r.file}")
    if not paths:
        return spark.createDataFrame([], BLOCK).withColumn("segment", F.lit(""))
    rows = spark.read.schema(BLOCK).parquet(*paths)
    return rows.select("*", F.regexp_extract(F.col("_metadata.file_path"), "/([^/]+)/postings/[^/]+$", 1).alias("segment")).where(F.col("token") == token)


def part(tf: Column, length: Column, mean: float) -> Column:
    """What a turn's rank is made of, but for the weight of the phrase: more with count, less with length."""
    return tf * (fts.K1 + 1) / (tf + fts.K1 * (1 - fts.B + fts.B * length / F.lit(mean)))


def reaching(least: float, mean: float, tf: str) -> Column:
    """Blocks that can hold a turn whose ``part`` is at least ``least``, by plain comparisons that a file's statistics answer."""
    keep = F.lit(False)
    least -= 1e-9
    for count in range(1, CLASSES + 1):
        if least <= 0:
            longest = math.inf
        else:
            longest = mean * ((count * ((fts.K1 + 1) / least - 1) / fts.K1 - (1 - fts.B)) / fts.B)
        if longest == math.inf:
            return F.col(tf) > 0
        if longest >= 0:
            keep = keep | ((F.col(tf) == count) & (F.col("min_length") <= int(longest) + 1))
    return keep | (F.col(tf) > CLASSES)
