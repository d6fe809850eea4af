"""Line dedup over levelled sorted runs of line hashes.

Documents arrive in batches. A batch's lines are reduced to runs: sorted tables of (128-bit line
hash, number of documents). Runs live in levels; when a level holds ``FAN_IN`` runs they are merged
into one run of the next level. A new batch is merge-anti-joined with the runs so far: keys that
already reached the limit are settled and add nothing, all others are written as a new level-0 run.
At the end the runs are merged once more and every line whose key reached the limit goes.

A line's key is the line without white space (``\\x20\\x09-\\x0D``) at both ends and with A-Z lower-cased.
Only built-in DataFrame functions are used. The count of a key is pre-aggregated before each
shuffle, so a line that occurs everywhere is a handful of rows. The lines are written once, in a folder
for each batch. The keys that go are written too, and broadcast to the lines when they are few enough
(``BROADCAST_ROWS``); beyond that both sides of a plain sort-merge join are read from files, so that
adaptive execution splits the rows of a hot line.

Defined cases: a null or empty text is one empty line; empty keys never go; a document is identified
by its ``doc_id`` and text, so a repeated row counts once and every copy of it is treated alike; an
empty table gives an empty result; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.session import forget, materialize

#: Batches a whole table is fed in, and runs of one level that are compacted into the next.
BATCHES = 4
FAN_IN = 2
#: Up to this many keys that go (16 bytes each) are broadcast.
BROADCAST_ROWS = 200_000
_BLANK = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    stripped = F.trim(line, F.lit(_BLANK))
    return F.translate(stripped, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _lines(docs: DataFrame) -> DataFrame:
    """One row per non-empty line: document (``_id``, ``_tx``), position, the key's two hashes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("_id"), F.xxhash64(text).alias("_tx"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    rows = rows.select("_id", "_tx", "pos", line_key(F.col("line")).alias("key")).where("key <> ''")
    return rows.select("_id", "_tx", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), F.col("key")).alias("h2"))


class LineRuns:
    """Levelled runs of line counts; ``add`` feeds a batch, ``frequent`` merges all levels."""

    def __init__(self, min_docs: int):
        self.min_docs = min_docs
        self.levels: list[list[DataFrame]] = []

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for r in runs[1:]:
            out = out.unionByName(r)
        return out.groupBy("h1", "h2").agg(F.sum("n").alias("n"))

    def _sorted_run(self, df: DataFrame, name: str) -> DataFrame:
        return materialize(df.sortWithinPartitions("h1", "h2"), name)

    def add(self, lines: DataFrame) -> None:
        """Add a batch of rows (``_id``, ``_tx``, ``h1``, ``h2``) whose documents are in no other batch."""
        counts = lines.select("_id", "_tx", "h1", "h2").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
        for runs in self.levels:
            for run in runs:
                settled = run.where(F.col("n") >= self.min_docs).select("h1", "h2")
                counts = counts.join(settled.hint("merge"), ["h1", "h2"], "left_anti")
        self._place(self._sorted_run(counts, "run0"), 0)

    def _place(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= FAN_IN:
            old, self.levels[level] = self.levels[level], []
            self._place(self._sorted_run(self._merged(old), f"run{level + 1}"), level + 1)
            for r in old:
                forget(r)

    def forget(self) -> None:
        """Delete all runs."""
        for level in self.levels:
            for run in level:
                forget(run)
        self.levels = []

    def frequent(self) -> DataFrame:
        runs = [r for level in self.levels for r in level]
        return self._merged(runs).where(F.col("n") >= self.min_docs).select("h1", "h2")


def _without(lines: Column, gone: Column) -> Column:
    """Lines but those at the ascending positions ``gone``: the stretches between them, put together."""
    first = lambda i: F.when(i == 0, 0).otherwise(F.get(gone, i - 1) + 1)
    past = lambda i: F.coalesce(F.get(gone, i), F.size(lines))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda i: F.slice(lines, first(i) + 1, past(i) - first(i))))


def dedup_lines(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """``docs`` with repeated lines gone from ``text``, plus ``n_lines`` and ``n_dropped``."""
    batch = F.pmod(F.xxhash64("_id", "_tx"), F.lit(BATCHES)).cast("int")
    lines = materialize(_lines(docs).withColumn("batch", batch), "lines", "batch")
    runs = LineRuns(min_docs)
    for b in range(BATCHES):
        runs.add(lines.where(F.col("batch") == b))
    frequent = materialize(runs.frequent(), "frequent")
    runs.forget()
    few = frequent.count() <= BROADCAST_ROWS
    gone = lines.join(F.broadcast(frequent) if few else frequent.hint("merge"), ["h1", "h2"], "left_semi")
    gone = gone.groupBy("_id", "_tx").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    # a row's own columns travel in one struct, so that no name of theirs meets one of these
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col("doc_id").alias("id"), text.alias("whole"), F.xxhash64(text).alias("key"))
    out = named.join(gone, named["id"].eqNullSafe(gone["_id"]) & (named["key"] == gone["_tx"]), "left")
    out = out.select("row", "whole", "at", F.split("whole", "\n", -1).alias("lines"))
    left = F.when(F.col("at").isNull(), F.col("whole")).otherwise(F.array_join(_without(F.col("lines"), F.col("at")), "\n"))
    return out.select(
        *[left.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in kept],
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("at").isNull(), 0).otherwise(F.size("at")).cast("long").alias("n_dropped"),
    )
