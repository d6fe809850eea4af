"""Folds over turn rows: numbering, compaction, session rollups, deduplicating and upserting writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_turns(rows: DataFrame, last_seq: DataFrame | None = None, order: str = "pos") -> DataFrame:
    """Continue each session's numbering (``seq``) after the largest number it already has."""
    rn = F.row_number().over(Window.partitionBy("session_id").orderBy(order)).cast("long")
    if last_seq is None:
        return rows.withColumn("seq", rn)
    known = last_seq.groupBy("session_id").agg(F.max("seq").alias("_last"))
    return rows.join(known, "session_id", "left").withColumn("seq", rn + F.coalesce("_last", F.lit(0))).drop("_last")


def boundaries(lines: DataFrame, is_turn: Column, is_marker: Column, anchor: Column | None = None) -> DataFrame:
    """Compaction boundaries of files: the turns seen before a marker, and the anchor it names if any."""
    before = F.sum(is_turn.cast("long")).over(Window.partitionBy("session_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    marked = lines.withColumns({"at": F.coalesce(before, F.lit(0)), "anchor": F.lit(None).cast("string") if anchor is None else anchor})
    return marked.where(is_marker).select("session_id", "at", "anchor")


def compact(turns: DataFrame, marks: DataFrame, tracks: Column | bool = True) -> DataFrame:
    """``surface`` of every turn: superseded before the widest boundary, else current; unknown without tracking.

    A positional mark supersedes the first ``at`` turns, an anchored one the turns before its anchor;
    an anchor that is no turn supersedes nothing. It is derived on read, so late marks need no update.
    """
    anchored = marks.where(F.col("anchor").isNotNull())
    first = turns.where(F.col("uuid").isNotNull()).groupBy("session_id", F.col("uuid").alias("anchor")).agg(F.min("seq").alias("cut"))
    cuts = anchored.join(first, ["session_id", "anchor"]).select("session_id", "cut")
    cuts = cuts.unionByName(marks.where(F.col("anchor").isNull()).select("session_id", (F.col("at") + 1).alias("cut")))
    widest = cuts.groupBy("session_id").agg(F.max("cut").alias("_cut"))
    state = F.when(F.col("seq") < F.col("_cut"), "superseded").otherwise("current")
    tracks = F.lit(tracks) if isinstance(tracks, bool) else tracks
    return turns.join(widest, "session_id", "left").withColumn("surface", F.when(tracks, state).otherwise("unknown")).drop("_cut")


def rollup(turns: DataFrame) -> DataFrame:
    """Per session: first and last known time in order, latest time, and the number of turns."""
    known = F.col("ts").isNotNull()
    return turns.groupBy("session_id").agg(
        F.min_by(F.when(known, F.col("ts")), F.when(known, F.col("seq"))).alias("started_at"),
        F.max_by(F.when(known, F.col("ts")), F.when(known, F.col("seq"))).alias("last_turn_at"),
        F.max("ts").alias("max_ts"),
        F.count(F.lit(1)).alias("turn_count"),
    )


def stated_titles(lines: DataFrame) -> DataFrame:
    """The last title each source states for a session; a blank one clears it."""
    last = lambda source: F.trim(F.max_by(F.when(F.col("source") == source, F.col("title")), F.when(F.col("source") == source, F.col("pos"))))
    blank = lambda c: F.when(c != "", c)
    return lines.groupBy("session_id").agg(last("user").alias("u"), last("ai").alias("a")).select("session_id", blank(F.col("u")).alias("title_user"), blank(F.col("a")).alias("title_ai"))


def push(existing: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of a pushed batch to insert, and its outcome (inserted, skipped, unkeyed).

    A row whose (session, uuid) exists, or came earlier in the batch, is skipped; rows without a
    uuid are always inserted and counted apart.
    """
    keyed = batch.where(F.col("uuid").isNotNull())
    once = keyed.withColumn("_rn", F.row_number().over(Window.partitionBy("session_id", "uuid").orderBy("pos"))).where("_rn = 1").drop("_rn")
    have = existing.where(F.col("uuid").isNotNull()).select("session_id", "uuid").distinct()
    new = once.join(have, ["session_id", "uuid"], "left_anti").select(batch.columns).unionByName(batch.where(F.col("uuid").isNull()))
    total = batch.agg(F.count(F.lit(1)).alias("total"))
    done = new.agg(F.count(F.lit(1)).alias("inserted"), F.coalesce(F.sum(F.col("uuid").isNull().cast("long")), F.lit(0)).alias("unkeyed"))
    outcome = total.crossJoin(done).select("inserted", (F.col("total") - F.col("inserted")).alias("skipped"), "unkeyed")
    return new, outcome


def upsert_sessions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Merge session rows: place and stated titles take the new value if known, derived titles stay, paths are replaced."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col("o.session_id") == F.col("n.session_id"), "full_outer")
    newer = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
    older = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c)
    path = F.when(F.col("n.session_id").isNotNull(), F.col("n.source_path")).otherwise(F.col("o.source_path")).alias("source_path")
    return both.select(older("session_id"), newer("cwd"), newer("title_user"), newer("title_ai"), older("title_derived"), path, older("started_at"))


def archive(sessions: DataFrame, turns: DataFrame, cutoff: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Split into archived and kept sessions and turns: archived when last active before the cutoff."""
    old = sessions.where(F.col("last_turn_at") < cutoff)
    keys = old.select("session_id")
    return old, sessions.join(keys, "session_id", "left_anti"), turns.join(keys, "session_id", "left_semi"), turns.join(keys, "session_id", "left_anti")


def reindex(turns: DataFrame, reread: DataFrame, present: DataFrame) -> DataFrame:
    """Turns after re-reading the sessions whose file is present; all others keep their rows."""
    return turns.join(present.select("session_id"), "session_id", "left_anti").unionByName(reread.join(present.select("session_id"), "session_id", "left_semi"))
