"""A stored library of sessions: turns, session rows and their full-text index, kept in step by commits.

Every write adds one segment (turns, session rows, compaction marks, lengths, postings in blocks) and, where it
replaces sessions, one table of the sessions that older segments lose. Nothing that is written is ever
changed: a session is dead in a segment if a later commit deleted it. ``merge`` folds neighbouring segments
of like size into one and leaves their dead rows behind, so the number of segments grows with the logarithm
of the turns, and a turn is rewritten as often.

A commit is one small file (see ``sources.versions``). What is checked before it (counts of what was written,
sessions that came back empty) leaves the last version as it was when it fails. A commit may carry the number
of a stream's batch: a batch that is in the ledger is not written again.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from colloquy.operators import blocks, fold, fts
from colloquy.session import forget, materialize
from colloquy.sources.versions import Versions

#: Neighbouring segments of like size that are merged; sizes are alike within the same factor.
FAN = 4
#: Deleted sessions up to this many are broadcast, more are shuffled.
BROADCAST_ROWS = 100_000
#: Of session rows: values that a later segment replaces only if it knows them, and those of the first that stay.
NEWER = ("cwd", "title_user", "title_ai", "source_path", "last_turn_at")
OLDER = ("title_derived", "started_at")
MARKS = "session_id string, at long, anchor string"


def _back(k: int):
    return lambda pos: pos - k


class CheckFailed(RuntimeError):
    """A write that was not committed."""


class Snapshot:
    """The library at one version."""

    def __init__(self, spark: SparkSession, versions: Versions, version: int, state: dict):
        self.spark, self.versions, self.version = spark, versions, version
        self.segments: dict[str, dict] = state.get("segments", {})
        self.deletes: dict[str, dict] = state.get("deletes", {})
        self.ledger: dict[str, int] = state.get("ledger", {})

    @property
    def n(self) -> int:
        return sum(s["turns"] for s in self.segments.values())

    @property
    def mean(self) -> float | None:
        return sum(s["tokens"] for s in self.segments.values()) / self.n if self.n else None

    def _of(self, segment: Column, what: str) -> Column:
        pairs = [F.lit(x) for name, s in self.segments.items() for x in (name, s[what])]
        return F.create_map(*pairs)[segment]

    def alive(self, rows: DataFrame) -> DataFrame:
        """Rows (``session_id``, ``segment``) whose session no later commit deleted."""
        oldest = min((s["clean"] for s in self.segments.values()), default=0)
        late = {name: d for name, d in self.deletes.items() if d["version"] > oldest}
        if not late:
            return rows
        by = F.regexp_extract(F.col("_metadata.file_path"), "/([^/]+)/[^/]+$", 1)
        number = F.create_map(*[F.lit(x) for name, d in late.items() for x in (name, d["version"])])[by]
        gone = self.spark.read.schema("session_id string").parquet(*[self.versions.data(name) for name in late])
        gone = gone.select(F.col("session_id").alias("_gone"), number.alias("_at")).groupBy("_gone").agg(F.max("_at").alias("_at"))
        if sum(d["rows"] for d in late.values()) <= BROADCAST_ROWS:
            gone = F.broadcast(gone)
        return rows.join(gone, (F.col("session_id") == F.col("_gone")) & (F.col("_at") > self._of(F.col("segment"), "clean")), "left_anti")

    def table(self, name: str, only: list[str] | None = None) -> DataFrame | None:
        """Live rows of one table of all segments (or some) with ``segment``; columns that a segment lacks are null.

        None where no segment has the table.
        """
        held = [s for s in (self.segments if only is None else only) if name in self.segments[s]["tables"]]
        if not held:
            return None
        fields = {f.name: f for s in held for f in StructType.fromJson(self.segments[s]["tables"][name])}
        rows = self.spark.read.schema(StructType(list(fields.values()))).parquet(*[self.versions.data(s, name) for s in held])
        return self.alive(rows.select("*", F.regexp_extract(F.col("_metadata.file_path"), f"/([^/]+)/{name}/[^/]+$", 1).alias("segment")))

    def turns(self) -> DataFrame | None:
        rows = self.table("turns")
        return None if rows is None else rows.drop("segment")

    def marks(self) -> DataFrame:
        rows = self.table("marks")
        return self.spark.createDataFrame([], MARKS) if rows is None else rows.drop("segment")

    def surfaced(self, tracks: Column | bool = True) -> DataFrame:
        """Turns with their ``surface``, worked out on read from all marks."""
        return fold.compact(self.turns(), self.marks(), tracks)

    def sessions(self, only: list[str] | None = None) -> DataFrame | None:
        """One row for each live session, folded over its segments."""
        rows = self.table("sessions", only)
        if rows is None:
            return None
        rows = rows.withColumn("_order", self._of(F.col("segment"), "order"))
        known = lambda c: F.when(F.col(c).isNotNull(), F.col("_order"))
        folds = {"turn_count": lambda c: F.sum(c), "max_ts": lambda c: F.max(c), "mtime": lambda c: F.max(c)}
        folds |= {c: lambda c: F.max_by(c, known(c)) for c in NEWER} | {c: lambda c: F.min_by(c, known(c)) for c in OLDER}
        kept = [c for c in rows.columns if c not in ("session_id", "segment", "_order")]
        other = lambda c: F.max_by(c, known(c))
        return rows.groupBy("session_id").agg(*[folds.get(c, other)(c).alias(c) for c in kept])

    def index(self) -> Index:
        return Index(self)


class Index:
    """Phrase search and ranking over a snapshot's postings."""

    def __init__(self, snapshot: Snapshot):
        self.at, self.spark = snapshot, snapshot.spark

    @property
    def n(self) -> int:
        return self.at.n

    def blocks(self, token: str) -> DataFrame:
        return blocks.read(self.spark, [self.at.versions.data(s) for s in self.at.segments], token)

    def _turns_of(self, found: DataFrame, include_thinking: bool, *more: str) -> DataFrame:
        each = found.select("segment", F.explode("entries").alias("e"))
        rows = each.select("segment", "e.session_id", "e.seq", "e.length", F.col("e.tf" if include_thinking else "e.plain").cast("long").alias("tf"), *[f"e.{c}" for c in more])
        return rows.where("tf > 0")

    def phrase(self, phrase: list[str], include_thinking: bool = False) -> DataFrame:
        """(``session_id``, ``seq``, ``length``, ``tf``) of the live turns that hold the phrase in one column, by joining positions."""
        if len(phrase) == 1:
            return self.at.alive(self._turns_of(self.blocks(phrase[0]), include_thinking)).drop("segment")
        cols = [c for c in fts.COLUMNS if include_thinking or c != "thinking"]
        out = None
        for k, word in enumerate(phrase):
            rows = self._turns_of(self.blocks(word), include_thinking, *cols)
            starts = [F.transform(c, _back(k)).alias(f"{c}_{k}") for c in cols]
            if out is None:
                out = rows.select("segment", "session_id", "seq", "length", *starts)
                continue
            out = out.join(rows.select("segment", "session_id", "seq", *starts), ["segment", "session_id", "seq"])
            both = {c: F.array_intersect(f"{c}_0", f"{c}_{k}") for c in cols}
            out = out.withColumns({f"{c}_0": both[c] for c in cols}).drop(*[f"{c}_{k}" for c in cols])
            out = out.where(sum((F.size(f"{c}_0") for c in cols), F.lit(0)) > 0)
        tf = sum((F.size(f"{c}_0") for c in cols), F.lit(0)).cast("long")
        return self.at.alive(out.select("segment", "session_id", "seq", "length", tf.alias("tf"))).drop("segment")

    def frequency(self, token: str, include_thinking: bool = False) -> int:
        """Live turns that hold a token: from the blocks' counts, entry by entry only while deleted sessions are still in segments."""
        found = self.blocks(token)
        oldest = min((s["clean"] for s in self.at.segments.values()), default=0)
        if any(d["version"] > oldest for d in self.at.deletes.values()):
            return self.at.alive(self._turns_of(found, include_thinking)).count()
        return int(found.agg(F.coalesce(F.sum("n" if include_thinking else "n_plain"), F.lit(0))).first()[0])

    def search(self, phrase: list[str], include_thinking: bool = False) -> DataFrame:
        """All turns with the whole phrase and their ``rank``, lower is better."""
        if not phrase or not self.n:
            return self.spark.createDataFrame([], "session_id string, seq long, tf long, rank double")
        hits = self.phrase(phrase, include_thinking)
        df = self.frequency(phrase[0], include_thinking) if len(phrase) == 1 else hits.count()
        return fts.ranked(hits, self.n, df, self.at.mean)

    def needed(self, token: str, k: int, include_thinking: bool = False, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """The blocks of a token that can hold one of its ``k`` best turns, of those that ``keep`` lets pass.

        Blocks are looked at from the highest bound down, in growing numbers, until k turns are found; the
        kth best of these is what a block's bound must reach.
        """
        found, tf, mean = self.blocks(token), "max_tf" if include_thinking else "max_plain", self.at.mean
        bound = blocks.part(F.col(tf), F.col("min_length"), mean)
        wanted = 2 + k // blocks.ENTRIES
        while True:
            # bounds alone: no entry is read for this
            seen, least = found.where(F.col(tf) > 0).select(bound.alias("bound")).orderBy(F.desc("bound")).limit(wanted).agg(F.count(F.lit(1)), F.min("bound")).first()
            if not seen:
                return found.where(F.lit(False))
            some = found.where(blocks.reaching(least, mean, tf) & (bound >= least))
            hits = self.at.alive(self._turns_of(some, include_thinking))
            hits = keep(hits) if keep else hits
            best = hits.select(blocks.part(F.col("tf"), F.col("length"), mean).alias("part")).orderBy(F.desc("part")).limit(k)
            have, kth = best.agg(F.count(F.lit(1)), F.min("part")).first()
            if have == k:
                return found.where(blocks.reaching(kth, mean, tf) & (bound >= F.lit(kth) - 1e-9))
            if seen < wanted:
                return found
            wanted *= 8

    def top_k(self, phrase: list[str], k: int, include_thinking: bool = False, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """The ``k`` best hits among those that ``keep`` (a filter on session_id and seq) lets pass.

        A single word skips the blocks that can't hold one. A phrase's weight needs the number of turns that
        hold all of it, so its hits are all found first.
        """
        if len(phrase) == 1 and self.n:
            hits = self.at.alive(self._turns_of(self.needed(phrase[0], k, include_thinking, keep), include_thinking)).drop("segment")
            hits = fts.ranked(hits, self.n, self.frequency(phrase[0], include_thinking), self.at.mean)
        else:
            hits = self.search(phrase, include_thinking)
        return fts.top_k(keep(hits) if keep else hits, k)


class Library:
    """A library under ``root``: writes, deletions and merges, each one commit."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.versions = spark, Versions(spark, root)

    def snapshot(self, version: int | None = None) -> Snapshot:
        return Snapshot(self.spark, self.versions, *self.versions.read(version))

    def _segment(self, turns: DataFrame, sessions: DataFrame | None, marks: DataFrame | None, rows: DataFrame | None = None) -> tuple[str, dict]:
        """Write one segment; ``rows`` may hold the postings' entries if they are known."""
        name = self.versions.folder("segment")
        at = lambda table: self.versions.data(name, table)
        # sorted where they are, so that a session's row groups are told by their statistics; nothing is worked out twice
        turns.sortWithinPartitions("session_id", "seq").write.parquet(at("turns"))
        stored = self.spark.read.parquet(at("turns"))
        indexed = materialize(fts.index(stored), "tokens")
        tables = {"turns": stored.schema.jsonValue()}
        for table, frame in (("sessions", sessions), ("marks", marks), ("lengths", indexed.select("session_id", "seq", "length"))):
            if frame is not None:
                frame.write.parquet(at(table))
                tables[table] = frame.schema.jsonValue()
        n, tokens = indexed.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        n_sessions = self.spark.read.parquet(at("sessions")).count() if sessions is not None else 0
        blocks.write(blocks.entries(indexed) if rows is None else rows, self.versions.data(name), tokens)
        forget(indexed)
        return name, {"turns": n, "tokens": tokens, "rows": n, "session_rows": n_sessions, "tables": tables}

    def _bury(self, base: int, state: dict, ids: str, n_ids: int) -> DataFrame:
        """Enter deleted sessions into ``state`` and take their live turns off the segments' counts; what they had, by session."""
        now = Snapshot(self.spark, self.versions, base, state)
        lengths = now.table("lengths")
        gone = self.spark.read.schema("session_id string").parquet(self.versions.data(ids))
        if lengths is not None:
            side = F.broadcast(gone) if n_ids <= BROADCAST_ROWS else gone
            dead = lengths.join(side, "session_id", "left_semi")
            for r in dead.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("tokens")).collect():
                state["segments"][r.segment]["turns"] -= r.n
                state["segments"][r.segment]["tokens"] -= r.tokens
            dead = dead.select("session_id").distinct()
        else:
            dead = gone.where(F.lit(False))
        state.setdefault("deletes", {})[ids] = {"version": base + 1, "rows": n_ids}
        return dead

    def _ids(self, ids: DataFrame) -> tuple[str, int]:
        name = self.versions.folder("deleted")
        ids.select("session_id").where(F.col("session_id").isNotNull()).distinct().write.parquet(self.versions.data(name))
        return name, self.spark.read.parquet(self.versions.data(name)).count()

    def write(self, turns: DataFrame, sessions: DataFrame | None = None, marks: DataFrame | None = None, *, replace: bool | DataFrame = True, reread: DataFrame | None = None, batch: tuple[str, int] | None = None, expect: int | None = None) -> int:
        """Commit turns (``session_id``, ``seq``, ``text``, ``thinking``, ``tool_calls``, and any more) and return the version.

        With ``replace`` the sessions of these turns, and those of ``reread``, lose what they had; a session
        of ``reread`` that had turns and has none now fails the write. Without it the turns are added; a table
        of sessions names those that lose what they had.
        ``batch`` names a stream and its batch; one that is in the ledger is left out. ``expect`` is the
        number of turns that must have been written.
        """
        if batch is not None and self.snapshot().ledger.get(batch[0], -1) >= batch[1]:
            return self.snapshot().version
        name, segment = self._segment(turns, sessions, marks)
        if expect is not None and segment["rows"] != expect:
            raise CheckFailed(f"{segment['rows']} turns were written, {expect} were to be")
        own = self.spark.read.parquet(self.versions.data(name, "turns")).select("session_id")
        ids = None
        if isinstance(replace, DataFrame):
            ids = self._ids(replace)
        elif replace:
            ids = self._ids(own if reread is None else own.unionByName(reread.select("session_id")))

        def step(base: int, state: dict) -> dict | None:
            if batch is not None:
                if state.setdefault("ledger", {}).get(batch[0], -1) >= batch[1]:
                    return None
                state["ledger"][batch[0]] = batch[1]
            if ids is not None and ids[1]:
                dead = self._bury(base, state, *ids)
                if reread is not None:
                    emptied = [r.session_id for r in dead.join(reread.select("session_id"), "session_id", "left_semi").join(own, "session_id", "left_anti").limit(3).collect()]
                    if emptied:
                        raise CheckFailed(f"sessions came back empty: {', '.join(emptied)}")
            state.setdefault("segments", {})[name] = segment | {"order": base + 1, "clean": base + 1}
            return self._tidy(state)

        return self.versions.change(step)

    def delete(self, ids: DataFrame, expect: int | None = None) -> int:
        """Commit the deletion of sessions; ``expect`` is the number of turns that must go with them."""
        name, n = self._ids(ids)

        def step(base: int, state: dict) -> dict:
            before = sum(s["turns"] for s in state.get("segments", {}).values())
            self._bury(base, state, name, n)
            gone = before - sum(s["turns"] for s in state.get("segments", {}).values())
            if expect is not None and gone != expect:
                raise CheckFailed(f"{gone} turns were to go, not {expect}")
            return self._tidy(state)

        return self.versions.change(step)

    @staticmethod
    def _tidy(state: dict) -> dict:
        """Forget empty segments, and deletions that no segment is older than."""
        segments = {k: s for k, s in state.get("segments", {}).items() if s["rows"] or s["session_rows"]}
        oldest = min((s["clean"] for s in segments.values()), default=math.inf)
        return state | {"segments": segments, "deletes": {k: d for k, d in state.get("deletes", {}).items() if d["version"] > oldest}}

    def _due(self, segments: dict[str, dict]) -> list[str]:
        """The newest run of neighbouring segments that is due: ``FAN`` or more, none larger than the first by the factor ``FAN``; or one that is mostly dead."""
        line = sorted(segments, key=lambda s: segments[s]["order"])
        tier = lambda s: int(math.log(max(1, segments[s]["turns"]), FAN))
        for i in reversed(range(len(line))):
            run = [line[i]]
            for s in line[i + 1 :]:
                if tier(s) > tier(line[i]):
                    break
                run.append(s)
            if len(run) >= FAN:
                return run
        return [s for s in line if segments[s]["turns"] * 2 < segments[s]["rows"]][:1]

    def merge(self) -> int:
        """Merge runs of segments that are due, each in a commit, until none is; returns the version."""
        while run := self._due(self.snapshot().segments):
            now = self.snapshot()
            rows = now.table("turns", run).drop("segment")
            sessions = now.sessions(run)
            marks = now.table("marks", run)
            found = self.spark.read.schema(blocks.BLOCK).parquet(*[self.versions.data(s, "postings") for s in run])
            named = found.select("token", F.regexp_extract(F.col("_metadata.file_path"), "/([^/]+)/postings/[^/]+$", 1).alias("segment"), F.explode("entries").alias("e"))
            entries = now.alive(named.select("token", "segment", "e.*")).drop("segment")
            name, segment = self._segment(rows, sessions, None if marks is None else marks.drop("segment"), entries)
            if segment["rows"] != sum(now.segments[s]["turns"] for s in run):
                raise CheckFailed("the merged segment has not the turns of those it is made of")

            def step(base: int, state: dict, run=run, name=name, segment=segment, now=now) -> dict | None:
                have = state["segments"]
                if base != now.version and (any(s not in have for s in run) or state.get("deletes", {}) != now.deletes):
                    return None  # others deleted or merged meanwhile: it is worked out anew
                last = max(have[s]["order"] for s in run)
                kept = {k: s for k, s in have.items() if k not in run}
                return self._tidy(state | {"segments": kept | {name: segment | {"order": last, "clean": now.version}}})

            self.versions.change(step)
        return self.snapshot().version

    def vacuum(self, keep: int = 2, **more) -> int:
        return self.versions.vacuum(keep, **more)


def move(main: Library, archive: Library, ids: DataFrame) -> tuple[int, int]:
    """Move sessions from one library to the other; how many sessions and turns went.

    The archive commits first, and only if it holds every turn that the main one had; then the main one
    deletes. Stopped between the two, it is simply run again: the archive replaces, and nothing is lost.
    """
    now = main.snapshot()
    turns, sessions = now.turns(), now.sessions()
    if turns is None:
        return 0, 0
    ids = materialize(turns.join(ids.select("session_id").distinct(), "session_id", "left_semi").groupBy("session_id").agg(F.count(F.lit(1)).alias("n")), "moved")
    n_sessions, n = ids.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if n:
        going = lambda rows: rows.join(ids.select("session_id"), "session_id", "left_semi")
        before = archive.snapshot().table("lengths")
        kept = 0 if before is None else before.join(ids, "session_id", "left_anti").count()
        archive.write(going(turns), None if sessions is None else going(sessions), going(now.marks()), expect=n)
        if archive.snapshot().n != kept + n:
            raise CheckFailed(f"the archive has {archive.snapshot().n} turns, not {kept + n}; nothing was deleted")
        main.delete(ids, expect=n)
    forget(ids)
    return n_sessions, n
