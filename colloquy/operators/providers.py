"""The retrieval API: two providers that answer alike, behind one redacting front with coverage."""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.text import scrub
from colloquy.operators import fts, retrieval, store
from colloquy.session import materialize
from colloquy.sources import ranges, skipping, transcripts

HOUR = 3_600_000
#: Windows and limits when the caller states none.
SEARCH_WINDOW, SEARCH_LIMIT = 6 * HOUR, 20
SESSION_WINDOW, SESSION_LIMIT = 7 * 24 * HOUR, 20
TURN_LIMIT = 200
#: Files of the first wave of a scan, and the factor from one wave to the next.
WAVE_FILES, WAVE_GROWTH = 64, 4
LISTED = "path string, mtime long, size long, runtime string, root string, place long"


@dataclass(frozen=True)
class Scope:
    """Where and when to look."""

    since: int
    until: int | None = None
    folder: str | None = None
    runtimes: tuple[str, ...] = ()
    include_thinking: bool = False

    def is_broad(self, now: int) -> bool:
        return retrieval.folder_needle(self.folder) is None and (self.until or now) - self.since > 24 * 3_600_000


@dataclass(frozen=True)
class Capabilities:
    ranked: bool
    unscoped: bool
    regex: bool


@dataclass
class Coverage:
    """What an answer may lack; never left out of it."""

    truncated: bool = False
    degraded: list[str] = field(default_factory=list)

    @property
    def partial(self) -> bool:
        return self.truncated or bool(self.degraded)


class ScanProvider:
    """Answers from turn rows as they were parsed."""

    capabilities = Capabilities(ranked=False, unscoped=False, regex=True)

    def __init__(self, turns: DataFrame, sessions: DataFrame, unreadable: tuple[str, ...] = (), notes: tuple[str, ...] = ()):
        self.turn_rows, self.session_rows, self.unreadable, self.notes = turns, sessions, unreadable, notes

    @staticmethod
    def over(spark: SparkSession, roots: dict[str, str], descriptors: dict, machine_id: str, since_ms: int | None = None, budget: int = transcripts.FILE_BUDGET, filters: skipping.Filters | None = None) -> FolderScan:
        """A provider over transcript folders (by runtime), newest files first within the budget.

        A runtime whose folder isn't there is reported as unreadable, files left out by the budget and
        files that could not be read as notes; none of these is taken for an absence of turns.
        """
        unreadable, listed = [], []
        for runtime, root in roots.items():
            if not transcripts.readable(spark, root):
                unreadable.append(runtime)
                continue
            listed.append(transcripts.files(spark, root, descriptors[runtime], since_ms).withColumns({"runtime": F.lit(runtime), "root": F.lit(root)}))
        if not listed:
            raise FileNotFoundError(f"none of the runtimes can be read: {', '.join(unreadable)}")
        return FolderScan(spark, listed, {r: descriptors[r] for r in roots if r not in unreadable}, machine_id, budget, filters, tuple(unreadable))

    def coverage(self) -> Coverage:
        return Coverage(degraded=[f"runtime {r} could not be read" for r in self.unreadable] + list(self.notes))

    def session_list(self, scope: Scope, limit: int) -> DataFrame:
        return retrieval.list_sessions(self.turn_rows, self.session_rows, scope.since, scope.until, scope.folder, scope.runtimes, limit)

    def turns_of(self, session_id: str) -> DataFrame:
        return self.turn_rows.where(F.col("session_id") == session_id)

    def search(self, query: str, scope: Scope, regex: bool, limit: int) -> DataFrame:
        return retrieval.scan_search(self.turn_rows, self.session_rows, query, scope.since, scope.until, scope.folder, scope.runtimes, scope.include_thinking, regex, limit)


class FolderScan(ScanProvider):
    """Answers read from transcript files when they are asked for.

    A search opens files in waves, the ones changed last first, each wave ``WAVE_GROWTH`` times the one
    before, and stops once it has as many hits as were asked for: hits go by file, so no later file can
    hold an earlier one. Files that were last changed before the window, that stored filters rule out, or whose
    raw bytes don't hold a literal are not parsed. ``opened`` counts the files whose bytes were looked at,
    ``parsed`` those that were parsed.
    """

    def __init__(self, spark: SparkSession, listed: list[DataFrame], descriptors: dict, machine_id: str, budget: int, filters: skipping.Filters | None, unreadable: tuple[str, ...]):
        self.spark, self.descriptors, self.machine_id, self.filters = spark, descriptors, machine_id, filters
        self.failures, self.opened, self.parsed = ranges.Failures(spark.sparkContext), 0, 0
        kept, notes = [], []
        for rows in listed:
            some, over = transcripts.within_budget(rows, budget)
            kept.append(some)
            notes += over
        # the files in the order in which they are searched, numbered from 0
        order = functools.reduce(DataFrame.unionByName, kept).orderBy(F.col("mtime").desc(), "path")
        placed = order.rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
        self.files = materialize(spark.createDataFrame(placed, LISTED), "files")
        super().__init__(None, None, unreadable, tuple(notes))

    @property
    def turn_rows(self) -> DataFrame:
        return self._tables(self.files)[0]

    @turn_rows.setter
    def turn_rows(self, rows: None) -> None:
        """Rows are read from the files each time."""

    @property
    def session_rows(self) -> DataFrame:
        return self._tables(self.files)[1]

    @session_rows.setter
    def session_rows(self, rows: None) -> None:
        """As ``turn_rows``."""

    def coverage(self) -> Coverage:
        out = super().coverage()
        failed = len(self.failures.paths)
        return Coverage(degraded=out.degraded + ([f"{failed} files could not be read"] if failed else []))

    def _tables(self, files: DataFrame, only: str | None = None) -> tuple[DataFrame, DataFrame]:
        turns = sessions = None
        for (runtime, root) in sorted({(r.runtime, r.root) for r in self.files.select("runtime", "root").distinct().collect()}):
            d = self.descriptors[runtime]
            own = files.where(F.col("runtime") == runtime)
            if only is not None:
                own = own.where(transcripts.native_id(F.col("path"), d.native_id) == only)
            rows = transcripts.lines(self.spark, root, d, kept=own, failures=self.failures)
            t, s = transcripts.tables(transcripts.parse(rows, d, self.machine_id), d)
            turns, sessions = (t, s) if turns is None else (turns.unionByName(t), sessions.unionByName(s))
        return turns, sessions

    def turns_of(self, session_id: str) -> DataFrame:
        """The turns of one session, from its own file alone."""
        machine, runtime, native = (session_id.split("/", 2) + ["", ""])[:3]
        own = self.files.where(F.col("runtime") == runtime) if machine == self.machine_id else self.files.limit(0)
        return self._tables(own, native)[0].where(F.col("session_id") == session_id)

    def session_list(self, scope: Scope, limit: int) -> DataFrame:
        turns, sessions = self._tables(self._in_scope(scope))
        return retrieval.list_sessions(turns, sessions, scope.since, scope.until, scope.folder, scope.runtimes, limit)

    def _in_scope(self, scope: Scope) -> DataFrame:
        """Files that can hold turns of a scope: changed since its start, of its runtimes."""
        files = self.files.where(F.col("mtime") >= scope.since)
        return files.where(F.col("runtime").isin(*scope.runtimes)) if scope.runtimes else files

    def search(self, query: str, scope: Scope, regex: bool, limit: int) -> DataFrame:
        needle = None if regex else ranges.plain_needle(query)
        files = self._in_scope(scope)
        if self.filters is not None:
            files = materialize(self.filters.candidates(files, needle), "candidates")
        last, first, wave = files.agg(F.max("place")).first()[0], 0, WAVE_FILES
        found = None
        while found is None or (last is not None and first <= last and found.count() < limit):
            some = files.where(F.col("place").between(first, first + wave - 1))
            self.opened += some.count()
            if needle is not None and all(ranges.reachable(r.root) for r in some.select("root").distinct().collect()):
                some = materialize(ranges.holding(some, needle, self.failures), "holding")
            self.parsed += some.count()
            turns, sessions = self._tables(some)
            hits = retrieval.scan_search(turns, sessions, query, scope.since, scope.until, scope.folder, scope.runtimes, scope.include_thinking, regex, 1 << 40)
            hits = materialize(retrieval.in_file_order(hits, sessions, limit), "hits")
            found = hits if found is None else found.unionByName(hits)
            first, wave = first + wave, wave * WAVE_GROWTH
        return found.orderBy(*retrieval.file_order()).limit(limit)


class IndexProvider(ScanProvider):
    """Answers from an index of tokens, stored or not; phrases of whole tokens, ranked.

    Hits are narrow until they are cut: window, runtimes and folder are tested on keys and times, and only
    the turns that are shown are read in full.

    ``archive`` may be a second provider of this kind: its answers are added to this one's, and the
    whole is sorted and cut again.
    """

    capabilities = Capabilities(ranked=True, unscoped=True, regex=False)

    def __init__(self, turns: DataFrame, sessions: DataFrame, indexed: DataFrame | store.Index, indexed_until: int | None = None, newest: int | None = None, archive: IndexProvider | None = None):
        super().__init__(turns, sessions)
        self.indexed, self.archive, self.lag = indexed, archive, None if None in (indexed_until, newest) else newest - indexed_until

    def coverage(self) -> Coverage:
        out = Coverage()
        if (not self.indexed.n if isinstance(self.indexed, store.Index) else self.indexed.isEmpty()):
            out.degraded.append("the index is empty")
        if self.lag is not None and self.lag > 3_600_000:
            out.degraded.append("the index is older than the newest transcript by more than an hour")
        return out

    def search(self, query: str, scope: Scope, regex: bool, limit: int) -> DataFrame:
        if regex:
            raise ValueError("the index can't answer regular expressions")
        phrase = fts.phrase_tokens(self.turn_rows.sparkSession, query)
        cut = max(1, min(limit, retrieval.MOST_ROWS))
        rows = self.turn_rows.where(retrieval.in_search_window(F.col("ts"), scope.since, scope.until))
        if scope.runtimes:
            rows = rows.where(F.col("runtime_id").isin(*scope.runtimes))
        places = self.session_rows.where(retrieval.in_folder(F.col("cwd"), scope.folder)).select("session_id", "cwd")
        wanted = rows.select("session_id", "seq").join(places.select("session_id"), "session_id", "left_semi")
        keep = lambda hits: hits.join(wanted, ["session_id", "seq"], "left_semi")
        if isinstance(self.indexed, store.Index):
            best = self.indexed.top_k(phrase, cut, scope.include_thinking, keep)
        else:
            best = fts.top_k(keep(fts.search(self.indexed, phrase, scope.include_thinking)), cut)
        shown = rows.join(best, ["session_id", "seq"]).join(places, "session_id")
        shown = shown.withColumn("excerpt", F.coalesce(fts.snippet(scrub(F.col("text")), phrase), fts.snippet(F.to_json("tool_calls"), phrase)) if phrase else F.lit(""))
        out = shown.select("session_id", "seq", "role", "ts", "cwd", "excerpt", "rank")
        more = self.archive.search(query, scope, regex, limit) if self.archive else None
        return retrieval.archive_too(fts.top_k(out, cut), more, cut, F.col("rank"), F.col("session_id"), F.col("seq"))

    def session_list(self, scope: Scope, limit: int) -> DataFrame:
        own = super().session_list(scope, limit)
        more = self.archive.session_list(scope, limit) if self.archive else None
        return retrieval.archive_too(own, more, limit, F.col("last_ts").desc_nulls_last(), F.col("session_id"))


class Retrieval:
    """The only way to an answer: checks capabilities, redacts, and reports coverage."""

    def __init__(self, provider: ScanProvider):
        self.provider = provider

    def warning(self, scope: Scope, now: int) -> str | None:
        if scope.is_broad(now) and not self.provider.capabilities.unscoped:
            return "no folder and more than a day: this reads every transcript"
        return None

    def search(self, query: str, scope: Scope, regex: bool = False, limit: int = SEARCH_LIMIT) -> tuple[DataFrame, Coverage]:
        if regex and not self.provider.capabilities.regex:
            raise ValueError("this provider can't answer regular expressions")
        most = max(1, min(limit, retrieval.MOST_ROWS - 1))
        found = self.provider.search(query, scope, regex, most + 1).withColumn("excerpt", scrub(F.col("excerpt")))
        return self._cut(found, most)

    def _cut(self, found: DataFrame, most: int) -> tuple[DataFrame, Coverage]:
        """At most ``most`` rows and whether there are more; the rows, one over the limit, are kept in the shared folder."""
        found = materialize(found, "answer")
        coverage = self.provider.coverage()
        coverage.truncated = found.count() > most
        if "source_path" in found.columns:
            return found.orderBy(*retrieval.file_order()).limit(most).drop("source_path", "mtime"), coverage
        order = [F.col("rank")] if "rank" in found.columns else [F.col(c).desc_nulls_last() for c in ("ts", "last_ts") if c in found.columns]
        return found.orderBy(*order, *[c for c in ("session_id", "seq") if c in found.columns]).limit(most), coverage

    def sessions(self, scope: Scope, limit: int = SESSION_LIMIT) -> tuple[DataFrame, Coverage]:
        most = max(1, min(limit, retrieval.MOST_ROWS - 1))
        return self._cut(self.provider.session_list(scope, most + 1), most)

    def search_or(self, fallback: Retrieval, query: str, scope: Scope, limit: int = SEARCH_LIMIT) -> tuple[DataFrame, Coverage]:
        """The answer of this provider, or of ``fallback`` when this one finds nothing; the note says which.

        A partial answer is never replaced, nor are two rankings merged.
        """
        found, coverage = self.search(query, scope, limit=limit)
        if found.isEmpty():
            other, theirs = fallback.search(query, scope, limit=limit)
            if not other.isEmpty():
                theirs.degraded.append("nothing found in the transcripts themselves; answered from the index")
                return other, theirs
        return found, coverage

    def turns(self, session_id: str, after: int | None = None, window: tuple[int, int | None] | None = None, include_thinking: bool = False, limit: int = TURN_LIMIT, budget: int = retrieval.BUDGET_BYTES) -> tuple[DataFrame, Coverage]:
        own = self.provider.turns_of(session_id)
        found = retrieval.read_latest(own, *window, include_thinking, limit, budget) if window else retrieval.read_forward(own, after, include_thinking, limit, budget)
        coverage = self.provider.coverage()
        coverage.truncated = bool(found.agg(F.max("more")).first()[0])
        return found.orderBy("seq"), coverage

    def resolve(self, scope: Scope, guess: bool = False) -> tuple[str, list[str], str | None]:
        """``None``, ``One`` or ``Ambiguous``, the newest sessions it could be, and a note.

        Without a folder several sessions are ambiguous; a caller that lets it ``guess`` gets the newest
        one, and the note says so.
        """
        ids = [r["session_id"] for r in self.sessions(scope, 2)[0].collect()]
        if len(ids) > 1 and guess:
            return "One", ids[:1], "several sessions fit; this is the newest"
        return ("None", "One", "Ambiguous")[min(len(ids), 2)], ids, None


def default_scope(now: int, of_sessions: bool = False) -> Scope:
    """The window looked at when the caller states none."""
    return Scope(since=now - (SESSION_WINDOW if of_sessions else SEARCH_WINDOW))


def empty_note(query: str, regex: bool, hits: int) -> str | None:
    """Why several words may find nothing."""
    if hits or regex or len(query.split()) < 2:
        return None
    return "no turn holds these words next to each other; search for one of them"
