"""The three retrieval queries over turn and session tables: search, sessions, turns.

All filters stand below the limit, so a window or folder never competes with newer rows for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import text as tx

BUDGET_BYTES = 40_000
MOST_ROWS = (1 << 31) - 1


def in_search_window(ts: Column, since: int, until: int | None = None) -> Column:
    """Unknown times pass the lower bound, but not an upper one; the upper bound is exclusive."""
    low = ts.isNull() | (ts >= since)
    return low if until is None else low & ts.isNotNull() & (ts < until)


def in_session_window(ts: Column, since: int | None = None, until: int | None = None) -> Column:
    """Unknown times drop out as soon as either bound is set."""
    keep = F.lit(True)
    if since is not None:
        keep = keep & (ts >= since)
    if until is not None:
        keep = keep & (ts < until)
    return keep


def at_cursor(ts: Column, after: int | None = None, window: tuple[int, int | None] | None = None) -> Column:
    """Turn cursors: from the start, strictly after a time, or inside [since, before)."""
    if after is not None:
        return ts > after
    if window is not None:
        since, before = window
        return (ts >= since) if before is None else (ts >= since) & (ts < before)
    return F.lit(True)


def folder_needle(folder: str | None) -> str | None:
    """A folder as it is matched: trimmed, no trailing separators, nothing if empty."""
    folder = (folder or "").strip().rstrip("/\\")
    return folder or None


def in_folder(cwd: Column, folder: str | None) -> Column:
    """Literal, case-insensitive match on the path or on its dash-encoded form; one rule for every query."""
    needle = folder_needle(folder)
    if needle is None:
        return F.lit(True)
    plain = F.contains(F.lower(cwd), F.lit(needle.lower()))
    coded = F.contains(F.replace(F.lower(cwd), F.lit("/"), F.lit("-")), F.lit(needle.lower().replace("/", "-")))
    return F.coalesce(plain | coded, F.lit(False))


def in_folder_slug(path: Column, folder: str) -> Column:
    """Match of a file path: it contains the needle, or its slug contains the needle's slug."""
    needle = folder_needle(folder)
    own = "".join(c if c.isalnum() else "-" for c in needle.lower())
    own = "-".join(x for x in own.split("-") if x)
    return F.contains(path, F.lit(needle)) | F.contains(tx.slug(path), F.lit(own))


def contains_text(c: Column, query: str) -> Column:
    return F.contains(F.lower(c), F.lit(query.lower()))


def _limited(df: DataFrame, limit: int, *order: Column) -> DataFrame:
    """At least one row; a limit beyond Spark's integers is none."""
    df = df.orderBy(*order)
    return df if limit > MOST_ROWS else df.limit(max(1, limit))


def scan_search(turns: DataFrame, sessions: DataFrame, query: str, since: int, until: int | None = None, folder: str | None = None, runtimes: tuple[str, ...] = (), include_thinking: bool = False, regex: bool = False, limit: int = 20) -> DataFrame:
    """Literal or regular-expression search: text first, then thinking if asked for, then tool names."""
    hit = (lambda c: F.rlike(c, F.lit(query))) if regex else (lambda c: contains_text(c, query))
    rows = turns.where(in_search_window(F.col("ts"), since, until))
    if runtimes:
        rows = rows.where(F.col("runtime_id").isin(*runtimes))
    tool = F.get(F.filter(F.transform("tool_calls", lambda t: t["name"]), hit), F.lit(0))
    with_tool = F.concat(F.lit("[tool] "), tool)
    show = lambda c: F.when(hit(c), tx.excerpt(tx.scrub(c), query, regex))
    found = F.coalesce(show(F.col("text")), show(F.col("thinking")) if include_thinking else F.lit(None).cast("string"), with_tool)
    rows = rows.withColumn("excerpt", found).where(F.col("excerpt").isNotNull())
    rows = rows.join(sessions.select("session_id", "cwd"), "session_id").where(in_folder(F.col("cwd"), folder))
    out = rows.select("session_id", "seq", "role", "ts", "cwd", "excerpt")
    return _limited(out, limit, F.col("ts").desc_nulls_last(), F.col("session_id"), F.col("seq"))


def file_order() -> tuple[Column, ...]:
    return F.col("mtime").desc_nulls_last(), F.col("source_path"), F.col("seq")


def in_file_order(hits: DataFrame, sessions: DataFrame, limit: int = 20) -> DataFrame:
    """Hits as a scan meets them: the file changed last first, and each file's lines in order; the first ``limit``.

    ``sessions`` names each session's file (``source_path``) and when it changed (``mtime``).
    """
    files = sessions.select("session_id", "source_path", "mtime")
    rows = hits.join(files, "session_id")
    return _limited(rows, limit, *file_order())


def archive_too(main: DataFrame, archive: DataFrame | None, limit: int, *order: Column) -> DataFrame:
    """Rows of the main and the archive table, sorted again and cut again after both were cut."""
    if archive is None:
        return _limited(main, limit, *order)
    return _limited(main.unionByName(archive), limit, *order)


def title(user: Column, ai: Column, derived: Column) -> Column:
    return F.coalesce(user, ai, derived)


def list_sessions(turns: DataFrame, sessions: DataFrame, since: int | None = None, until: int | None = None, folder: str | None = None, runtimes: tuple[str, ...] = (), limit: int = 50) -> DataFrame:
    """Sessions with turns in the window, counted inside it, most recently active first."""
    rows = turns.where(in_session_window(F.col("ts"), since, until))
    if runtimes:
        rows = rows.where(F.col("runtime_id").isin(*runtimes))
    active = rows.groupBy("session_id").agg(F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("turns"))
    s = sessions.where(in_folder(F.col("cwd"), folder))
    out = active.join(s, "session_id").select("session_id", "cwd", tx.scrub(title(F.col("title_user"), F.col("title_ai"), F.col("title_derived"))).alias("title"), "last_ts", "turns")
    return _limited(out, limit, F.col("last_ts").desc_nulls_last(), F.col("session_id"))


def _priced(turns: DataFrame, include_thinking: bool) -> DataFrame:
    """Fields capped and scrubbed, thinking only if asked for, with each turn's cost in bytes."""
    text = tx.cap_bytes(F.col("text"))
    thinking = tx.cap_bytes(F.col("thinking"), marker=tx.THINKING_CUT) if include_thinking else F.lit("")
    rows = turns.withColumns({"text": text, "thinking": thinking})
    return rows.withColumn("cost", (F.octet_length("text") + F.octet_length("thinking")).cast("long"))


def read_forward(turns: DataFrame, after: int | None = None, include_thinking: bool = False, limit: int = 200, budget: int = BUDGET_BYTES) -> DataFrame:
    """The longest prefix of every session within the byte budget and the limit, never empty.

    ``more`` tells whether the session has turns beyond it. Costs are not negative, so the prefix is a
    running sum; the first turn is always admitted.
    """
    rows = _priced(turns.where(at_cursor(F.col("ts"), after)), include_thinking)
    w = Window.partitionBy("session_id").orderBy("seq")
    rows = rows.withColumns({"rn": F.row_number().over(w), "used": F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, 0)), "all": F.count(F.lit(1)).over(Window.partitionBy("session_id"))})
    kept = rows.where(((F.col("rn") == 1) | (F.col("used") <= budget)) & (F.col("rn") <= max(1, limit)))
    last = F.max("rn").over(Window.partitionBy("session_id"))
    return kept.withColumn("more", last < F.col("all")).select("session_id", "seq", "role", "ts", tx.scrub(F.col("text")).alias("text"), tx.scrub(F.col("thinking")).alias("thinking"), "used", "more")


def read_latest(turns: DataFrame, since: int, before: int | None = None, include_thinking: bool = False, limit: int = 200, budget: int = BUDGET_BYTES) -> DataFrame:
    """The longest suffix of a window within budget and limit, at least one turn, oldest first by ``seq``."""
    rows = _priced(turns.where(at_cursor(F.col("ts"), window=(since, before))), include_thinking)
    w = Window.partitionBy("session_id").orderBy(F.col("seq").desc())
    rows = rows.withColumns({"rn": F.row_number().over(w), "used": F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, 0)), "all": F.count(F.lit(1)).over(Window.partitionBy("session_id"))})
    kept = rows.where((F.col("rn") == 1) | ((F.col("used") <= budget) & (F.col("rn") <= limit)))
    last = F.max("rn").over(Window.partitionBy("session_id"))
    return kept.withColumn("more", last < F.col("all")).select("session_id", "seq", "role", "ts", tx.scrub(F.col("text")).alias("text"), tx.scrub(F.col("thinking")).alias("thinking"), "more")


def page(turns: DataFrame, after_seq: int, limit: int) -> DataFrame:
    """One page of every session after a sequence number, looking one turn ahead for ``more``."""
    w = Window.partitionBy("session_id").orderBy("seq")
    rows = turns.where(F.col("seq") > after_seq).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit + 1)
    rows = rows.withColumn("more", F.max("rn").over(Window.partitionBy("session_id")) > limit)
    return rows.where(F.col("rn") <= limit).select("session_id", "seq", "more")
