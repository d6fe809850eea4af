"""Registered queries over the stored library, folder scans, streams into the library, and further transcript formats, with their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from colloquy.functions import text as tx
from colloquy.operators import providers, reach, retrieval, store
from colloquy.plans import views
from colloquy.plans.catalog import _EXCERPT, _FTS, SINCE, _excerpt, _requested, _requests, query
from colloquy.plans.catalog import ORACLE_SQL as KNOWN_SQL
from colloquy.plans.extended import _FORMAT, _LINE, _flat_calls, _records
from colloquy.plans.views import BASE_MS, HOUR, SQL
from colloquy.session import scratch_path, table
from colloquy.sources import descriptors, ranges, skipping, transcripts
from colloquy.streaming import ingest

# -- the stored library


def _grown(spark, sf_dir):
    """A library that came about by several commits: other texts first, read again; sessions added; some deleted; merged."""
    t, n = _flat_calls(views.turns(spark, sf_dir)), F.col("native_id").cast("long")
    library = store.Library(spark, scratch_path(spark, "library"))
    library.write(t.where(n % 2 == 0).withColumn("text", F.concat(F.lit("of the other "), "text")))
    library.write(t.where(n % 4 == 1))
    library.write(t.where(n % 2 == 0))
    library.write(t.where(n % 4 == 3))
    library.delete(t.where(n % 5 == 3).select("session_id"))
    library.write(t.where(n % 20 == 13))
    library.merge()
    return library


_LEFT = "(CAST(split_part(session_id, '/', 3) AS BIGINT) % 5 <> 3 OR CAST(split_part(session_id, '/', 3) AS BIGINT) % 20 = 13)"


@query(f"""{SQL}, {_FTS}, tf AS (SELECT session_id, seq, length, len(list_filter(string_split(a, ' '), lambda x: x = 'of')) + len(list_filter(string_split(c, ' '), lambda x: x = 'of')) AS tf FROM fx WHERE {_LEFT}),
    st AS (SELECT count(*) AS n, avg(length) AS mean, count(*) FILTER (tf > 0) AS df FROM tf)
    SELECT session_id, seq, CAST(tf AS BIGINT) AS tf, round(-CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)), 9) AS rank FROM tf, st WHERE tf > 0""")
def index_upkeep(spark, sf_dir):
    """The index after re-reads, deletions and merges answers as one built from what is left."""
    return _grown(spark, sf_dir).snapshot().index().search(["of"]).withColumn("rank", F.round("rank", 9))


@query(f"""{SQL} SELECT session_id, seq, role, ts, text FROM turn WHERE {_LEFT}""")
def library_turns(spark, sf_dir):
    """Live turns of a library after re-reads, deletions and merges."""
    return _grown(spark, sf_dir).snapshot().turns().select("session_id", "seq", "role", "ts", "text")


@query(f"""{SQL} SELECT CASE WHEN last_turn_at < {SINCE} THEN 'archive' ELSE 'main' END AS place, session_id, cwd, turn_count, last_turn_at FROM session""")
def archive_moved(spark, sf_dir):
    """Sessions moved to an archive once it holds all of their turns; those of unknown last activity stay."""
    t, s = _flat_calls(views.turns(spark, sf_dir)), views.sessions(spark, sf_dir)
    main, old = (store.Library(spark, scratch_path(spark, name)) for name in ("main", "archive"))
    main.write(t, s)
    store.move(main, old, s.where(F.col("last_turn_at") < SINCE))
    show = lambda library, place: library.snapshot().sessions().select(F.lit(place).alias("place"), "session_id", "cwd", "turn_count", "last_turn_at")
    held = [(library, place) for library, place in ((main, "main"), (old, "archive")) if library.snapshot().segments]
    out = show(*held[0])
    return out.unionByName(show(*held[1])) if len(held) > 1 else out


@query(f"""{SQL} SELECT session_id, seq, CASE WHEN session_id IN (SELECT session_id FROM session WHERE source_path IS NOT NULL) THEN 'again ' || text ELSE text END AS text FROM turn""")
def reread_sessions(spark, sf_dir):
    """Sessions whose file is there are read again in one commit; the others keep their turns, the version before stays."""
    t, s = _flat_calls(views.turns(spark, sf_dir)), views.sessions(spark, sf_dir)
    library = store.Library(spark, scratch_path(spark, "reread"))
    library.write(t, s)
    have = s.where("source_path is not null").select("session_id")
    library.write(t.join(have, "session_id", "left_semi").withColumn("text", F.concat(F.lit("again "), "text")), reread=have)
    return library.snapshot().turns().select("session_id", "seq", "text")


# -- streams


@query(KNOWN_SQL["transcripts_parsed"])
def streamed_turns(spark, sf_dir):
    """Lines streamed into a library in several batches: numbers go on, later marks reach back."""
    rows = _records(spark, sf_dir).drop("conv_id")
    folder = scratch_path(spark, "lines")
    for part in (rows.where("pos < 2"), rows.where("pos between 2 and 3"), rows.where("pos > 3")):
        # the lines are made by as many tasks as the input has; one batch takes the files of one part
        part.repartition(4, "path", "pos").write.mode("append").parquet(folder)
    library = store.Library(spark, scratch_path(spark, "streamed"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(folder)
    write = ingest.writer(library, _FORMAT, "m1", "lines")
    stream.writeStream.foreachBatch(write).option("checkpointLocation", scratch_path(spark, "lines-mark")).trigger(availableNow=True).start().awaitTermination()
    return library.snapshot().surfaced().select("session_id", "seq", "role", "ts", "text", "uuid", "tokens_out", "surface")


@query(f"""WITH RECURSIVE {_requested("key")}, r AS (SELECT key, "at", rn, CAST(4 AS DOUBLE) AS level, true AS passed FROM n WHERE rn = 1
    UNION ALL SELECT n.key, n."at", n.rn, least(5.0::DOUBLE, r.level + (n."at" - r."at") * 5 / 60000.0::DOUBLE) - CASE WHEN least(5.0::DOUBLE, r.level + (n."at" - r."at") * 5 / 60000.0::DOUBLE) >= 1 THEN 1 ELSE 0 END,
        least(5.0::DOUBLE, r.level + (n."at" - r."at") * 5 / 60000.0::DOUBLE) >= 1 FROM r JOIN n ON n.key = r.key AND n.rn = r.rn + 1) SELECT key, "at", passed FROM r""")
def rate_limited_within(spark, sf_dir):
    """Token buckets in lanes of a bounded number of keys (refusals beyond it are tested by brute force)."""
    return reach.rate_limited_within(_requests(spark, sf_dir, "key"), lanes=16).select("key", "at", "passed")


# -- folders


def _folder(spark, sf_dir):
    """Transcript files, each with the lines of some conversations, and their format."""
    path = scratch_path(spark, "folder")
    _records(spark, sf_dir).select("value").repartition(24).write.option("lineSep", "\n").text(path)
    return path, replace(_FORMAT, dir_depth=0, suffix=".txt")


@query(f"""WITH {_LINE} SELECT '/w/conv-' || conv_id AS said_in, role, ts, {_excerpt("text", "than ")} AS excerpt FROM line WHERE role <> 'system' AND contains(lower(text), 'than ')""")
def folder_scan(spark, sf_dir):
    """SC1 F9 F11 T2: a literal in a folder of transcripts: stored filters and raw bytes rule files out, the rest is parsed in waves."""
    path, d = _folder(spark, sf_dir)
    filters = skipping.Filters(spark, scratch_path(spark, "filters"))
    filters.renew(transcripts.files(spark, path, d))
    scan = providers.FolderScan.over(spark, {d.id: path}, {d.id: d}, "m1", filters=filters)
    hits = scan.search("than ", providers.Scope(since=0), False, 1 << 30).select("session_id", "seq", "role", "ts", "excerpt")
    # conversations share files here, so the place of a hit is told by its time
    place = F.floor((F.col("ts") - BASE_MS) / (6 * HOUR)).cast("string")
    return hits.select(F.concat(F.lit("/w/conv-"), place).alias("said_in"), "role", "ts", "excerpt")


@query(f"""WITH {_LINE} SELECT '/w/conv-' || conv_id AS cwd, uuid, strlen(text) AS bytes FROM line WHERE role <> 'system'""")
def ranged_lines(spark, sf_dir):
    """SC9: lines read by byte ranges, with bytes that aren't UTF-8 and blank lines between them."""
    path = scratch_path(spark, "ranges")
    rows = _records(spark, sf_dir)
    bad = F.when(F.col("pos") % 3 == 1, F.concat(F.lit("\n"), F.unhex(F.lit("FFFE7B7D")).cast("string"), F.lit("\n \n"))).otherwise("")
    rows.select(F.concat("value", bad).alias("value")).write.option("lineSep", "\n").text(path)
    d = replace(_FORMAT, dir_depth=0, suffix=".txt")
    parsed = transcripts.parse(ranges.lines(transcripts.files(spark, path, d)), d, "m1")
    return parsed.where("is_turn").select("cwd", "uuid", F.octet_length("text").cast("long").alias("bytes"))


# -- further formats

_TREE, _NESTED = descriptors.BUILT_IN[1], descriptors.BUILT_IN[2]


def _stamp():
    at = F.timestamp_millis(F.lit(BASE_MS) + F.col("conv_id") * (6 * HOUR) + F.col("turn") * 60_000)
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


@query(f"""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE role IN ('user', 'assistant', 'system')),
    t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq FROM c),
    cut AS (SELECT m.conv_id, max(a.seq) AS cut FROM t m JOIN t a ON a.conv_id = m.conv_id AND a.turn = m.turn - 1 WHERE m.role = 'system' GROUP BY 1)
    SELECT 'm1/pi/' || conv_id AS session_id, seq, CASE WHEN role = 'system' OR (role = 'assistant' AND turn % 3 <> 2) THEN 'assistant' WHEN role = 'assistant' THEN 'user' ELSE 'user' END AS role,
        CASE WHEN role = 'assistant' AND turn % 3 = 2 THEN '$ ' || left(text, 9) || chr(10) || text ELSE text END AS text, conv_id || '-' || turn AS uuid,
        CASE WHEN role = 'assistant' AND turn % 3 = 1 THEN 'Find' END AS tool, CASE WHEN seq < cut THEN 'superseded' ELSE 'current' END AS surface
    FROM t LEFT JOIN cut USING (conv_id)""")
def tree_transcripts(spark, sf_dir):
    """PJ4 PJ5 PJ7 PJ9 W7: a format with joined commands, a fallback text, summaries as entries, tool calls and anchored marks."""
    c = table(spark, sf_dir, "conversations").where("role in ('user', 'assistant', 'system')").withColumn("text", F.coalesce("text", F.lit("")))
    name = lambda turn: F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))
    head = [F.lit("message").alias("type"), name(F.col("turn")).alias("id"), _stamp().alias("timestamp")]
    message = lambda *fields: F.to_json(F.struct(*head, F.struct(*fields).alias("message")))
    asked = message(F.lit("user").alias("role"), F.col("text").alias("content"))
    ran = message(F.lit("bashExecution").alias("role"), F.left("text", F.lit(9)).alias("command"), F.col("text").alias("output"))
    told = message(F.lit("branchSummary").alias("role"), F.col("text").alias("summary"))
    block, call = F.to_json(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))), F.lit('{"type":"toolCall","name":"Find","arguments":{"q":1}}')
    plain = message(F.lit("assistant").alias("role"), F.lit("@").alias("content"))
    called = F.replace(plain, F.lit('"@"'), F.concat(F.lit("["), block, F.lit(","), call, F.lit("]")))
    mark = F.to_json(F.struct(F.lit("compaction").alias("type"), name(F.col("turn")).alias("id"), F.col("text").alias("summary"), name(F.col("turn") - 1).alias("firstKeptEntryId")))
    said = F.when(F.col("turn") % 3 == 2, ran).when(F.col("turn") % 3 == 1, called).otherwise(told)
    value = F.when(F.col("role") == "system", mark).when(F.col("role") == "user", asked).otherwise(said)
    rows = c.select(F.concat(F.lit("/logs/p/t_"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("path"), F.lit(BASE_MS).alias("mtime"), F.col("turn").cast("long").alias("pos"), value.alias("value"))
    turns, _ = transcripts.tables(transcripts.parse(rows, _TREE, "m1"), _TREE)
    return turns.select("session_id", "seq", "role", "text", "uuid", F.get("tool_calls", F.lit(0))["name"].alias("tool"), "surface")


@query("""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE role IN ('user', 'assistant')),
    t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq FROM c WHERE role = 'user' OR turn % 3 <> 2 OR text <> '')
    SELECT 'm1/codex/' || printf('%08d', conv_id) || '-0000-4000-8000-000000000000' AS session_id, seq, role, CASE WHEN role = 'assistant' AND turn % 3 = 2 THEN '' ELSE text END AS text,
        CASE WHEN role = 'assistant' AND turn % 3 = 2 THEN text || chr(10) || 'so' ELSE '' END AS thinking, CASE WHEN role = 'assistant' AND turn % 3 = 2 THEN CASE WHEN turn % 2 = 0 THEN 'opaque' ELSE 'text' END ELSE 'none' END AS thinking_state
    FROM t""")
def nested_transcripts(spark, sf_dir):
    """PJ6 PJ7 PJ8 PJ14 F21: a format with nested payloads, required kinds, reasoning entries (some sealed) and ids at the end of names."""
    c = table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')").withColumn("text", F.coalesce("text", F.lit("")))
    item = lambda *fields: F.to_json(F.struct(F.lit("response_item").alias("type"), _stamp().alias("timestamp"), F.struct(*fields).alias("payload")))
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    asked = item(F.lit("message").alias("type"), F.lit("developer").alias("role"), F.array(part("input_text", F.col("text"))).alias("content"))
    said = item(F.lit("message").alias("type"), F.lit("assistant").alias("role"), F.array(part("output_text", F.col("text"))).alias("content"))
    sealed = F.when(F.col("turn") % 2 == 0, "zz").alias("encrypted_content")
    thought = item(F.lit("reasoning").alias("type"), F.array(part("summary_text", F.col("text")), part("summary_text", F.lit("so"))).alias("summary"), sealed)
    other = F.to_json(F.struct(F.lit("event_msg").alias("type"), F.struct(F.lit("message").alias("type"), F.lit("user").alias("role")).alias("payload")))
    values = F.array(other, F.when(F.col("role") == "user", asked).when(F.col("turn") % 3 == 2, thought).otherwise(said))
    name = F.concat(F.lit("/logs/2024/01/02/rollout-2024-01-02T03-04-05-"), F.lpad(F.col("conv_id").cast("string"), 8, "0"), F.lit("-0000-4000-8000-000000000000.jsonl"))
    rows = c.select(name.alias("path"), F.lit(BASE_MS).alias("mtime"), "turn", F.posexplode(values).alias("k", "value"))
    rows = rows.select("path", "mtime", (F.col("turn") * 2 + F.col("k")).cast("long").alias("pos"), "value")
    turns, _ = transcripts.tables(transcripts.parse(rows, _NESTED, "m1"), _NESTED)
    return turns.select("session_id", "seq", "role", "text", "thinking", "thinking_state")


@query("""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE role IN ('user', 'assistant') AND NOT contains(coalesce(text, ''), chr(10)) AND NOT contains(coalesce(text, ''), '|'))
    SELECT 'm1/plain/' || conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq, role, text FROM c""")
def coded_transcripts(spark, sf_dir):
    """PJ16 SC13: a format that isn't JSON, read by a registered function whose columns are checked."""
    c = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit(""))).where("role in ('user', 'assistant', 'system') and not contains(text, '\\n') and not contains(text, '|')")
    rows = c.select(F.concat(F.lit("/logs/p/"), F.col("conv_id").cast("string"), F.lit(".log")).alias("path"), F.lit(BASE_MS).alias("mtime"), F.col("turn").cast("long").alias("pos"), F.concat_ws("|", "role", "text").alias("value"))
    part = lambda k: F.get(F.split("value", "\\|", 2), F.lit(k))
    d = descriptors.Coded(id="plain", suffix=".log", parser=lambda lines: lines.select("path", "mtime", "pos", part(0).alias("role"), part(1).alias("text")))
    turns, _ = transcripts.tables(transcripts.parse(rows, d, "m1"), d)
    return turns.select("session_id", "seq", "role", "text")
