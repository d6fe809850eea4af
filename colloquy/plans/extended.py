"""Registered queries over transcripts, pushed turns, the stored index, registrations and mailboxes, with their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from colloquy.functions import text as tx
from colloquy.functions import timeparse
from colloquy.operators import fts, names, reach, retrieval, store
from colloquy.plans import views
from colloquy.plans.catalog import _EXCERPT, _FTS, FAR, SINCE, _excerpt, _indexed, query
from colloquy.plans.views import BASE_MS, HOUR, SQL
from colloquy.session import scratch_path, table
from colloquy.sources import descriptors, push, transcripts

QUARTER = 15 * 60_000

# -- transcripts


def _records(spark, sf_dir):
    """Conversations as transcript lines of the first built-in format: ``conv_id``, ``path``, ``mtime``, ``pos``, ``value``."""
    c = table(spark, sf_dir, "conversations").where("role in ('user', 'assistant', 'system')")
    conv, turn = F.col("conv_id"), F.col("turn")
    at = F.timestamp_millis(F.lit(BASE_MS) + conv * (6 * HOUR) + turn * 60_000)
    stamp = F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    name = F.concat_ws("-", conv.cast("string"), turn.cast("string"))
    head = [stamp.alias("timestamp"), F.concat(F.lit("/w/conv-"), conv.cast("string")).alias("cwd"), name.alias("uuid")]
    block = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"))
    asked = F.to_json(F.struct(F.lit("user").alias("type"), *head, F.struct(F.lit("user").alias("role"), F.coalesce("text", F.lit("")).alias("content")).alias("message")))
    usage = F.struct(F.length(F.coalesce("text", F.lit(""))).alias("output_tokens"))
    said = F.to_json(F.struct(F.lit("assistant").alias("type"), *head, F.struct(F.lit("assistant").alias("role"), usage.alias("usage"), F.array(block, block).alias("content")).alias("message")))
    mark = F.to_json(F.struct(F.lit("system").alias("type"), F.lit("compact_boundary").alias("subtype")))
    value = F.when(F.col("role") == "user", asked).when(F.col("role") == "assistant", said).otherwise(mark)
    path = F.concat(F.lit("/logs/p/"), conv.cast("string"), F.lit(".jsonl"))
    return c.select("conv_id", path.alias("path"), F.lit(BASE_MS).alias("mtime"), turn.cast("long").alias("pos"), value.alias("value"))


_FORMAT = descriptors.BUILT_IN[0]
_LINE = f"""line AS (SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN coalesce(text, '') || coalesce(text, '') ELSE coalesce(text, '') END AS text,
        {BASE_MS} + conv_id * {6 * HOUR} + turn * 60000 AS ts, conv_id || '-' || turn AS uuid, CASE WHEN role = 'assistant' THEN length(coalesce(text, '')) END AS tokens_out
    FROM conversations WHERE role IN ('user', 'assistant', 'system'))"""


@query(f"""WITH {_LINE}, cut AS (SELECT conv_id, max(n) AS cut FROM (SELECT conv_id, role, count(*) FILTER (role <> 'system') OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM line) WHERE role = 'system' GROUP BY 1),
    t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq FROM line WHERE role <> 'system')
    SELECT 'm1/claude_code/' || conv_id AS session_id, seq, role, ts, text, uuid, tokens_out, CASE WHEN seq <= cut THEN 'superseded' ELSE 'current' END AS surface FROM t LEFT JOIN cut USING (conv_id)""")
def transcripts_parsed(spark, sf_dir):
    """PJ1 PJ2 PJ3 PJ4 PJ10 PJ12 SC13: transcript lines to numbered, compacted turns."""
    turns, _ = transcripts.tables(transcripts.parse(_records(spark, sf_dir), _FORMAT, "m1"), _FORMAT)
    return turns.select("session_id", "seq", "role", "ts", "text", "uuid", "tokens_out", "surface")


@query(f"""WITH {_LINE} SELECT 'm1/claude_code/' || conv_id AS session_id, '/w/conv-' || conv_id AS cwd, left(min_by(text, turn) FILTER (role = 'user' AND text <> ''), 200) AS title_derived,
    min(ts) AS started_at, max(ts) AS last_turn_at, count(*) AS turn_count FROM line WHERE role <> 'system' GROUP BY conv_id""")
def transcript_sessions(spark, sf_dir):
    """PJ13 PJ14 PJ15: session rows of parsed transcripts."""
    _, sessions = transcripts.tables(transcripts.parse(_records(spark, sf_dir), _FORMAT, "m1"), _FORMAT)
    return sessions.select("session_id", "cwd", "title_derived", "started_at", "last_turn_at", "turn_count")


@query(f"""WITH {_LINE} SELECT '/w/conv-' || conv_id AS cwd, uuid, role, ts, text FROM line WHERE role <> 'system'""")
def transcripts_read(spark, sf_dir):
    """SC1: transcript files written to the shared folder, read back line by line and parsed."""
    path = scratch_path(spark, "transcripts")
    _records(spark, sf_dir).select("value").write.option("lineSep", "\n").text(path)
    d = replace(_FORMAT, dir_depth=0)
    rows = transcripts.parse(transcripts.lines(spark, path, d, suffix=".txt"), d, "m1")
    return rows.where("is_turn").select("cwd", "uuid", "role", "ts", "text")


@query(f"""WITH {_LINE} SELECT uuid, {_excerpt("text", "than ")} AS excerpt FROM line WHERE role <> 'system' AND contains(lower(text), 'than ')""")
def prefiltered_search(spark, sf_dir):
    """raw lines are tested for the needle before they are parsed."""
    rows = transcripts.parse(transcripts.may_hold(_records(spark, sf_dir), "than "), _FORMAT, "m1")
    hits = rows.where(F.col("is_turn") & retrieval.contains_text(F.col("text"), "than "))
    return hits.select("uuid", tx.excerpt(tx.scrub(F.col("text")), "than ").alias("excerpt"))


@query("""WITH f AS (SELECT 'f' || page_id AS path, CAST(page_id % 97 AS BIGINT) AS mtime, CAST(strlen(html) AS BIGINT) AS size FROM pages)
    SELECT path, mtime, size FROM f ORDER BY mtime DESC, path LIMIT 100""")
def files_in_budget(spark, sf_dir):
    """SC7: the files changed last, up to the budget."""
    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("f"), F.col("page_id").cast("string")).alias("path"), (F.col("page_id") % 97).cast("long").alias("mtime"), F.octet_length("html").cast("long").alias("size"))
    return transcripts.within_budget(p, 100)[0]


@query("""SELECT 'f' || page_id AS path, strlen(url) AS size FROM pages WHERE page_id % 11 = 3 AND strlen(url) > 0""")
def unread_files(spark, sf_dir):
    """SC10: files of which nothing could be read are named, never taken for empty ones."""
    f = table(spark, sf_dir, "pages").select(F.concat(F.lit("f"), F.col("page_id").cast("string")).alias("path"), F.octet_length("url").cast("long").alias("size"), "page_id")
    return transcripts.unread(f, f.where("page_id % 11 <> 3"))


@query(f"""WITH d AS (SELECT doc_id, repeat('İ', CAST(doc_id % 90 AS INT)) || 'K' || coalesce(text, '') AS text FROM documents)
    SELECT doc_id, {_excerpt("text", "en")} AS excerpt, strpos(lower(text), 'k') AS kelvin FROM d""")
def folded_excerpts(spark, sf_dir):
    """Places of matches are counted in the text itself, whatever its lower case is."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.repeat(F.lit("İ"), (F.col("doc_id") % 90).cast("int")), F.lit("K"), F.coalesce("text", F.lit(""))).alias("text"))
    return d.select("doc_id", tx.excerpt(F.col("text"), "en").alias("excerpt"), tx.literal_position(F.col("text"), "k").cast("long").alias("kelvin"))


# -- pushed turns


def _batches(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')")
    turn = F.struct("role", F.when(F.col("turn") % 4 != 3, F.lit(BASE_MS) + F.col("turn") * 1000).alias("ts"), F.coalesce("text", F.lit("")).alias("text"), F.struct(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("uuid")).alias("prov"))
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))).alias("ts"))
    body = F.to_json(F.transform("ts", lambda x: x["t"]))
    return rows.select(F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"), F.when(F.col("conv_id") % 7 == 3, F.concat(F.lit('{"turns":'), body, F.lit("}"))).when(F.col("conv_id") % 7 == 4, F.left(body, F.lit(20))).otherwise(body).alias("body"))


@query(f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS pos, CASE WHEN turn % 4 <> 3 THEN {BASE_MS} + turn * 1000 END AS ts FROM conversations WHERE role IN ('user', 'assistant') AND conv_id % 7 NOT IN (3, 4))
    SELECT 's' || conv_id AS session_id, min(ts) OVER (PARTITION BY conv_id) AS started_at, pos, role, ts, coalesce(text, '') AS text, conv_id || '-' || turn AS uuid FROM t""")
def pushed_turns(spark, sf_dir):
    """SC11: turns of pushed JSON arrays, whole batches or none."""
    return push.parse_turns(_batches(spark, sf_dir))[0].select("session_id", "started_at", "pos", "role", "ts", "text", "uuid")


@query("""SELECT DISTINCT 's' || conv_id AS session_id FROM conversations WHERE role IN ('user', 'assistant') AND conv_id % 7 IN (3, 4)""")
def rejected_batches(spark, sf_dir):
    """SC11: pushed bodies that are no JSON array of turns."""
    return push.parse_turns(_batches(spark, sf_dir))[1]


@query("""SELECT conv_id, turn AS pos, role, coalesce(text, '') AS text, CASE WHEN role = 'assistant' THEN 'why' ELSE '' END AS thinking, CASE WHEN role = 'assistant' THEN 'm' END AS model,
    CASE WHEN role = 'assistant' THEN CAST(turn AS BIGINT) END AS tokens_in, CASE WHEN role = 'assistant' THEN 'run:' || left(coalesce(text, ''), 80) END AS call FROM conversations WHERE role IN ('user', 'assistant')""")
def mapped_events(spark, sf_dir):
    """PJ16: finished messages of a runtime's events; streamed parts and other events are left out."""
    c = table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')")
    text = F.coalesce("text", F.lit(""))
    block = lambda kind, body: F.struct(F.lit(kind).alias("type"), body.alias("text"))
    asked = F.to_json(F.struct(F.lit("user/message").alias("type"), F.struct(text.alias("content")).alias("data")))
    tool = F.struct(F.lit("tool-call").alias("type"), F.lit("run").alias("name"), text.alias("arguments"))
    content = F.to_json(F.array(block("reasoning", F.lit("why")), block("text", text)))
    message = F.concat(F.lit('{"type":"assistant/message","data":{"usage":{"inputTokens":'), F.col("turn").cast("string"), F.lit('},"message":{"source":{"model":"m"},"content":'), F.left(content, F.length(content) - 1), F.lit(","), F.to_json(tool), F.lit("]}}}"))
    chunk = F.to_json(F.struct(F.lit("assistant/chunk").alias("type"), F.struct(text.alias("content")).alias("data")))
    rows = c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("pos"), F.when(F.col("role") == "user", F.array(asked)).otherwise(F.array(chunk, message, F.lit("torn {"))).alias("values"))
    out = push.map_events(rows.select("session_id", "pos", F.explode("values").alias("value")))
    first = F.get("tool_calls", F.lit(0))
    return out.select(F.col("session_id").alias("conv_id"), "pos", "role", "text", "thinking", "model", "tokens_in", F.concat_ws(":", first["name"], first["input_digest"]).alias("call")).withColumn("call", F.when(F.col("role") == "assistant", F.col("call")))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS calls, CASE WHEN doc_id % 3 = 0 THEN 'T' || doc_id END AS name FROM documents""")
def calls_read_back(spark, sf_dir):
    """PJ17: stored tool calls; text that is no such list reads as none."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    stored = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('[{"name":"T'), n, F.lit('","input_digest":"x"}]'))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit('[{"name":"'), n))
    calls = push.read_calls(stored)
    return d.select("doc_id", F.size(calls).alias("calls"), F.get(calls, F.lit(0))["name"].alias("name"))


@query(f"""{SQL} SELECT t.session_id, seq, CASE WHEN thinking <> '' THEN 'text' ELSE 'none' END AS thinking_state, nullif(s.title_user, '') AS title_derived FROM turn t JOIN session s USING (session_id)""")
def backfilled(spark, sf_dir):
    """Columns that older rows lacked."""
    s, t = push.backfilled(views.sessions(spark, sf_dir).withColumn("title", F.col("title_user")), views.turns(spark, sf_dir))
    return t.join(s.select("session_id", "title_derived"), "session_id").select("session_id", "seq", "thinking_state", "title_derived")


# -- the stored index


def _flat_calls(turns):
    """Turns with the first tool call as text."""
    calls = F.when(F.size("tool_calls") > 0, F.concat_ws(" ", F.get("tool_calls", F.lit(0))["name"], F.get("tool_calls", F.lit(0))["input_digest"])).otherwise("")
    return turns.withColumn("tool_calls", calls)


def _stored(spark, sf_dir):
    library = store.Library(spark, scratch_path(spark, "index"))
    library.write(_flat_calls(views.turns(spark, sf_dir)))
    return library.snapshot().index()


@query(f"""{SQL}, {_FTS}, tf AS (SELECT session_id, seq, length, len(list_filter(string_split(a, ' '), lambda x: x = 'of')) + len(list_filter(string_split(c, ' '), lambda x: x = 'of')) AS tf FROM fx),
    st AS (SELECT count(*) AS n, avg(length) AS mean, count(*) FILTER (tf > 0) AS df FROM tf),
    r AS (SELECT session_id, seq, CAST(tf AS BIGINT) AS tf, -CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)) AS rank FROM tf, st WHERE tf > 0)
    SELECT session_id, seq, tf, round(rank, 9) AS rank FROM r ORDER BY round(rank, 9), session_id, seq LIMIT 25""")
def search_ranked_top_k(spark, sf_dir):
    """The best hits of a word, from the blocks of stored postings that can hold one."""
    return _stored(spark, sf_dir).top_k(["of"], 25).withColumn("rank", F.round("rank", 9))


@query(f"""{SQL}, {_FTS}, p AS (SELECT session_id, seq, len(list_filter(range(1, len(string_split(a, ' '))), lambda i: string_split(a, ' ')[i] = 'of' AND string_split(a, ' ')[i + 1] = 'the'))
        + len(list_filter(range(1, len(string_split(c, ' '))), lambda i: string_split(c, ' ')[i] = 'of' AND string_split(c, ' ')[i + 1] = 'the')) AS tf FROM fx)
    SELECT session_id, seq, CAST(tf AS BIGINT) AS tf FROM p WHERE tf > 0""")
def phrase_by_positions(spark, sf_dir):
    """A phrase by joining its tokens' postings on positions."""
    return _stored(spark, sf_dir).phrase(["of", "the"]).drop("length")


_UNIT = "[^\\p{L}\\p{N}\\p{Co}\\p{Mn}]*[\\p{L}\\p{N}\\p{Co}\\p{Mn}]+"


@query(f"""{SQL}, u AS (SELECT session_id, seq, regexp_extract_all(text, '{_UNIT}') AS us, list_position(regexp_extract_all(lower(strip_accents(text)), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+'), 'of') AS p FROM turn),
    w AS (SELECT *, greatest(1, p - 4) AS low FROM u WHERE p > 0),
    h AS (SELECT *, array_to_string(us[low:p - 1], '') AS before, us[p] AS hit, array_to_string(us[p + 1:p + 9 - (p - low)], '') AS after FROM w)
    SELECT session_id, seq, CASE WHEN low > 1 THEN '…' ELSE '' END || regexp_replace(before || regexp_extract(hit, '^[^\\p{{L}}\\p{{N}}\\p{{Co}}\\p{{Mn}}]*') || '[' || regexp_replace(hit, '^[^\\p{{L}}\\p{{N}}\\p{{Co}}\\p{{Mn}}]+', '') || ']' || after, '^[^\\p{{L}}\\p{{N}}\\p{{Co}}\\p{{Mn}}\\[]+', '')
        || CASE WHEN low + 9 < len(us) THEN '…' ELSE '' END AS snippet FROM h""")
def snippets(spark, sf_dir):
    """Ten tokens of the text around a match, as they are written."""
    t = views.turns(spark, sf_dir).withColumn("snippet", fts.snippet(F.col("text"), ["of"]))
    return t.where("snippet is not null").select("session_id", "seq", "snippet")


# -- order and archive


@query(f"""{SQL} SELECT session_id, cwd, coalesce(title_user, title_ai, title_derived) AS title, last_ts, turns FROM (SELECT session_id, max(ts) AS last_ts, count(*) AS turns FROM turn GROUP BY ALL) JOIN session USING (session_id)
    ORDER BY last_ts DESC NULLS LAST, session_id LIMIT 15""")
def archive_top_k(spark, sf_dir):
    """SC12 T4: main and archive each cut, then sorted and cut again."""
    t, s = views.turns(spark, sf_dir), views.sessions(spark, sf_dir)
    old = F.col("native_id").cast("long") % 2 == 0
    lists = [retrieval.list_sessions(t.where(c), s, limit=15) for c in (~old, old)]
    return retrieval.archive_too(lists[0], lists[1], 15, F.col("last_ts").desc_nulls_last(), F.col("session_id"))


@query(f"""{SQL} SELECT t.session_id, seq, role, ts, cwd, {_excerpt("text", "en")} AS excerpt, source_path, last_turn_at AS mtime FROM turn t JOIN session s USING (session_id)
    WHERE contains(lower(text), 'en') AND (ts IS NULL OR ts >= {SINCE}) ORDER BY last_turn_at DESC NULLS LAST, source_path NULLS FIRST, seq LIMIT 30""")
def files_first(spark, sf_dir):
    """Hits by file, the one changed last first, and by line."""
    t, s = views.turns(spark, sf_dir), views.sessions(spark, sf_dir)
    hits = retrieval.scan_search(t, s, "en", SINCE, limit=FAR)
    return retrieval.in_file_order(hits, s.withColumn("mtime", F.col("last_turn_at")), 30)


@query(f"""{SQL} SELECT session_id, last_seen_at FROM live ORDER BY last_seen_at DESC, session_id LIMIT 25""")
def live_order(spark, sf_dir):
    """Live sessions, the one seen last first."""
    return views.live(spark, sf_dir).orderBy(F.col("last_seen_at").desc(), "session_id").limit(25).select("session_id", "last_seen_at")


@query("""SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '-' ELSE strftime(make_timestamp(epoch_us(ts) // 1000 * 1000) + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') END AS shown FROM events""")
def formatted_times(spark, sf_dir):
    """Local time, a dash for an unknown one."""
    at = F.when(F.col("event_id") % 9 != 0, F.unix_millis(F.col("ts").cast("timestamp")))
    return table(spark, sf_dir, "events").select("event_id", timeparse.fmt_ts(at, "Asia/Kolkata").alias("shown"))


@query("""SELECT event_id, '[redacted]' AS token, 'v' || event_id AS note, '[redacted]' AS cookie FROM events""")
def censored_logs(spark, sf_dir):
    """Values of log fields with secret names."""
    v = F.concat(F.lit("v"), F.col("event_id").cast("string"))
    m = names.censor(F.create_map(F.lit("Token"), v, F.lit("note"), v, F.lit("cookie"), v))
    return table(spark, sf_dir, "events").select("event_id", m["Token"].alias("token"), m["note"].alias("note"), m["cookie"].alias("cookie"))


@query()
def device_fingerprints(spark, sf_dir):
    """Fingerprints of keys (tested against the hash's published vectors)."""
    key = F.unhex(F.sha2(F.col("c_custkey").cast("string"), 256))
    return table(spark, sf_dir, "customer").select("c_custkey", names.fingerprint(key).alias("fingerprint"))


# -- registrations and mailboxes


def _presence_events(spark, sf_dir):
    i, e = F.col("event_id"), table(spark, sf_dir, "events")
    kind = F.get(F.array(*map(F.lit, ("register", "scan", "beat", "stale", "leave", "scan", "beat"))), (i % 7).cast("int"))
    return e.select(F.concat(F.lit("s"), (F.col("user_id") % 200).cast("string")).alias("session_id"), kind.alias("kind"), (i % 3).alias("pid"), F.concat(F.lit("/w/"), (i % 5).cast("string")).alias("cwd"), F.when(i % 2 == 0, "declared").otherwise("scan").alias("presence"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), "event_id")


_STEP = """CASE WHEN n.kind = 'leave' AND r.pid = n.pid THEN {gone} WHEN n.kind = 'register' THEN {register} WHEN n.kind = 'scan' THEN {scan} WHEN n.kind = 'beat' AND r.pid IS NOT NULL THEN {beat} WHEN n.kind = 'stale' AND r.pid IS NOT NULL THEN {stale} ELSE r.{c} END AS {c}"""


def _step(c: str, register: str, scan: str, beat: str | None = None, stale: str | None = None) -> str:
    return _STEP.format(c=c, gone="NULL", register=register, scan=scan, beat=beat or f"r.{c}", stale=stale or f"r.{c}")


@query(f"""WITH RECURSIVE e AS (SELECT 's' || (user_id % 200) AS session_id, (['register', 'scan', 'beat', 'stale', 'leave', 'scan', 'beat'])[CAST(event_id % 7 + 1 AS INT)] AS kind, event_id % 3 AS pid, '/w/' || (event_id % 5) AS cwd,
        CASE WHEN event_id % 2 = 0 THEN 'declared' ELSE 'scan' END AS presence, epoch_us(ts) // 1000 AS "at", event_id FROM events),
    n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY "at", event_id) AS rn FROM e),
    r AS (SELECT DISTINCT session_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS pid, CAST(NULL AS VARCHAR) AS cwd, CAST(NULL AS VARCHAR) AS source, CAST(NULL AS VARCHAR) AS presence, CAST(NULL AS BIGINT) AS registered_at, CAST(NULL AS BIGINT) AS last_seen_at, CAST(NULL AS BIGINT) AS stale_at FROM n
        UNION ALL SELECT n.session_id, n.rn, {_step("pid", "n.pid", "n.pid")}, {_step("cwd", "n.cwd", "n.cwd")}, {_step("source", "'hook'", "coalesce(r.source, 'scan')")}, {_step("presence", "n.presence", "coalesce(r.presence, 'scan')")},
            {_step("registered_at", 'coalesce(r.registered_at, n."at")', 'coalesce(r.registered_at, n."at")')}, {_step("last_seen_at", 'n."at"', 'n."at"', 'n."at"')}, {_step("stale_at", "NULL", "r.stale_at", "NULL", 'n."at"')}
        FROM r JOIN n ON n.session_id = r.session_id AND n.rn = r.rn + 1)
    SELECT session_id, pid, cwd, source, presence, registered_at, last_seen_at, stale_at FROM r WHERE pid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY rn DESC) = 1 AND rn = (SELECT max(rn) FROM n WHERE n.session_id = r.session_id)""")
def registrations(spark, sf_dir):
    """Presence rows folded from registrations, scans, beats, marks and pinned leaves."""
    return reach.registered(_presence_events(spark, sf_dir))


@query(f"""{SQL} SELECT session_id, pid FROM live WHERE NOT (pid % 2 = 0 AND pid = user_pid)""".replace("pid = user_pid", "CAST(substr(session_id, 2) AS BIGINT) % 40 + 100 = pid"))
def pinned_leave(spark, sf_dir):
    """A row goes only with the process it belongs to."""
    rows = views.live(spark, sf_dir)
    gone = rows.select("session_id", F.when(F.col("pid") % 2 == 0, F.col("pid")).otherwise(F.col("pid") + 1).alias("pid"))
    return reach.leave(rows, gone).select("session_id", "pid")


@query(f"""{SQL} SELECT 's' || user_id AS session_id, epoch_us(ts) // 1000 AS "at", 's' || user_id IN (SELECT session_id FROM live WHERE pid % 2 = 0) AS known FROM events""")
def heartbeats(spark, sf_dir):
    """A beat learns whether its row exists."""
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    return reach.heartbeats(e, views.live(spark, sf_dir).where("pid % 2 = 0"))


_NEW = BASE_MS + 40 * 24 * HOUR


@query(f"""{SQL}, p AS (SELECT session_id, pid + 1 AS pid, '/moved' AS cwd FROM live WHERE pid % 5 = 0 UNION ALL SELECT 'new-' || session_id, pid, '/new' FROM live WHERE pid % 7 = 0),
    m AS (SELECT coalesce(live.session_id, p.session_id) AS session_id, coalesce(p.pid, live.pid) AS pid, CASE WHEN p.session_id IS NOT NULL THEN p.cwd ELSE live.cwd END AS cwd, CASE WHEN live.session_id IS NULL THEN 'scan' ELSE live.source END AS source,
        CASE WHEN live.session_id IS NULL THEN 'scan' ELSE live.presence END AS presence, coalesce(live.registered_at, {_NEW}) AS registered_at, CASE WHEN p.session_id IS NOT NULL THEN {_NEW} ELSE live.last_seen_at END AS last_seen_at FROM live FULL JOIN p ON live.session_id = p.session_id)
    SELECT session_id, pid, cwd, source, last_seen_at FROM m WHERE NOT (source = 'scan' AND presence <> 'declared' AND pid NOT IN (SELECT pid FROM p))
    QUALIFY row_number() OVER (PARTITION BY pid ORDER BY CASE WHEN source = 'hook' THEN 0 ELSE 1 END, registered_at DESC, session_id) = 1""")
def discovery(spark, sf_dir):
    """One cycle of finding, moving, pruning and reconciling sessions."""
    rows = views.live(spark, sf_dir).drop("pid_start")
    moved = rows.where("pid % 5 = 0").select("session_id", (F.col("pid") + 1).alias("pid"), F.lit("/moved").alias("cwd"))
    new = rows.where("pid % 7 = 0").select(F.concat(F.lit("new-"), "session_id").alias("session_id"), "pid", F.lit("/new").alias("cwd"))
    return reach.discover(rows, moved.unionByName(new), _NEW).select("session_id", "pid", "cwd", "source", "last_seen_at")


_BOX = """box AS (SELECT DISTINCT me.session_id, o.session_id AS to_session FROM joined me JOIN joined c ON c.pid = me.pid AND c.pid_start IS NOT DISTINCT FROM me.pid_start JOIN joined o ON o.conversation_id = c.conversation_id
    UNION ALL SELECT session_id, session_id FROM live WHERE session_id NOT IN (SELECT session_id FROM joined))"""


def _pane(spark, sf_dir, kind):
    members = views.members(spark, sf_dir).where("pid % 5 <> 2")
    return reach.pane_mail(views.messages(spark, sf_dir), members, views.live(spark, sf_dir), kind, SINCE).select("session_id", "id", "to_session", "place")


@query(f"""{SQL}, joined AS (SELECT * FROM member WHERE pid % 5 <> 2), {_BOX}
    SELECT box.session_id, id, box.to_session, row_number() OVER (PARTITION BY box.session_id ORDER BY created_at, id) AS place FROM box JOIN message USING (to_session) WHERE read_at IS NULL""")
def pane_inbox(spark, sf_dir):
    """Unread messages of all conversations of a pane, oldest first, else of the session alone."""
    return _pane(spark, sf_dir, "unread")


@query(f"""{SQL}, joined AS (SELECT * FROM member WHERE pid % 5 <> 2), {_BOX}
    SELECT box.session_id, id, box.to_session, row_number() OVER (PARTITION BY box.session_id ORDER BY CASE WHEN box.session_id IN (SELECT session_id FROM joined) THEN created_at ELSE -acked_at END, id) AS place
    FROM box JOIN message USING (to_session) WHERE acked_at >= {SINCE}""")
def pane_history(spark, sf_dir):
    """Acknowledged messages; by creation across a pane, newest acknowledgement first for a session alone."""
    return _pane(spark, sf_dir, "acked")


@query(f"""{SQL} SELECT conversation_id, id, row_number() OVER (PARTITION BY conversation_id ORDER BY acked_at DESC, id) AS place FROM message JOIN (SELECT DISTINCT conversation_id, session_id AS to_session FROM member) USING (to_session) WHERE acked_at >= {SINCE}""")
def conversation_history(spark, sf_dir):
    """A conversation's acknowledged messages, newest acknowledgement first."""
    return reach.history(views.messages(spark, sf_dir), views.members(spark, sf_dir), SINCE).select("conversation_id", "id", "place")


@query(f"""{SQL}, cur AS (SELECT conversation_id, max_by(session_id, row(CAST(substr(session_id, 2) AS BIGINT) % 2 = 0, joined_at, session_id)) AS target FROM member GROUP BY 1),
    own AS (SELECT session_id, max_by(conversation_id, row(joined_at, conversation_id)) AS conversation_id FROM member GROUP BY 1)
    SELECT r.id, r.reply_to, CASE WHEN o.id IS NULL THEN 'NoSuchMessage' WHEN o.from_session IS NULL THEN 'NoSender' ELSE 'Sent' END AS outcome, CASE WHEN o.from_session IS NOT NULL THEN coalesce(cur.target, o.from_session) END AS target
    FROM message r LEFT JOIN message o ON r.reply_to = o.id LEFT JOIN own ON own.session_id = o.from_session LEFT JOIN cur USING (conversation_id) WHERE r.reply_to IS NOT NULL""")
def sent_replies(spark, sf_dir):
    """A reply is followed to the session that now answers for the original's sender."""
    live = views.live(spark, sf_dir).where("source = 'hook'")
    return reach.send(views.messages(spark, sf_dir), views.members(spark, sf_dir), live).select("id", "reply_to", "outcome", "target")


@query(f"""WITH RECURSIVE {SQL.removeprefix("WITH ")}, l AS (SELECT session_id, pid - 90 AS pid, CASE WHEN presence = 'declared' THEN 'declared' ELSE 'scan' END AS presence FROM live WHERE pid % 2 = 0),
    p AS (SELECT event_id AS pid, event_id // 3 AS ppid FROM events WHERE event_id > 0),
    w AS (SELECT pid, count(*) FILTER (presence = 'scan') AS scans, count(*) AS n, min(session_id) FILTER (presence = 'scan') AS scan, min(session_id) AS one FROM l GROUP BY 1),
    c AS (SELECT pid AS ask, pid AS "at", 1 AS level FROM p UNION ALL SELECT c.ask, p.ppid, level + 1 FROM c JOIN p ON p.pid = c."at" WHERE p.ppid > 0 AND p.ppid <> p.pid AND level < 16 AND c."at" NOT IN (SELECT pid FROM w))
    SELECT p.pid, CASE WHEN scans = 1 THEN scan WHEN scans = 0 AND n = 1 THEN one END AS session_id, CASE WHEN w.pid IS NULL THEN 'Unknown' WHEN scans = 1 OR (scans = 0 AND n = 1) THEN 'Resolved' ELSE 'Ambiguous' END AS state
    FROM p LEFT JOIN (SELECT ask, "at" FROM c WHERE "at" IN (SELECT pid FROM w)) x ON x.ask = p.pid LEFT JOIN w ON w.pid = x."at\"""")
def own_sessions(spark, sf_dir):
    """The session of a process, from the nearest of its ancestors that owns one."""
    processes = table(spark, sf_dir, "events").where("event_id > 0").select(F.col("event_id").alias("pid"), F.floor(F.col("event_id") / 3).cast("long").alias("ppid"))
    live = views.live(spark, sf_dir).where("pid % 2 = 0").select("session_id", (F.col("pid") - 90).alias("pid"), F.when(F.col("presence") == "declared", "declared").otherwise("scan").alias("presence"))
    return reach.own_sessions(processes, processes, live)


@query("""WITH e AS (SELECT 'n' || (event_id // 3) AS nonce, CASE WHEN event_id % 3 = 0 THEN 'issue' ELSE 'consume' END AS kind, epoch_us(ts) // 1000 // 50 AS "at", event_id FROM events),
    i AS (SELECT nonce, min("at") AS issued_at FROM e WHERE kind = 'issue' GROUP BY 1)
    SELECT e.nonce, e."at", coalesce(row_number() OVER (PARTITION BY e.nonce ORDER BY e."at", e.event_id) = 1 AND e."at" >= issued_at AND e."at" - issued_at <= 60000, false) AS accepted FROM e LEFT JOIN i USING (nonce) WHERE kind = 'consume'""")
def challenges(spark, sf_dir):
    """A challenge counts once, within its lifetime."""
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("n"), F.floor(i / 3).cast("long").cast("string")).alias("nonce"), F.when(i % 3 == 0, "issue").otherwise("consume").alias("kind"), F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 50).cast("long").alias("at"), "event_id")
    return reach.challenges(e)


def _peers(spark, sf_dir):
    n = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("d"), n.cast("string")).alias("device_id"), F.when(n % 50 == 1, "pending_in").when(n % 3 == 0, "trusted").otherwise("pending_out").alias("trust")).where("device_id like '%1' or trust = 'trusted'")


_PEER = """peer AS (SELECT 'd' || c_custkey AS device_id, CASE WHEN c_custkey % 50 = 1 THEN 'pending_in' WHEN c_custkey % 3 = 0 THEN 'trusted' ELSE 'pending_out' END AS trust FROM customer),
    known AS (SELECT * FROM peer WHERE device_id LIKE '%1' OR trust = 'trusted')"""


@query(f"""WITH {_PEER} SELECT count(*) FILTER (trust = 'pending_in') AS waiting, count(*) FILTER (trust = 'pending_in') >= 32 AS "full" FROM known""")
def pending_requests(spark, sf_dir):
    """Incoming requests that wait, against the cap."""
    return reach.pending_requests(_peers(spark, sf_dir))


@query(f"""WITH {_PEER}, a AS (SELECT 'd' || user_id AS device_id, event_id AS "at" FROM events), k AS (SELECT a.*, trust, row_number() OVER (PARTITION BY a.device_id ORDER BY "at") AS rn FROM a LEFT JOIN known USING (device_id)),
    t AS (SELECT device_id FROM (SELECT device_id, row_number() OVER (ORDER BY "at", device_id) AS n FROM k WHERE trust IS NULL AND rn = 1) WHERE n <= 32 - (SELECT count(*) FROM known WHERE trust = 'pending_in'))
    SELECT device_id, "at", CASE WHEN trust = 'trusted' THEN 'Inert' WHEN trust IS NOT NULL OR device_id IN (SELECT device_id FROM t) THEN 'Recorded' ELSE 'ListFull' END AS outcome FROM k""")
def admitted_requests(spark, sf_dir):
    """New devices are admitted while there is room on the list."""
    asked = table(spark, sf_dir, "events").select(F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("device_id"), F.col("event_id").alias("at"))
    return reach.admit(asked, _peers(spark, sf_dir))
