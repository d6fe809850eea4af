"""Turn, session, message and presence views derived from the generic input tables.

The inputs carry no transcripts, so these views make deterministic ones with integer arithmetic: every
clause exists once as Spark columns here and once as SQL in ``SQL`` (for the comparison in DuckDB).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.session import table

BASE_MS = 1_704_067_200_000
HOUR = 3_600_000
RUNTIMES = ("blocks", "tree", "events")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turn fact table: user and assistant rows of ``conversations`` with derived columns."""
    c = table(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    runtime = F.element_at(F.array(*map(F.lit, RUNTIMES)), (conv % 3 + 1).cast("int"))
    machine = F.concat(F.lit("m"), (conv % 3).cast("string"))
    assistant = F.col("role") == "assistant"
    tool = F.struct(F.concat(F.lit("Tool"), (conv % 4).cast("string")).alias("name"), F.concat(F.lit('{"q":"'), F.left(F.col("text"), F.lit(12)), F.lit('"}')).alias("input_digest"))
    none = F.array().cast("array<struct<name:string,input_digest:string>>")
    return c.where(F.col("role").isin("user", "assistant")).select(
        F.concat_ws("/", machine, runtime, conv.cast("string")).alias("session_id"),
        machine.alias("machine_id"),
        runtime.alias("runtime_id"),
        conv.cast("string").alias("native_id"),
        (turn + 1).alias("seq"),
        "role",
        F.when((conv * 7 + turn) % 17 == 0, F.lit(None)).otherwise(F.lit(BASE_MS) + conv * (6 * HOUR) + turn * 60_000).cast("long").alias("ts"),
        F.when((conv + turn) % 13 == 0, F.lit("")).otherwise(F.col("text")).alias("text"),
        F.when(assistant & (conv % 4 == 0), F.concat(F.lit("considering "), F.left(F.col("text"), F.lit(40)))).otherwise("").alias("thinking"),
        (assistant & (conv % 9 == 0)).alias("opaque"),
        F.when(assistant & (conv % 5 == 0), F.array(tool)).otherwise(none).alias("tool_calls"),
        F.length("text").cast("long").alias("tokens_out"),
        F.when((conv + turn) % 11 == 0, F.lit(None)).otherwise(F.concat_ws("-", conv.cast("string"), turn.cast("string"))).alias("uuid"),
        F.when(turn == 0, F.lit(None)).otherwise(F.concat_ws("-", conv.cast("string"), (turn - 1).cast("string"))).alias("parent_uuid"),
        (conv % 10 == 3).alias("sidechain"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session dimension: one row per conversation with a place and three kinds of title."""
    t = turns(spark, sf_dir)
    s = t.groupBy("session_id", "machine_id", "runtime_id", "native_id").agg(
        F.expr("min_by(text, seq) FILTER (WHERE role = 'user' AND text <> '')").alias("first_text"),
        F.expr("min_by(ts, seq) FILTER (WHERE ts IS NOT NULL)").alias("started_at"),
        F.expr("max_by(ts, seq) FILTER (WHERE ts IS NOT NULL)").alias("last_turn_at"),
        F.count(F.lit(1)).alias("turn_count"),
    )
    n = F.col("native_id").cast("long")
    return s.select(
        "session_id",
        "machine_id",
        "runtime_id",
        "native_id",
        F.when(n % 8 == 5, F.lit(None)).otherwise(F.concat(F.lit("/Home/u"), (n % 7).cast("string"), F.lit("/proj-"), (n % 5).cast("string"))).alias("cwd"),
        F.when(n % 6 == 0, F.concat(F.lit("Named "), F.col("native_id"))).alias("title_user"),
        F.when(n % 4 == 0, F.concat(F.lit("Auto "), F.col("native_id"))).alias("title_ai"),
        F.left("first_text", F.lit(200)).alias("title_derived"),
        F.when(n % 3 == 1, F.lit(None)).otherwise(F.concat(F.lit("/logs/"), F.col("native_id"), F.lit(".jsonl"))).alias("source_path"),
        "started_at",
        "last_turn_at",
        "turn_count",
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mailbox rows: one per event, with read, acknowledgement and attempts derived from its number."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    created = F.unix_millis(F.col("ts").cast("timestamp"))
    read = F.when(i % 3 != 0, created + 1000)
    return e.select(
        F.concat(F.lit("msg-"), i.cast("string")).alias("id"),
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("to_session"),
        F.when(i % 5 != 0, F.concat(F.lit("s"), (F.col("user_id") + 1).cast("string"))).alias("from_session"),
        F.col("event_type").alias("kind"),
        F.when(i % 7 == 0, F.concat(F.lit("msg-"), (i - 1).cast("string"))).alias("reply_to"),
        created.alias("created_at"),
        read.alias("read_at"),
        F.when(i % 6 == 1, read + 5000).alias("acked_at"),
        (i % 6).alias("attempts"),
    )


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presence rows: the latest event of each user."""
    e = table(spark, sf_dir, "events")
    u = F.col("user_id")
    rows = e.groupBy("user_id").agg(F.unix_millis(F.max("ts").cast("timestamp")).alias("last_seen_at"), F.unix_millis(F.min("ts").cast("timestamp")).alias("registered_at"), F.count(F.lit(1)).alias("events"))
    return rows.select(
        F.concat(F.lit("s"), u.cast("string")).alias("session_id"),
        (u % 40 + 100).alias("pid"),
        F.when(u % 4 == 0, F.lit(None)).otherwise(F.concat(F.lit("start-"), (u % 40).cast("string"))).alias("pid_start"),
        F.concat(F.lit("/w/"), (u % 9).cast("string")).alias("cwd"),
        F.when(u % 2 == 0, F.lit("hook")).otherwise("scan").alias("source"),
        F.when(u % 3 == 0, F.lit("declared")).otherwise("observed").alias("presence"),
        "registered_at",
        "last_seen_at",
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership: sessions grouped into conversations by process and place."""
    rows = live(spark, sf_dir)
    name = F.concat_ws("-", F.lit("conv"), F.col("pid").cast("string"), F.col("cwd"), F.coalesce("pid_start", F.lit("none")))
    return rows.select(name.alias("conversation_id"), "session_id", "pid", "pid_start", "cwd", F.col("registered_at").alias("joined_at"), "last_seen_at")


_TURN = f"""turn AS (
    SELECT 'm' || (conv_id % 3) || '/' || (['{RUNTIMES[0]}', '{RUNTIMES[1]}', '{RUNTIMES[2]}'])[CAST(conv_id % 3 + 1 AS INT)] || '/' || conv_id AS session_id,
        'm' || (conv_id % 3) AS machine_id, (['{RUNTIMES[0]}', '{RUNTIMES[1]}', '{RUNTIMES[2]}'])[CAST(conv_id % 3 + 1 AS INT)] AS runtime_id,
        CAST(conv_id AS VARCHAR) AS native_id, turn + 1 AS seq, role,
        CASE WHEN (conv_id * 7 + turn) % 17 = 0 THEN NULL ELSE {BASE_MS} + conv_id * {6 * HOUR} + turn * 60000 END AS ts,
        CASE WHEN (conv_id + turn) % 13 = 0 THEN '' ELSE text END AS text,
        CASE WHEN role = 'assistant' AND conv_id % 4 = 0 THEN 'considering ' || left(text, 40) ELSE '' END AS thinking,
        role = 'assistant' AND conv_id % 9 = 0 AS opaque,
        CASE WHEN role = 'assistant' AND conv_id % 5 = 0 THEN 'Tool' || (conv_id % 4) END AS tool_name,
        CASE WHEN role = 'assistant' AND conv_id % 5 = 0 THEN '{{"q":"' || left(text, 12) || '"}}' END AS tool_digest,
        length(text) AS tokens_out,
        CASE WHEN (conv_id + turn) % 11 = 0 THEN NULL ELSE conv_id || '-' || turn END AS uuid,
        CASE WHEN turn = 0 THEN NULL ELSE conv_id || '-' || (turn - 1) END AS parent_uuid,
        conv_id % 10 = 3 AS sidechain
    FROM conversations WHERE role IN ('user', 'assistant'))"""

_SESSION = """session_rows AS (
    SELECT session_id, machine_id, runtime_id, native_id, CAST(native_id AS BIGINT) AS n,
        min_by(text, seq) FILTER (WHERE role = 'user' AND text <> '') AS first_text,
        min_by(ts, seq) FILTER (WHERE ts IS NOT NULL) AS started_at,
        max_by(ts, seq) FILTER (WHERE ts IS NOT NULL) AS last_turn_at, count(*) AS turn_count
    FROM turn GROUP BY ALL),
session AS (
    SELECT session_id, machine_id, runtime_id, native_id,
        CASE WHEN n % 8 = 5 THEN NULL ELSE '/Home/u' || (n % 7) || '/proj-' || (n % 5) END AS cwd,
        CASE WHEN n % 6 = 0 THEN 'Named ' || native_id END AS title_user,
        CASE WHEN n % 4 = 0 THEN 'Auto ' || native_id END AS title_ai,
        left(first_text, 200) AS title_derived,
        CASE WHEN n % 3 = 1 THEN NULL ELSE '/logs/' || native_id || '.jsonl' END AS source_path,
        started_at, last_turn_at, turn_count
    FROM session_rows)"""

_MESSAGE = """message AS (
    SELECT 'msg-' || event_id AS id, 's' || user_id AS to_session,
        CASE WHEN event_id % 5 <> 0 THEN 's' || (user_id + 1) END AS from_session, event_type AS kind,
        CASE WHEN event_id % 7 = 0 THEN 'msg-' || (event_id - 1) END AS reply_to, epoch_us(ts) // 1000 AS created_at,
        CASE WHEN event_id % 3 <> 0 THEN (epoch_us(ts) // 1000) + 1000 END AS read_at,
        CASE WHEN event_id % 6 = 1 THEN (epoch_us(ts) // 1000) + 6000 END AS acked_at, event_id % 6 AS attempts
    FROM events)"""

_LIVE = """live AS (
    SELECT 's' || user_id AS session_id, user_id % 40 + 100 AS pid,
        CASE WHEN user_id % 4 = 0 THEN NULL ELSE 'start-' || (user_id % 40) END AS pid_start, '/w/' || (user_id % 9) AS cwd,
        CASE WHEN user_id % 2 = 0 THEN 'hook' ELSE 'scan' END AS source,
        CASE WHEN user_id % 3 = 0 THEN 'declared' ELSE 'observed' END AS presence,
        epoch_us(min(ts)) // 1000 AS registered_at, epoch_us(max(ts)) // 1000 AS last_seen_at
    FROM events GROUP BY user_id),
member AS (
    SELECT 'conv-' || pid || '-' || cwd || '-' || coalesce(pid_start, 'none') AS conversation_id, session_id, pid, pid_start, cwd,
        registered_at AS joined_at, last_seen_at FROM live)"""

#: Common table expressions that give DuckDB the same views.
SQL = f"WITH {_TURN},\n{_SESSION},\n{_MESSAGE},\n{_LIVE}"
