"""Pushed turns: JSON arrays of normalised turns, and the mapping of a runtime's events to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGEST_CHARS = 80
CALLS = "array<struct<name:string,input_digest:string>>"
TURNS = f"array<struct<role:string,ts:bigint,text:string,thinking:string,tool_calls:{CALLS},tokens_in:bigint,tokens_out:bigint,prov:struct<uuid:string,parent_uuid:string,model:string,cache_read_tokens:bigint,cache_creation_tokens:bigint>>>"


def parse_turns(batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of pushed batches (``session_id``, ``body``), and the batches that are no JSON array.

    A batch is taken whole or not at all. Turns keep their order (``pos``); ``started_at`` is the
    batch's least known time.
    """
    read = batches.withColumn("t", F.from_json("body", TURNS))
    good = F.rlike(F.ltrim("body"), F.lit("^\\[")) & F.col("t").isNotNull() & F.try_parse_json("body").isNotNull()
    good = F.coalesce(good, F.lit(False))
    started = F.array_min(F.filter(F.transform("t", lambda t: t["ts"]), lambda x: x.isNotNull()))
    rows = read.where(good).withColumn("started_at", started).select("session_id", "started_at", F.posexplode("t").alias("pos", "t"))
    text = lambda c: F.coalesce(F.col(f"t.{c}"), F.lit("")).alias(c)
    turns = rows.select("session_id", "started_at", F.col("pos").cast("long"), "t.role", "t.ts", text("text"), text("thinking"), F.coalesce("t.tool_calls", F.array().cast(CALLS)).alias("tool_calls"), "t.tokens_in", "t.tokens_out", "t.prov.uuid", "t.prov.parent_uuid", "t.prov.model", "t.prov.cache_read_tokens", "t.prov.cache_creation_tokens")
    return turns, read.where(~good).select("session_id")


def _string(v: Column, path: str) -> Column:
    raw = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(raw) == "STRING", F.try_variant_get(v, path, "string"))


def _blocks(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _of_kind(blocks: Column, kind: str) -> Column:
    mine = F.filter(blocks, lambda b: F.try_variant_get(b, "$.type", "string") == kind)
    return F.array_join(F.filter(F.transform(mine, lambda b: _string(b, "$.text")), lambda t: t.isNotNull()), "")


def _calls(blocks: Column) -> Column:
    """Names and digests of tool calls; the arguments themselves are never kept."""
    mine = F.filter(blocks, lambda b: F.try_variant_get(b, "$.type", "string") == "tool-call")
    name = lambda b: F.coalesce(F.try_variant_get(b, "$.name", "string"), F.lit("?")).alias("name")
    return F.transform(mine, lambda b: F.struct(name(b), F.left(_string(b, "$.arguments"), F.lit(DIGEST_CHARS)).alias("input_digest")))


def map_events(events: DataFrame) -> DataFrame:
    """Turns of a runtime's events (``session_id``, ``pos``, ``value``): finished messages alone.

    Streamed parts of a message are left out, as the finished one repeats them. A user's content is
    kept at ``data.content``, an assistant's at ``data.message.content``.
    """
    rows = events.withColumn("v", F.try_parse_json("value")).where("v is not null")
    v = F.col("v")
    kind = F.try_variant_get(v, "$.type", "string")
    role = F.when(kind == "user/message", "user").when(kind == "assistant/message", "assistant")
    rows = rows.withColumn("role", role).where("role is not null")
    own = F.col("role") == "user"
    blocks = F.when(own, _blocks(v, "$.data.content")).otherwise(_blocks(v, "$.data.message.content"))
    plain = F.when(own, _string(v, "$.data.content")).otherwise(_string(v, "$.data.message.content"))
    by_assistant = lambda c: F.when(~own, c)
    return rows.select(
        "session_id",
        "pos",
        "role",
        F.try_variant_get(v, "$.time", "long").alias("ts"),
        F.coalesce(plain, _of_kind(blocks, "text")).alias("text"),
        _of_kind(blocks, "reasoning").alias("thinking"),
        _calls(blocks).alias("tool_calls"),
        F.when(own, _string(v, "$.data.id")).otherwise(_string(v, "$.data.message.id")).alias("uuid"),
        by_assistant(_string(v, "$.data.message.source.model")).alias("model"),
        by_assistant(F.try_variant_get(v, "$.data.usage.inputTokens", "long")).alias("tokens_in"),
        by_assistant(F.try_variant_get(v, "$.data.usage.outputTokens", "long")).alias("tokens_out"),
        by_assistant(F.try_variant_get(v, "$.data.usage.cacheReadTokens", "long")).alias("cache_read_tokens"),
    )


def read_calls(stored: Column) -> Column:
    """Tool calls from their stored JSON; text that isn't such a list reads as none."""
    return F.coalesce(F.when(F.try_parse_json(stored).isNotNull(), F.from_json(stored, CALLS)), F.array().cast(CALLS))


def backfilled(sessions: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of an older schema with the columns it lacked.

    Reasoning that is there marks its turn as having it (opaque reasoning can't be told afterwards), and
    an old title was always a derived one.
    """
    state = F.when(F.col("thinking").isNotNull() & (F.col("thinking") != ""), "text").otherwise("none")
    derived = F.when(F.col("title").isNotNull() & (F.col("title") != ""), F.col("title"))
    return sessions.withColumn("title_derived", derived), turns.withColumn("thinking_state", state)
