"""JSONL transcripts as turn tables: discovery, torn lines, descriptor-driven parsing, all in columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions.text import scrub
from colloquy.operators import fold
from colloquy.sources import ranges
from colloquy.sources.descriptors import Coded, Descriptor

UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
DIGEST_CHARS, TITLE_CHARS = 80, 200
#: Files that one scan reads at most; what is left out is noted.
FILE_BUDGET = 5000


def safe_native_id(native_id: str) -> bool:
    return bool(native_id) and not re.search(r"[/\\\x00]|\.\.", native_id)


def native_id(path: Column, rule: str) -> Column:
    """A session's id from its file name; a rule that doesn't fit falls back to the stem."""
    stem = F.regexp_extract(path, r"([^/]*?)(?:\.(?:jsonl|txt|log))?$", 1)
    pattern = {"stem": None, "after_underscore": "_(.+)$", "trailing_uuid": f"({UUID})$"}[rule]
    if pattern is None:
        return stem
    own = F.regexp_extract(stem, pattern, 1)
    return F.coalesce(F.nullif(own, F.lit("")), stem)


def _pruned(reader, d: Descriptor, since_ms: int | None, only: str | None, suffix: str | None):
    """A file reader that lists only wanted names and times."""
    suffix = d.suffix if suffix is None else suffix
    if only is not None and not safe_native_id(only):
        raise ValueError(f"not a session id: {only!r}")
    name = re.sub(r"([\[\]{}*?,])", r"\\\1", only) if only else ""
    reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{name}*{suffix}" if only else f"*{suffix}")
    if since_ms is not None:
        import datetime as dt

        stamp = dt.datetime.fromtimestamp(since_ms // 1000, dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S")
        reader = reader.option("modifiedAfter", stamp).option("timeZone", "UTC")
    return reader


def _wanted(path: Column, root: str, d: Descriptor, only: str | None) -> Column:
    """Whether a file lies where this format keeps its transcripts."""
    base = re.sub(r"^\w+:(//)?", "", root).rstrip("/")
    inner = F.regexp_extract(path, re.escape(base) + "/(.*)$", 1)
    wanted = F.size(F.split(inner, "/")) == d.dir_depth + 1
    if d.nested_dir:
        wanted = wanted | F.rlike(inner, F.lit(f"(^|/){re.escape(d.nested_dir)}/[^/]+$"))
    return wanted if only is None else wanted & (native_id(path, d.native_id) == only)


def files(spark: SparkSession, root: str, d: Descriptor, since_ms: int | None = None, only: str | None = None, suffix: str | None = None) -> DataFrame:
    """The transcript files as listed: ``path``, ``mtime``, ``size``; contents aren't read."""
    found = _pruned(spark.read.format("binaryFile").option("ignoreMissingFiles", "true"), d, since_ms, only, suffix).load(root)
    return found.where(_wanted(F.col("path"), root, d, only)).select("path", F.unix_millis("modificationTime").alias("mtime"), F.col("length").alias("size"))


def within_budget(found: DataFrame, most: int = FILE_BUDGET) -> tuple[DataFrame, list[str]]:
    """The files changed last, at most ``most``, and a note if there are more."""
    total = found.count()
    notes = [f"only the {most} newest of {total} files were searched"] if total > most else []
    return found.orderBy(F.col("mtime").desc(), "path").limit(most), notes


def lines(spark: SparkSession, root: str, d: Descriptor, since_ms: int | None = None, only: str | None = None, suffix: str | None = None, kept: DataFrame | None = None, failures: ranges.Failures | None = None) -> DataFrame:
    """Complete lines of all transcript files: ``path``, ``mtime``, ``pos``, ``value``.

    Files lie exactly ``dir_depth`` folders below the root, or in folders named ``nested_dir`` at any
    depth. ``since_ms`` prunes files by modification time, ``only`` by native id, both before reading;
    ``kept`` may hold the files to read instead, as ``files`` lists them. Files are read by byte ranges (see
    ``ranges``: torn tails, bytes that aren't UTF-8, failures), those that only Hadoop reaches by Spark's
    text source.
    """
    if not ranges.reachable(root):
        return _through_hadoop(spark, root, d, since_ms, only, suffix, kept)
    return ranges.lines(files(spark, root, d, since_ms, only, suffix) if kept is None else kept, failures)


def _through_hadoop(spark: SparkSession, root: str, d: Descriptor, since_ms: int | None, only: str | None, suffix: str | None, kept: DataFrame | None) -> DataFrame:
    """As ``lines``, for file systems that tasks can't open by themselves.

    The text source doesn't tell a line's offset, so the lines of a file are put in order by block and place
    in it; its last line is torn when the lines with one line feed each are a byte longer than the file.
    """
    reader = spark.read.option("lineSep", "\n").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    raw = _pruned(reader.format("text"), d, since_ms, only, suffix).load(root)
    # the metadata column percent-encodes paths
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    rows = raw.select(path.alias("path"), F.unix_millis("_metadata.file_modification_time").alias("mtime"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    rows = rows.where(_wanted(F.col("path"), root, d, only))
    if kept is not None:
        rows = rows.join(kept.select("path"), "path", "left_semi")
    order = Window.partitionBy("path").orderBy("block", "at")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"pos": F.row_number().over(order).cast("long") - 1, "used": F.sum(F.octet_length("value").cast("long") + 1).over(so_far), "last": F.lead(F.lit(1)).over(order).isNull()})
    # a byte order mark at a file's start is not part of any line: three bytes less
    torn = F.col("last") & (F.col("used") - F.col("size")).isin(1, -2)
    return rows.where(~torn & F.is_valid_utf8("value")).where("trim(value) <> ''").select("path", "mtime", "pos", "value")


def unread(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Listed files (``path``, ``size``) of which no line came although they aren't empty: the failed ones."""
    return found.where("size > 0").join(rows.select("path").distinct(), "path", "left_anti").select("path", "size")


def readable(spark: SparkSession, root: str) -> bool:
    """Whether a transcript folder exists; one that doesn't is reported, never taken for an empty one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path))


def may_hold(rows: DataFrame, query: str) -> DataFrame:
    """Lines that may hold a literal, told before they are parsed.

    Only a needle that JSON writes in one way is looked for in raw lines: printable ASCII without quote,
    backslash and slash. For any other all lines stay.
    """
    if ranges.plain_needle(query) is None:
        return rows
    return rows.where(F.contains(F.lower("value"), F.lit(query.lower())))


def _get(v: Column, path: str, kind: str = "string") -> Column:
    """A value at a dotted path if it has the kind; a number where a string belongs is absent."""
    if not path:
        return F.lit(None).cast(kind)
    at = "$" + "".join(f"['{p}']" for p in path.split("."))
    if kind == "string":
        raw = F.try_variant_get(v, at, "variant")
        return F.when(F.schema_of_variant(raw) == "STRING", F.try_variant_get(v, at, "string"))
    return F.try_variant_get(v, at, kind)


def _blocks(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, "$" + "".join(f"['{p}']" for p in path.split(".")), "array<variant>"), F.array().cast("array<variant>"))


def _joined(blocks: Column, kinds: tuple[str, ...], name: str, sep: str = "") -> Column:
    """Texts of the blocks of some kinds, one after the other; the field is named like the kind by default."""
    if not kinds:
        return F.lit("")
    mine = F.filter(blocks, lambda b: F.try_variant_get(b, "$.type", "string").isin(*kinds))
    body = lambda b: F.coalesce(*[F.when(F.try_variant_get(b, "$.type", "string") == k, F.try_variant_get(b, f"$.{name or k}", "string")) for k in kinds])
    return F.array_join(F.filter(F.transform(mine, body), lambda t: t.isNotNull()), sep)


def _all_equal(v: Column, rules: tuple[dict, ...]) -> Column:
    out = F.lit(True)
    for r in rules:
        out = out & F.coalesce(_get(v, r["path"]) == r["equals"], F.lit(False))
    return out


def parse(rows: DataFrame, d: Descriptor, machine_id: str) -> DataFrame:
    """Every line with its fields: whether it is a turn (``is_turn``) or a compaction mark, place, titles, turn columns.

    Reasoning rules come first, then entry rules, then roles; the marker test precedes all of them.
    """
    if isinstance(d, Coded):
        return _coded(d.parser(rows), d, machine_id)
    v = F.try_parse_json("value")
    rows = rows.withColumn("v", v).where("v is not null")
    v = F.col("v")
    kind = _get(v, d.type_path)
    role_from = kind if d.role_source == "entry_type" else _get(v, d.role_path)
    role = F.when(role_from.isin(*d.user_roles), "user").when(role_from.isin(*d.assistant_roles), "assistant")
    content, blocks = _get(v, d.content_path), _blocks(v, d.content_path)
    text = F.coalesce(content, _joined(blocks, d.text_block, d.text_field))
    for path in d.text_fallbacks[::-1]:
        text = F.when(text == "", F.coalesce(_get(v, path), F.lit(""))).otherwise(text)
    if d.text_join:
        paths = d.text_join["paths"]
        joined = F.concat(F.lit(d.text_join.get("prefix", "")), F.concat_ws(d.text_join.get("sep", ""), *[F.coalesce(_get(v, p), F.lit("")) for p in paths]))
        text = F.when((text == "") & _get(v, paths[0]).isNotNull(), joined).otherwise(text)
    thinking = _joined(blocks, d.thinking_block, d.thinking_field)
    name = lambda b: F.coalesce(F.try_variant_get(b, f"$.{d.tool_name_field}", "string"), F.lit("?")).alias("name")
    digest = lambda b: F.left(F.coalesce(F.to_json(F.try_variant_get(b, f"$.{d.tool_input_field}", "variant")), F.lit("null")), F.lit(DIGEST_CHARS)).alias("input_digest")
    used = F.filter(blocks, lambda b: F.try_variant_get(b, "$.type", "string") == (d.tool_block or "\0"))
    calls = F.transform(used, lambda b: F.struct(name(b), digest(b)))
    opaque, tokens_in, tokens_out = F.lit(False), _get(v, d.usage_in_path, "long"), _get(v, d.usage_out_path, "long")
    no_calls = F.array().cast("array<struct<name:string,input_digest:string>>")
    for r in d.entry_rules[::-1]:
        mine = F.coalesce(kind == r["entry_type"], F.lit(False))
        said = _get(v, r["text_path"])
        role = F.when(mine, F.when(said.isNotNull(), F.lit(r["role"]))).otherwise(role)
        text, thinking, calls = F.when(mine, said).otherwise(text), F.when(mine, "").otherwise(thinking), F.when(mine, no_calls).otherwise(calls)
        tokens_in = F.when(mine, _get(v, "usage.input", "long")).otherwise(tokens_in)
        tokens_out = F.when(mine, _get(v, "usage.output", "long")).otherwise(tokens_out)
    for r in d.reasoning_rules[::-1]:
        mine = F.coalesce(kind == r["entry_type"], F.lit(False))
        thought = _joined(_blocks(v, r["text_path"]), (r["block_type"],), "text", "\n")
        sealed = F.lit(False)
        if r.get("opaque_path"):
            at = F.try_variant_get(v, "$" + "".join(f"['{p}']" for p in r["opaque_path"].split(".")), "variant")
            sealed = at.isNotNull() & ~F.coalesce(F.is_variant_null(at), F.lit(True))
        role = F.when(mine, F.when((thought != "") | sealed, "assistant")).otherwise(role)
        text, thinking, calls = F.when(mine, "").otherwise(text), F.when(mine, thought).otherwise(thinking), F.when(mine, no_calls).otherwise(calls)
        opaque = F.when(mine, sealed).otherwise(opaque)
    is_turn = _all_equal(v, d.require) & role.isNotNull()
    is_marker = _all_equal(v, d.compaction_markers) if d.compaction_markers else F.lit(False)
    title_user, title_ai = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in d.title_rules:
        stated = F.when(_get(v, "type") == r["entry_type"], _get(v, r["title_path"]))
        title_user, title_ai = (F.coalesce(stated, title_user), title_ai) if r["source"] == "user" else (title_user, F.coalesce(stated, title_ai))
    own = native_id(F.col("path"), d.native_id)
    return rows.select(
        F.concat_ws("/", F.lit(machine_id), F.lit(d.id), own).alias("session_id"),
        F.lit(machine_id).alias("machine_id"),
        F.lit(d.id).alias("runtime_id"),
        own.alias("native_id"),
        F.col("path").alias("source_path"),
        "mtime",
        "pos",
        F.coalesce(is_turn, F.lit(False)).alias("is_turn"),
        is_marker.alias("is_marker"),
        _get(v, d.compaction_keeps_from).alias("anchor"),
        _get(v, d.cwd_path).alias("cwd"),
        title_user.alias("title_user"),
        title_ai.alias("title_ai"),
        role.alias("role"),
        F.unix_millis(F.try_to_timestamp(_get(v, d.ts_path))).alias("ts"),
        text.alias("text"),
        thinking.alias("thinking"),
        F.coalesce(opaque, F.lit(False)).alias("opaque"),
        calls.alias("tool_calls"),
        tokens_in.alias("tokens_in"),
        tokens_out.alias("tokens_out"),
        _get(v, d.uuid_path).alias("uuid"),
        _get(v, d.parent_uuid_path).alias("parent_uuid"),
        _get(v, d.model_path).alias("model"),
        _get(v, d.cache_read_path, "long").alias("cache_read_tokens"),
        _get(v, d.cache_creation_path, "long").alias("cache_creation_tokens"),
        F.coalesce(_get(v, d.sidechain_path, "boolean"), F.lit(False)).alias("sidechain"),
    )


#: What the function of a coded format may return, beside ``path``, ``mtime`` and ``pos``; ``role`` and ``text`` it must.
CODED = {
    "role": "string", "text": "string", "ts": "bigint", "thinking": "string", "opaque": "boolean", "tool_calls": "array<struct<name:string,input_digest:string>>", "is_marker": "boolean", "anchor": "string", "cwd": "string",
    "title_user": "string", "title_ai": "string", "tokens_in": "bigint", "tokens_out": "bigint", "uuid": "string", "parent_uuid": "string", "model": "string", "cache_read_tokens": "bigint", "cache_creation_tokens": "bigint", "sidechain": "boolean",
}


def _coded(rows: DataFrame, d: Coded, machine_id: str) -> DataFrame:
    """What a coded format returned, checked, with the columns of ``parse``."""
    kinds = dict(rows.dtypes)
    lacking = [c for c in ("path", "mtime", "pos", "role", "text") if c not in kinds]
    odd = [f"{c} {kinds[c]}" for c in rows.columns if c not in ("path", "mtime", "pos") and CODED.get(c) != kinds[c]]
    if lacking or odd:
        raise ValueError(f"format {d.id}: " + "; ".join([f"no column {c}" for c in lacking] + [f"unknown column or type: {c}" for c in odd]))
    own = native_id(F.col("path"), d.native_id)
    blank = {"thinking": F.lit(""), "tool_calls": F.array(), "opaque": F.lit(False), "is_marker": F.lit(False), "sidechain": F.lit(False)}

    def col(name: str) -> Column:
        held = F.col(name) if name in kinds else F.lit(None)
        return (F.coalesce(held, blank[name]) if name in blank else held).cast(CODED[name]).alias(name)

    known = F.when(F.col("role").isin(*d.user_roles), "user").when(F.col("role").isin(*d.assistant_roles), "assistant")
    return rows.select(
        F.concat_ws("/", F.lit(machine_id), F.lit(d.id), own).alias("session_id"),
        F.lit(machine_id).alias("machine_id"),
        F.lit(d.id).alias("runtime_id"),
        own.alias("native_id"),
        F.col("path").alias("source_path"),
        "mtime",
        "pos",
        (known.isNotNull() & F.col("text").isNotNull()).alias("is_turn"),
        *[col(c) for c in ("is_marker", "anchor", "cwd", "title_user", "title_ai")],
        known.alias("role"),
        *[col(c) for c in CODED if c not in ("role", "is_marker", "anchor", "cwd", "title_user", "title_ai")],
    )


TURN = ["session_id", "machine_id", "runtime_id", "native_id", "seq", "role", "ts", "text", "thinking", "opaque", "thinking_state", "tool_calls", "tokens_in", "tokens_out", "uuid", "parent_uuid", "model", "cache_read_tokens", "cache_creation_tokens", "surface", "sidechain"]


def tables(parsed: DataFrame, d: Descriptor) -> tuple[DataFrame, DataFrame]:
    """The turn and session tables of parsed lines, redacted, compacted and rolled up."""
    turns, sessions, marks = chunk(parsed, d)
    return fold.compact(turns, marks, bool(d.compaction_markers)).select(TURN), sessions.where("turn_count > 0")


def chunk(parsed: DataFrame, d: Descriptor, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Turns, session rows and compaction marks of some lines of sessions; numbers go on from ``known`` (``session_id``, ``seq``).

    Turns have no ``surface`` yet, as marks may come later; sessions without a turn among these lines count 0.
    """
    from colloquy.functions.text import thinking_state

    hidden = F.transform("tool_calls", lambda t: F.struct(t["name"].alias("name"), scrub(t["input_digest"]).alias("input_digest")))
    turns = fold.number_turns(parsed.where("is_turn"), known)
    turns = turns.withColumns({"text": scrub(F.col("text")), "thinking": scrub(F.col("thinking")), "tool_calls": hidden, "thinking_state": thinking_state(F.col("thinking"), F.col("opaque"))})
    turns = turns.select([c for c in TURN if c != "surface"])
    marks = fold.boundaries(parsed, F.col("is_turn"), F.col("is_marker"), F.col("anchor"))
    if d.compaction_keeps_from:
        marks = marks.where("anchor is not null")
    if known is not None:
        marks = marks.join(known.groupBy("session_id").agg(F.max("seq").alias("_last")), "session_id", "left").withColumn("at", F.col("at") + F.coalesce("_last", F.lit(0))).drop("_last")
    last = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.trim(c)), F.when(F.col(c).isNotNull(), F.col("pos")))
    first = F.min_by(F.when(F.col("cwd").isNotNull(), F.col("cwd")), F.when(F.col("cwd").isNotNull(), F.col("pos")))
    said = F.col("is_turn") & (F.col("role") == "user") & (F.col("text") != "")
    derived = F.left(F.min_by(F.when(said, F.col("text")), F.when(said, F.col("pos"))), F.lit(TITLE_CHARS))
    meta = parsed.groupBy("session_id", "machine_id", "runtime_id", "native_id").agg(first.alias("cwd"), F.nullif(last("title_user"), F.lit("")).alias("title_user"), F.nullif(last("title_ai"), F.lit("")).alias("title_ai"), scrub(derived).alias("title_derived"), F.max("source_path").alias("source_path"), F.max("mtime").alias("mtime"))
    sessions = meta.join(fold.rollup(turns), "session_id", "left").withColumn("turn_count", F.coalesce("turn_count", F.lit(0)))
    return turns, sessions, marks
