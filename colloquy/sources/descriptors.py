"""Runtime descriptors: where a transcript format keeps what a turn needs. Data, not code, but for formats that no description fits."""

from __future__ import annotations

import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Descriptor:
    """One transcript format; every path is dotted, an empty one is absent."""

    id: str
    root: str = ""
    name: str = ""
    native_id: str = "stem"
    role_source: str = "entry_type"
    role_path: str = "message.role"
    user_roles: tuple[str, ...] = ("user",)
    assistant_roles: tuple[str, ...] = ("assistant",)
    type_path: str = "type"
    ts_path: str = "timestamp"
    cwd_path: str = "cwd"
    content_path: str = "message.content"
    usage_in_path: str = ""
    usage_out_path: str = ""
    text_block: tuple[str, ...] = ("text",)
    text_field: str = ""
    thinking_block: tuple[str, ...] = ()
    thinking_field: str = ""
    tool_block: str = ""
    tool_name_field: str = "name"
    tool_input_field: str = "input"
    entry_rules: tuple[dict, ...] = ()
    reasoning_rules: tuple[dict, ...] = ()
    title_rules: tuple[dict, ...] = ()
    compaction_markers: tuple[dict, ...] = ()
    compaction_keeps_from: str = ""
    require: tuple[dict, ...] = ()
    text_fallbacks: tuple[str, ...] = ()
    text_join: dict = field(default_factory=dict)
    uuid_path: str = ""
    parent_uuid_path: str = ""
    model_path: str = ""
    cache_read_path: str = ""
    cache_creation_path: str = ""
    sidechain_path: str = ""
    dir_depth: int = 1
    nested_dir: str = ""
    suffix: str = ".jsonl"
    capabilities: dict = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> Descriptor:
        """From TOML; unknown keys, a missing id or unusable rules are errors."""
        raw = tomllib.loads(text)
        known = {f.name: f for f in fields(cls)}
        if odd := sorted(set(raw) - set(known)):
            raise ValueError(f"unknown keys: {', '.join(odd)}")
        if not raw.get("id"):
            raise ValueError("a descriptor needs an id")
        for k in ("text_block", "thinking_block"):
            if isinstance(raw.get(k), str):
                raw[k] = [raw[k]] if raw[k] else []
        if raw.get("native_id", "stem") not in ("stem", "after_underscore", "trailing_uuid"):
            raise ValueError(f"unknown rule for ids: {raw['native_id']}")
        if raw.get("role_source", "entry_type") not in ("entry_type", "message_role"):
            raise ValueError(f"unknown source of roles: {raw['role_source']}")
        if raw.get("text_join") and set(raw["text_join"]) - {"prefix", "paths", "sep"}:
            raise ValueError("unknown keys in text_join")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})


@dataclass(frozen=True)
class Coded(Descriptor):
    """A format read by a function from lines (``path``, ``mtime``, ``pos``, ``value``) to rows.

    The rows keep ``path``, ``mtime`` and ``pos`` and have ``role`` and ``text``, and any more of ``transcripts.CODED``
    with the type stated there; what they lack is absent. A row of no known role is no turn. Files are found,
    numbered, redacted and rolled up as for any other format.
    """

    parser: Callable[[DataFrame], DataFrame] = lambda rows: rows


#: The three transcript formats known without a file.
BUILT_IN = [
    Descriptor(
        id="claude_code", root="~/.claude/projects", name="Claude Code", usage_in_path="message.usage.input_tokens", usage_out_path="message.usage.output_tokens",
        thinking_block=("thinking",), tool_block="tool_use", uuid_path="uuid", parent_uuid_path="parentUuid", sidechain_path="isSidechain", nested_dir="subagents", model_path="message.model",
        cache_read_path="message.usage.cache_read_input_tokens", cache_creation_path="message.usage.cache_creation_input_tokens",
        title_rules=({"entry_type": "custom-title", "title_path": "customTitle", "source": "user"}, {"entry_type": "ai-title", "title_path": "aiTitle", "source": "ai"}),
        compaction_markers=({"path": "type", "equals": "system"}, {"path": "subtype", "equals": "compact_boundary"}),
    ),
    Descriptor(
        id="pi", root="~/.pi/agent/sessions", name="pi", native_id="after_underscore", role_source="message_role",
        user_roles=("user", "toolResult", "bashExecution", "custom"), assistant_roles=("assistant", "branchSummary", "compactionSummary"), usage_in_path="message.usage.input", usage_out_path="message.usage.output",
        thinking_block=("thinking",), tool_block="toolCall", tool_input_field="arguments", text_fallbacks=("message.summary",), uuid_path="id", parent_uuid_path="parentId", model_path="modelId",
        entry_rules=({"entry_type": "compaction", "role": "assistant", "text_path": "summary"}, {"entry_type": "branch_summary", "role": "assistant", "text_path": "summary"}, {"entry_type": "custom_message", "role": "user", "text_path": "content"}),
        text_join={"prefix": "$ ", "paths": ["message.command", "message.output"], "sep": "\n"}, title_rules=({"entry_type": "session_info", "title_path": "name", "source": "user"},),
        compaction_markers=({"path": "type", "equals": "compaction"},), compaction_keeps_from="firstKeptEntryId",
    ),
    Descriptor(
        id="codex", root="~/.codex/sessions", name="Codex", dir_depth=3, native_id="trailing_uuid", type_path="payload.type", cwd_path="payload.cwd", content_path="payload.content",
        role_source="message_role", role_path="payload.role", user_roles=("user", "developer"), text_block=("output_text", "input_text"), text_field="text", tool_block="function_call", tool_input_field="arguments",
        require=({"path": "type", "equals": "response_item"},), reasoning_rules=({"entry_type": "reasoning", "text_path": "payload.summary", "block_type": "summary_text", "opaque_path": "payload.encrypted_content"},),
        compaction_markers=({"path": "type", "equals": "compacted"},),
    ),
]


#: Formats that were registered in code, by id.
REGISTERED: dict[str, Coded] = {}


def register(d: Coded) -> None:
    """Make a coded format known to ``load``; an id is registered once."""
    if not d.id or d.id in REGISTERED or d.id in {x.id for x in BUILT_IN}:
        raise ValueError(f"a format needs an id of its own, not {d.id!r}")
    REGISTERED[d.id] = d


def load(folder: str | None = None) -> tuple[dict[str, Descriptor], dict[str, str]]:
    """All descriptors by id, files of ``folder`` over registered and built-in ones, and what was wrong with skipped files."""
    found, wrong = {d.id: d for d in BUILT_IN} | REGISTERED, {}
    for path in sorted(Path(folder).glob("*.toml")) if folder else []:
        try:
            d = Descriptor.parse(path.read_text())
        except (ValueError, TypeError, OSError) as e:
            wrong[path.name] = str(e)
            continue
        found[d.id] = d
    return found, wrong


def overrides(folder: str) -> dict[str, bool]:
    """Built-in ids that files of ``folder`` restate: True where the file says the same."""
    own = {d.id: d for d in BUILT_IN}
    out = {}
    for path in sorted(Path(folder).glob("*.toml")):
        try:
            d = Descriptor.parse(path.read_text())
        except (ValueError, TypeError, OSError):
            continue
        if d.id in own:
            out[d.id] = d == own[d.id]
    return out
