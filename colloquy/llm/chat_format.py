"""Chat formatting with a grammar round trip.

A conversation is rendered as ``### <role>: <text></turn>\\n`` per turn. The rendered text is parsed
again by a deterministic parser; any turn whose text does not come back unchanged is rendered anew
one escape level higher, until the parsed turns equal the source. Level 0 is the raw text; level 1,
announced by ``\\:`` after the role, puts a backslash before every backslash, ``#`` and ``<``, so that
neither control string can occur in it; level 1 always comes back, so the loop ends.

Conversations are read as streams sorted by (conversation, turn) within hash partitions; a task
holds one conversation at a time, rendered as one text, which must stay below 2 GB (an Arrow string).

Defined cases: a null text or role is empty; turns with equal numbers are ordered by role, then text;
repeated rows are turns of their own; a null conversation id is a conversation of its own; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", "</turn>\n"
_HEAD = re.compile(r"### ([^:\\\s]*)(\\?): ")
_CONTROL = re.compile(r"###|</turn>")
_ESCAPED_CONTROL = re.compile(r"\\.|###|</turn>", re.DOTALL)
_SPECIAL = re.compile(r"[\\#<]")
_PAIR = re.compile(r"\\(.)", re.DOTALL)
#: Roles whose text is under the loss mask.
LOSS_ROLES = ("assistant",)
SCHEMA = "conv_id long, formatted string, loss_spans array<struct<start: long, stop: long>>, rounds int"


class GrammarError(ValueError):
    """The rendered text is not a sequence of turns."""


def _role(name: str) -> str:
    return quote(name, safe="")


def render(turns: list[tuple[str, str]], levels: list[int]) -> tuple[str, list[tuple[int, int]]]:
    """The text of all turns and, for each turn, the span of its body in it."""
    parts, spans, at = [], [], 0
    for (role, text), level in zip(turns, levels, strict=True):
        head = f"{OPEN}{_role(role)}{'\\' if level else ''}: "
        body = _SPECIAL.sub(lambda m: "\\" + m[0], text) if level else text
        spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, CLOSE)
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """The turns (role, text, start and stop of the body) of a rendered text, or GrammarError."""
    turns, at = [], 0
    while at < len(formatted):
        head = _HEAD.match(formatted, at)
        if not head:
            raise GrammarError(f"no turn begins at {at}")
        pattern, stop = _ESCAPED_CONTROL if head[2] else _CONTROL, head.end()
        while True:
            m = pattern.search(formatted, stop)
            if not m:
                raise GrammarError(f"the turn at {at} doesn't end")
            if m[0][0] != "\\":
                break
            stop = m.end()
        if not formatted.startswith(CLOSE, m.start()):
            raise GrammarError(f"a control string stands inside the turn at {at}")
        body = formatted[head.end() : m.start()]
        turns.append((unquote(head[1]), _PAIR.sub(r"\1", body) if head[2] else body, head.end(), m.start()))
        at = m.start() + len(CLOSE)
    return turns


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]], int]:
    """Rendered text, body spans, and the number of renderings until the round trip was identical.

    Each turn's text is first tried on its own, so one conflicting turn never raises the level of the others.
    """
    levels, rounds = [0] * len(turns), 0
    while True:
        rounds += 1
        out, spans = render(turns, levels)
        try:
            if [t[:2] for t in parse(out)] == turns:
                return out, spans, rounds
        except GrammarError:
            pass
        for i, turn in enumerate(turns):
            if levels[i] == 0:
                try:
                    alone = [t[:2] for t in parse(render([turn], [0])[0])] == [turn]
                except GrammarError:
                    alone = False
                levels[i] = 0 if alone else 1


def _groups(batches):
    """(conversation id, turns) of batches sorted by conversation and turn."""
    key, turns, begun = None, [], False
    for b in batches:
        for k, role, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if begun and k != key:
                yield key, turns
                turns = []
            key, begun = k, True
            turns.append((role or "", text or ""))
    if begun:
        yield key, turns


def _format_batches(batches):
    rows = {"conv_id": [], "formatted": [], "loss_spans": [], "rounds": []}
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("rounds", pa.int32())])
    size = 0
    for key, turns in _groups(batches):
        out, spans, rounds = format_turns(turns)
        rows["conv_id"].append(key)
        rows["formatted"].append(out)
        rows["loss_spans"].append([{"start": a, "stop": b} for (a, b), (role, _) in zip(spans, turns, strict=True) if role in LOSS_ROLES])
        rows["rounds"].append(rounds)
        size += len(out)
        if size > 4_000_000:
            yield pa.RecordBatch.from_pydict(rows, schema=schema)
            rows, size = {k: [] for k in rows}, 0
    yield pa.RecordBatch.from_pydict(rows, schema=schema)


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted``, ``loss_spans`` (code points), ``rounds``."""
    rows = turns.select(F.col("conv_id").cast("long"), "role", "text", "turn")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(_format_batches, SCHEMA)


def _read_batches(batches):
    from hashlib import sha256

    for b in batches:
        out = {k: [] for k in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
        for key, formatted, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            turns, whole, loss, chars = parse(formatted), sha256(), sha256(), 0
            texts = {(start, stop): text for _, text, start, stop in turns}
            for role, text, _, _ in turns:
                whole.update(f"{role}\n{text}\n".encode())
            for span in spans:
                text = texts[span["start"], span["stop"]]
                loss.update(text.encode())
                chars += len(text)
            for k, v in zip(out, (key, len(turns), whole.hexdigest(), chars, loss.hexdigest(), len(formatted)), strict=True):
                out[k].append(v)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what a reader of the formatted text recovers from it and its loss mask."""
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(_read_batches, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
