"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is modelled as its words (A-Z lower-cased, split at white space) with one blank between them and
an end mark. A token is a word with the blank or end mark after it. Its bytes are written as six bits each:
the 63 bytes of ``COMMON`` have codes of their own, code 63 announces any other byte, whose eight bits
follow. Every bit is predicted by ``K`` bit predictors, each looking up the bit's history under a hash of
its own context inside the word: the last one to four bytes, and the whole word so far. Their log-odds are
mixed with weights that a gate chooses by how well the longer contexts are known; an adaptive
probability map refines the mix. Every probability depends on earlier bytes of the token only and each
bit's two probabilities add up to one, so the score is the log-probability of the normalised text;
``bits_per_byte`` divides it by the text's own bytes in UTF-8.

As no context reaches back over a blank, equal words cost the same wherever they stand. So everything is
worked out once for each distinct word, with its number of occurrences as weight, which gives the sums
that a pass over every token of the corpus would:

1. All words are counted, exactly (``words``): how often each stands before a blank and before an end.
2. The counts of symbols after the contexts of up to four bytes are summed over all words into tables
   of fixed size (``SLOT_BITS``; such contexts are few in any corpus) and sent to all tasks.
3. Words are dealt by their first bytes, so a task holds all words that share a longer beginning: the
   contexts of the whole word so far are counted exactly there, in tables as large as they must be. They
   grow with the corpus and are never sent anywhere. Words are dealt by their first four bytes, those of a
   beginning that more than ``TASK_WORDS`` words share by eight or sixteen (``DEPTHS``); a context that is
   shorter than a word was dealt by is counted in one more shared table.
4. The mixing weights and the probability map are learned online from all words, block by block, every
   occurrence being predicted by the counts of all others (its own is taken off). The pass goes in rounds
   (``ROUNDS``): a round's tasks go on from what the rounds before have learned, and their weights are
   averaged by their bits.
5. Every distinct word, held-out ones included, is given its cost; texts add up the costs of their tokens.

One more bit stands before each sentence (words up to one that ends in ``.``, ``!`` or ``?``, at least
``LEAST_SENTENCE`` and at most ``MOST_SENTENCE`` of them): whether it comes as a whole, as a sentence of the
corpus. Training sentences are counted exactly, by a 64-bit hash; those that a training text has itself brought
are taken off when it is scored, so that training and other texts are scored alike. The bit is predicted online: a text begins
with the corpus' share of sentences that recur and goes on with what its own sentences so far were. The two
ways to come by a sentence are added up, so a score is still the log-probability of the text.

The most frequent words' costs and counts (at most ``HEAD_WORDS``) are looked up in the tasks, all others
are joined by word; both ways give the same numbers. Neither scores nor counts depend on how the input is
split into files.

Defined cases: a null or empty text is the end mark alone; rows may repeat and are scored each; a null
``doc_id`` is not held out; ids are integers; with no training document all counts are 0; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.words import hold, mix
from colloquy.session import forget, materialize

#: Fixed code of the model: the bytes with six-bit codes of their own; the line feed is the end mark.
COMMON = b" \nabcdefghijklmnopqrstuvwxyz.,'-\"!?:;()0123456789\xc3\xa9\xa8\xa0\xb3\xb1\xad\x9f\xb6\xbc\xa4\xaa\xa7\xa1"
BITS, CODES = 6, 64
OTHER = CODES - 1
BLANK, END = 0, 1
#: Bytes of context of the bit predictors and the sizes of their tables; one more sees the word so far.
ORDERS = (1, 2, 3, 4)
SLOT_BITS = (9, 12, 14, 16)
#: Words are dealt by so many first bytes; shorter beginnings are counted in a table of this size.
DEPTHS, SHORT_BITS = (4, 8, 16), 15
K = len(ORDERS) + 1
#: Positions that are predicted between two corrections of the weights.
BLOCK = 4096
#: Added to the counts of ones and zeros before their log-odds are taken.
PRIOR = np.float32(0.2)
RATE = 0.15
#: Where the rounds begin in which weights are learned, and the last one's end, in shares of the beginnings.
ROUNDS = (0, 1, 4, 16)
HEAD_WORDS, HEAD_WORD_BYTES = 300_000, 64
LEAST_SENTENCE, MOST_SENTENCE = 8, 128
#: Sentences that the corpus' share of recurring ones stands for at a text's beginning.
SHARE_WEIGHT = 2.0
#: Words a task aims at when they are dealt, and bytes of text of a batch when they are scored or counted.
TASK_WORDS, BATCH, COUNTED_WORDS = 30_000, 1 << 20, 600_000
#: Beginnings whose dense tables a task holds at once.
TABLE_ROWS = 1 << 15
_PAD = max(ORDERS)
_GATES = 16
_STEPS = 33
_SLICES = 16
_TABLES = (*SLOT_BITS, SHORT_BITS)
_CODE = np.full(256, OTHER, np.uint8)
_CODE[np.frombuffer(COMMON, np.uint8)] = np.arange(len(COMMON))
_C = np.arange(CODES)
_NODE = np.stack([(1 << j) | (_C >> (BITS - j)) for j in range(BITS)], 1).astype(np.int64)
_BIT = np.stack([(_C >> (BITS - 1 - j)) & 1 for j in range(BITS)], 1).astype(np.float32)
#: Nodes on a code's way down a binary tree whose leaves are the codes, the leaf included.
_WAY = np.concatenate([_NODE, CODES + _C[:, None]], 1)
_IS_STOP = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))
_MUL = 0x9E3779B97F4A7C15
_INV = pow(_MUL, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64."""
    both = []
    for m in (_MUL, _INV):
        steps = np.full(n, m, np.uint64)
        steps[:1] = 1
        both.append(np.cumprod(steps, dtype=np.uint64))
    return both[0], both[1]


class Types:
    """Distinct words as one array of symbols with each predictor's context.

    A position is a byte of a word or one of its two endings: the blank, or the end mark, which stands
    right after it in the arrays. ``weight`` is how often the position's symbol came in training. Beginnings
    of ``depth`` bytes or more are counted exactly from the words held here (``long``).
    """

    def __init__(self, words: list[bytes], mid: np.ndarray, last: np.ndarray, depth: np.ndarray):
        size = np.array([len(w) for w in words], np.int64)
        x = np.frombuffer(b"\0" * _PAD + (b" \n" + b"\0" * _PAD).join(words) + b" \n", np.uint8)
        ends = np.cumsum(size + 2 + _PAD)
        begins = ends - size - 2
        self.size, self.first = size, np.cumsum(size + 2) - (size + 2)
        self.owner = np.repeat(np.arange(len(words)), size + 2)
        place = np.arange(len(self.owner)) - self.first[self.owner]
        at = begins[self.owner] + place
        self.x = x[at]
        # both endings have the context of the word's end
        is_end = place == size[self.owner] + 1
        seen = at - is_end
        self.code = _CODE[self.x]
        self.weight = np.where(place < size[self.owner], (mid + last)[self.owner], np.where(is_end, last[self.owner], mid[self.owner])).astype(np.float64)
        wide = x.astype(np.uint64)
        self.slots = []
        for order, bits in zip(ORDERS, SLOT_BITS, strict=True):
            h = np.full(len(at), order, np.uint64)
            for back in range(1, order + 1):
                h = (h + wide[seen - back] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(32)
            self.slots.append((h >> np.uint64(64 - bits)).astype(np.int64))
        up, down = _powers(len(x) + 1)
        total = np.concatenate([[np.uint64(0)], np.cumsum((wide + np.uint64(1)) * up[: len(x)], dtype=np.uint64)])
        start = begins[self.owner]
        so_far = mix((total[seen] - total[start]) * down[start] + np.minimum(place - is_end, 1 << 30).astype(np.uint64))
        self.long = place - is_end >= depth[self.owner]
        self.slots.append((so_far >> np.uint64(64 - SHORT_BITS)).astype(np.int64))
        self.prefixes, ids = np.unique(so_far[self.long], return_inverse=True)
        self.exact = np.zeros(len(at), np.int64)
        self.exact[self.long] = ids
        self.before = np.where(place > 0, x[seen - 1], 0)
        self.rare = np.flatnonzero(self.code == OTHER)

    def chunks(self, at: np.ndarray):
        """Positions ``at`` in chunks of few beginnings, with the counts of all nodes after each of these.

        Positions of one beginning come in one chunk, all others are spread over the chunks alike.
        """
        rows = max(1, len(self.prefixes))
        key = np.where(self.long[at], self.exact[at], (mix(at.astype(np.uint64)) % np.uint64(rows)).astype(np.int64))
        cuts = np.arange(0, rows + TABLE_ROWS, TABLE_ROWS)
        order, ends = _by_chunk(key, len(cuts))
        whole = np.flatnonzero(self.long)
        by_row, bounds = _by_chunk(self.exact[whole], len(cuts))
        by_row = whole[by_row]
        for i in range(len(cuts) - 1):
            mine = by_row[bounds[i] : bounds[i + 1]]
            cells = (self.exact[mine] - cuts[i]) * CODES + self.code[mine]
            many = max(1, min(TABLE_ROWS, rows - int(cuts[i])))
            yield at[order[ends[i] : ends[i + 1]]], int(cuts[i]), _nodes(np.bincount(cells, self.weight[mine], many * CODES))


def _by_chunk(rows: np.ndarray, chunks: int) -> tuple[np.ndarray, np.ndarray]:
    """An order in which rows of one chunk stand together, as they came, and where each chunk begins.

    Chunks' numbers are small, so sorting these is much cheaper than sorting the rows.
    """
    number = rows // TABLE_ROWS
    order = np.argsort(number.astype(np.uint16 if chunks < 1 << 16 else np.int64), kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(number, minlength=chunks)[: chunks - 1])])


def _known(n: np.ndarray) -> np.ndarray:
    """How well a context with so many symbols is known: 0 to 3."""
    return (n > 0).astype(np.int64) + (n >= 4) + (n >= 64)


class Tables:
    """Counts of symbols after the contexts that all tasks share, and of other bytes after each byte."""

    def __init__(self):
        self.counts = [np.zeros(CODES << b, np.float64) for b in _TABLES]
        self.literal = np.zeros(1 << 16, np.float64)

    def add(self, t: Types) -> None:
        for number, (table, slot) in enumerate(zip(self.counts, t.slots, strict=True)):
            keep = ~t.long if number == len(ORDERS) else slice(None)
            np.add.at(table, slot[keep] * CODES + t.code[keep], t.weight[keep])
        np.add.at(self.literal, t.before[t.rare].astype(np.int64) * 256 + t.x[t.rare], t.weight[t.rare])

    def __getstate__(self) -> dict:
        """What is sent to the tasks: mostly zeros, so it is small when compressed."""
        return {"counts": [zlib.compress(c.astype(np.float32).tobytes(), 1) for c in self.counts], "literal": self.literal}

    def __setstate__(self, state: dict) -> None:
        self.counts = [np.frombuffer(zlib.decompress(c), np.float32) for c in state["counts"]]
        self.literal = state["literal"]

    def ready(self) -> Tables:
        """Counts of all nodes of each context's tree, for prediction."""
        self.nodes = [_nodes(c) for c in self.counts]
        self.counts = []
        one, two = self.literal.reshape(256, 256), self.literal.reshape(256, 256).sum(0)[None, :]
        odds, byte = _log_odds(one, 8) * 0.75 + _log_odds(two, 8) * 0.25, np.arange(256)
        self.other = np.zeros((256, 256))
        for j in range(8):
            y = 2.0 * ((byte >> (7 - j)) & 1) - 1
            self.other -= np.log1p(np.exp(-y * odds[:, (1 << j) | (byte >> (8 - j))]))
        # bytes with a code of their own never come this way
        self.other[:, _CODE != OTHER] = -np.inf
        self.other -= np.log(np.exp(self.other).sum(1))[:, None]
        return self


def _nodes(counts: np.ndarray) -> np.ndarray:
    """Counts of symbols after contexts, one after the other, as counts of all nodes of their trees: 2 * CODES each."""
    level = counts.reshape(-1, CODES).astype(np.float32)
    out = np.zeros((len(level), 2 * CODES), np.float32)
    for j in range(BITS, -1, -1):
        out[:, 1 << j : 2 << j] = level
        level = level[:, 0::2] + level[:, 1::2] if j else level
    return out.ravel()


def _log_odds(counts: np.ndarray, depth: int) -> np.ndarray:
    """Per context and tree node, log-odds of a one bit."""
    level = counts.reshape(-1, 1 << depth).astype(np.float32)
    out = np.zeros(level.shape, np.float32)
    for j in range(depth - 1, -1, -1):
        zero, one = level[:, 0::2], level[:, 1::2]
        out[:, 1 << j : 2 << j] = np.log((one + PRIOR) / (zero + PRIOR))
        level = zero + one
    return out


class Mixer:
    """Gated weights and the adaptive probability map."""

    def __init__(self):
        self.weights = np.full((_GATES, BITS, K), 0.25, np.float64)
        # hits of ones and zeros for each tree node and step of the mixed log-odds
        centre = 1 / (1 + np.exp(-(np.arange(_STEPS) - _STEPS // 2) * 28 / (_STEPS - 1)))
        self.map = np.stack([np.tile(1 - centre, (CODES, 1)), np.tile(centre, (CODES, 1))], 2) * 64
        self.bits = 0.0

    @staticmethod
    def inputs(t: Types, tables: Tables, own: np.ndarray, base: int, at: np.ndarray, less: float) -> tuple[list[np.ndarray], np.ndarray]:
        """Log-odds of the bits that came, by each predictor (positions, bits), and gates at some positions.

        ``own`` has the node counts for beginnings from number ``base`` on. ``less`` occurrences of the
        position's own symbol are taken off all counts first.
        """
        way = _WAY[t.code[at]]
        odds, known = [], []
        for number in range(K):
            n = tables.nodes[number].take((t.slots[number][at] * (2 * CODES))[:, None] + way)
            if number == K - 1:
                long = np.flatnonzero(t.long[at])
                n[long] = own.take(((t.exact[at[long]] - base) * (2 * CODES))[:, None] + way[long])
            came, other = n[:, 1:], n[:, :-1] - n[:, 1:]
            if less:
                came = np.maximum(came - np.float32(less), 0)
            known.append(_known(n[:, 0] - less))
            odds.append(np.log((came + PRIOR) / (np.maximum(other, 0) + PRIOR)))
        return odds, known[-1] * 4 + known[-2]

    def mixed(self, odds: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        """Mixed log-odds of the bits that came."""
        w = np.ascontiguousarray(np.moveaxis(self.weights, 2, 0)).astype(np.float32)
        out = odds[0] * w[0].take(gate, 0)
        for k in range(1, K):
            out += odds[k] * w[k].take(gate, 0)
        return np.clip(out, -14, 14, out=out)

    @staticmethod
    def _step(x: np.ndarray) -> np.ndarray:
        return (x * ((_STEPS // 2) / 14) + (_STEPS // 2 + 0.5)).astype(np.int64)

    def learn(self, t: Types, tables: Tables) -> None:
        """Predict all positions block by block, correcting the gated weights after each block.

        Blocks are drawn from all words alike. A position counts as often as it came in training. A
        correction is a damped Newton step on the diagonal, per gate, bit and predictor.
        """
        for at, base, own in t.chunks(np.flatnonzero(t.weight > 0)):
            at = at[np.argsort(mix(at.astype(np.uint64) + np.uint64(1)))]
            for low in range(0, len(at), BLOCK):
                self._learn_block(t, tables, own, base, at[low : low + BLOCK])

    def _learn_block(self, t: Types, tables: Tables, own: np.ndarray, base: int, some: np.ndarray) -> None:
        o, g = self.inputs(t, tables, own, base, some, 1.0)
        code, times = t.code[some], t.weight[some].astype(np.float32)[:, None]
        b = _BIT[code]
        each = (g[:, None] * BITS + np.arange(BITS)).ravel()
        x = self.mixed(o, g)
        p = 1 / (1 + np.exp(-x))
        miss, curve = (1 - p) * times, np.maximum(p * (1 - p), np.float32(0.06)) * times
        for k in range(K):
            up, down = miss * o[k], curve * o[k] * o[k]
            n = BITS * _GATES
            step = np.bincount(each, up.ravel(), n) / (np.bincount(each, down.ravel(), n) + 20)
            self.weights[:, :, k] += RATE * step.reshape(_GATES, BITS)
        place = _NODE[code] * _STEPS + self._step((2 * b - 1) * x)
        whole = np.broadcast_to(times, b.shape)
        for value in (0, 1):
            hit = np.bincount(place[b == value], whole[b == value], CODES * _STEPS)
            self.map[:, :, value] += hit.reshape(CODES, _STEPS)
        self.bits += float(BITS * times.sum())

    def costs(self, t: Types, tables: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log probability of each word's bytes, of a blank after it, and of the end mark after it."""
        out = np.zeros(len(t.x))
        refined = np.log(self.map[:, :, 1] / self.map[:, :, 0]).astype(np.float32).ravel()
        for chunk, base, own in t.chunks(np.arange(len(out))):
            for low in range(0, len(chunk), 2 * BLOCK):
                at = chunk[low : low + 2 * BLOCK]
                o, g = self.inputs(t, tables, own, base, at, 0.0)
                code = t.code[at]
                x, y = self.mixed(o, g), 2 * _BIT[code] - 1
                twice = refined[_NODE[code] * _STEPS + self._step(y * x)]
                # the refined and the mixed probability are averaged as probabilities of the bit that came
                p = (1 / (1 + np.exp(-x)) + 1 / (1 + np.exp(-y * twice))) / 2
                out[at] = np.log(p).sum(1)
        if len(t.rare):
            out[t.rare] += tables.other[t.before[t.rare], t.x[t.rare]]
        end = t.first + t.size + 1
        body = np.add.reduceat(out, np.stack([t.first, end - 1], 1).ravel())[::2] if len(end) else np.zeros(0)
        return np.where(t.size > 0, body, 0.0), out[end - 1], out[end]


def held_out() -> Column:
    """Whether a document is kept from training: crc32 of its id as text, mod 7, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


# -- learning

_WORD = "word binary, mid long, last long"


def tokens(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text in UTF-8, A-Z lower-cased."""
    return text.lower().split() if text else []


def _stops(words: list[bytes]) -> list[int]:
    """How many words there are up to each one that ends in a stop."""
    x = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    blank = np.flatnonzero(x == 32)
    return (np.flatnonzero(_IS_STOP[x[blank - 1]]) + 1).tolist() if words else []


def sentences(words: list[bytes]) -> list[int]:
    """Where the sentences of a text end."""
    cuts, low = [], 0
    for end in _stops(words):
        while end - low > MOST_SENTENCE:
            low += MOST_SENTENCE
            cuts.append(low)
        if end - low >= LEAST_SENTENCE:
            cuts.append(end)
            low = end
    while len(words) - low > MOST_SENTENCE:
        low += MOST_SENTENCE
        cuts.append(low)
    if low < len(words):
        cuts.append(len(words))
    return cuts


def keys(words: list[bytes], cuts: list[int]) -> list[bytes]:
    """The sentences' keys, which stand among words but are none, as they begin with a line feed."""
    return [b"\n" + xxhash.xxh3_64_digest(b" ".join(words[a:b])) for a, b in zip([0, *cuts], cuts, strict=False)]


def _count(batches):
    """Words, and keys of sentences, with how often they stand before a blank and before an end in training
    texts; words of other texts with 0."""
    mid, last, rest = Counter(), Counter(), set()

    def flush():
        nonlocal rest
        rest -= mid.keys()
        words = [*mid, *(last.keys() - mid.keys()), *(rest - last.keys())]
        for low in range(0, len(words), 20_000):
            some = words[low : low + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), pa.array([mid.get(w, 0) for w in some], pa.int64()), pa.array([last.get(w, 0) for w in some], pa.int64())], ["word", "mid", "last"])
        mid.clear()
        last.clear()
        rest = set()

    for b in batches:
        for text, learned in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            own = tokens(text.as_py())
            if learned:
                last[own[-1] if own else b""] += 1
                if own:
                    mid.update(own)
                    mid[own[-1]] -= 1
                    mid.update(keys(own, sentences(own)))
            else:
                rest.update(own)
        if len(mid) + len(rest) > COUNTED_WORDS:
            yield from flush()
    yield from flush()


def _types(rows: list[tuple]) -> Types:
    words, *numbers = zip(*rows, strict=True)
    return Types(list(words), *[np.array(x, np.int64) for x in numbers])


def _rows(batches) -> list[tuple]:
    """Rows (word, mid, last, depth) of a task."""
    return [r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True)]


_PART = "kind int, key binary, n long, data binary"


def _part(kind, key, n, data) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(key, pa.binary()), pa.array(n, pa.int64()), pa.array(data, pa.binary())], ["kind", "key", "n", "data"])


def _tables(batches):
    """Sparse slices of the shared tables over the words of a task."""
    tables, rows, some = Tables(), [], False
    for b in batches:
        rows += _rows([b])
        if len(rows) >= TASK_WORDS:
            tables.add(_types(rows))
            rows, some = [], True
    if rows:
        tables.add(_types(rows))
    elif not some:
        return
    out = []
    for number, table in enumerate([*tables.counts, tables.literal]):
        for i, part in enumerate(np.split(table, _SLICES)):
            at = np.flatnonzero(part)
            if len(at):
                out.append((1, bytes([number, i]), len(at), zlib.compress(np.diff(at, prepend=0).astype(np.uint32).tobytes() + part[at].tobytes(), 1)))
    if out:
        yield _part(*zip(*out, strict=True))


def _add_up(batches):
    """Sums of the sparse slices that arrive here, one dense compressed slice for each table and slice."""
    sums: dict[bytes, np.ndarray] = {}
    for b in batches:
        for key, n, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
            raw = zlib.decompress(data.as_py())
            at, value = np.cumsum(np.frombuffer(raw[: 4 * n], np.uint32)), np.frombuffer(raw[4 * n :], np.float64)
            if key not in sums:
                sums[key] = np.zeros((CODES << _TABLES[key[0]] if key[0] < len(_TABLES) else 1 << 16) // _SLICES)
            sums[key][at] += value
    for key, total in sums.items():
        yield _part([1], [key], [len(total)], [zlib.compress(total.tobytes(), 1)])


def _shared_tables(words: DataFrame) -> Tables:
    parts = words.mapInArrow(_tables, _PART)
    total = Tables()
    for r in parts.repartition("key").mapInArrow(_add_up, _PART).toLocalIterator():
        number, i = r["key"]
        table = total.counts[number] if number < len(_TABLES) else total.literal
        width = len(table) // _SLICES
        table[i * width : (i + 1) * width] = np.frombuffer(zlib.decompress(bytes(r["data"])), np.float64)
    return total


_WORKER: dict = {}


def _kept(shared, token: str, make):
    """What a worker makes of a broadcast value, once."""
    hold("lm_scoring", _WORKER.clear)
    if _WORKER.get("token") != token:
        _WORKER.clear()
        _WORKER.update(token=token, value=make(shared.value))
    return _WORKER["value"]


def _learn(shared, token: str, weights: np.ndarray, hits: np.ndarray):
    """Go on learning from these weights and hits of the probability map: the weights after it, and the hits it adds."""

    def run(batches):
        rows = _rows(batches)
        if rows:
            t, mixer = _types(rows), Mixer()
            mixer.weights, mixer.map = weights.copy(), hits.copy()
            mixer.learn(t, _kept(shared, token, lambda v: v.ready()))
            if mixer.bits:
                yield _part([2], [b""], [int(mixer.bits)], [mixer.weights.tobytes() + (mixer.map - hits).tobytes()])

    return run


def _add_mixers(batches):
    """Sums of the weights, by their bits, and of the hits that arrive here."""
    weights, hits, bits = 0.0, 0.0, 0
    cut = 8 * _GATES * BITS * K
    for b in batches:
        for n, data in zip(b.column(2).to_pylist(), b.column(3), strict=True):
            raw = data.as_py()
            weights, hits, bits = weights + n * np.frombuffer(raw[:cut]), hits + np.frombuffer(raw[cut:]), bits + n
    if bits:
        yield _part([3], [b""], [bits], [weights.tobytes() + hits.tobytes()])


def _deal(words: DataFrame, tasks: int) -> DataFrame:
    """Words in ``tasks`` partitions, those of one beginning in one, in an order of their own."""
    first = F.expr("substring(word, 1, int(depth))")
    return words.withColumn("first", first).repartition(max(1, tasks), "first").sortWithinPartitions("word").drop("first")


def round_of(words: DataFrame, number: int) -> DataFrame:
    """The words whose beginnings are learned from in a round."""
    part = F.pmod(F.xxhash64(F.expr("substring(word, 1, int(depth))")), F.lit(ROUNDS[-1]))
    return words.where((part >= ROUNDS[number]) & (part < ROUNDS[number + 1]))


def learn(words: DataFrame, shared, token: str, tasks: int) -> Mixer:
    """The mixer after one pass over all words, in rounds of growing size.

    A round's tasks go on from what all rounds before have learned; their weights are averaged by their bits,
    as they work at the same time. With one task a round the pass is that of one learner.
    """
    mixer = Mixer()
    for number in range(len(ROUNDS) - 1):
        many = math.ceil(tasks * (ROUNDS[number + 1] - ROUNDS[number]) / ROUNDS[-1])
        # the tasks' weights are added up in few tasks first
        learned = _deal(round_of(words, number), many).mapInArrow(_learn(shared, token, mixer.weights, mixer.map), _PART).repartition(many // 64 + 1)
        weights, hits, seen = np.zeros_like(mixer.weights), mixer.map.copy(), 0
        for r in learned.mapInArrow(_add_mixers, _PART).collect():
            raw, cut = bytes(r["data"]), weights.nbytes
            weights += np.frombuffer(raw[:cut]).reshape(weights.shape)
            hits += np.frombuffer(raw[cut:]).reshape(hits.shape)
            seen += r["n"]
        if seen:
            mixer.weights, mixer.map, mixer.bits = weights / seen, hits, mixer.bits + seen
    return mixer


_COST = "word binary, c long, body double, blank double, stop double"


def _cost(shared, token: str):
    def run(batches):
        rows = _rows(batches)
        if rows:
            tables, mixer = _kept(shared, token, lambda v: (v[0].ready(), v[1]))
            t = _types(rows)
            body, blank, stop = mixer.costs(t, tables)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] + r[2] for r in rows], pa.int64()), *[pa.array(x) for x in (body, blank, stop)]], ["word", "c", "body", "blank", "stop"])

    return run


class Model:
    """Corpus counts and the cost of every distinct word (``costs``: word, c, body, blank, stop)."""

    def __init__(self, costs: DataFrame, tokens: int, types: int, ends: int, empty: float, sentences: DataFrame, many: int, again: int):
        self.costs, self.tokens, self.types, self.ends, self.empty = costs, tokens, types, ends, empty
        #: Training sentences (``word``, ``c``), how many they are, and how many of these occur twice or more.
        self.sentences, self.many, self.again = sentences, many, again

    @property
    def whole(self) -> int:
        """What the add-one estimate divides by."""
        return self.tokens + self.types + 1


def _dealt(words: DataFrame) -> DataFrame:
    """Words with the number of first bytes they are dealt by (``depth``).

    A list of beginnings has at most one for every ``TASK_WORDS`` distinct words.
    """
    out = words.withColumn("depth", F.lit(DEPTHS[0]))
    for depth, deeper in zip(DEPTHS[:-1], DEPTHS[1:], strict=True):
        mine = out.where(F.col("depth") == depth).groupBy(F.substring("word", 1, depth).alias("_first")).agg(F.count(F.lit(1)).alias("k"))
        hot = materialize(mine.where(F.col("k") > TASK_WORDS).select("_first"), "hot")
        if hot.isEmpty():
            break
        marked = F.broadcast(hot.withColumn("_hot", F.lit(deeper)))
        out = out.withColumn("_f", F.substring("word", 1, depth)).join(marked, F.col("_f") == F.col("_first"), "left")
        out = out.withColumn("depth", F.coalesce("_hot", "depth")).drop("_f", "_first", "_hot")
    return out.select("word", "mid", "last", F.col("depth").cast("long").alias("depth"))


def train(docs: DataFrame, training: Column) -> Model:
    """A model of the texts for which ``training`` holds; every distinct word of all texts is given its cost."""
    spark = docs.sparkSession
    rows = docs.select(F.col("text").cast("binary").alias("text"), F.coalesce(training, F.lit(False)).alias("learned")).mapInArrow(_count, _WORD)
    counted = materialize(rows.groupBy("word").agg(F.sum("mid").alias("mid"), F.sum("last").alias("last")), "words")
    c = F.col("mid") + F.col("last")
    is_sentence = F.startswith("word", F.lit(b"\n"))
    is_word = ~is_sentence & (F.octet_length("word") > 0)
    n, v, ends, types, many, again = counted.agg(
        F.sum(F.when(is_word, c)), F.count_if(is_word & (c > 0)), F.sum("last"), F.count_if(is_word), F.sum(F.when(is_sentence, c)), F.sum(F.when(is_sentence & (c > 1), c))
    ).first()
    words = counted.where(~is_sentence)
    known = counted.where(is_sentence).select("word", F.col("mid").alias("c"))
    # the empty word has a cost, too
    if words.where(F.octet_length("word") == 0).isEmpty():
        words = words.unionByName(spark.createDataFrame([(b"", 0, 0)], _WORD))
    words = _dealt(words)
    tables = _shared_tables(words)
    shared, token = spark.sparkContext.broadcast(tables), uuid.uuid4().hex
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), types // TASK_WORDS)
    mixer = learn(words, shared, token, tasks)
    both = spark.sparkContext.broadcast((tables, mixer))
    costs = materialize(_deal(words, tasks).mapInArrow(_cost(both, uuid.uuid4().hex), _COST), "costs")
    shared.unpersist()
    empty = costs.where(F.octet_length("word") == 0).first()["stop"]
    return Model(costs, (n or 0) + (ends or 0), (v or 0) + bool(ends), ends or 0, empty, known, many or 0, again or 0)


def _head(costs: DataFrame) -> DataFrame:
    """The most frequent words that fit into the head: all with at least a certain count."""
    fit = costs.where((F.octet_length("word") <= HEAD_WORD_BYTES) & (F.col("c") > 0) & (F.octet_length("word") > 0))
    step = F.floor(F.log2("c") * 16)
    sizes, room, least = {r["s"]: r["k"] for r in fit.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("k")).collect()}, HEAD_WORDS, None
    for s in sorted(sizes, reverse=True):
        room -= sizes[s]
        if room < 0:
            break
        least = s
    return fit.where(step >= least) if least is not None else fit.limit(0)


# -- scoring

#: A word that isn't in the head: how often it stands in a sentence (``place``) of a text before a blank (``tf``),
#: as its last word (``ends``) and as the text's last (``closes``); or the key of a sentence, with how often the text
#: itself brought it into the corpus (``own``).
_SCORED = "uid long, word binary, place int, tf long, ends long, closes long, own long, head binary"
_INFO = "<?qqqqdd"


def _score(shared, token: str):
    def run(batches):
        place, arrays, model = _kept(shared, token, lambda v: ({w: i for i, w in enumerate(v[0])}, v[1], v[2]))
        counts, body, blank, stop = arrays
        share = np.log10((counts + 1.0) / model["whole"])
        end_share = float(np.log10((model["ends"] + 1.0) / model["whole"]))
        uid = TaskContext.get().partitionId() << 36
        infos, taught, size = [], [], 0

        def flush():
            nonlocal infos, taught, size, uid
            words = [w for _, own, _, _ in infos for w in own]
            at = np.fromiter(map(place.get, words, repeat(-1)), np.int64, len(words))
            stops = np.cumsum([len(own) for _, own, _, _ in infos])
            known = at >= 0
            # sentences of all texts, one after the other
            first = np.array([a + start for (_, own, cuts, _), start in zip(infos, stops - [len(own) for _, own, _, _ in infos], strict=True) for a in [0, *cuts[:-1]] if own], np.int64)
            final = np.zeros(len(words), bool)
            final[np.append(first[1:], len(words))[: len(first)] - 1] = True
            closing = np.zeros(len(words), bool)
            closing[stops[[len(own) > 0 for _, own, _, _ in infos]] - 1] = True
            if len(counts):
                inside = np.where(known, body[at] + np.where(final, 0.0, blank[at]), 0.0)
                after = np.where(known & final, np.where(closing, stop[at], blank[at]), 0.0)
                base = np.where(known, share[at], 0.0)
            else:
                inside = after = base = np.zeros(len(words))
            spelled = np.add.reduceat(inside, first) if len(first) else np.zeros(0)
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (known, after, base)]
            # words that aren't in the head, token by token
            many = np.array([len(cuts) for _, _, cuts, _ in infos])
            begins = np.cumsum(many) - many
            lone = np.flatnonzero(~known)
            sentence = np.searchsorted(first, lone, "right") - 1
            text = np.searchsorted(stops, lone, "right")
            heads, empty = [], model["empty"]
            for (doc_id, own, _, n_bytes), low, high, begin, count in zip(infos, (stops - [len(own) for _, own, _, _ in infos]).tolist(), stops.tolist(), begins.tolist(), many.tolist(), strict=True):
                n, score, share_of = (float(x[high] - x[low]) for x in sums)
                info = struct.pack(_INFO, doc_id is None, doc_id or 0, len(own) + 1, int(n) + (model["ends"] > 0), n_bytes, share_of + end_share, score if own else empty)
                heads.append(info + spelled[begin : begin + count].tobytes())
            n, k, docs = len(lone), int(many.sum()), len(infos)
            # the blank in its key keeps a document's own row from meeting any word
            word, brought = [words[i] for i in lone.tolist()], [0] * n
            for (_, own, cuts, _), learned in zip(infos, taught, strict=True):
                mine = keys(own, cuts)
                times = Counter(mine) if learned else {}
                word += mine
                brought += [times.get(key, 0) for key in mine]
            word += [b" " + (uid + i).to_bytes(8, "big") for i in range(docs)]
            zeros = np.zeros(k + docs, np.int64)
            cols = [
                pa.array(uid + np.concatenate([text, np.repeat(np.arange(docs), many), np.arange(docs)])),
                pa.array(word, pa.binary()),
                pa.array(np.concatenate([sentence - begins[text], np.arange(k) - np.repeat(begins, many), np.full(docs, -1)]).astype(np.int32)),
                pa.array(np.concatenate([~final[lone], zeros]).astype(np.int64)),
                pa.array(np.concatenate([final[lone] & ~closing[lone], zeros]).astype(np.int64)),
                pa.array(np.concatenate([closing[lone], zeros]).astype(np.int64)),
                pa.array(np.array(brought + [0] * docs, np.int64)),
                pa.array([None] * (n + k) + heads, pa.binary()),
            ]
            uid += docs
            infos, taught, size = [], [], 0
            return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in _SCORED.split(", ")])

        for b in batches:
            for doc_id, text, learned in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                text = text.as_py() or b""
                own = tokens(text)
                infos.append((doc_id, own, sentences(own), len(text)))
                taught.append(learned)
                size += len(text)
                if size >= BATCH:
                    yield flush()
        if infos:
            yield flush()

    return run


def whole_text(spelled: list[float], copied: dict[int, float], share: float) -> float:
    """log probability of a text's sentences, each spelled or copied.

    ``spelled`` has the log probabilities of the sentences' words, ``copied`` those of the sentences that
    the corpus has, ``share`` how many of its sentences recur.
    """
    total, hits = 0.0, 0.0
    for n, one in enumerate(spelled):
        f = (SHARE_WEIGHT * share + hits) / (SHARE_WEIGHT + n)
        whole = one + math.log1p(-f)
        if n in copied:
            other = copied[n] + math.log(f)
            high, low = max(whole, other), min(whole, other)
            whole = high + math.log1p(math.exp(low - high))
            hits += math.exp(other - whole)
        total += whole
    return total


_PARTS = "doc_id long, n_tokens long, n_bytes long, n_known long, base_score double, score double"
_LN10 = math.log(10)


def _unpack(share: float):
    def run(batches):
        for b in batches:
            rows = []
            lists = b.column(4)
            place, copied, cost = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
            ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            for raw, known, base, more, low, high in zip(b.column(0), *[b.column(i).to_pylist() for i in range(1, 4)], [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                raw = raw.as_py()
                none, doc_id, n, head, size, part, score = struct.unpack_from(_INFO, raw)
                spelled = np.frombuffer(raw, np.float64, offset=struct.calcsize(_INFO)).copy()
                own, is_copy, value = place[low:high], copied[low:high], cost[low:high]
                np.add.at(spelled, own[~is_copy], value[~is_copy])
                score += more + whole_text(spelled.tolist(), dict(zip(own[is_copy].tolist(), value[is_copy].tolist(), strict=True)), share)
                rows.append((None if none else doc_id, n, size, head + known, part + base, score / _LN10))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64()] * 4 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [c.split()[0] for c in _PARTS.split(", ")])

    return run


def score(docs: DataFrame, training: Column) -> DataFrame:
    """Scores of all ``docs`` (``doc_id``, ``text``) by a model of those rows for which ``training`` holds.

    ``doc_id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` (both log10), ``n_bytes``
    (of the text), ``bits_per_byte`` (null for an empty text).
    """
    spark = docs.sparkSession
    model = train(docs, training)
    head = _head(model.costs).toArrow()
    plain = {"whole": model.whole, "ends": model.ends, "empty": model.empty}
    arrays = [head[c].to_numpy() for c in ("c", "body", "blank", "stop")]
    shared = spark.sparkContext.broadcast((head["word"].to_pylist(), arrays, plain))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.coalesce(training, F.lit(False)).alias("learned"))
    rows = texts.mapInArrow(_score(shared, uuid.uuid4().hex), _SCORED)
    none = F.lit(None).cast("double")
    found = model.costs.unionByName(model.sentences.select("word", "c", none.alias("body"), none.alias("blank"), none.alias("stop")))
    found = found.withColumnRenamed("word", "_w")
    rows = rows.join(found, rows["word"] == found["_w"], "left")
    c, times = F.coalesce("c", F.lit(0)), F.col("tf") + F.col("ends") + F.col("closes")
    each = F.log10((c + 1) / F.lit(float(model.whole)))
    # a training text can't copy what it alone has brought
    others = c - F.col("own")
    is_tail, is_copied = times > 0, F.startswith("word", F.lit(b"\n")) & (others > 0)
    cost = F.when(is_copied, F.log(others / F.lit(float(max(1, model.many))))).otherwise(times * F.col("body") + F.col("tf") * F.col("blank"))
    part = F.when(is_tail | is_copied, F.struct("place", is_copied.alias("copied"), cost.alias("cost")))
    zero = F.lit(0.0)
    # a sentence that is not copied adds nothing
    rows = rows.where(F.col("head").isNotNull() | is_tail | is_copied)
    sums = rows.groupBy("uid").agg(
        F.max("head").alias("head"),
        F.coalesce(F.sum(F.when(c > 0, times).otherwise(0)), F.lit(0)).cast("long").alias("known"),
        F.coalesce(F.sum(F.when(is_tail, times * each)), zero).alias("base"),
        F.coalesce(F.sum(F.when(is_tail, F.col("ends") * F.col("blank") + F.col("closes") * F.col("stop"))), zero).alias("more"),
        F.collect_list(part).alias("parts"),
    )
    share = min(0.9, max(1e-4, model.again / max(1, model.many)))
    out = sums.select("head", "known", "base", "more", "parts").mapInArrow(_unpack(share), _PARTS)
    return out.select(
        "doc_id",
        "n_tokens",
        "n_known",
        F.lit(int(model.tokens)).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        "n_bytes",
        F.when(F.col("n_bytes") > 0, -F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
