"""Vector bin packing of tokenized documents into training sequences.

Every document becomes token ids (a public byte-level BPE vocabulary, read from the path given) and
one end id. What fills whole sequences is cut off first; the remainder is an item with the vector
(tokens, one segment, loss-bearing tokens). It goes to the open bin with the largest dot product
of the item's and the bin's free capacity (both in fractions of the limits) among the bins where it
fits in every dimension. With ``OPEN_BINS`` bins open and none that takes it, the item is cut to fill
the bin with the largest dot product exactly, and its rest is placed anew. At the end of a partition
the open bins are poured together, and what doesn't fill a sequence is cut at powers of two, which
need no padding either.

It is a map over the input's partitions without any shuffle; a task holds one Arrow batch of texts
and the open bins. Sequence ids are the partition's number and a counter, so a task that is run
again gives the same rows.

Defined cases: a null text is empty and has just the end id; a repeated row is packed once per row;
a null ``doc_id`` stays null; ids are integers; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import os
import re
from collections.abc import Callable
from itertools import compress
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.words import hold

OPEN_BINS = 48
#: Words whose ids a worker remembers before it forgets those it has not seen lately (some 200 bytes each, twice as many at most).
CACHE_WORDS = 500_000
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, loss_tokens long, sequence_id long, offset long"
#: New words that are encoded as one text.
JOINED_WORDS = 100
_CUT = re.compile(r"(?<=\S) (?=\S)")
_BESIDE_BLANK = re.compile(r"\s | \s")
#: Texts that are encoded together.
TOGETHER = 512
_WORKER: dict = {}
#: Letters that need no look at the vocabulary's pattern: a run of them is one pre-token; marks that are one after such a run.
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_MARKS = ".,;:!?"


def _signs() -> str:
    """The character that byte-level vocabularies write for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return "".join(chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256))


_SIGNS = _signs()


def _odd(words: set[str]) -> bool:
    """Whether any word is empty or has white space at an end."""
    return "" in words or _BESIDE_BLANK.search(" " + " ".join(words) + " ") is not None


class WordEncoder:
    """Ids of whole texts, word by word.

    A blank between two characters that aren't white space always begins a new pre-token of this
    kind of vocabulary, so the ids of a text are those of its first word followed by those of every
    further word with its leading blank. Ids of words seen lately are remembered.

    New words are encoded many at a time as one text, and its ids are cut before every id whose token
    begins with the blank's sign. A word may hold line feeds or other white space, but one with a blank in it,
    white space at an end or a special token is encoded alone, and so are all when the number of cuts isn't
    that of the words. Words of Latin letters, with marks after them or without, are cut without the
    vocabulary's pattern, which makes a pre-token of the letters with their blank and one of the marks.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size(True)
        self.begins = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
        self.pattern, self.at_blanks = self.tokenizer.pre_tokenizer, pre_tokenizers.Split(_SIGNS[32], "merged_with_next")
        usual = isinstance(self.pattern, pre_tokenizers.ByteLevel) and self.pattern.use_regex and not self.pattern.add_prefix_space
        self.usual = usual and self.tokenizer.normalizer is None
        self.marks: dict[str, bytes] = {"": b""}
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        many = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [np.array(e.ids, "<u4").tobytes() for e in many(texts, add_special_tokens=False)]

    def _joined(self, words: list[str], lettered: bool) -> list[bytes]:
        """Ids of words with their leading blank, many encoded as one text."""
        out = []
        texts = [words[low : low + JOINED_WORDS] for low in range(0, len(words), JOINED_WORDS)]
        if lettered:
            self.tokenizer.pre_tokenizer = self.at_blanks
        try:
            whole = (" " + " ".join(some) for some in texts)
            found = self._encode([codecs.charmap_decode(t.encode(), "strict", _SIGNS)[0] if lettered else t for t in whole])
        finally:
            if lettered:
                self.tokenizer.pre_tokenizer = self.pattern
        for some, raw in zip(texts, found, strict=True):
            at = np.flatnonzero(self.begins[np.frombuffer(raw, "<u4")])
            if len(at) != len(some) or (len(at) and at[0]):
                out += self._encode([" " + w for w in some])
                continue
            begins = (4 * at).tolist()
            out += map(raw.__getitem__, map(slice, begins, [*begins[1:], len(raw)]))
        return out

    def _words(self, words: list[str], odd: bool) -> dict[str, bytes]:
        """Ids of words with their leading blank; ``odd`` if any may be odd."""
        out, rest, whole = {}, words, " ".join(words)
        # one look at all words together tells nearly always that none is odd
        special = [t for t in self.special if t in whole]
        if special or odd:
            alone = [w for w in words if w != w.strip() or " " in w or any(t in w for t in special)]
            out = dict(zip(alone, self._encode([" " + w for w in alone]), strict=True))
            rest = [w for w in words if w not in out]
        if self.usual:
            stems = [w.rstrip(_MARKS) for w in rest]
            lettered = [s.isalpha() and (s.isascii() or _LETTERS.fullmatch(s) is not None) for s in stems]
            mine = list(compress(rest, lettered))
            stems = list(compress(stems, lettered))
            tails = [w[len(s) :] for w, s in zip(mine, stems, strict=True)]
            for t in set(tails).difference(self.marks):
                self.marks[t] = self._encode([t])[0]
            once, new, old = dict.fromkeys(stems), self.new, self.old
            ids = {s: known for s in once if (known := new.get(s) or old.get(s))}
            once = [s for s in once if s not in ids]
            ids.update(zip(once, self._joined(once, True), strict=True))
            out.update(zip(mine, map(add, map(ids.__getitem__, stems), map(self.marks.__getitem__, tails)), strict=True))
            rest = [w for w, is_lettered in zip(rest, lettered, strict=True) if not is_lettered]
        out.update(zip(rest, self._joined(rest, False), strict=True))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [t.split(" ") for t in texts]
        new, old = self.new, self.old
        # the new words of all these texts are told by set operations and encoded together
        seen = set().union(*split)
        fresh = seen.difference(new)
        is_odd = _odd(fresh)
        if is_odd:
            # a blank beside other white space is no cut; such a word is never remembered
            odd = {w for w in fresh if w != w.strip() or not w}
            split = [words if odd.isdisjoint(words) else _CUT.split(t) for words, t in zip(split, texts, strict=True)]
            fresh = set().union(*split).difference(new)
        unknown = fresh.difference(old)
        for w in fresh.difference(unknown):
            new[w] = old[w]
        if unknown:
            new.update(self._words(list(unknown), is_odd))
        firsts = self._encode([words[0] for words in split])
        out = [first + b"".join(map(new.__getitem__, words[1:])) for first, words in zip(firsts, split, strict=True)]
        if is_odd and unknown:
            for w in [w for w in unknown if w != w.strip() or not w]:
                del new[w]
        if len(new) > CACHE_WORDS:
            self.old, self.new = new, {}
        return out


def _encoder(path: str) -> WordEncoder:
    """A worker's encoder, kept from task to task. (What a task's own function refers to is made anew with it.)"""
    hold("packing", _WORKER.clear)
    if _WORKER.get("path") != path:
        _WORKER.update(path=path, encoder=WordEncoder(path))
    return _WORKER["encoder"]


class Packer:
    """Open bins of one partition; finished pieces gather in ``rows``."""

    def __init__(self, part: int, size: int, max_segments: int, max_loss: int):
        self.limits = np.array([size, max_segments, max_loss], float)
        self.size, self.part, self.count, self.squares = size, part, 0, self.limits**2
        self.free = np.zeros((0, 3))
        self.bins: list[list[tuple]] = []
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        sequence, offset = (self.part << 36) + self.count, 0
        self.count += 1
        for doc, start, ids, total, loss in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, ids, total, self._loss(start, n, total, loss), sequence, offset))
            offset += n

    @staticmethod
    def _loss(start: int, n: int, total: int, loss: int) -> int:
        """Of a piece's ids, those among the document's last ``loss``."""
        return max(0, min(n, start + n - (total - loss)))

    def _close(self, i: int) -> None:
        pieces = self.bins.pop(i)
        self.free = np.delete(self.free, i, 0)
        if sum(len(p[2]) for p in pieces) == 4 * self.size:
            self._emit(pieces)
        else:
            self._powers(pieces)

    def _powers(self, pieces: list[tuple]) -> None:
        """Sequences of power-of-two lengths holding the pieces, largest first."""
        left = sum(len(p[2]) for p in pieces) // 4
        pieces = pieces[::-1]
        while left:
            want, take = 1 << (left.bit_length() - 1), []
            left -= want
            while want:
                doc, start, ids, total, loss = pieces.pop()
                n = min(want, len(ids) // 4)
                take.append((doc, start, ids[: 4 * n], total, loss))
                if 4 * n < len(ids):
                    pieces.append((doc, start + n, ids[4 * n :], total, loss))
                want -= n
            self._emit(take)

    def add(self, doc, ids: bytes, loss: int) -> None:
        total, at = len(ids) // 4, 0
        while total - at >= self.size and self._loss(at, self.size, total, loss) <= self.limits[2]:
            self._emit([(doc, at, ids[4 * at : 4 * (at + self.size)], total, loss)])
            at += self.size
        while at < total:
            at += self._place(doc, at, ids, total, loss)

    def _place(self, doc, at: int, ids: bytes, total: int, loss: int) -> int:
        """Put the rest of a document, or as much as is cut to fit, into a bin; the number of ids placed."""
        n = min(total - at, self.size)
        item = np.array([n, 1, self._loss(at, n, total, loss)], float)
        dots = (self.free / self.squares) @ item if len(self.free) else np.zeros(0)
        fits = (self.free >= item).all(1) if len(self.free) else np.zeros(0, bool)
        if not fits.any():
            if item[2] > self.limits[2] or len(self.bins) >= OPEN_BINS:
                open_ = np.flatnonzero((self.free[:, 1] >= 1) & (self.free[:, 0] >= 1) & (self.free[:, 2] >= 1)) if len(self.free) else []
                if item[2] > self.limits[2] and (not len(open_) or len(self.bins) < OPEN_BINS):
                    self.bins.append([])
                    self.free = np.vstack([self.free, self.limits])
                    i = len(self.bins) - 1
                else:
                    i = int(open_[np.argmax(dots[open_])])
                # cut: as many ids as leave the bin within its tokens and its loss-bearing tokens
                n = int(min(n, self.free[i, 0]))
                over = self._loss(at, n, total, loss) - self.free[i, 2]
                n -= int(max(0, over))
                item = np.array([n, 1, self._loss(at, n, total, loss)], float)
            else:
                self.bins.append([])
                self.free = np.vstack([self.free, self.limits])
                i = len(self.bins) - 1
        else:
            i = int(np.flatnonzero(fits)[np.argmax(dots[fits])])
        self.bins[i].append((doc, at, ids[4 * at : 4 * (at + n)], total, loss))
        self.free[i] -= item
        if self.free[i].min() < 1:
            self._close(i)
        return n

    def finish(self) -> None:
        """Pour the open bins together, fullest first, cutting where a bin is full."""
        order = np.argsort(self.free[:, 0], kind="stable") if len(self.free) else []
        pieces = [p for i in order for p in self.bins[i]]
        self.bins, self.free = [], np.zeros((0, 3))
        take, used = [], np.zeros(3)
        queue = pieces[::-1]
        while queue:
            doc, start, ids, total, loss = queue.pop()
            room = self.limits - used
            n = int(min(len(ids) // 4, room[0]))
            n -= int(max(0, self._loss(start, n, total, loss) - room[2]))
            if n > 0 and room[1] >= 1:
                take.append((doc, start, ids[: 4 * n], total, loss))
                used += (n, 1, self._loss(start, n, total, loss))
                if 4 * n < len(ids):
                    queue.append((doc, start + n, ids[4 * n :], total, loss))
            else:
                queue.append((doc, start, ids, total, loss))
            if used[0] == self.size or n <= 0 or used[1] >= self.limits[1] or used[2] >= self.limits[2]:
                self._emit(take) if used[0] == self.size else self._powers(take)
                take, used = [], np.zeros(3)
        if take:
            self._powers(take)


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    names = ("doc_id", "start", "length", "ids", "doc_tokens", "loss_tokens", "sequence_id", "offset")
    cols = zip(*rows, strict=True) if rows else [()] * len(names)
    kinds = {"ids": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, cols, strict=True)], list(names))


def pack(docs: DataFrame, vocabulary: str | Callable[[], str], size: int = 2048, max_segments: int = 256, max_loss: int | None = None, end_id: int = 1, loss_tokens: str | None = None) -> DataFrame:
    """Pieces of documents in sequences (``SCHEMA``); ``ids`` are little-endian unsigned 32-bit.

    ``vocabulary`` is the tokenizer's file, or a function that finds it on the machine of a task.
    ``docs`` has ``doc_id`` and ``text``; ``loss_tokens`` may name a column with the number of
    loss-bearing ids at a document's end (else all are). No sequence holds more than ``size`` ids,
    ``max_segments`` pieces or ``max_loss`` loss-bearing ids.
    """
    most = size if max_loss is None else max_loss
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder = _encoder(vocabulary() if callable(vocabulary) else vocabulary)
        packer = Packer(TaskContext.get().partitionId(), size, max_segments, most)
        for b in batches:
            for low in range(0, b.num_rows, TOGETHER):
                part = b.slice(low, TOGETHER)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc, ids, loss in zip(part.column(0).to_pylist(), encoder.encode(texts), part.column(2).to_pylist(), strict=True):
                    ids += end
                    packer.add(doc, ids, len(ids) // 4 if loss is None else min(loss, len(ids) // 4))
                if packer.rows:
                    yield _arrow(packer.rows)
                    packer.rows = []
        packer.finish()
        encoder.old = {}  # between tasks only what was seen last is kept
        yield _arrow(packer.rows)

    loss = F.col(loss_tokens).cast("long") if loss_tokens else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long"), "text", loss.alias("loss")).mapInArrow(run, SCHEMA)
