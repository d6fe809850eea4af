"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

A benchmark item counts as contained in a document when some stretch of the document's words is
within ``edits`` (a fifth of the item's words) word edits of it. Words are lower-cased, stripped of
punctuation at both ends, and left out when nothing remains.

Items of more than ``LONG`` words are sought by pieces of at most ``PIECE`` words: of an item within its
edits at least one piece is within a fifth of its own words. Windows of a piece's size are laid over a
document wherever it holds enough word trigrams of pieces of that size: by the q-gram lemma a stretch
within k edits of w words keeps at least w - 2 - 3k trigrams, so no window is lost by that, and most
documents have none. Every window is embedded by CGK random walks (at each step the current word is
written, and a random bit of step and word says whether to go on to the next), which map edit distance to
Hamming distance. The benchmark's pieces lie in hash tables under ``SAMPLES`` random samples of
``SAMPLE_BITS`` embedded positions for each walk; the pieces found under a window's samples are its
candidates. The number of walks for a size is drawn from ``TARGET_RECALL`` and from how often one walk
finds a piece of that size at the largest distance (simulated with a fixed seed). Candidate windows of
an item that overlap are joined, and the item is aligned with the joined stretch exactly.

Items travel to the tasks in blocks of at most ``BLOCK_BYTES``; the documents are read once per block.
The job is a map over documents without any shuffle.

Defined cases: null or empty texts contain nothing; items of fewer than ``min_words`` words (3 unless
stated) are not looked for, as they are phrases that occur anywhere; with a lower bound, items of one or
two words are looked for as they are, without edits; repeated documents are reported each, repeated
items once per item id; null ids stay null; ids are integers (other types are cast to long); other
columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.words import WordIds, grams, hold, mix
from colloquy.session import materialize

EDIT_SHARE = 0.2
MIN_WORDS = 3
LONG, PIECE = 60, 40
SAMPLES, SAMPLE_BITS, MOST_WALKS = 24, 3, 12
TARGET_RECALL = 0.95
_TRIALS = 48
_STEP = 2048
BLOCK_BYTES = 16_000_000
#: Up to this many hits (8 bytes each) are broadcast to the anti-join, more are shuffled.
BROADCAST_ROWS = 200_000
_FILTER_BITS = 20
SCHEMA = "doc_id long, item_id long, edits long, item_words long, first_word long, last_word long"


class PlainWords(WordIds):
    """Words without punctuation at their ends; 0 for those of which nothing remains."""

    def __missing__(self, word: str) -> int:
        bare = word.strip(_EDGE) if word.isascii() else "".join(c for c in word if c.isalnum() or c in "'’-").strip(_EDGE)
        if not bare:
            self[word] = 0
            return 0
        value = self[word] = super().__missing__(bare.encode("utf-8", "surrogatepass"))
        return value

    def sequence(self, text: str | None) -> np.ndarray:
        ids = self.of(text.lower().split()) if text else np.zeros(0, np.uint64)
        return ids[ids != 0]


_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def allowed_edits(words: int, share: float = EDIT_SHARE) -> int:
    """Word edits allowed for an item; none for items too short for the trigram bound to hold."""
    k = int(share * words)
    while k and words - 2 - 3 * k < 1:
        k -= 1
    return k


def embed(windows: np.ndarray, walk: int) -> np.ndarray:
    """CGK embeddings of equally long rows of word numbers: twice their length, 0 beyond the end."""
    n, w = windows.shape
    padded = np.concatenate([windows, np.zeros((n, 1), np.uint64)], 1)
    at, rows = np.zeros(n, np.int64), np.arange(n)
    out = np.zeros((n, 2 * w), np.uint64)
    for step in range(2 * w):
        word = padded[rows, at]
        out[:, step] = word
        coin = (word * np.uint64(2 * (walk * 7919 + step * 104729) + 1) + np.uint64(walk + 1)) * np.uint64(0x9E3779B97F4A7C15)
        at = np.minimum(at + (coin >> np.uint64(63)).astype(np.int64), w)
    return out


def samples(width: int) -> np.ndarray:
    """Embedded positions of each of the ``SAMPLES`` bit samples, drawn alike everywhere."""
    return np.random.default_rng(width).integers(0, width, (SAMPLES, SAMPLE_BITS))


def sample_keys(embedded: np.ndarray, walk: int) -> np.ndarray:
    """The key of each row of embedded words under each sample; 0 where a sample reaches beyond the end."""
    picked = embedded[:, samples(embedded.shape[1])]
    key = np.arange(SAMPLES, dtype=np.uint64)[None, :] + np.uint64(SAMPLES * walk)
    for i in range(SAMPLE_BITS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + picked[:, :, i])
    return np.where((picked == 0).any(2), np.uint64(0), key | np.uint64(1))


@lru_cache(512)
def walks(words: int, edits: int) -> int:
    """Walks that find a piece within so many mixed edits with ``TARGET_RECALL``, a quarter of its misses being planned for."""
    if not edits:
        return 1
    rng = np.random.default_rng(1000 * words + edits)
    one, two = rng.integers(1, 1 << 63, (_TRIALS, words), dtype=np.uint64), np.zeros((_TRIALS, words), np.uint64)
    for r in range(_TRIALS):
        own = one[r].tolist()
        for _ in range(edits):
            at, kind = int(rng.integers(0, len(own))), int(rng.integers(0, 3))
            own[at : at + (kind != 1)] = [int(rng.integers(1, 1 << 63))] if kind != 2 or len(own) == 1 else []
        own = (own + rng.integers(1, 1 << 63, words).tolist())[:words]
        two[r] = np.array(own, np.uint64)
    found = 0
    for walk in range(2):
        a, b = sample_keys(embed(one, walk), walk), sample_keys(embed(two, walk), walk)
        found += int(((a == b) & (a != 0)).any(1).sum())
    miss = 1 - min(0.99, max(0.05, found / (2 * _TRIALS)))
    return min(MOST_WALKS, max(2, int(np.ceil(np.log((1 - TARGET_RECALL) / 4) / np.log(miss)))))


def alignment(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """Least word edits between the item and any stretch of the region, and where it lies (first, past)."""
    n = len(region)
    cost, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    ramp = np.arange(n + 1)
    for word in item:
        sub = np.concatenate([[cost[0] + 1], cost[:-1] + (region != word)])
        other = cost + 1
        take = np.concatenate([[False], sub[1:] <= other[1:]])
        best = np.where(take, sub, other)
        origin = np.where(take, np.concatenate([[0], start[:-1]]), start)
        # insertions: the least best[j] + (i - j) for j <= i
        shifted = best - ramp
        low = np.minimum.accumulate(shifted)
        last = np.maximum.accumulate(np.where(shifted == low, ramp, 0))
        cost, start = low + ramp, origin[last]
    end = int(np.argmin(cost))
    return int(cost[end]), int(start[end]), end


class Pieces:
    """The pieces of one size, in hash tables under the samples of their embeddings."""

    def __init__(self, words: int, edits: int, rows: list[tuple[int, int, np.ndarray]]):
        self.size, self.edits, self.need = words, edits, max(1, words - 2 - 3 * edits)
        # equal pieces lie in the tables once
        self.places: dict[bytes, list[tuple[int, int]]] = {}
        for item, offset, seq in rows:
            self.places.setdefault(seq.tobytes(), []).append((item, offset))
        self.owners = list(self.places.values())
        whole = np.stack([np.frombuffer(k, np.uint64) for k in self.places])
        self.tables = []
        for walk in range(walks(words, edits)):
            key = sample_keys(embed(whole, walk), walk)
            owner = np.repeat(np.arange(len(whole)), SAMPLES)[key.ravel() != 0]
            key = key.ravel()[key.ravel() != 0]
            order = np.argsort(key, kind="stable")
            self.tables.append((key[order], owner[order]))

    def windows(self, hit: np.ndarray, words: int) -> np.ndarray:
        """Where windows begin that hold enough trigrams of pieces of this size."""
        at = np.flatnonzero(hit)
        if len(at) < self.need:
            return at[:0]
        reach = self.size + self.edits
        begin = np.arange(max(0, int(at[0]) - reach), int(at[-1]) + 1)
        many = np.searchsorted(at, begin + reach - 2, "left") - np.searchsorted(at, begin, "left")
        return begin[(many >= self.need) & (begin < words)]

    def candidates(self, doc: np.ndarray, begin: np.ndarray):
        """(piece, where windows begin) for all pieces that share a sample with a window; equal windows are embedded once."""
        padded = np.concatenate([doc, np.zeros(self.size + 1, np.uint64)])
        _, first, same = np.unique(grams(padded, self.size)[begin], return_index=True, return_inverse=True)
        one, found = begin[first], []
        for low in range(0, len(one), _STEP):
            windows = padded[one[low : low + _STEP, None] + np.arange(self.size)]
            for walk, (keys, owner) in enumerate(self.tables):
                mine = sample_keys(embed(windows, walk), walk).ravel()
                left, right = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
                for i in np.flatnonzero((right > left) & (mine != 0)):
                    some = owner[left[i] : right[i]]
                    found.append(np.stack([some, np.full(len(some), low + i // SAMPLES)], 1))
        if not found:
            return
        pairs = np.unique(np.concatenate(found), axis=0)
        for piece in np.unique(pairs[:, 0]).tolist():
            yield piece, begin[np.isin(same, pairs[pairs[:, 0] == piece, 1])]


class Items:
    """Benchmark items of one block with an index of their pieces' trigrams."""

    def __init__(self, rows: list[tuple], share: float, min_words: int = MIN_WORDS):
        words = PlainWords()
        self.ids, self.words, self.most = [], [], []
        pieces: dict[int, list] = {}
        where: dict[int, int] = {}
        self.short: dict[tuple, list[int]] = {}
        for item_id, text in rows:
            seq = words.sequence(text)
            if len(seq) < max(1, min_words):
                continue
            number = len(self.ids)
            self.ids.append(item_id)
            self.words.append(seq)
            self.most.append(allowed_edits(len(seq), share))
            if len(seq) < MIN_WORDS:
                self.short.setdefault(tuple(seq.tolist()), []).append(number)
                continue
            parts = 1 if len(seq) <= LONG else -(-len(seq) // PIECE)
            cuts = [len(seq) * i // parts for i in range(parts + 1)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                pieces.setdefault(high - low, []).append((number, low, seq[low:high]))
                for g in grams(seq[low:high], 3).tolist():
                    where[g] = where.get(g, 0) | 1 << (high - low)
        self.pieces = {n: Pieces(n, allowed_edits(n, share), some) for n, some in pieces.items()}
        self.grams = np.array(sorted(where), np.uint64)
        self.sizes = np.array([where[g] for g in self.grams.tolist()], np.uint64)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def search(self, doc: np.ndarray) -> list[tuple]:
        """(item number, edits, first word, past last word) of the best stretch for each item contained."""
        out = self._short(doc) if self.short else []
        if len(doc) < MIN_WORDS or not len(self.grams):
            return out
        g = grams(doc, 3)
        maybe = np.flatnonzero(self.filter[(g >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        if not len(maybe):
            return out
        at = np.minimum(np.searchsorted(self.grams, g[maybe]), len(self.grams) - 1)
        sizes = np.where(self.grams[at] == g[maybe], self.sizes[at], np.uint64(0))
        regions: dict[int, list[np.ndarray]] = {}
        for n in np.flatnonzero(np.bitwise_or.reduce(sizes) >> np.arange(64, dtype=np.uint64) & np.uint64(1)).tolist():
            own = self.pieces[n]
            hit = np.zeros(len(g), bool)
            hit[maybe[(sizes >> np.uint64(n) & np.uint64(1)).astype(bool)]] = True
            begin = own.windows(hit, len(doc))
            for piece, found in own.candidates(doc, begin) if len(begin) else ():
                for item, offset in own.owners[piece]:
                    k, first = self.most[item], found - offset
                    span = np.stack([np.maximum(0, first - 2 * k - 1), np.minimum(len(doc), first + len(self.words[item]) + 2 * k + 1)], 1)
                    regions.setdefault(item, []).append(span)
        for item, spans in regions.items():
            best = self._verify(item, doc, np.concatenate(spans))
            if best:
                out.append((item, *best))
        return out

    def _short(self, doc: np.ndarray) -> list[tuple]:
        """Items of one or two words, as they are."""
        out = []
        for n in {len(k) for k in self.short}:
            for i in range(len(doc) - n + 1):
                for number in self.short.get(tuple(doc[i : i + n].tolist()), ()):
                    out.append((number, 0, i, i + n))
        return out

    def _verify(self, number: int, doc: np.ndarray, spans: np.ndarray) -> tuple | None:
        """Exact alignment of an item with every joined stretch of its candidates."""
        best = None
        spans = spans[np.argsort(spans[:, 0], kind="stable")]
        past = np.maximum.accumulate(spans[:, 1])
        new = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > past[:-1]]))
        for low, high in zip(spans[new, 0].tolist(), past[np.append(new[1:], len(past)) - 1].tolist(), strict=True):
            cost, first, last = alignment(self.words[number], doc[low:high])
            if cost <= self.most[number] and (best is None or cost < best[0]):
                best = (cost, low + first, low + last)
                if cost == 0:
                    break
        return best


_WORKER: dict = {}


def _held(token: str, shared) -> tuple[Items, PlainWords]:
    """A worker's items and words, kept from task to task. (What a task's own function refers to is made anew with it.)"""
    hold("decontamination", _WORKER.clear)
    if _WORKER.get("token") != token:
        _WORKER.update(token=token, items=Items(*shared.value), words=PlainWords())
    return _WORKER["items"], _WORKER["words"]


def find(docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """One row (``SCHEMA``) for each document and benchmark item it contains, with the least edits and the place."""
    spark = docs.sparkSession
    sized = benchmark.select("item_id", "text").where("text is not null")
    total = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    numbered = sized.withColumn("b", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    found = None
    for b in range(blocks):
        rows = [(r["item_id"], r["text"]) for r in numbered.where(F.col("b") == b).select("item_id", "text").distinct().collect()]
        part = _search(spark, docs, rows, share, min_words)
        found = part if found is None else found.unionByName(part)
    return found


def _search(spark, docs: DataFrame, rows: list[tuple], share: float, min_words: int) -> DataFrame:
    shared = spark.sparkContext.broadcast((rows, share, min_words))
    token = uuid.uuid4().hex

    def run(batches):
        items, words = _held(token, shared)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                best: dict = {}
                for number, cost, first, last in items.search(words.sequence(text.as_py())):
                    item_id = items.ids[number]
                    if item_id not in best or cost < best[item_id][0]:
                        best[item_id] = (cost, len(items.words[number]), first, last)
                out += [(doc_id, item_id, *v) for item_id, v in best.items()]
            cols = zip(*out, strict=True) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def remove(docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE) -> DataFrame:
    """``docs`` without the documents that contain a benchmark item."""
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    hit = materialize(find(docs.withColumn("doc_id", key), benchmark, share).select(F.col("doc_id").alias("_hit")).distinct(), "leaks")
    if hit.count() <= BROADCAST_ROWS:
        hit = F.broadcast(hit)
    rows = docs.select(F.struct("*").alias("row"), key.alias("key"))
    return rows.join(hit, F.col("key") == F.col("_hit"), "left_anti").select("row.*")
