"""Spelling variants: words grouped under the commoner word that is one edit away.

Full neighbourhood generation: every word of the vocabulary emits all its distinct neighbours, that is
each deletion, each replacement and each insertion over the alphabet seen in the vocabulary, and the
neighbours are hash-joined to the vocabulary. A neighbour that is a word is near by construction, so no
distance is ever computed.

The neighbours (some 700 for a word of nine letters) are never shuffled. A word of length m is cut into
windows of about ``WINDOW`` code points; an edit lies in one of them and leaves all before and behind it
alone. So words travel instead, keyed by target length, window and the text around the window (three
records for each window), and the task that receives them emits the neighbours with an edit in that
window and looks them up among the words that came under the same key. Only words that agree everywhere
but in one window meet on a key, at most alphabet ** WINDOW of them for words up to ``WINDOW * WINDOWS``
code points, so a common beginning or ending makes no hot group. Neighbours are told by rolling 64-bit
hashes, worked out for many words and positions at once, and each hit is compared letter by letter with
the word that it hit.

A neighbour is emitted once: of a run of equal letters the first is deleted, and a letter is inserted
before an equal one, never behind it.

Defined cases: a null text holds no word and a null or empty word is none; a null ``doc_id`` counts as the
empty text in the slip rule of ``occurrences``; repeated rows count again; of near words that are equally
common the smallest in code-point order is the form; an empty table gives an empty result; a word given
twice to ``variants`` counts with the sum of its counts; further columns are left out. Words of any
length are kept whole; a word of a million letters travels in 3 * ``WINDOWS`` records.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.session import forget, materialize

#: Code points that a window aims at, and the most windows a word is cut into.
WINDOW = 4
WINDOWS = 16
#: Records that one task of the neighbourhood join aims at, and hashes that it holds at a time.
TASK_RECORDS = 150_000
HASHES = 1 << 19
#: The multiplier of the rolling hash: any odd number with well mixed bits.
BASE = 0x9E3779B97F4A7C15

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTER = "[A-Za-zÀ-ÿ]"


def _lower(run: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    ascii_only = F.length(run) == F.octet_length(run)
    return F.when(ascii_only, F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def occurrences(docs: DataFrame, min_length: int, slip: int | None = None) -> DataFrame:
    """One row ``word`` for each run of letters of at least ``min_length`` code points.

    With ``slip`` typing slips are planted: where it divides h, the CRC-32 of ``<doc_id>:<run>``, the run
    loses its code point h % length.
    """
    runs = F.regexp_extract_all("text", F.lit(f"({LETTER}{{{min_length},}}+)"), 1)
    found = docs.select("doc_id", F.explode(runs).alias("run")).select("doc_id", _lower(F.col("run")).alias("word"))
    if slip is not None:
        name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word"))
        found = found.withColumn("h", F.crc32(name.cast("binary")))
        at = F.expr("cast(h % length(word) as int)")
        shorter = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
        found = found.withColumn("word", F.when(F.col("h") % slip == 0, shorter).otherwise(F.col("word")))
        found = found.where(F.length("word") >= min_length)
    return found.select("word")


def vocabulary(words: DataFrame, min_count: int) -> DataFrame:
    """``word`` and its number of occurrences ``n``, from ``min_count`` on."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _records(vocab: DataFrame) -> DataFrame:
    """Every word under each (target length ``m``, window ``j``) its neighbours can have: length(word) is m or one off."""
    windows = f"least({WINDOWS}, cast(ceil(m / {WINDOW}) as int))"
    targets = f"""
        flatten(transform(filter(sequence(length(word) - 1, length(word) + 1), m -> m > 0),
            m -> transform(sequence(0, {windows} - 1), j -> struct(m as m, j as j,
                cast(j * cast(m as long) div {windows} as int) as begin,
                cast((j + 1) * cast(m as long) div {windows} as int) as stop))))"""
    rows = vocab.select("word", "n", F.explode(F.expr(targets)).alias("t")).select("word", "n", "t.*")
    around = F.xxhash64("m", "j", F.expr("substring(word, 1, begin)"), F.expr("substring(word, length(word) - (m - stop) + 1, m - stop)"))
    return rows.select("word", "n", "m", "j", around.alias("around"))


def _powers(k: int, base: int = BASE) -> np.ndarray:
    """base ** 0 up to base ** k, modulo 2 ** 64."""
    out = np.full(k + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Words:
    """Words of one length as code points, with their counts; hashes of all beginnings and endings."""

    def __init__(self, words: list[str], counts: np.ndarray, length: int) -> None:
        self.words, self.counts, self.length = words, counts, length
        self.codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length).astype(np.uint64)

    def ends(self, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """``before[:, p]``: hash of the first p code points; ``behind[:, p]``: what those from p on add to the whole's."""
        codes, power = self.codes[rows], _powers(self.length)
        weighted = codes * power[:-1][::-1]
        behind = np.zeros((len(codes), self.length + 1), np.uint64)
        behind[:, :-1] = np.cumsum(weighted[:, ::-1], axis=1)[:, ::-1]
        # the beginning's share of the whole, with the weights of what follows divided out (the base is odd)
        inverse = _powers(self.length, pow(BASE, -1, 1 << 64))
        before = (behind[:, :1] - behind) * inverse[::-1]
        return before, behind


def _look_up(hashes: np.ndarray, known: np.ndarray, order: np.ndarray, seen: np.ndarray, shift: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """(place among ``hashes``, place among the known words) of all equal hashes."""
    flat = hashes.ravel()
    some = np.flatnonzero(seen[flat >> shift])
    low, high = np.searchsorted(known, flat[some], "left"), np.searchsorted(known, flat[some], "right")
    times = high - low
    some, low = np.repeat(some, times), np.repeat(low, times)
    step = np.arange(len(some)) - np.repeat(np.cumsum(times) - times, times)
    return some, order[low + step]


def _neighbours(source: _Words, target: _Words, begin: int, stop: int, alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(source word, target word) for every neighbour with an edit in [begin, stop) that is a target word."""
    m, step = target.length, target.length - source.length
    if step == 0 and len(source.words) < 2:
        return
    power = _powers(m)
    whole = target.codes @ power[:-1][::-1]
    order = np.argsort(whole, kind="stable")
    known = whole[order]
    bits = min(24, int(math.log2(len(known))) + 6)
    shift = np.uint64(64 - bits)
    seen = np.zeros(1 << bits, bool)
    seen[known >> shift] = True
    letters = 1 if step < 0 else len(alphabet)
    if step < 0 and stop == m:
        stop += 1  # the last code point deleted
    n_rows = max(1, HASHES // (source.length + 1 + letters * min(stop - begin, 64)))
    for first in range(0, len(source.words), n_rows):
        rows = slice(first, first + n_rows)
        before, behind = source.ends(rows)
        codes = source.codes[rows]
        for left in range(begin, stop, 64):
            p = np.arange(left, min(stop, left + 64))
            if step < 0:
                hashes = before[:, p] * power[m - p] + behind[:, p + 1]
                hashes = hashes[:, :, None]
                first_of_run = np.ones((len(codes), len(p)), bool)
                inner = p > 0
                first_of_run[:, inner] = codes[:, p[inner]] != codes[:, p[inner] - 1]
                keep = first_of_run[:, :, None]
            else:
                put = alphabet[None, :] * power[m - 1 - p][:, None]
                if step == 0:
                    rest = before[:, p] * power[m - p] + behind[:, p + 1]
                    keep = codes[:, p, None] != alphabet
                else:
                    rest = before[:, p] * power[m - p] + behind[:, p]
                    keep = np.ones((len(codes), len(p), len(alphabet)), bool)
                    inner = p > 0
                    keep[:, inner] = codes[:, p[inner] - 1, None] != alphabet
                hashes = rest[:, :, None] + put[None]
            at, word = _look_up(hashes, known, order, seen, shift)
            good = keep.ravel()[at]
            at, word = at[good], word[good]
            row, place, letter = np.unravel_index(at, hashes.shape)
            place = p[place]
            same = np.fromiter((_equal(codes[r], q, alphabet[x], step, target.codes[w]) for r, q, x, w in zip(row, place, letter, word, strict=True)), bool, len(at))
            yield row[same] + first, word[same]


def _equal(codes: np.ndarray, p: int, letter: int | None, step: int, word: np.ndarray) -> bool:
    """Whether the neighbour with the edit at p is the word, letter by letter."""
    if not np.array_equal(codes[:p], word[:p]):
        return False
    if step < 0:
        return np.array_equal(codes[p + 1 :], word[p:])
    return word[p] == letter and np.array_equal(codes[p + 1 - step :], word[p + 1 :])


#: Of ``links``: a word, its near word and that one's count.
LINKS = "word string, near string, near_n long"


def _joined(alphabet: list[int]):
    letters = np.array(alphabet, np.uint64)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if not rows:
            return
        rows = pa.Table.from_batches(rows)
        m, j = rows["m"].to_numpy(), rows["j"].to_numpy()
        words = rows["word"].to_pylist()
        counts = rows["n"].to_numpy()
        length = np.fromiter(map(len, words), np.int64, len(words))
        order = np.lexsort((length, j, m))
        cuts = np.flatnonzero(np.diff(m[order]) | np.diff(j[order])) + 1
        for part in np.split(order, cuts):
            size, window = int(m[part[0]]), int(j[part[0]])
            windows = min(WINDOWS, -(-size // WINDOW))
            begin, stop = window * size // windows, (window + 1) * size // windows
            by = {}
            for k in (size, size - 1, size + 1):
                of = part[length[part] == k]
                if len(of):
                    by[k] = _Words([words[i] for i in of], counts[of], k)
            target = by.get(size)
            if target is None:
                continue
            for source in by.values():
                for row, word in _neighbours(source, target, begin, stop, letters):
                    if len(row):
                        near = [target.words[w] for w in word]
                        yield pa.RecordBatch.from_arrays([pa.array([source.words[r] for r in row]), pa.array(near), pa.array(target.counts[word])], ["word", "near", "near_n"])

    return join


def links(vocab: DataFrame) -> DataFrame:
    """``word``, ``near``, ``near_n`` for every ordered pair of words that differ by one edit. ``vocab``: distinct words, stored."""
    shape = vocab.agg(F.count(F.lit(1)), F.sum(F.least(F.lit(WINDOWS), F.ceil(F.length("word") / WINDOW))), F.max(F.length("word"))).first()
    letters = vocab.select(F.explode(F.expr("transform(sequence(1, length(word)), i -> ascii(substring(word, i, 1)))")).alias("c"))
    alphabet = sorted(row.c for row in letters.distinct().collect())  # one number for each letter of the alphabet
    parts = max(vocab.sparkSession.sparkContext.defaultParallelism, -(-3 * (shape[1] or 0) // TASK_RECORDS))
    return _records(vocab).repartition(parts, "around").mapInArrow(_joined(alphabet), LINKS)


def _roots(forms: DataFrame, longest: int) -> DataFrame:
    """``word`` and ``root``, the end of its chain of at most ``longest`` forms, by doubling the chains."""
    up = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(max(0, math.ceil(math.log2(max(1, longest))))):
        above = up.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        higher = up.join(above, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root"))
        last, up = up, materialize(higher, "roots")
        forget(last)
    return up


def variants(vocab: DataFrame, ratio: int = 10) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` for every word of ``vocab`` (word, n).

    The form is the commonest near word if its count is at least ``ratio`` (2 or more) times the word's.
    Counts grow along a chain of forms, so that chains are short and end.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    vocab = vocab.where(F.length("word") > 0).groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    vocab = materialize(vocab, "vocabulary")
    near = links(vocab).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("down"), "near")).alias("best"))
    out = vocab.join(near, "word", "left")
    common = -F.col("best.down") >= ratio * F.col("n")
    out = out.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(common, F.col("best.near")).alias("form"),
        F.when(common, -F.col("best.down")).alias("form_n"),
    )
    out = materialize(out, "forms")
    low, high = vocab.agg(F.min("n"), F.max("n")).first()
    forget(vocab)
    longest = int(math.log(high / max(1, low), ratio)) + 1 if high else 0
    roots = _roots(out.where(F.col("form").isNotNull()), longest)
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
