"""Full-text search: tokens of turns, phrases, BM25 ranking, snippets. The stored index is in ``store`` and ``blocks``."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import let

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
COLUMNS = ("text", "thinking", "tool_calls")


def fold(text: Column) -> Column:
    """Lower case without diacritics (ICU decomposition, marks removed)."""
    parts = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), F.coalesce(text, F.lit("")), F.lit(False))
    plain = ~F.rlike(F.coalesce(text, F.lit("")), F.lit("[^\\x00-\\x7F]"))
    return F.lower(F.when(plain, text).otherwise(F.regexp_replace(parts, "\\p{Mn}+", "")))


def tokens(text: Column) -> Column:
    """Runs of letters, digits and private-use characters of the folded text."""
    return F.regexp_extract_all(fold(text), F.lit("[\\p{L}\\p{N}\\p{Co}]+"), F.lit(0))


def index(turns: DataFrame) -> DataFrame:
    """One row per turn: its key, the token array of each column, and the length over all columns."""
    calls = F.to_json("tool_calls") if dict(turns.dtypes)["tool_calls"].startswith("array") else F.col("tool_calls")
    rows = turns.select("session_id", "seq", tokens(F.col("text")).alias("text"), tokens(F.col("thinking")).alias("thinking"), tokens(calls).alias("tool_calls"))
    return rows.withColumn("length", (F.size("text") + F.size("thinking") + F.size("tool_calls")).cast("long"))


def postings(indexed: DataFrame) -> DataFrame:
    """(token, session_id, seq, col, positions) of all columns; written in the same batch as the turns."""
    each = [indexed.select("session_id", "seq", F.lit(c).alias("col"), F.posexplode(c).alias("pos", "token")) for c in COLUMNS]
    rows = each[0].unionByName(each[1]).unionByName(each[2])
    return rows.groupBy("token", "session_id", "seq", "col").agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def occurrences(column: Column, phrase: list[str]) -> Column:
    """How often a phrase of tokens occurs in a token array; overlapping occurrences count."""
    n = len(phrase)
    at = F.when(F.size(column) >= n, F.sequence(F.lit(0), F.size(column) - n)).otherwise(F.array().cast("array<int>"))
    same = lambda i: F.reduce(F.array(*[F.get(column, i + k) == F.lit(w) for k, w in enumerate(phrase)]), F.lit(True), lambda a, b: a & b)
    return F.size(F.filter(at, same)).cast("long")


def phrase_tokens(spark, query: str) -> list[str]:
    return spark.range(1).select(tokens(F.lit(query)).alias("t")).first()["t"]


def search(indexed: DataFrame, phrase: list[str], include_thinking: bool = False) -> DataFrame:
    """Turns that hold the whole phrase, ranked: ``rank`` is negative, lower is better.

    The token filter is an array overlap before any counting. Corpus statistics are two aggregates
    over the index; term counts are of the searched columns, lengths of all columns.
    """
    cols = [c for c in COLUMNS if include_thinking or c != "thinking"]
    if not phrase:
        return indexed.where(F.lit(False)).select("session_id", "seq", F.lit(0).cast("long").alias("tf"), F.lit(0.0).alias("rank"))
    may = F.lit(False)
    for c in cols:
        may = may | F.array_contains(c, phrase[0])
    tf = sum((occurrences(F.col(c), phrase) for c in cols), F.lit(0).cast("long"))
    hits = indexed.where(may).withColumn("tf", tf).where("tf > 0")
    n, mean = indexed.agg(F.count(F.lit(1)), F.avg("length")).first()
    return ranked(hits, n, hits.count(), mean)


def ranked(hits: DataFrame, n: int, df: int, mean: float | None) -> DataFrame:
    """Rank of hits (``tf``, ``length``) among ``n`` turns of ``mean`` tokens, ``df`` of which have the phrase."""
    idf = log((n - df + 0.5) / (df + 0.5)) if n else 0.0
    idf = idf if idf > 0 else LEAST_IDF
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(float(mean or 1))))
    return hits.select("session_id", "seq", "tf", (-idf * part).alias("rank"))


def top_k(hits: DataFrame, k: int) -> DataFrame:
    """The ``k`` best hits, ties by session and number."""
    return hits.orderBy("rank", "session_id", "seq").limit(k)


_TOKEN = "\\p{L}\\p{N}\\p{Co}\\p{Mn}"


def snippet(text: Column, phrase: list[str], width: int = 10) -> Column:
    """``width`` tokens of the text itself around the phrase's first match, the match in brackets, ``…`` where it was cut.

    What stands between tokens is kept; null if the text doesn't hold the phrase.
    """
    units = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[^{_TOKEN}]*[{_TOKEN}]+"), F.lit(0))
    return let(F.struct(units.alias("units"), tokens(text).alias("own")), lambda s: _around(s["units"], s["own"], phrase, width))


def _around(units: Column, own: Column, phrase: list[str], width: int) -> Column:
    """A snippet from the tokens of a text as they are written, each with what stands before it, and as they are folded."""
    n = len(phrase)
    last = F.size(own) - n
    same = lambda i: F.reduce(F.array(*[F.get(own, i + k) == F.lit(w) for k, w in enumerate(phrase)]), F.lit(True), lambda a, b: a & b)
    places = F.filter(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")), same)
    join = lambda low, count: F.array_join(F.slice(units, low + 1, F.greatest(count, F.lit(0))), "")

    def shown(first: Column) -> Column:
        start = F.greatest(F.lit(0), first - (width - n) // 2)
        hit = join(first, F.lit(n))
        marked = F.concat(F.regexp_extract(hit, f"^[^{_TOKEN}]*", 0), F.lit("["), F.regexp_replace(hit, f"^[^{_TOKEN}]+", ""), F.lit("]"))
        body = F.concat(join(start, first - start), marked, join(first + n, F.lit(width - n) - (first - start)))
        body = F.regexp_replace(body, f"^[^{_TOKEN}\\[]+", "")
        return F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(start + width < F.size(units), "…").otherwise(""))

    return let(F.get(places, F.lit(0)), lambda first: F.when(first.isNotNull(), shown(first)))
