"""Canonical exact digests of documents.

A text is brought to one canonical form (Unicode NFKC, full case folding, NFKC again, every run of
white space one blank, ends trimmed), hashed to 128 bits with two differently seeded xxhash64, and
documents are grouped by that digest. Inside a bucket of equal digests the canonical bytes are
compared; should two different canonical texts ever meet in one bucket, their fingerprints are made
distinct by their SHA-256, so equal fingerprints always mean byte-equal canonical texts.

Everything runs as built-in Spark SQL expressions (the normalisation is ICU's, which Spark ships,
called through Spark's ``reflect`` function).

Defined cases: a null text is the empty text; empty texts share one fingerprint; repeated rows get
the same fingerprint and each its own output row; an empty table gives an empty result; any further
columns are carried along untouched unless they clash with an output name, in which case the output
wins; a null ``doc_id`` sorts before all others; ids of ``edit_report`` are integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.session import forget, materialize

#: Rows that one bucket of ascending ids aims at, and the most buckets there can be.
ROWS_PER_BUCKET = 1024
MAX_BUCKETS = 1 << 18
#: A set of digests up to this many rows (some 50 bytes each) is broadcast, a larger one is shuffled.
BROADCAST_ROWS = 100_000


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC, white space folded; null becomes the empty text."""
    nfkc = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    fold = lambda c: F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))
    x = F.coalesce(text, F.lit(""))
    plain = ~F.rlike(x, F.lit("[^\\x00-\\x7F]"))
    x = F.when(plain, F.lower(x)).otherwise(nfkc(fold(nfkc(x))))
    return F.trim(F.regexp_replace(x, "[\\s\\p{Z}\\x1C-\\x1F\\x85]+", " "))


def digest(canon: Column) -> Column:
    """128 bits as 32 lowercase hexadecimal digits."""
    halves = [F.lpad(F.hex(F.xxhash64(canon)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit("second half"), canon)), 16, "0")]
    return F.lower(F.concat(*halves))


def near(left: Column, left_canon: Column, right: Column, right_canon: Column) -> Column:
    """Likeness of two exact fingerprints: 1 for byte-equal canonical texts, else 0."""
    same = F.when(left == right, left_canon == right_canon).otherwise(F.lit(False))
    return same.cast("double")


def _raw(text: Column) -> Column:
    return F.xxhash64(F.lit("raw"), F.coalesce(text, F.lit("")))


def _printed(docs: DataFrame, text: str) -> DataFrame:
    """All columns in ``row``, the canonical text (``canon``, worked out once) and its digest (``fp``)."""
    return docs.select(F.struct("*").alias("row"), canonical(F.col(text)).alias("canon")).select("row", "canon", digest(F.col("canon")).alias("fp"))


def collisions(docs: DataFrame, text: str = "text") -> DataFrame | None:
    """Digests under which different canonical texts meet (``_met``), by comparing bytes in each bucket.

    The digests are written once, with a hash of the text they come from. Only texts in buckets of two or
    more rows are read again, and of each bucket only the least and the greatest canonical text are kept,
    so no bucket is ever collected. None if no bucket holds different texts.
    """
    texts = docs.select(F.col(text).alias("text"))
    prints = materialize(_printed(texts, "text").select(_raw(F.col("row.text")).alias("raw"), "fp"), "prints")
    many = prints.groupBy("fp").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("fp")
    shared = materialize(prints.join(many, "fp", "left_semi").select("raw").distinct(), "shared")
    forget(prints)
    n = shared.count()
    found = None
    if n:
        side = F.broadcast(shared) if n <= BROADCAST_ROWS else shared
        again = _printed(texts.join(side, _raw(F.col("text")) == F.col("raw"), "left_semi"), "text")
        met = again.groupBy("fp").agg(F.min("canon").alias("a"), F.max("canon").alias("b")).where("a <> b")
        met = materialize(met.select(F.col("fp").alias("_met")), "met")
        found = None if met.isEmpty() else met
    forget(shared)
    return found


def _longer(rows: DataFrame, met: DataFrame | None, fp: str, canon: str) -> DataFrame:
    """Digests that different texts share, made distinct by the SHA-256 of the text."""
    if met is None:
        return rows
    out = rows.join(met, F.col(fp) == F.col("_met"), "left")
    return out.withColumn(fp, F.when(F.col("_met").isNotNull(), F.concat(fp, F.sha2(canon, 256))).otherwise(F.col(fp))).drop("_met")


def fingerprint(docs: DataFrame, text: str = "text", exact: bool = True) -> DataFrame:
    """``docs`` with ``fingerprint``; with ``exact`` buckets of equal digests are compared by bytes."""
    met = collisions(docs, text) if exact else None
    out = _longer(_printed(docs.drop("fingerprint"), text), met, "fp", "canon")
    return out.select("row.*", F.col("fp").alias("fingerprint"))


def duplicate_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key``, ``fingerprint``, ``class_id`` (least key of its class), ``class_size``."""
    named = fingerprint(docs, text).select(key, "fingerprint")
    classes = named.groupBy("fingerprint").agg(F.min(key).alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return named.join(classes, "fingerprint").select(key, "fingerprint", "class_id", "class_size")


def _buckets(ids: DataFrame, key: str) -> Column:
    """Range bucket of ``key`` from its quantiles, refined linearly between them; null goes to -1."""
    n, low, high = ids.agg(F.count(F.lit(1)), F.min(key), F.max(key)).first()
    if low is None or low == high:
        return F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.lit(0)).cast("long")
    wanted = min(MAX_BUCKETS, max(1, n // ROWS_PER_BUCKET))
    cuts = min(wanted, 256)
    fine = max(1, wanted // cuts)
    at = [i / cuts for i in range(1, cuts)] or [0.5]
    inner = ids.agg(F.percentile_approx(key, at, 10_000).alias("q")).first()["q"]
    edges = sorted({low, min(high + 1, (1 << 63) - 1), *inner})
    bounds = F.array(*[F.lit(int(e)) for e in edges])
    i = F.size(F.filter(bounds, lambda b: b <= F.col(key)))
    lo, hi = F.get(bounds, i - 1), F.get(bounds, i)
    # as doubles, which never overflow and keep the order; the largest long has no edge above it
    wide = lambda c: c.cast("double")
    part = F.floor((wide(F.col(key)) - wide(lo)) / (wide(hi) - wide(lo)) * fine)
    b = (i - 1).cast("long") * fine + F.least(part, F.lit(fine - 1))
    return F.when(F.col(key).isNull(), F.lit(-1)).otherwise(b).cast("long")


def with_next(docs: DataFrame, key: str, columns: list[str], order: list[str], derive=lambda df: df) -> DataFrame:
    """``docs`` plus ``next_<c>`` of the following row by ascending ``key`` (the last row's is the first's).

    Rows are dealt into range buckets of the key, each bucket sorted on its own; only the first row
    of each bucket (at most ``MAX_BUCKETS`` of them) crosses to its predecessor, so nothing is
    ordered in a single task. ``derive`` adds columns that are dear to work out: once for each row, and
    for the rows that cross.
    """
    bucket = _buckets(docs.select(key), key)
    rows = derive(docs).withColumn("_b", bucket)
    w = Window.partitionBy("_b").orderBy(key, *order)
    for c in columns:
        rows = rows.withColumn(f"next_{c}", F.lead(c).over(w))
    rows = rows.withColumn("_last", F.lead(F.lit(1)).over(w).isNull())
    # the least row of every bucket, by key first and then by the tie order
    first = docs.select(key, *order).groupBy(bucket.alias("_b")).agg(F.min(F.struct(key, *order)).alias("f"))
    first = materialize(first.select("_b", *[F.col("f")[c].alias(f"_f_{c}") for c in (key, *order)]), "first")
    top = first.agg(F.max("_b")).first()[0]
    # at most MAX_BUCKETS rows of a few numbers
    lead_of = first.withColumn("_to", F.coalesce(F.lag("_b").over(Window.orderBy("_b")), F.lit(top))).drop("_b")
    heads = docs.join(F.broadcast(lead_of), F.col(key).eqNullSafe(F.col(f"_f_{key}")))
    for c in order:
        heads = heads.where(F.col(c).eqNullSafe(F.col(f"_f_{c}")))
    heads = derive(heads).groupBy("_to").agg(*[F.first(c).alias(f"_h_{c}") for c in columns])
    heads = heads.withColumn("_end", F.lit(True))
    out = rows.join(heads, (F.col("_b") == F.col("_to")) & (F.col("_last") == F.col("_end")), "left")
    for c in columns:
        out = out.withColumn(f"next_{c}", F.when(F.col("_last"), F.col(f"_h_{c}")).otherwise(F.col(f"next_{c}")))
    return out.drop("_b", "_last", "_to", "_end", *[f"_h_{c}" for c in columns])


def edit_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text (see the query's contract in ``queries``).

    A text is brought to canonical form once to find shared digests, once for its fingerprint and once
    edited; canonical texts are compared only where digests are equal.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("_tie"))
    met = collisions(rows)

    def derive(df: DataFrame) -> DataFrame:
        done = _longer(_printed(df, "text"), met, "fp", "canon")
        return done.select("row.*", F.col("fp").alias("fingerprint"))

    rows = with_next(rows, "doc_id", ["text", "fingerprint"], ["_tie"], derive)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), F.substring(F.col("next_text"), F.lit(1), half))
    done = _longer(_printed(rows.withColumn("_edited", edited), "_edited"), met, "fp", "canon")
    out = done.select("row.*", "canon", F.col("fp").alias("edited_fingerprint"))
    return out.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("_edited"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        near(F.col("fingerprint"), canonical(F.col("text")), F.col("edited_fingerprint"), F.col("canon")).alias("near_edited"),
        near(F.col("fingerprint"), canonical(F.col("text")), F.col("next_fingerprint"), canonical(F.col("next_text"))).alias("near_next"),
    )
