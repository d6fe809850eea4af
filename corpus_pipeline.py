"""A corpus pipeline over ``documents``: language, repeated lines, near copies, leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last
return the columns of ``documents``. ``run`` writes each stage's rows to the shared folder and reads
them back for the next one.

Defined cases, the same for all stages: ids, texts and any other column may be null; a null or empty text
has no letters and goes in the first stage; repeated rows are treated alike, and of equal rows of a class
one stays; further columns pass through all stages but the last, whatever their names are, which returns
pieces; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import decontamination, jaccard_join, langid, line_dedup, packing
from colloquy.llm.queries import vocabulary
from colloquy.session import materialize, ship, table

#: Lines found in so many documents go.
MIN_DOCS = 10
#: Up to this many dropped documents (16 bytes each) are broadcast, more are shuffled.
BROADCAST_ROWS = 200_000


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: texts without letters and texts whose best two languages are tied go.

    When no row has a language to learn from, every text with letters stays.
    """
    ship(spark)
    model = langid.train(docs, F.lit(True))
    if not model.languages:
        return docs.where(F.udf(lambda text: bool(langid.letters(text)), "boolean")("text")).select(*docs.columns)
    kept = langid.predict(docs, model).where((F.col("lang_pred") != langid.UNKNOWN) & ~F.col("ambiguous"))
    return kept.select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: lines found in ``MIN_DOCS`` documents or more go from every text."""
    out = line_dedup.dedup_lines(docs, MIN_DOCS)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*docs.columns)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each class of near copies one document stays, that with the least id.

    Ids may repeat or be null (these come last), so classes are formed by a key of id and text, which
    also decides between different texts of one id.
    """
    ship(spark)
    # a row's own columns travel in one struct, so that no name of theirs meets one of these
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.coalesce("text", F.lit("")))
    rows = docs.select(F.struct("*").alias("row"), key.alias("key"), F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("whole"))
    classes = jaccard_join.join_classes(docs.select(key.alias("doc_id"), "text"))
    many = classes.where("class_size > 1").select(F.col("doc_id").alias("key"), F.col("component_id").alias("class"))
    many = materialize(many.groupBy("key", "class").agg(F.count(F.lit(1)).alias("rows")), "classes")
    ids = rows.select("key", F.struct(F.col("id").isNull().alias("none"), "id", F.xxhash64("whole").alias("text"), F.col("key").alias("k")).alias("rank"))
    first = many.join(ids, "key").groupBy("class").agg(F.min("rank")["k"].alias("key"))
    marked = materialize(many.join(first.withColumn("first", F.lit(True)), ["class", "key"], "left"), "marked")
    gone = marked.where("first is null").select("key").distinct()
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    kept = rows.join(gone, "key", "left_anti")
    if not marked.where("first and rows > 1").isEmpty():
        kept = kept.dropDuplicates(["id", "whole"])
    return kept.select("row.*")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that contain a benchmark item go."""
    ship(spark)
    return decontamination.remove(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: pieces of sequences of at most 2048 tokens."""
    ship(spark)
    pieces = packing.pack(docs, vocabulary, size=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", keep_identified),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", keep_one_of_each_class),
    ("decontamination", drop_leaks),
    ("packing", pack_sequences),
]

#: Language ID and packing can't be said in SQL; the tests hold run() against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
