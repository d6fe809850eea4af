import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from colloquy.llm import line_dedup

BLANK = " \t\n\x0b\x0c\r"
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute(rows, least):
    key = lambda line: line.strip(BLANK).translate(UPPER)
    docs = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            docs[key(line)].add((d, t or ""))
    gone = {k for k, v in docs.items() if k and len(v) >= least}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in gone]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def check(spark, rows, least):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_lines int")
    got = line_dedup.dedup_lines(df, least).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, least)
    return got


def test_equals_brute_force(spark):
    rows = [(i, f"Shared line \n own {i}\n\n  \n{'ÄB' if i % 2 else 'äb'}\nSHARED LINE\t") for i in range(12)]
    rows += [(100, None), (101, ""), (102, "shared line"), (102, "shared line"), (None, "shared line\nx"), (103, "\n" * 500 + "z" * 100_000)]
    check(spark, rows, 10)
    check(spark, rows, 3)
    check(spark, rows, 1)


def test_repeated_rows_are_one_document(spark):
    got = check(spark, [(1, "a line")] * 12 + [(2, "a line")], 3)
    assert all(r["n_dropped"] == 0 for r in got)


def test_empty_table_and_digest(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.dedup_lines(df).count() == 0
    one = line_dedup.dedup_lines(spark.createDataFrame([(1, None)], "doc_id long, text string"), 1)
    assert one.select(F.sha2("text", 256)).first()[0] == hashlib.sha256(b"").hexdigest()


def test_runs_are_compacted(spark):
    runs = line_dedup.LineRuns(3)
    for b in range(5):
        runs.add(spark.createDataFrame([(b, b, 1, 1), (b, b, b, 9)], "_id long, _tx long, h1 long, h2 long"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert [tuple(r) for r in runs.frequent().collect()] == [(1, 1)]


def test_own_names_of_other_columns_are_kept(spark):
    rows = [(i, f"shared\nown {i}", 10 + i, 20 + i, 30 + i, 40 + i, 50 + i) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id int, _tx int, _key int, _gone int, at int")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df, 3).collect()}
    assert all((r["text"], r["_id"], r["_tx"], r["_key"], r["_gone"], r["at"]) == (f"own {i}", 10 + i, 20 + i, 30 + i, 40 + i, 50 + i) for i, r in got.items())


def test_a_document_of_very_many_lines(spark):
    body = "\n".join("again" if i % 2 else f"line {i}" for i in range(60_000))
    check(spark, [(1, body), (2, "again"), (3, "again\nx")], 3)


def test_lines_are_dropped_alike_by_a_join(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    check(spark, [(i, f"shared\nown {i}\n\nshared") for i in range(12)], 10)
