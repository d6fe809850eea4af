"""The stored library: its index equals a rebuild after any writes, and commits are whole or not at all."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from colloquy.operators import blocks, fts, providers, store
from colloquy.sources.versions import Conflict, Versions

TURN = "session_id string, seq long, text string, thinking string, tool_calls string, uuid string"
WORDS = ["red", "fox", "hen", "the", "Réd", "sea"]


def make(spark, sessions, rng):
    rows = []
    for s in sessions:
        for seq in range(1, rng.randint(1, 6)):
            say = lambda: " ".join(rng.choices(WORDS, weights=[5, 3, 1, 9, 1, 2], k=rng.randint(0, 12)))
            rows.append((s, seq, say(), say() if rng.random() < 0.3 else "", rng.choice(["", "fox", "the the"]), f"{s}-{seq}"))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, TURN)


def ranks(df):
    return sorted((r["session_id"], r["seq"], r["tf"], round(r["rank"], 9)) for r in df.collect())


def best(df):
    return [(r["session_id"], r["seq"], r["tf"], round(r["rank"], 9)) for r in df.orderBy("rank", "session_id", "seq").collect()]


def same_as_rebuilt(spark, library, rows):
    """The library's turns and answers against an index made of the rows alone."""
    now = library.snapshot()
    assert sorted(tuple(r) for r in now.turns().select("session_id", "seq", "text").collect()) == sorted(r[:3] for r in rows)
    fresh = fts.index(frame(spark, rows)).cache()
    index = now.index()
    assert now.n == len(rows)
    for phrase, thinking in ((["the"], False), (["red", "fox"], True)):
        want = fts.search(fresh, phrase, thinking)
        assert ranks(index.search(phrase, thinking)) == ranks(want), phrase
        assert best(index.top_k(phrase, 7, thinking)) == best(fts.top_k(want, 7)), phrase
    fresh.unpersist()


def files(root):
    return {p: p.stat().st_mtime_ns for p in Path(root).rglob("*.parquet")}


def test_writes_deletions_rereads_and_merges_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(11)
    library, live = store.Library(spark, str(tmp_path / "lib")), {}

    def put(names):
        rows = make(spark, names, rng)
        library.write(frame(spark, rows))
        for s in {r[0] for r in rows}:
            live[s] = [r for r in rows if r[0] == s]

    rows = lambda: [r for own in live.values() for r in own]
    put([f"s{i}" for i in range(20)])
    first = files(tmp_path / "lib")
    put([f"t{i}" for i in range(6)])
    same_as_rebuilt(spark, library, rows())
    put(["s3", "s4", "t1", "new"])  # read again
    same_as_rebuilt(spark, library, rows())
    gone = ["s3", "s7", "t2", "unknown"]
    library.delete(spark.createDataFrame([(s,) for s in gone], "session_id string"))
    for s in gone:
        live.pop(s, None)
    same_as_rebuilt(spark, library, rows())
    # nothing written before was touched
    later = files(tmp_path / "lib")
    assert all(later[p] == t for p, t in first.items())
    put(["s3"])  # a deleted session comes back
    before = len(library.snapshot().segments)
    library.merge()
    now = library.snapshot()
    assert len(now.segments) < before == 4 and not now.deletes
    same_as_rebuilt(spark, library, rows())
    put(["s3", "u"])
    same_as_rebuilt(spark, library, rows())
    assert library.vacuum(keep=1, grace_ms=0) > 0
    same_as_rebuilt(spark, library, rows())


def test_most_blocks_of_a_common_word_stay_unread(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blocks, "FILE_ENTRIES", 20_000)
    n = 30_000
    times = F.when(F.col("id") % 5000 == 7, 9).when(F.col("id") % 11 == 0, 2).otherwise(1).cast("int")
    turns = spark.range(n).select(
        F.concat(F.lit("s"), F.pmod(F.xxhash64("id"), F.lit(997)).cast("string")).alias("session_id"),
        F.col("id").alias("seq"),
        F.concat(F.repeat(F.lit("common "), times), F.repeat(F.lit("x "), (F.col("id") % 37).cast("int")), F.when(F.col("id") % 300 == 0, "rare").otherwise("")).alias("text"),
        F.lit("").alias("thinking"),
        F.lit("").alias("tool_calls"),
    )
    library = store.Library(spark, str(tmp_path / "lib"))
    library.write(turns)
    index = library.snapshot().index()
    found = index.blocks("common")
    total = found.count()
    # the common word fills blocks of several files; no file is one word's alone
    assert total >= n / blocks.ENTRIES and found.select(F.input_file_name()).distinct().count() >= 2
    assert index.needed("common", 10).count() <= 0.05 * total
    assert index.frequency("common") == n
    full = fts.top_k(index.search(["common"]), 10)
    assert best(index.top_k(["common"], 10)) == best(full)
    # a filter that drops the best: later blocks are looked at
    keep = lambda hits: hits.where("seq % 11 = 5 and seq % 5000 != 7")
    assert best(index.top_k(["common"], 10, keep=keep)) == best(fts.top_k(keep(index.search(["common"])), 10))
    none = lambda hits: hits.where("seq < 0")
    assert index.top_k(["common"], 10, keep=none).count() == 0
    plan = index.needed("common", 10)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(max_plain" in plan and "LessThanOrEqual(min_length" in plan and "EqualTo(token,common)" in plan
    # deleted sessions neither count nor take a place
    dead = turns.select("session_id").where("session_id like 's1%'").distinct()
    library.delete(dead)
    now = library.snapshot().index()
    left = turns.where("session_id not like 's1%'")
    assert now.frequency("common") == now.n == left.count()
    assert best(now.top_k(["common"], 10)) == best(fts.top_k(fts.search(fts.index(left), ["common"]), 10))


def test_an_empty_library_and_empty_writes(spark, tmp_path):
    library = store.Library(spark, str(tmp_path / "lib"))
    now = library.snapshot()
    assert now.version == 0 and now.n == 0 and now.turns() is None and now.index().search(["x"]).count() == 0 and now.index().top_k(["x"], 3).count() == 0
    library.write(frame(spark, []))
    assert library.snapshot().n == 0 and library.merge() == 1
    library.write(frame(spark, [("a", 1, None, None, None, None)]))
    now = library.snapshot()
    assert now.n == 1 and now.index().search([]).count() == 0 and now.index().top_k(["x"], 3).count() == 0


def test_commits_are_whole_and_in_order(spark, tmp_path):
    versions = Versions(spark, str(tmp_path / "v"))
    assert versions.read() == (0, {}) and versions.commit(0, {"a": 1}) == 1
    with pytest.raises(Conflict):
        versions.commit(0, {"a": 2})
    assert versions.read() == (1, {"a": 1})
    # another commit between reading and writing: the change is worked out anew
    seen = []

    def step(base, state):
        seen.append(base)
        if len(seen) == 1:
            versions.commit(1, {"a": 5})
        return {"a": state["a"] + 1}

    assert versions.change(step) == 3 and seen == [1, 2] and versions.read() == (3, {"a": 6})
    assert versions.read(1) == (1, {"a": 1})


def test_failed_checks_leave_the_last_version(spark, tmp_path):
    library = store.Library(spark, str(tmp_path / "lib"))
    rows = [("a", 1, "one", "", "", "a1"), ("b", 1, "two", "", "", "b1")]
    library.write(frame(spark, rows))
    with pytest.raises(store.CheckFailed, match="2 were to be"):
        library.write(frame(spark, [("c", 1, "x", "", "", None)]), expect=2)
    # both were read again, one came back without turns
    ids = spark.createDataFrame([("a",), ("b",), ("never",)], "session_id string")
    with pytest.raises(store.CheckFailed, match="empty: b"):
        library.write(frame(spark, [("a", 1, "again", "", "", None)]), reread=ids)
    with pytest.raises(store.CheckFailed):
        library.delete(ids, expect=1)
    assert library.snapshot().version == 1
    same_as_rebuilt(spark, library, rows)
    library.write(frame(spark, [("a", 1, "again", "", "", None)]), reread=ids.where("session_id = 'a'"))
    same_as_rebuilt(spark, library, [("a", 1, "again", "", "", None), rows[1]])


def test_archive_moves_add_up(spark, tmp_path):
    main, old = store.Library(spark, str(tmp_path / "main")), store.Library(spark, str(tmp_path / "old"))
    rng = random.Random(2)
    rows = make(spark, [f"s{i}" for i in range(12)], rng)
    sessions = spark.createDataFrame([(s, f"/w/{s}", 5) for s in sorted({r[0] for r in rows})], "session_id string, cwd string, turn_count long")
    main.write(frame(spark, rows), sessions)
    total = main.snapshot().n
    ids = spark.createDataFrame([("s1",), ("s2",), ("s3",), ("nowhere",)], "session_id string")
    there = {r[0] for r in rows} & {"s1", "s2", "s3"}
    moved = [r for r in rows if r[0] in there]
    assert store.move(main, old, ids) == (len(there), len(moved))
    assert main.snapshot().n + old.snapshot().n == total and old.snapshot().n == len(moved)
    assert {r.session_id for r in old.snapshot().sessions().collect()} == there and not there & {r.session_id for r in main.snapshot().sessions().collect()}
    assert store.move(main, old, ids) == (0, 0) and old.snapshot().n == len(moved)
    same_as_rebuilt(spark, main, [r for r in rows if r[0] not in there])
    # stopped after the archive's commit: run again, nothing is lost or doubled
    more = ids.sparkSession.createDataFrame([("s5",), ("s6",)], "session_id string")
    going = main.snapshot().turns().join(more, "session_id", "left_semi")
    old.write(going)
    store.move(main, old, more)
    assert main.snapshot().n + old.snapshot().n == total
    assert store.Snapshot(spark, main.versions, *main.versions.read(1)).n == total  # the version before is whole


def test_a_batch_is_written_once_and_appends(spark, tmp_path):
    library = store.Library(spark, str(tmp_path / "lib"))
    one, two = [("a", 1, "one", "", "", "u1")], [("a", 2, "two", "", "", "u2"), ("b", 1, "x", "", "", "u3")]
    meta = "session_id string, cwd string, title_user string, title_derived string, started_at long, last_turn_at long, turn_count long, max_ts long, note string"
    library.write(frame(spark, one), spark.createDataFrame([("a", "/w", "T", "one", 5, 5, 1, 5, "n1")], meta), replace=False, batch=("in", 0))
    for _ in range(2):
        library.write(frame(spark, two), spark.createDataFrame([("a", None, None, "two", 6, 6, 1, 6, "n2"), ("b", "/v", None, "x", None, None, 1, None, None)], meta), replace=False, batch=("in", 1))
    library.write(frame(spark, two), replace=False, batch=("in", 0))
    now = library.snapshot()
    same_as_rebuilt(spark, library, one + two)
    got = {r["session_id"]: (r["cwd"], r["title_user"], r["title_derived"], r["started_at"], r["last_turn_at"], r["turn_count"], r["max_ts"], r["note"]) for r in now.sessions().collect()}
    assert got == {"a": ("/w", "T", "one", 5, 6, 2, 6, "n2"), "b": ("/v", None, "x", None, None, 1, None, None)}


def test_marks_of_later_segments_reach_earlier_turns(spark, tmp_path):
    library = store.Library(spark, str(tmp_path / "lib"))
    library.write(frame(spark, [("a", 1, "x", "", "", "u1"), ("a", 2, "y", "", "", "u2")]), replace=False)
    library.write(frame(spark, [("a", 3, "z", "", "", "u3")]), marks=spark.createDataFrame([("a", 2, None)], store.MARKS), replace=False)
    assert [r["surface"] for r in library.snapshot().surfaced().orderBy("seq").collect()] == ["superseded", "superseded", "current"]


def test_columns_that_older_segments_lack_read_as_null(spark, tmp_path):
    library = store.Library(spark, str(tmp_path / "lib"))
    library.write(frame(spark, [("a", 1, "x", "", "", "u1")]).drop("uuid"))
    library.write(frame(spark, [("b", 1, "y", "", "", "u2")]))
    assert {r.session_id: r.uuid for r in library.snapshot().turns().collect()} == {"a": None, "b": "u2"}


def test_the_provider_cuts_before_it_reads_texts(spark, tmp_path):
    rows = [(f"s{i % 40}", i, "r", "user", i, "word " * (1 + i % 3) + "pad " * (i % 5), "", "[]") for i in range(400)]
    turns = spark.createDataFrame(rows, "session_id string, seq long, runtime_id string, role string, ts long, text string, thinking string, tool_calls string")
    turns = turns.withColumn("tool_calls", F.array().cast("array<struct<name:string,input_digest:string>>"))
    sessions = turns.groupBy("session_id").agg(F.lit("/w").alias("cwd"))
    library = store.Library(spark, str(tmp_path / "lib"))
    library.write(turns)
    plain = providers.IndexProvider(turns, sessions, fts.index(turns))
    stored = providers.IndexProvider(turns, sessions, library.snapshot().index())
    for scope in (providers.Scope(since=0), providers.Scope(since=100, until=200), providers.Scope(since=0, folder="/none")):
        rows = [[tuple(r) for r in providers.Retrieval(p).search("word", scope, limit=15)[0].collect()] for p in (plain, stored)]
        assert rows[0] == rows[1] and len(rows[0]) == (0 if scope.folder else 15)


def test_postings_of_a_turn_are_put_together_where_it_is(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BATCH_TOKENS", 8)
    rows = [("s1", 1, ["b", "a", "b"], ["b"], []), ("s1", 2, [], [], []), ("s2", 1, ["é", "a"], [], ["a", "a"]), ("s2", 2, None, ["a"], ["a"]), ("s3", 1, ["a"] * 30, ["x"] * 3, ["y"])]
    indexed = spark.createDataFrame(rows, "session_id string, seq long, text array<string>, thinking array<string>, tool_calls array<string>")
    indexed = indexed.withColumn("length", (F.size("text") + F.size("thinking") + F.size("tool_calls")).cast("long"))
    found = blocks.entries(indexed.repartition(2, "session_id"))
    assert "Exchange" not in blocks.entries(indexed)._jdf.queryExecution().executedPlan().toString()
    want = []
    for session_id, seq, *columns in rows:
        if None in columns:
            continue
        for token in {t for c in columns for t in c}:
            at = [[i for i, t in enumerate(c) if t == token] for c in columns]
            want.append((token, session_id, seq, sum(map(len, columns)), *at, sum(map(len, at)), len(at[0]) + len(at[2])))
    assert sorted(map(tuple, found.collect())) == sorted(want)
