"""Streams into the library: every line once, whatever is stopped where; limits whose state lives between batches."""

import json
import os
import random
import time
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from colloquy.operators import reach, store, upkeep
from colloquy.sources import descriptors, ranges, transcripts
from colloquy.sources.versions import Versions
from colloquy.streaming import appended, ingest, limits

BLOCKS = descriptors.BUILT_IN[0]


def line(text, **more):
    return (json.dumps({"type": "user", "timestamp": "2024-01-01T00:00:01Z", "cwd": "/w", "message": {"content": text}, **more}) + "\n").encode()


def mark():
    return (json.dumps({"type": "system", "subtype": "compact_boundary"}) + "\n").encode()


class Folder:
    def __init__(self, spark, tmp_path):
        self.spark, self.root, self.checkpoint = spark, tmp_path / "in", str(tmp_path / "mark")
        (self.root / "p").mkdir(parents=True)
        self.library = store.Library(spark, str(tmp_path / "lib"))

    def add(self, name, *lines):
        with open(self.root / "p" / f"{name}.jsonl", "ab") as f:
            f.write(b"".join(lines))

    def start(self, write=None):
        write = write or ingest.writer(self.library, BLOCKS, "m", "in")
        rows = appended.lines(self.spark, str(self.root))
        return rows.writeStream.foreachBatch(write).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()

    def run(self, write=None):
        self.start(write).awaitTermination()

    def turns(self):
        rows = self.library.snapshot().surfaced().orderBy("native_id", "seq").collect()
        return [(r["native_id"], r["seq"], r["text"], r["surface"]) for r in rows]


def test_numbers_titles_and_marks_go_on_between_batches(spark, tmp_path):
    f = Folder(spark, tmp_path)
    f.add("a", line("one"), line("two")[:-5])
    f.add("b", line("x"))
    f.run()
    f.add("a", line("two")[-5:], mark(), line("three"), (json.dumps({"type": "custom-title", "customTitle": "Named"}) + "\n").encode())
    f.run()
    f.add("b", line("y"))
    f.run()
    assert f.turns() == [("a", 1, "one", "superseded"), ("a", 2, "two", "superseded"), ("a", 3, "three", "current"), ("b", 1, "x", "current"), ("b", 2, "y", "current")]
    sessions = {r["native_id"]: r for r in f.library.snapshot().sessions().collect()}
    assert (sessions["a"]["turn_count"], sessions["a"]["title_user"], sessions["a"]["title_derived"], sessions["b"]["turn_count"]) == (3, "Named", "one", 2)
    assert f.library.snapshot().index().search(["three"]).count() == 1
    # the same as reading the folder whole
    whole, _ = transcripts.tables(transcripts.parse(transcripts.lines(spark, str(f.root), BLOCKS), BLOCKS, "m"), BLOCKS)
    assert [(r["native_id"], r["seq"], r["text"], r["surface"]) for r in whole.orderBy("native_id", "seq").collect()] == f.turns()


def test_a_crash_between_commit_and_checkpoint_writes_nothing_twice(spark, tmp_path, monkeypatch):
    f = Folder(spark, tmp_path)
    f.add("a", line("one"))
    f.run()
    f.add("a", line("two"))
    own = ingest.writer(f.library, BLOCKS, "m", "in")

    def dies_after(rows, number):
        own(rows, number)
        raise RuntimeError("killed after the commit")

    with pytest.raises(Exception, match="killed after"):
        f.run(dies_after)
    assert len(f.turns()) == 2
    f.run()
    assert [t[2] for t in f.turns()] == ["one", "two"]
    f.add("a", line("three"))
    commit = Versions.commit
    monkeypatch.setattr(Versions, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed before the commit")))
    with pytest.raises(Exception, match="killed before"):
        f.run()
    monkeypatch.setattr(Versions, "commit", commit)
    assert len(f.turns()) == 2
    f.run()
    assert [t[:3] for t in f.turns()] == [("a", 1, "one"), ("a", 2, "two"), ("a", 3, "three")]
    f.run()
    assert len(f.turns()) == 3


def test_a_file_written_anew_replaces_its_session(spark, tmp_path):
    f = Folder(spark, tmp_path)
    f.add("a", line("one"), line("two"), line("three"))
    f.add("b", line("kept"))
    f.run()
    (f.root / "p" / "a.jsonl").write_bytes(line("new"))
    f.run()
    assert [t[:3] for t in f.turns()] == [("a", 1, "new"), ("b", 1, "kept")]


def test_reconcile_finds_what_the_stream_missed(spark, tmp_path):
    f = Folder(spark, tmp_path)
    f.add("a", line("one"))
    f.run()
    f.add("missed", line("m1"), mark(), line("m2"))
    f.add("a", line("two"))
    os.utime(f.root / "p" / "a.jsonl", (4_000_000_000, 4_000_000_000))
    listed = lambda: transcripts.files(spark, str(f.root), BLOCKS)
    step = lambda: ingest.reconcile(f.library, listed(), ranges.lines, BLOCKS, "m")
    assert step() == 2 and step() == 0
    assert f.turns() == [("a", 1, "one", "current"), ("a", 2, "two", "current"), ("missed", 1, "m1", "superseded"), ("missed", 2, "m2", "current")]
    # a session that comes back empty fails the commit and keeps its turns
    (f.root / "p" / "a.jsonl").write_bytes(b"{}\n")
    os.utime(f.root / "p" / "a.jsonl", (4_100_000_000, 4_100_000_000))
    with pytest.raises(store.CheckFailed, match="empty"):
        step()
    assert len(f.turns()) == 4


def test_a_watch_starts_again_after_failures(spark, tmp_path):
    f = Folder(spark, tmp_path)
    f.add("a", line("one"))
    own, left = ingest.writer(f.library, BLOCKS, "m", "in"), [2]

    def fails_twice(rows, number):
        if left[0]:
            left[0] -= 1
            raise RuntimeError("injected")
        own(rows, number)

    def start():
        rows = appended.lines(spark, str(f.root))
        return rows.writeStream.foreachBatch(fails_twice).option("checkpointLocation", f.checkpoint).trigger(processingTime="100 milliseconds").start()

    reconciled, end = [], time.monotonic() + 90

    def reconcile():
        reconciled.append(1)
        raise OSError("folder is away")

    w = ingest.Watch(start, reconcile, every=0.5, first_pause=0.05)
    w.run(until=lambda: time.monotonic() > end or (f.library.snapshot().n == 1 and reconciled))
    assert [t[2] for t in f.turns()] == ["one"] and left == [0]
    assert sum("injected" in x for x in w.failures) == 2 and any("away" in x for x in w.failures)


def requests(n, keys, seed, step=300):
    rng, at = random.Random(seed), 1_700_000_000_000
    out = []
    for _ in range(n):
        at += rng.choice([0, 10, step, step, 5 * step])
        out.append((f"k{rng.randrange(keys)}", at))
    return out


def plain_limiter(rows, most):
    """One table of buckets, looked through whole at every request."""
    held, out = {}, []
    for key, at in rows:
        for k in list(held):
            level, last = held[k]
            if level + max(0, at - last) * 5 / 60_000 >= 5:
                del held[k]
        if key not in held and len(held) >= most:
            out.append(False)
            continue
        level, last = held.get(key, (5.0, at))
        level = min(5.0, level + max(0, at - last) * 5 / 60_000)
        out.append(level >= 1)
        held[key] = (level - (level >= 1), max(at, last))
    return out


@pytest.mark.parametrize(("keys", "most", "step"), [(3, 10, 2000), (40, 6, 900), (40, 6, 5000), (5, 1, 3000)])
def test_a_full_table_refuses_new_keys(spark, keys, most, step):
    rows = sorted(requests(400, keys, keys, step), key=lambda r: (r[1], r[0]))
    want = plain_limiter(rows, most)
    buckets = reach.Buckets(most=most)
    assert [buckets.allow(k, at) for k, at in rows] == want and len(buckets.entries) <= most
    got = reach.rate_limited_within(spark.createDataFrame(rows, "key string, at long").repartition(5), most=most)
    assert sorted((r["key"], r["at"], r["passed"]) for r in got.collect()) == sorted((k, at, p) for (k, at), p in zip(rows, want, strict=True))


def test_a_clock_that_steps_back_neither_fills_nor_drains():
    b = reach.Buckets()
    assert [b.allow("k", at) for at in (10_000, 0, 5_000, 10_000, 10_000, 10_000)] == [True] * 5 + [False]
    assert b.allow("k", 22_000)


def stream_of(spark, folder, rows, schema, batches):
    folder.mkdir()
    for i in range(batches):
        part = rows[i * len(rows) // batches : (i + 1) * len(rows) // batches]
        spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_millis("at")).coalesce(1).write.parquet(str(folder / "tmp" / str(i)))
        (source,) = (folder / "tmp" / str(i)).glob("part-*.parquet")
        source.rename(folder / f"{i}.parquet")
        os.utime(folder / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema + ", ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(folder))


def drained(spark, rows, tmp_path, name):
    q = rows.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"mark-{name}")).start()
    try:
        q.processAllAvailable()
        return spark.table(name).collect()
    finally:
        q.stop()


def test_streamed_limits_equal_the_batch_folds(spark, tmp_path):
    rows = sorted(requests(160, 9, 4, 2500), key=lambda r: (r[1], r[0]))
    rows = list(dict.fromkeys(rows))
    # rows of one time stay in one batch
    batches = 4
    got = drained(spark, limits.rate_limited(stream_of(spark, tmp_path / "a", rows, "key string, at long", batches), most=4), tmp_path, "limited")
    want = plain_limiter(rows, 4)
    assert sorted((r["key"], r["at"], r["passed"]) for r in got) == sorted((k, at, p) for (k, at), p in zip(rows, want, strict=True))
    sessions = spark.createDataFrame(rows, "session_id string, at long")
    got = drained(spark, limits.wakes_sent(stream_of(spark, tmp_path / "b", rows, "session_id string, at long", batches)), tmp_path, "wakes")
    assert sorted(map(tuple, got)) == sorted(map(tuple, reach.wakes_sent(sessions).collect()))


def test_jobs_of_a_late_peer_are_cancelled(spark):
    def endless():
        return spark.range(8, numPartitions=8).mapInPandas(lambda it: (time.sleep(60) or x for x in it), "id long")

    began = time.monotonic()
    got = upkeep.ask_peers({"slow": endless, "slower": endless, "ok": lambda: spark.range(3)}, at_once=2, seconds=6.0)
    assert time.monotonic() - began < 20 and isinstance(got["slow"], TimeoutError) and isinstance(got["slower"], TimeoutError)
    tracker = spark.sparkContext.statusTracker()
    for _ in range(100):
        if not tracker.getActiveJobsIds():
            break
        time.sleep(0.1)
    assert not tracker.getActiveJobsIds()
    assert spark.range(5).count() == 5


def test_buckets_count_to_the_last_digit_as_the_fold_does(spark):
    # waits whose shares of a token add up to whole ones, exactly or all but
    rng = random.Random(1)
    rows = [(f"k{step}", at) for step in (1_000, 3_000, 4_000, 6_000) for at in accumulate(step * rng.randrange(8) for _ in range(300))]
    asked = spark.createDataFrame(rows, "key string, at long")
    got = reach.rate_limited_within(asked).select("key", "at", "passed")
    want = reach.rate_limited(asked).select("key", "at", "passed")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
