import json

from pyspark.sql import functions as F

from colloquy.sources import descriptors, transcripts
from colloquy.streaming import appended, presence

BLOCKS = descriptors.BUILT_IN[0]


def line(text):
    return (json.dumps({"type": "user", "message": {"content": text}}) + "\n").encode()


def test_appended_lines_resume_after_a_restart(spark, tmp_path):
    folder, out, mark = tmp_path / "in" / "p", str(tmp_path / "out"), str(tmp_path / "mark")
    folder.mkdir(parents=True)
    file = folder / "s.jsonl"

    def run():
        stream = appended.lines(spark, str(tmp_path / "in"))
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
        q.awaitTermination()

    torn = line("fünf")
    file.write_bytes(line("one") + b"\xff\n\n" + line("two") + torn[:-3])
    run()
    assert spark.read.parquet(out).count() == 2
    file.write_bytes(line("one") + b"\xff\n\n" + line("two") + torn + line("three"))
    (folder / "other.jsonl").write_bytes(line("new"))
    run()
    rows = spark.read.parquet(out)
    turns, _ = transcripts.tables(transcripts.parse(rows, BLOCKS, "m"), BLOCKS)
    assert sorted((t["native_id"], t["seq"], t["text"]) for t in turns.collect()) == [("other", 1, "new"), ("s", 1, "one"), ("s", 2, "two"), ("s", 3, "fünf"), ("s", 4, "three")]


def test_presence_changes(spark, tmp_path):
    steps = [[("a", 5), ("b", 10)], [("b", 60)], [("b", 100)], [("b", 200)], [("c", 1000)], [("c", 1001)], [("c", 1002)]]
    for i, rows in enumerate(steps):
        spark.createDataFrame(rows, "session_id string, s long").select("session_id", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(str(tmp_path / f"in-{i}"))
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(len(steps)):
        (source,) = (tmp_path / f"in-{i}").glob("part-*.parquet")
        source.rename(folder / f"{i}.parquet")
        import os

        os.utime(folder / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema("session_id string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = presence.changes(stream).writeStream.format("memory").queryName("presence").outputMode("append").option("checkpointLocation", str(tmp_path / "mark")).start()
    q.processAllAvailable()
    q.stop()
    got = {}
    for r in spark.table("presence").collect():
        got.setdefault(r["session_id"], []).append((r["state"], r["at"] // 1000))
    assert got["a"] == [("live", 5), ("stale", 95), ("evicted", 695)]
    assert [s for s, _ in got["b"]][:2] == ["live", "stale"] and got["c"][0][0] == "live"
