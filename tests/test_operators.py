import random
import sqlite3
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as tx
from colloquy.functions import timeparse
from colloquy.operators import fold, fts, providers, reach, retrieval, upkeep

TURN = "session_id string, runtime_id string, seq long, role string, ts long, text string, thinking string, opaque boolean, tool_calls array<struct<name:string,input_digest:string>>"


def turn(session, seq, text, ts=None, thinking="", tools=(), runtime="a"):
    return (session, runtime, seq, "user", ts, text, thinking, False, [(n, d) for n, d in tools])


def test_time_bounds_and_durations():
    zone, now = ZoneInfo("Europe/Berlin"), 1_700_000_000_000
    assert [timeparse.parse_duration(x) for x in ("90s", "5m", "6h", "2d", "1w", "3")] == [90_000, 300_000, 21_600_000, 172_800_000, 604_800_000, 10_800_000]
    assert timeparse.parse_bound("2024-01-01", now, zone) == 1_704_063_600_000
    assert timeparse.parse_bound("2024-01-01 10:30", now, zone) == 1_704_101_400_000
    assert timeparse.parse_bound("1704063600000", now, zone) == 1_704_063_600_000
    assert timeparse.parse_bound("1h", now, zone) == now - 3_600_000
    for bad in ("", "soon", "5y", "-3h", "9" * 9 + "w" + "x", "2024-03-31 02:30"):
        with pytest.raises(ValueError):
            timeparse.parse_bound(bad, now, zone)
    assert timeparse.parse_bound("2024-10-27 02:30", now, zone) == 1_729_989_000_000  # the earlier of two


@pytest.mark.parametrize("latest", [False, True])
def test_budgets_equal_a_literal_replay(spark, latest):
    rng = random.Random(5)
    rows, want = [], {}
    for s in range(40):
        sizes = [rng.choice([0, 1, 5, 30, 90]) for _ in range(rng.randint(1, 9))]
        rows += [turn(f"s{s}", i + 1, "x" * n, ts=i) for i, n in enumerate(sizes)]
        kept, used = [], 0
        for i in (reversed(range(len(sizes))) if latest else range(len(sizes))):
            if kept and (used + sizes[i] > 100 or len(kept) >= 4):
                break
            kept.append(i + 1)
            used += sizes[i]
        want[f"s{s}"] = (sorted(kept), len(kept) < len(sizes))
    df = spark.createDataFrame(rows, TURN)
    got = retrieval.read_latest(df, 0, None, limit=4, budget=100) if latest else retrieval.read_forward(df, limit=4, budget=100)
    out = {}
    for r in got.collect():
        out.setdefault(r["session_id"], ([], r["more"]))[0].append(r["seq"])
    assert {k: (sorted(v), m) for k, (v, m) in out.items()} == want


def test_byte_caps_never_split_characters(spark):
    df = spark.createDataFrame([("é" * 10,), ("a" + "é" * 10,), ("日本" * 5,), ("short",), ("😀" * 4,)], "t string")
    got = [r[0] for r in df.select(tx.cap_bytes(F.col("t"), 9, "|")).collect()]
    assert got == ["é" * 4 + "|", "a" + "é" * 4 + "|", "日本日|", "short", "😀😀|"]


def test_excerpts_and_redaction(spark):
    long = "a" * 100 + " NEEDLE " + "b" * 200
    row = spark.createDataFrame([(long, "no match " * 30, "needle at once")], "a string, b string, c string").select(*[tx.excerpt(F.col(c), "needle") for c in "abc"]).first()
    assert row[0].startswith("…a") and row[0].endswith("…") and "NEEDLE" in row[0] and row[1] == ("no match " * 30)[:120] and row[2] == "needle at once"
    key = "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----"
    df = spark.createDataFrame([(f"x {key} y", "redis://h:6379 mongodb+srv://u:p@h")], "a string, b string")
    once = df.select(tx.scrub(F.col("a")).alias("a"), tx.scrub(F.col("b")).alias("b"))
    assert tuple(once.first()) == ("x [redacted:private-key] y", "redis://h:6379 mongodb+srv://u:[redacted]@h")
    assert once.select(tx.scrub(F.col("a")), tx.scrub(F.col("b"))).first()[0] == "x [redacted:private-key] y"


def test_full_text_equals_sqlite(spark):
    rng = random.Random(2)
    words = "alpha beta gamma délta the of café x_y a/b".split()
    rows = [turn(f"s{i % 7}", i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12))), thinking="beta hidden" if i % 5 == 0 else "", tools=[("Run", "gamma of")] if i % 4 == 0 else []) for i in range(60)]
    plain = [(r[5], r[6], " ".join(f"{n} {d}" for n, d in r[8])) for r in rows]
    df = spark.createDataFrame([(*r[:8], p[2]) for r, p in zip(rows, plain, strict=True)], TURN.replace("array<struct<name:string,input_digest:string>>", "string"))
    indexed = fts.index(df)
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table f using fts5(text, thinking, tool_calls, tokenize='unicode61 remove_diacritics 2')")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5 here")
    db.executemany("insert into f(rowid, text, thinking, tool_calls) values (?, ?, ?, ?)", [(i + 1, *p) for i, p in enumerate(plain)])
    for phrase in ("the of", "delta", "gamma of", "beta", "x y", "cafe the"):
        want = sorted((r, round(b, 6)) for r, b in db.execute("select rowid, bm25(f) from f where f match ?", ('{text tool_calls} : "' + phrase + '"',)))
        got = sorted((r["seq"] + 1, round(r["rank"], 6)) for r in fts.search(indexed, fts.phrase_tokens(spark, phrase)).collect())
        assert got == want, phrase
    assert fts.search(indexed, []).count() == 0 and fts.search(indexed, ["hidden"]).count() == 0 and fts.search(indexed, ["hidden"], True).count() == 12


def provider_data(spark):
    rows = [turn("m/a/1", 1, "Alpha word", 1000), turn("m/a/1", 2, "second alpha token sk-ant-abcdefghijklmnopqrstuv", None), turn("m/b/2", 1, "alpha", 5000, thinking="cursors", runtime="b"), turn("m/b/2", 2, "", 6000, tools=[("Alpha", "{}")], runtime="b"), turn("m/b/2", 3, "other", 90, runtime="b")]
    sessions = [("m/a/1", "/Users/me/dev/demo", None, None, "one"), ("m/b/2", None, "Two", None, "x")]
    return spark.createDataFrame(rows, TURN), spark.createDataFrame(sessions, "session_id string, cwd string, title_user string, title_ai string, title_derived string")


def test_both_providers_answer_alike(spark):
    turns, sessions = provider_data(spark)
    for p in (providers.ScanProvider(turns, sessions), providers.IndexProvider(turns, sessions, fts.index(turns))):
        r = providers.Retrieval(p)
        keys = lambda found: sorted((x["session_id"], x["seq"]) for x in found[0].collect())  # noqa: E731, B023
        assert keys(r.search("alpha", providers.Scope(500))) == [("m/a/1", 1), ("m/a/1", 2), ("m/b/2", 1), ("m/b/2", 2)]
        assert keys(r.search("alpha", providers.Scope(500, 2000))) == [("m/a/1", 1)]
        assert keys(r.search("alpha", providers.Scope(0, folder="/Users/me/dev/demo/"))) == [("m/a/1", 1), ("m/a/1", 2)]
        assert keys(r.search("alpha", providers.Scope(0, runtimes=("b",)))) == [("m/b/2", 1), ("m/b/2", 2)]
        assert keys(r.search("cursors", providers.Scope(0))) == []
        assert r.search("alpha", providers.Scope(0), limit=2)[1].truncated and not r.search("alpha", providers.Scope(0), limit=4)[1].truncated
        assert all("sk-ant" not in x["excerpt"] for x in r.search("token", providers.Scope(0))[0].collect())
        found, coverage = r.sessions(providers.Scope(0))
        assert [(x["session_id"], x["title"], x["turns"]) for x in found.collect()] == [("m/b/2", "Two", 3), ("m/a/1", "one", 1)] and not coverage.partial
        assert r.resolve(providers.Scope(0))[0] == "Ambiguous" and r.resolve(providers.Scope(0, runtimes=("b",)))[0] == "One" and r.resolve(providers.Scope(10**9))[0] == "None"
        page, coverage = r.turns("m/b/2", limit=2)
        assert [x["seq"] for x in page.collect()] == [1, 2] and coverage.truncated
    with pytest.raises(ValueError):
        r.search("a.", providers.Scope(0), regex=True)
    empty = providers.IndexProvider(turns, sessions, fts.index(turns).limit(0))
    assert providers.Retrieval(empty).search("alpha", providers.Scope(0))[1].degraded
    assert providers.Retrieval(providers.ScanProvider(turns, sessions)).warning(providers.Scope(0), 10**12)
    assert providers.empty_note("two words", False, 0) and not providers.empty_note("one", False, 0)


def test_sequential_folds_equal_replays(spark):
    rng = random.Random(4)
    asks = [(f"k{i % 5}", rng.randrange(200_000)) for i in range(300)]
    sent, passed = {}, {}
    for key in {k for k, _ in asks}:
        last, level, before = None, 5.0, None
        for at in sorted(t for k, t in asks if k == key):
            ok = last is None or at - last >= reach.WAKE_GAP_MS
            last = at if ok else last
            sent.setdefault(key, []).append((at, ok))
            level = min(5.0, level + (0 if before is None else at - before) * 5 / 60_000)
            before = at
            passed.setdefault(key, []).append((at, level >= 1))
            level -= level >= 1
    got = {}
    for r in reach.wakes_sent(spark.createDataFrame(asks, "session_id string, at long")).collect():
        got.setdefault(r["session_id"], []).append((r["at"], r["sent"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in sent.items()}
    got = {}
    for r in reach.rate_limited(spark.createDataFrame(asks, "key string, at long")).collect():
        got.setdefault(r["key"], []).append((r["at"], r["passed"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in passed.items()}


def test_conversation_gaps(spark):
    rows = [("a", "r", 1, None, "/w", 0), ("b", "r", 1, None, "/w", 300_000), ("c", "r", 1, None, "/w", 600_001), ("d", "r", 1, "x", "/w", 0), ("e", "r", 1, "x", "/w", 10**9)]
    got = {r["session_id"]: r["part"] for r in reach.conversations(spark.createDataFrame(rows, "session_id string, runtime_id string, pid long, pid_start string, cwd string, at long")).collect()}
    assert got == {"a": 1, "b": 1, "c": 2, "d": 1, "e": 1}


def test_push_counts(spark):
    have = spark.createDataFrame([("s", "a")], "session_id string, uuid string")
    batch = spark.createDataFrame([("s", "a", 1), ("s", "b", 2), ("s", "b", 3), ("s", None, 4), ("s", None, 5)], "session_id string, uuid string, pos long")
    new, outcome = fold.push(have, batch)
    assert tuple(outcome.first()) == (3, 2, 2) and new.count() == 3


def test_peers(spark):
    peers = spark.createDataFrame([("d1", "home", "a", "trusted"), ("d2", "work", None, "trusted"), ("d3", "home", "b", "trusted"), ("x9", "n", "c", "pending_in")], "device_id string, name string, addr string, trust string")
    assert upkeep.select_peers(peers, ["all"]) == ("Ready", ["d1", "d3"])
    assert upkeep.select_peers(peers, ["home"])[0] == "Ambiguous" and upkeep.select_peers(peers, ["work"])[0] == "NoneUsable" and upkeep.select_peers(peers, ["d1"]) == ("Ready", ["d1"])
    hits = spark.createDataFrame([("me", "s", 1, 5), ("me", "s", 2, None)], "machine_id string, session_id string, seq long, ts long")
    merged, failed = upkeep.merge_hits(hits, {"p": hits.drop("machine_id").withColumn("ts", F.lit(9).cast("long")), "q": TimeoutError("5 s")}, 3)
    assert [(r["machine_id"], r["ts"]) for r in merged.collect()] == [("p", 9), ("p", 9), ("me", 5)] and failed == {"q": "5 s"}
