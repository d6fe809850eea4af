import random

import pytest

from colloquy.llm import warc


def test_records_round_trip_with_separators_inside():
    payloads = [b"", b"\r\n\r\n", b"WARC/1.1\r\n\r\nx", "ü\x00".encode()]
    data = b"".join(warc.record(i, f"http://a.b/{i} x\n", p, None if i else 9) + warc.END.encode() for i, p in enumerate(payloads))
    got = list(warc.parse(data))
    assert [g[2]["WARC-Type"] for g in got] == ["revisit"] + ["response"] * 3
    assert [g[3].split(b"\r\n\r\n", 1)[1] for g in got[1:]] == payloads[1:]
    assert all(data[o : o + n].startswith(b"WARC/1.1") for o, n, *_ in got)
    with pytest.raises(ValueError):
        list(warc.parse(data[:-6]))


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree_merges(k):
    rng = random.Random(k)
    runs = [sorted(rng.choices(range(30), k=rng.randint(0, 20))) for _ in range(k)]
    assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_url_key_sorts_hosts_together():
    assert warc.url_key("http://www.Example.com/A?b=1#f") == "com,example)/a?b=1"
    assert warc.url_key("https://x.example.com:8080") == "com,example,x:8080)/"
    assert warc.url_key("http://[bad") == "http://[bad"


def brute(rows, least):
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        again = p is not None and len(b) >= least and first[h or ""] < p
        out.append((p, len(b), warc.digest_of(b), "revisit" if again else "response", first[h or ""] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 3])
def test_archive_equals_brute_force_and_is_in_order(spark, least, monkeypatch):
    monkeypatch.setattr(warc, "ROWS_PER_FILE", 7)
    rows = [(i, f"http://h{i % 5}.org/{i % 3}", f"<p>{i % 11}\r\n\r\né</p>" if i % 4 else ("ab" if i % 8 else None)) for i in range(90)]
    rows += [(500, None, "x" * 200_000), (501, "http://h1.org/ sp", ""), (3, rows[3][1], rows[3][2]), (None, "http://z/", "alone")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, position int").repartition(4)
    got = warc.archive_and_index(df, least).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == brute(rows, least)


def test_global_order_over_many_ranges(spark, tmp_path):
    rows = [(i, "http://hot.org/" if i % 3 else f"http://h{i}.org/", f"p{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    warc.write(df, str(tmp_path / "w"))
    got = warc.merge_index(warc.captures(spark, str(tmp_path / "w")), ranges=6).collect()
    assert len({r["range_id"] for r in got}) == 6
    got.sort(key=lambda r: (r["range_id"], r["position"]))
    keys = [(r["url_key"], r["captured_at"], r["page_id"]) for r in got]
    assert keys == sorted(keys) and len(keys) == 300
    r = got[17]
    with open(r["archive"].removeprefix("file:"), "rb") as f:
        assert f.read()[r["offset"] : r["offset"] + r["length"]].endswith(f"p{r['page_id']}".encode())


def test_empty_table(spark):
    assert warc.archive_and_index(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_files_are_bounded_in_bytes_and_ranges_by_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 300_000)
    monkeypatch.setattr(warc, "RANGE_ROWS", 10)
    rows = [(i, f"http://h{i}.org/", str(i) * 50_000 if i < 12 else f"p{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write(df, str(tmp_path / "w"))
    sizes = [p.stat().st_size for p in (tmp_path / "w").rglob("part-*")]
    assert len(sizes) > 3 and max(sizes) < 300_000
    got = warc.merge_index(warc.captures(spark, str(tmp_path / "w"))).collect()
    assert len(got) == 60 and len({r["range_id"] for r in got}) > 3
    got.sort(key=lambda r: (r["range_id"], r["position"]))
    keys = [(r["url_key"], r["captured_at"], r["page_id"]) for r in got]
    assert keys == sorted(keys)


def test_rows_that_repeat_an_id_keep_their_own_payloads(spark, tmp_path):
    rows = [(1, "u", "AAAA"), (2, "u", "BBBB"), (5, "u", "AAAA"), (5, "u", "UNIQUE"), (6, "u", "BBBB"), (6, "u", "AAAA"), (6, "u", "AAAA"), (7, "u", None), (7, "u", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc.archive_and_index(df).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == brute(rows, 0)
    warc.write(df, str(tmp_path / "w"))
    blocks = [block for p in (tmp_path / "w").rglob("part-*") for *_, block in warc.parse(p.read_bytes())]
    assert sum(b.endswith(b"UNIQUE") for b in blocks) == 1


def test_one_long_page_bounds_no_other_file(spark, tmp_path):
    rows = [(i, f"http://h{i}.org/", "y" * 9_000_000 if i == 3 else "z" * 300_000 if i < 6 else f"p{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write(df, str(tmp_path / "w"))
    files = list((tmp_path / "w").rglob("part-*"))
    assert len(files) == 3 and len(warc.archive_and_index(df).collect()) == 400
