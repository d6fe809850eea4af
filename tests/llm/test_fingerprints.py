import hashlib
import re
import unicodedata

import xxhash

from colloquy.llm import fingerprints

ROWS = [
    (3, "Straße  und\tCafe\u0301"),
    (1, "STRASSE und Café "),
    (2, None),
    (5, ""),
    (8, "ﬁne\u00a0print " * 3),
    (8, "ﬁne\u00a0print " * 3),
    (13, "x"),
    (21, "long " * 4000),
    (None, "no id"),
]


def canon(t):
    x = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold())
    return re.sub(r"\s+", " ", x).strip(" ")


def wide(t):
    b = canon(t).encode()
    second = xxhash.xxh64(b, seed=xxhash.xxh64(b"second half", seed=42).intdigest()).hexdigest()
    return xxhash.xxh64(b, seed=42).hexdigest() + second


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for i, (d, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        n = len(t)
        e = t[: n - n // 2] + nxt[: n // 2]
        out.append((d, n, hashlib.sha256(e.encode()).hexdigest(), wide(t), wide(e), float(canon(t) == canon(e)), float(canon(t) == canon(nxt))))
    return sorted(out, key=str)


def test_report_equals_brute_force(spark):
    got = fingerprints.edit_report(spark.createDataFrame(ROWS, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute(ROWS)


def test_report_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_PER_BUCKET", 4)
    rows = [(i * i, f"Text {i % 7} " * (i % 5)) for i in range(200)]
    got = fingerprints.edit_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_classes_and_empty_table(spark):
    df = spark.createDataFrame([(*r, "e", 7) for r in ROWS], "doc_id long, text string, fingerprint string, extra int")
    classes = {r["doc_id"]: r["class_id"] for r in fingerprints.duplicate_classes(df).collect()}
    assert classes == {3: 1, 1: 1, 2: 2, 5: 2, 8: 8, 13: 13, 21: 21, None: None}
    assert fingerprints.edit_report(df.limit(0)).count() == 0


def test_equal_digests_of_different_texts_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(fingerprints, "digest", lambda c: F.substring(c, 1, 1))
    df = spark.createDataFrame([(1, "ab"), (2, "ac"), (3, "AB"), (4, "zz")], "doc_id long, text string")
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(df).collect()}
    assert got[1] == got[3] != got[2] and got[4] == "z"


def test_edited_texts_get_the_same_fingerprint_as_equal_texts_after_a_collision(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(fingerprints, "digest", lambda c: F.substring(c, 1, 1))
    # the edited text of 1 is "ad", the text of 3
    df = spark.createDataFrame([(1, "ab"), (2, "dx"), (3, "ad"), (4, "ae")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprints.edit_report(df).collect()}
    assert got[1]["edited_fingerprint"] == got[3]["fingerprint"] != got[1]["fingerprint"]
    assert got[1]["near_edited"] == 0.0


def test_ids_at_both_ends_of_a_long(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_PER_BUCKET", 2)
    ids = [-(2**63), -(2**63) + 1, -5, 0, 7, 2**62, 2**63 - 2, 2**63 - 1]
    rows = [(i, f"text {k % 3} " * (k + 1)) for k, i in enumerate(ids)]
    for some in (rows, rows[-1:], [rows[0], rows[-1]]):
        got = fingerprints.edit_report(spark.createDataFrame(some, "doc_id long, text string").repartition(3)).collect()
        assert sorted(map(tuple, got), key=str) == brute(some)
