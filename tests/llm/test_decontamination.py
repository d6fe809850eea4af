import random
import time

import numpy as np
import pytest

from colloquy.llm import decontamination as dc


def words(rng, n):
    return ["".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def edited(rng, seq, k):
    seq = list(seq)
    for _ in range(k):
        i = rng.randrange(len(seq))
        kind = rng.random()
        if kind < 0.6:
            seq[i] = "zz" + rng.choice("abc")
        elif kind < 0.8:
            del seq[i]
        else:
            seq.insert(i, "yy")
    return seq


def distance(a, b):
    """Least edits between a and any stretch of b, plainly."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [row[0] + 1]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_alignment_equals_plain_dynamic_programming():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.randrange(1, 5) for _ in range(rng.randint(1, 12))]
        b = [rng.randrange(1, 5) for _ in range(rng.randint(1, 30))]
        cost, first, last = dc.alignment(np.array(a, np.uint64), np.array(b, np.uint64))
        assert cost == distance(a, b) and 0 <= first <= last <= len(b)
        assert distance(a, b[first:last]) == cost


def test_recall_at_the_largest_distance():
    rng = random.Random(2)
    ids = dc.PlainWords()
    found = 0
    for _ in range(400):
        item = words(rng, rng.randint(12, 60))
        k = dc.allowed_edits(len(item))
        text = words(rng, 200) + edited(rng, item, k) + words(rng, 200)
        items = dc.Items([(1, " ".join(item))], dc.EDIT_SHARE)
        hit = items.search(ids.sequence(" ".join(text)))
        found += bool(hit)
        assert not hit or hit[0][1] <= k
    assert found / 400 >= dc.TARGET_RECALL


def test_queries_against_brute_force(spark):
    rng = random.Random(3)
    bench = [(i, " ".join(words(rng, rng.randint(8, 40)))) for i in range(12)] + [(50, "ab"), (51, None), (52, ""), (3, "other words " * 9)]
    docs = []
    for i in range(80):
        body = words(rng, rng.randint(0, 300))
        if i % 3 == 0:
            item = bench[i % 12][1].split()
            part = edited(rng, item, rng.choice([0, 0, 1, len(item) // 2]))
            at = rng.randrange(len(body) + 1)
            body[at:at] = [w.upper() + "," if rng.random() < 0.2 else w for w in part]
        docs.append((i, " ".join(body)))
    docs += [(200, None), (201, ""), (0, docs[0][1]), (None, docs[3][1]), (202, " ".join(words(rng, 30_000)) + " " + bench[5][1])]
    got = dc.find(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, edits long"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    ids = dc.PlainWords()
    want = []
    for d, t in docs:
        best = {}
        for i, b in bench:
            a, s = ids.sequence(b).tolist(), ids.sequence(t).tolist()
            if len(a) >= dc.MIN_WORDS and len(s) >= 3 and (c := distance(a, s)) <= dc.allowed_edits(len(a)):
                best[i] = min(c, best.get(i, c))
        want += [(d, i, c) for i, c in best.items()]
    assert sorted(((r["doc_id"], r["item_id"], r["edits"]) for r in got), key=str) == sorted(want, key=str)


def test_remove_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "say ALPHA beta, gamma delta epsilon zeta eta theta now", 5), (2, "alpha beta delta", 6), (3, None, 7)], "doc_id long, text string, x int")
    assert sorted(tuple(r) for r in dc.remove(docs, bench).select("doc_id", "x").collect()) == [(2, 6), (3, 7)]
    assert dc.find(docs.limit(0), bench).count() == 0 and dc.find(docs, bench.limit(0)).count() == 0
    assert dc.remove(docs, bench.limit(0)).count() == 3


@pytest.mark.parametrize("size", [8, 15, 30, 60, 61, 200, 500])
def test_recall_by_size(size):
    """Items of every size at the largest distance, with all kinds of edits and with insertions and deletions alone."""
    rng = random.Random(size)
    ids = dc.PlainWords()
    found = total = 0
    for trial in range(24 if size > 100 else 60):
        item = words(rng, size)
        k = dc.allowed_edits(size)
        part = list(item)
        for _ in range(k):
            i = rng.randrange(len(part))
            kind = rng.random() if trial % 2 else 0.6 + 0.4 * rng.random()
            if kind < 0.6:
                part[i] = "zz" + rng.choice("abc")
            elif kind < 0.8:
                del part[i]
            else:
                part.insert(i, "yy")
        doc = ids.sequence(" ".join(words(rng, 150) + part + words(rng, 150)))
        if distance(ids.sequence(" ".join(item)).tolist(), doc.tolist()) <= k:
            total += 1
            found += bool(dc.Items([(1, " ".join(item))], dc.EDIT_SHARE).search(doc))
    assert total and found / total >= dc.TARGET_RECALL


def test_repeated_words_cost_little():
    ids, began = dc.PlainWords(), time.time()
    items = dc.Items([(1, "echo " * 800), (2, "one two three four five six seven eight")], dc.EDIT_SHARE)
    hits = items.search(ids.sequence("echo " * 20_000 + "one two three four five six seven eight"))
    assert {items.ids[h[0]]: h[1] for h in hits} == {1: 0, 2: 0} and time.time() - began < 10


def test_short_items_are_found_as_they_are_when_asked_for(spark):
    bench = spark.createDataFrame([(1, "alpha"), (2, "beta gamma"), (3, "one two three")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "say Beta, gamma!"), (2, "alphabet"), (3, "ALPHA one two three")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in dc.find(docs, bench, min_words=1).collect()) == [(1, 2), (3, 1), (3, 3)]
    assert sorted((r["doc_id"], r["item_id"]) for r in dc.find(docs, bench).collect()) == [(3, 3)]


def test_names_of_own_columns_are_kept(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "alpha beta gamma delta", 5, 6, 7), (2, "x", 8, 9, 10)], "doc_id long, text string, _hit int, key int, row int")
    assert [tuple(r) for r in dc.remove(docs, bench).collect()] == [(2, "x", 8, 9, 10)]
