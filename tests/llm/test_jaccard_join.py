import random

import numpy as np
import pyarrow as pa
import pytest

from colloquy.llm import jaccard_join as jj
from colloquy.llm.words import split
from pyspark.sql import functions as F


def shingle_set(text):
    w = split(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and 100 * o >= 75 * (len(sets[i]) + len(sets[j]) - o):
                top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def corpus(n=160, seed=5):
    rng = random.Random(seed)
    word = lambda: rng.choice("ab cd ef gh ij kl mn op qr st uv wx yz".split()) + rng.choice("abcdefgh")
    passages = [" ".join(word() for _ in range(40)) for _ in range(3)]
    bases = [" ".join(word() for _ in range(rng.randint(3, 120))) for _ in range(25)]
    rows = []
    for i in range(n):
        t = rng.choice(bases).split(" ")
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            t[rng.randrange(len(t))] = word()
        t = " ".join(t)
        if rng.random() < 0.4:
            t = rng.choice(passages) + " " + t
        rows.append((i, t if rng.random() < 0.9 else t.upper()))
    return rows


EDGE = [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE  two\n"), (904, "ONE  two\n"), (905, "one two three"), (None, "one two"), (906, "é é é é é é é"), (907, "x " * 30_000)]


@pytest.mark.parametrize("limit", [jj.GROUP_SHINGLES, 150])
def test_classes_equal_brute_force(spark, limit, monkeypatch):
    monkeypatch.setattr(jj, "HOT", 6)
    rows = corpus() + EDGE
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, node string, component long").repartition(3)
    got = jj.join_classes(df, limit).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_small_chunks_and_empty_table(spark, monkeypatch):
    rows = corpus(80, 9)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = jj.join_classes(df).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert jj.join_classes(df.limit(0)).count() == 0


def test_shared_counts_never_lose_a_partner(monkeypatch):
    """Step 1 and step 2 bounds on random pairs just at the threshold."""
    rng = np.random.default_rng(2)
    for _ in range(3000):
        n = int(rng.integers(1, 60))
        m = int(rng.integers(max(1, -(-3 * n // 4)), n + 1))
        o = -(-3 * (n + m) // 7)
        if o > m:
            continue
        pool = np.sort(rng.choice(10_000, n + m - o, replace=False)).astype(np.uint64)
        common = rng.choice(pool, o, replace=False)
        rest = np.setdiff1d(pool, common)
        a = np.sort(np.concatenate([common, rest[: n - o]]))
        b = np.sort(np.concatenate([common, rest[n - o :]]))
        assert jj.linked(o, n, m)
        head = lambda s: s[: len(s) - jj.least_overlap(len(s)) + jj._need(len(s))]
        both = len(np.intersect1d(head(a), head(b)))
        assert both >= jj._least_need(n) and both >= jj._least_need(m)


def test_search_finds_all_links_and_nothing_else():
    rng = random.Random(4)
    sets = []
    for _ in range(60):
        base = rng.choice([range(40), range(20, 70), range(60, 75)])
        s = set(base) - set(rng.sample(list(base), 3)) | set(rng.sample(range(100, 400), rng.randint(0, 8)))
        sets.append(np.array(sorted(s), np.uint64))
    index = jj.Index(sets)
    for i, s in enumerate(sets):
        alive = np.array([rng.random() < 0.8 for _ in sets])
        want = [j for j, t in enumerate(sets) if alive[j] and jj.linked(len(np.intersect1d(s, t)), len(s), len(t))]
        assert index.search(s, alive).tolist() == want, i


def test_components_of_chains(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 101 + i) for i in range(20)] + [(7, 7)]
    rng.shuffle(edges)
    got = jj.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert sorted(map(tuple, got)) == [(i, 0) for i in range(61)] + [(100 + i, 100) for i in range(21)]


def chains(n, words=60, step=6, seed=3):
    """Texts in a chain: neighbours are linked, those further on are not; with branches, and near misses."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**6)}"
    text, rows = [word() for _ in range(words)], []
    for i in range(n):
        text = list(text)
        for k in range(step):
            text[(i * step + k) % words] = word()
        rows.append((i, " ".join(text)))
        if i % 3 == 0:
            near = list(text)
            near[rng.randrange(words)] = word()
            rows.append((1000 + i, " ".join(near)))
        if i % 5 == 0:
            rows.append((2000 + i, " ".join(text[: words // 2] + [word() for _ in range(words // 2)])))
    return rows


@pytest.mark.parametrize("step", [2, 4, 6])
def test_large_groups_of_loosely_linked_sets(spark, step, monkeypatch):
    """Groups many blocks large whose links form long chains: what the rounds don't join, the blocks do."""
    monkeypatch.setattr(jj, "LEADER_ROUNDS", 1)
    rows = chains(60, step=step)
    got = jj.join_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 300).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_near_copies_grow_together_in_rounds(spark):
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(10**6)}"
    base = [word() for _ in range(100)]
    rows = []
    for i in range(400):
        text = list(base)
        text[rng.randrange(100)] = word()
        rows.append(text)
    sets = [(1, jj.digest(s := jj.shingles(" ".join(t))), s.tobytes()) for t in rows]
    frame = spark.createDataFrame([(c, bytearray(d), bytearray(s)) for c, d, s in sets], "component long, digest binary, shingles binary").repartition(4)
    edges, outside = jj._grown(frame, 2000)
    assert len({r["digest"] for r in edges.select("digest").unionByName(edges.select(F.col("root").alias("digest"))).collect()}) > 390
    assert outside.count() < 40


@pytest.mark.parametrize("most", [3, 1000])
def test_components_take_few_rounds(spark, most, monkeypatch):
    monkeypatch.setattr(jj, "FOREST_NODES", most)
    rng, written, write = random.Random(5), [], jj.materialize
    monkeypatch.setattr(jj, "materialize", lambda df, name, *rest: written.append(name) or write(df, name, *rest))
    ids = [b"%05d" % i for i in rng.sample(range(10_000), 300)]
    edges = [(ids[i], ids[i + 1]) for i in range(299) if i % 30 != 29]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a binary, b binary").coalesce(1)
    got = {bytes(r["node"]): bytes(r["component"]) for r in jj.components(df, "a", "b").collect()}
    assert got == {ids[i]: min(ids[i // 30 * 30 : i // 30 * 30 + 30]) for i in range(300)}
    assert most == 3 or len(written) <= 3
    assert jj.components(spark.createDataFrame([], "a binary, b binary"), "a", "b").collect() == []


def test_components_of_few_trees_take_one_more_pass_however_they_lie(spark, monkeypatch):
    rng, written, write = random.Random(8), [], jj.materialize
    monkeypatch.setattr(jj, "materialize", lambda df, name, *rest: written.append(name) or write(df, name, *rest))
    ids = rng.sample(range(10_000), 400)
    edges = [(ids[i], ids[i + 1]) for i in range(399) if i % 40 != 39]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(8)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        got = {r["node"]: r["component"] for r in jj.components(df, "a", "b").collect()}
    finally:
        spark.conf.set(key, before)
    assert got == {ids[i]: min(ids[i // 40 * 40 : i // 40 * 40 + 40]) for i in range(400)}
    assert len(written) == 2


def test_rounds_around_leaders_end_when_they_leave_most_rows(spark, monkeypatch):
    rounds, thin = [], jj._thin
    monkeypatch.setattr(jj, "_thin", lambda rows: rounds.append(1) or thin(rows))
    rows = chains(40, step=6)
    got = jj.join_classes(spark.createDataFrame(rows, "doc_id long, text string"), 300).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert len(rounds) == 1


def test_no_words_stay_in_a_worker_when_shingles_are_counted():
    texts = pa.RecordBatch.from_arrays([pa.array([" ".join(f"w{i}x{k}" for k in range(30)) for i in range(50)])], ["text"])
    assert sum(b.num_rows for b in jj._deal([0, 1], 1 << 63)(iter([texts])))
    assert not jj._WORDS
