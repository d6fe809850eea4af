import math

import numpy as np
import pytest
from colloquy.llm import topk_search
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, score int"


def brute(rows, k, asked=lambda i: i % 10 == 0):
    whole = [(i, [math.floor(1024 * float(c)) for c in v]) for i, v in rows]
    out = []
    for i, x in whole:
        if asked(i):
            scores = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), j) for j, y in whole if j != i and len(y) == len(x))
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def run(spark, rows, k=10, parts=4):
    frame = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in topk_search.top_k(frame, F.col("vec_id") % 10 == 0, k).collect())


def random_rows(n, width, seed=0, scale=1.0):
    rng = np.random.default_rng(seed)
    return [(i, v.tolist()) for i, v in enumerate((scale * rng.normal(size=(n, width))).astype(np.float32))]


@pytest.mark.parametrize(("n", "width", "k", "scale"), [(700, 8, 10, 1), (300, 64, 3, 0.1), (50, 2, 100, 5), (400, 5, 10, 100_000)])
def test_equals_brute_force(spark, n, width, k, scale):
    rows = random_rows(n, width, seed=n, scale=scale)
    assert run(spark, rows, k) == brute(rows, k)


def test_many_shards_waves_and_blocks(spark, monkeypatch):
    for name, value in (("FIRST_ROWS", 10), ("GROWTH", 3), ("SHARD_ROWS", 64), ("LEAF_ROWS", 8), ("TOGETHER", 16), ("QUERY_BYTES", 6000)):
        monkeypatch.setattr(topk_search, name, value)
    rows = random_rows(900, 6, seed=3)
    assert run(spark, rows) == brute(rows, 10)


def test_one_vector_holding_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "SHARD_ROWS", 128)
    rows = random_rows(600, 4, seed=4)
    rows = [(i, [0.5, -0.25, 1.0, 0.0] if i % 3 == 0 else v) for i, v in rows]
    rows += [(i, [0.0] * 4) for i in range(600, 640)]
    assert run(spark, rows) == brute(rows, 10)


def test_a_query_excludes_all_rows_of_its_id(spark):
    rows = [(0, [1.0, 0.0])] * 30 + [(10, [2.0, 1.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0]), (4, [-1.0, 0.0])]
    got = run(spark, rows)
    assert [r[1:] for r in got if r[0] == 10] == [(1, 3, 3 * 2**20), (2, 3, 3 * 2**20)] + [(i, 0, 2 * 2**20) for i in range(3, 11)]
    zero = [r for r in got if r[0] == 0]
    assert len(zero) == 30 * 4 and {(r[2], r[3]) for r in zero} == {(10, 2 * 2**20), (3, 2**20), (4, -(2**20))}


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (20, [1.0, 1.0, 1.0]), (21, [3.0, 1.0, 1.0]), (30, [5.0])]
    bad = [(10, None), (40, []), (50, [1.0, None]), (60, [nan, 1.0]), (2, [inf, 1.0]), (3, [1e20, 0.0]), (None, [9.0, 9.0])]
    assert run(spark, good + bad) == brute(good, 10)


def test_empty_tables_and_no_queries(spark):
    assert run(spark, []) == [] and run(spark, [(1, [1.0]), (2, None)]) == []
    out = topk_search.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(32, 8)) * 2000
    points = np.floor(np.repeat(centres, 64, axis=0) + rng.normal(size=(2048, 8)) * 20)
    tree = topk_search.BallTree(points)
    queries = np.floor(centres[:5])
    scores = queries @ points.T
    for level in range(tree.depth + 1):
        cuts = tree.cuts[level]
        bounds = tree.bounds(level, queries, np.linalg.norm(queries, axis=1), np.arange(len(cuts) - 1))
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            assert (scores[:, tree.order[a:b]].max(1) <= bounds[:, i]).all()
    assert max(np.diff(tree.cuts[-1])) <= topk_search.LEAF_ROWS
    # with clustered rows few leaves can hold one of the ten best
    kth = np.sort(scores, axis=1)[:, -10]
    assert (bounds >= kth[:, None]).sum() <= 5 * 4
