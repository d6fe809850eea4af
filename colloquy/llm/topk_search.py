"""Exact search for the candidates of greatest inner product.

Ball-tree branch and bound per shard. Each task cuts the rows of its partition into shards of
``SHARD_ROWS``, builds a ball tree over each, and searches it for a block of queries. A node with centre c
and radius r can hold no product above q.c + |q| r, so a query goes down only where that bound reaches its
current kth score, and takes the leaves that are left in the order of their bounds, a few at first, as the
kth score rises with each. The kth score is shared: shards of one task go on from that of the shards
before, and the shards are searched in waves of growing size, each of which starts from the kth scores of
all waves before. So the rows that leave the tasks of a wave are about k times its growth for a query,
however many tasks there are.

Queries come in blocks of at most ``QUERY_BYTES``, counted before they are sent out; each block is one
search over all rows. Entries count as whole numbers, floor(``SCALE`` * x), and scores are exact.

Defined cases: a row takes no part, as query or candidate, if its vector is null or empty, holds a null or
non-finite entry, or is longer than ``LONGEST`` (its products need not fit a long), or if its ``vec_id`` is
null; vectors of different lengths are never compared; a query's own rows are all those of its ``vec_id``;
a repeated row is a candidate, and a query, each time; of equal scores the smaller ``vec_id`` goes first; a
query without any candidate has no row; other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm import vectors
from colloquy.session import forget, materialize

SCALE = 1024
#: Greatest length of a scaled vector: the product of two such fits a long.
LONGEST = 2.0**31
#: Rows under one tree, and in one of its leaves at most.
SHARD_ROWS = 8192
LEAF_ROWS = 64
#: Queries that go down a tree together, and bytes of queries that one search takes.
TOGETHER = 256
QUERY_BYTES = 16 << 20
#: Rows of the first wave, and by how much the rows searched grow with each wave; the last one takes all that is left.
FIRST_ROWS = 1024
GROWTH = 8
#: Share by which bounds are raised, far above the rounding of doubles.
SLACK = 1e-9

FOUND = "query long, query_id long, score long, vec_id long"


class BallTree:
    """A complete binary tree over the rows of a shard; the nodes of a level hold consecutive rows of ``order``."""

    def __init__(self, points: np.ndarray) -> None:
        self.points = points.astype(np.float64)
        n = len(points)
        self.depth = max(0, math.ceil(math.log2(n / LEAF_ROWS)))
        self.order = np.arange(n)
        self.cuts = [np.array([0, n])]
        self.centres, self.radii = [], []
        for level in range(self.depth + 1):
            self._describe(self.cuts[level])
            if level < self.depth:
                self.cuts.append(self._halve(self.cuts[level]))

    def _describe(self, cuts: np.ndarray) -> None:
        rows = self.points[self.order]
        centres = np.add.reduceat(rows, cuts[:-1]) / np.diff(cuts)[:, None]
        far = np.linalg.norm(rows - np.repeat(centres, np.diff(cuts), axis=0), axis=1)
        self.centres.append(centres)
        self.radii.append(np.maximum.reduceat(far, cuts[:-1]))

    def _halve(self, cuts: np.ndarray) -> np.ndarray:
        """Each node's rows parted at the median of their place between two far rows."""
        out = [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = self.order[a:b]
            rows = self.points[own]
            one = rows[np.argmax(((rows - rows[0]) ** 2).sum(1))]
            other = rows[np.argmax(((rows - one) ** 2).sum(1))]
            half = (b - a) // 2
            self.order[a:b] = own[np.argpartition(rows @ (other - one), half)]
            out += [a + half, b]
        return np.array(out)

    def bounds(self, level: int, queries: np.ndarray, lengths: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Upper bound of the inner product of each query with any row of each node."""
        centres, radii = self.centres[level][nodes], self.radii[level][nodes]
        reach = lengths[:, None] * (radii + SLACK * (radii + np.linalg.norm(centres, axis=1)))[None]
        return queries @ centres.T + reach + 1

    def leaf(self, i: int) -> np.ndarray:
        return self.order[self.cuts[-1][i] : self.cuts[-1][i + 1]]


@dataclass
class Block:
    """Queries of one length: numbers, own ids, vectors, and the kth (score, id) of the waves before, if they have k."""

    number: np.ndarray
    query_id: np.ndarray
    x: np.ndarray
    kth: np.ndarray
    kth_id: np.ndarray


class Best:
    """The best candidates of one task for each query of a block."""

    def __init__(self, block: Block, k: int) -> None:
        self.block, self.k = block, k
        self.query, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.kth, self.kth_id = block.kth.copy(), block.kth_id.copy()

    def add(self, query: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        """Take in candidates of some queries, keep k of each, raise the kth scores."""
        touched = np.isin(self.query, query)
        q, s, v = (np.concatenate([old[touched], new]) for old, new in ((self.query, query), (self.score, score), (self.id, vec_id)))
        order = np.lexsort((v, -s, q))
        q, s, v = q[order], s[order], v[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        last = rank == self.k - 1
        # never below what the waves before have set
        higher = (s[last] > self.kth[q[last]]) | ((s[last] == self.kth[q[last]]) & (v[last] < self.kth_id[q[last]]))
        at = q[last][higher]
        self.kth[at], self.kth_id[at] = s[last][higher], v[last][higher]
        kept = rank < self.k
        self.query, self.score, self.id = (np.concatenate([old[~touched], new[kept]]) for old, new in ((self.query, q), (self.score, s), (self.id, v)))

    def rows(self) -> pa.RecordBatch:
        number, own = self.block.number[self.query], self.block.query_id[self.query]
        return pa.RecordBatch.from_arrays([pa.array(number), pa.array(own), pa.array(self.score), pa.array(self.id)], ["query", "query_id", "score", "vec_id"])


def _products(left: np.ndarray, right: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of whole numbers; by doubles where these hold any sum exactly."""
    return left @ right.T if exact else left.astype(np.int64) @ right.T.astype(np.int64)


def search_shard(best: Best, ids: np.ndarray, points: np.ndarray) -> None:
    """Branch and bound of all queries of the block over one shard."""
    block, tree = best.block, BallTree(points)
    points, lengths = tree.points, np.linalg.norm(block.x, axis=1)
    longest = float(np.linalg.norm(points, axis=1).max())
    for start in range(0, len(block.x), TOGETHER):
        rows = np.arange(start, min(len(block.x), start + TOGETHER))
        queries, own = block.x[rows], lengths[rows]
        exact = longest * float(own.max()) < 2.0**52
        active, nodes = np.arange(len(rows)), np.zeros(1, np.int64)
        open_ = np.ones((len(rows), 1), bool)
        # down the tree, only where the bound reaches the kth score
        for level in range(tree.depth + 1):
            bounds = tree.bounds(level, queries[active], own[active], nodes)
            open_ &= bounds >= best.kth[rows[active]][:, None]
            some, held = open_.any(1), open_.any(0)
            active, nodes, open_, bounds = active[some], nodes[held], open_[some][:, held], bounds[some][:, held]
            if not len(active):
                break
            if level < tree.depth:
                nodes = (2 * nodes[:, None] + np.arange(2)).ravel()
                open_ = np.repeat(open_, 2, axis=1)
        if not len(active):
            continue
        # the leaves that are left, greatest bound first, in growing steps
        bounds = np.where(open_, bounds, -np.inf)
        order = np.argsort(-bounds, axis=1)
        bounds = np.take_along_axis(bounds, order, axis=1)
        done, step = 0, 1
        while done < len(nodes):
            cut = slice(done, done + step)
            q, at = np.nonzero(bounds[:, cut] >= best.kth[rows[active]][:, None])
            if not len(q):
                break
            leaf = nodes[order[q, done + at]]
            by_leaf = np.argsort(leaf, kind="stable")
            found = []
            for part in np.split(by_leaf, np.flatnonzero(np.diff(leaf[by_leaf])) + 1):
                who, held = active[q[part]], tree.leaf(leaf[part[0]])
                score = _products(queries[who], points[held], exact)
                kth, kth_id = best.kth[rows[who]][:, None], best.kth_id[rows[who]][:, None]
                good = (score > kth) | ((score == kth) & (ids[held][None] < kth_id))
                good &= ids[held][None] != block.query_id[rows[who]][:, None]
                i, j = np.nonzero(good)
                found.append((rows[who[i]], score[i, j].astype(np.int64), ids[held[j]]))
            best.add(*(np.concatenate(x) for x in zip(*found, strict=True)))
            done, step = done + step, 2 * step


def usable(rows: DataFrame) -> DataFrame:
    """``vec_id`` and ``embedding`` of the rows that take part."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull())
    length = F.aggregate("embedding", F.lit(0.0), lambda a, c: a + F.pow(F.abs(c.cast("double")) * SCALE + 1, F.lit(2.0)))
    return rows.where(vectors.finite(F.col("embedding"), LONGEST)).where(length < LONGEST**2)


def _search(points: DataFrame, queries: list[tuple[int, int, list[float]]], kth: dict[int, tuple[int, int]], k: int) -> DataFrame:
    """Candidates of ``points`` for the queries (number, own id, vector) that can be among the k best so far."""
    blocks = {}
    none = (-(1 << 63), 1 << 62)
    for width in {len(v) for _, _, v in queries}:
        some = [(number, own, v) for number, own, v in queries if len(v) == width]
        number, own = (np.array([q[i] for q in some], np.int64) for i in (0, 1))
        x = np.floor(np.array([q[2] for q in some], np.float64) * SCALE)
        known = np.array([kth.get(q[0], none) for q in some], np.int64)
        blocks[width] = Block(number, own, x, known[:, 0], known[:, 1])
    sent = points.sparkSession.sparkContext.broadcast(blocks)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {width: Best(block, k) for width, block in sent.value.items()}
        kept: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {width: [] for width in best}

        def flush(width: int, least: int) -> None:
            if sum(len(ids) for ids, _ in kept[width]) >= least:
                ids, x = (np.concatenate(part) for part in zip(*kept[width], strict=True))
                kept[width] = []
                for a in range(0, len(ids), SHARD_ROWS):
                    search_shard(best[width], ids[a : a + SHARD_ROWS], x[a : a + SHARD_ROWS])

        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy()
            for width in best:
                own = pa.array(sizes == width)
                ids = batch.column(0).filter(own).to_numpy()
                if len(ids):
                    kept[width].append((ids, np.floor(vectors.matrix(batch.column(1).filter(own), width) * SCALE)))
                    flush(width, SHARD_ROWS)
        for width in best:
            flush(width, 1)
            yield best[width].rows()

    return points.mapInArrow(search, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(rows: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` for each row for which ``is_query`` (of ``vec_id``) holds."""
    spark = rows.sparkSession
    points = usable(rows)
    asked = points.where(is_query)
    n_queries, widest = asked.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    empty = spark.createDataFrame([], FOUND + ", rank int")
    if not n_queries:
        return empty.select("query_id", "rank", "vec_id", "score")
    blocks = -(-n_queries * (8 * widest + 32 * k) // QUERY_BYTES)
    # numbered once, stored, then dealt evenly by a hash of the number
    numbered = materialize(asked.withColumn("query", F.monotonically_increasing_id()), "queries")
    dealt = materialize(numbered.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")).repartition(blocks, "block"), "queries", "block")
    forget(numbered)
    # waves by a hash of the row: those before the last hold at most one row in GROWTH, and are stored
    n = points.count()
    waves = int(math.log(n / FIRST_ROWS, GROWTH)) if n > FIRST_ROWS else 0
    shares = [GROWTH**i * FIRST_ROWS / n for i in range(waves)]
    place = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(1 << 53)) / float(1 << 53)
    wave = F.size(F.filter(F.array(*[F.lit(s) for s in shares]).cast("array<double>"), lambda s: s <= place))
    early = None
    if waves:
        early = materialize(points.where(place < shares[-1]).withColumn("wave", wave).repartition("wave", F.pmod(F.xxhash64("vec_id"), F.lit(-(-n // GROWTH // SHARD_ROWS)))), "early", "wave")
    late = points.where(place >= shares[-1]) if waves else points
    out = []
    for b in range(blocks):
        queries = [(r.query, r.vec_id, r.embedding) for r in dealt.where(F.col("block") == b).select("query", "vec_id", "embedding").collect()]
        best = None
        for w in range(waves + 1):
            kth = {}
            if best is not None:
                kth = {r.query: (r.score, r.vec_id) for r in best.where(F.col("rank") == k).select("query", "score", "vec_id").collect()}
            part = early.where(F.col("wave") == w).select("vec_id", "embedding") if w < waves else late
            found = _search(part, queries, kth, k)
            last = best
            best = materialize(_ranked(found if last is None else found.unionByName(last.drop("rank")), k), "best")
            if last is not None:
                forget(last)
        out.append(best)
    forget(dealt)
    if early is not None:
        forget(early)
    result = spark.read.schema(out[0].schema).parquet(*[f for part in out for f in part.inputFiles()]) if len(out) > 1 else out[0]
    return result.select("query_id", "rank", "vec_id", "score")
