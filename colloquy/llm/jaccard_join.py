"""N-gram Jaccard self-join by T-occurrence search, with the classes its links form.

Two documents are linked when the Jaccard similarity of their sets of distinct 5-word shingles is at
least ``num/den`` (0.75). The result is exact for every set of documents; steps 1 to 3 only narrow
down, without loss, which documents can have a partner at all and which may meet each other.

1. *Shared counts.* Of each distinct set of n shingles, the q lowest in one global (hash) order are
   dealt to hash ranges, and there compared. Two linked sets share at least ``need`` of these (prefix
   filter with q = n - T + need, T the overlap a partner requires), so a set that shares fewer with
   all others together has no partner. Of a shingle held by many sets of a task one copy is dealt.
2. *Candidates.* The ranges report the shared shingles with their exact number of holders. Sets meet
   at those of their n - T + 1 first shingles in an order that puts rare ones first, and sets that
   meet are joined to the least of them.
3. *Groups.* The connected components of sets that meet hold all possible links. They are found by
   contraction and large-star/small-star rounds, each written to the shared folder.
4. *T-occurrence search.* In each group an inverted index is built. A query merges its short lists,
   keeps the sets reaching the required overlap less the number of long lists, and probes the long
   lists for these by binary search (DivideSkip); the sets reaching the required overlap are linked
   to it. Sets already reached leave the index, so a group of thousands of copies costs one pass.
   Groups over ``GROUP_SHINGLES`` shingles are first thinned around a leader, row by row in parallel
   tasks, with the triangle inequality of the Jaccard distance. What remains is searched in a few rounds of
   random blocks, whose trees grow together where sets are near copies. Only sets outside their group's largest
   tree are then searched for in the whole group, block by block: a task searches one block of sets of like
   size by one of such sets, of their size or within 4/3 of it, and reports a spanning forest of the links
   it finds, so no task outgrows two blocks.

Shingles are 64-bit hashes; sets are told apart by a 128-bit digest of theirs. The number of hash
ranges follows the bytes of the texts, so that a task holds about ``RANGE_BYTES`` of shingles.

Defined cases: null or empty texts have the empty set and link with nothing; texts of fewer words
than the shingle size have one shingle, the whole sequence; repeated rows are documents of one
class; a null ``doc_id`` never names a class unless all its members are null; ids are integers (other
types are cast to long); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from hashlib import blake2b
from heapq import merge

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.words import WordIds, grams, hold, release, split
from colloquy.session import forget, materialize

SHINGLE = 5
NUM, DEN = 3, 4
#: Share of a set's shingles that partners must share among the q lowest (step 1).
NEED_SHARE = 0.2
#: Share of the hash ranges whose shingles are low: all of these are dealt, so their holders are counted.
LOW_SHARE = 0.42
#: A shingle with more holders in one chunk is hot: it is sent once, and ordered behind all others counted.
HOT = 64
MANY = (1 << 31) - 1
#: A dealt shingle's name: its hash range above, the low bits of its hash below.
NAME_BITS = 44
MASK = np.uint64((1 << NAME_BITS) - 1)
#: Bytes of dealt shingles that one hash range aims at, and of text for each of these.
RANGE_BYTES, TEXT_PER_DEALT = 24_000_000, 2
#: Bits of the filter for each grouped set; the filter is at most 2**MOST_BLOOM bits, beyond which more sets are written.
BLOOM_EACH, LEAST_BLOOM, MOST_BLOOM = 16, 20, 30
#: Up to this many grouped sets (some 50 bytes each) are broadcast, more are shuffled.
BROADCAST_ROWS = 250_000
#: Shingles of a chunk of documents in a task, and of a group searched in one task.
CHUNK, GROUP_SHINGLES = 2_000_000, 100_000
LEADER_ROUNDS = 4
#: Rounds of random blocks in which the trees of large groups grow together.
DEAL_ROUNDS = 2
#: A round around leaders that leaves more than this share of its rows is the last.
THINNED_SHARE = 0.75
#: Nodes of the trees that a task holds at once (some 150 bytes each), and tasks for each core that make trees of edges.
FOREST_NODES, FOREST_TASKS = 200_000, 4
#: Sizes of one size class differ by less than this factor, which is over 4/3.
SIZE_CLASS = 1.34
_WORDS = WordIds()


def _hold() -> None:
    """The words of this module's own dictionary are all that a worker remembers."""
    hold("jaccard_join", _WORDS.clear)


def shingles(text: str | None) -> np.ndarray:
    """Ascending distinct shingle hashes of a whole text."""
    return np.unique(grams(_WORDS.of(split(text)), SHINGLE))


def digest(tokens: np.ndarray) -> bytes:
    return blake2b(tokens.tobytes(), digest_size=16).digest()


def least_overlap(n: int) -> int:
    """Shingles a set of n must share with any partner: ceil(3n/4)."""
    return -(-NUM * n // DEN)


def linked(overlap: int, n: int, m: int) -> bool:
    return overlap > 0 and DEN * overlap >= NUM * (n + m - overlap)


def _need(n: int) -> int:
    """Shingles of a set of n that its q lowest hold in common with any partner that deals as many."""
    return max(1, min(least_overlap(n), int(NEED_SHARE * n)))


def _least_need(n: int) -> int:
    """The same bound when the partner may be as small as a partner can be."""
    return _need(least_overlap(n))


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.astype(np.uint64).view(np.int64))


def _node(d: bytes) -> int:
    return int.from_bytes(d[:8], "little")


def _chunks(batches):
    """Texts of a partition as lists of (digest, shingles), a chunk's distinct non-empty sets at a time."""
    seen: dict[bytes, np.ndarray] = {}
    size = 0

    def taken():
        nonlocal seen, size
        out, seen, size = list(seen.items()), {}, 0
        return out

    for b in batches:
        for text in b.column(0):
            s = shingles(text.as_py())
            if len(s) and (d := digest(s)) not in seen:
                seen[d] = s
                size += len(s)
                if size >= CHUNK:
                    yield taken()
    if seen:
        yield taken()


# -- step 1

_DEALT = "bucket int, kind int, nodes binary, numbers binary, shingles binary"


def _packed(x: np.ndarray) -> bytes:
    """The low 48 bits of 64-bit numbers, 6 bytes each."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _dealt_size(s: np.ndarray, limit: int) -> tuple[int, int]:
    """How many lowest shingles of a set are dealt, and how many of all are low."""
    low = int(np.searchsorted(s, np.uint64(min(limit, (1 << 64) - 1))))
    return max(low, len(s) - least_overlap(len(s)) + _need(len(s))), low


def _deal(keys: list[int], limit: int):
    """Deal shingles to as many hash ranges as there are keys; the i-th range travels under the i-th key.

    Kind 0 holds, for the sets of a chunk, how many shingles each has in the range, and these; kind 1
    the sets' sizes; kind 2 the hot shingles of the chunk, each once for every holder; kind 3 each once.
    """
    buckets = len(keys)
    bounds = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)

    def run(batches):
        _hold()
        for sets in _chunks(batches):
            nodes = np.array([_node(d) for d, _ in sets], np.uint64)
            sizes = np.array([_dealt_size(s, limit) for _, s in sets], np.int64)
            total = np.array([len(s) for _, s in sets], np.int64)
            token = np.concatenate([s[:k] for (_, s), k in zip(sets, sizes[:, 0].tolist(), strict=True)])
            # what is dealt is all that is looked at from here on, in arrays no wider than they must be; the chunk's
            # words, few of which the next one has, would stay beside them and beside the counting that follows
            del sets
            _WORDS.clear()
            owner = np.repeat(np.arange(len(nodes), dtype=np.int32), sizes[:, 0])
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            del order
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            times = np.diff(np.append(first, len(token)))
            once = first[times > HOT]
            hot = np.repeat(times > HOT, times)
            del first, times
            rows = []
            ends = [0, *np.searchsorted(token, bounds).tolist(), len(token)]
            for i in range(buckets):
                cold = ~hot[ends[i] : ends[i + 1]]
                mine = owner[ends[i] : ends[i + 1]][cold]
                if len(mine):
                    n = np.bincount(mine, minlength=len(nodes))
                    have = np.flatnonzero(n)
                    dealt = token[ends[i] : ends[i + 1]][cold][np.argsort(mine, kind="stable")]
                    rows.append((keys[i], 0, nodes[have].tobytes(), n[have].astype(np.uint32).tobytes(), _packed(dealt)))
            spread = (nodes % np.uint64(buckets)).astype(np.int64)
            for i in np.unique(spread).tolist():
                mine = np.flatnonzero(spread == i)
                rows.append((keys[i], 1, nodes[mine].tobytes(), np.stack([total[mine], sizes[mine, 1]], 1).astype(np.uint32).tobytes(), b""))
            if len(once):
                held = np.flatnonzero(hot)
                part = np.searchsorted(bounds, token[held], "right")
                name = token[held] & MASK | part.astype(np.uint64) << np.uint64(NAME_BITS)
                to = spread[owner[held]]
                for i in np.unique(to).tolist():
                    mine = np.flatnonzero(to == i)
                    rows.append((keys[i], 2, nodes[owner[held[mine]]].tobytes(), b"", name[mine].tobytes()))
                part = np.searchsorted(bounds, token[once], "right")
                for i in np.unique(part).tolist():
                    rows.append((keys[i], 3, b"", b"", _packed(token[once[part == i]])))
                del held, part, name, to
            del token, owner, hot, once
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), *[pa.binary()] * 3), strict=True)], [c.split()[0] for c in _DEALT.split(", ")])
            del rows
            yield out
            # the next chunk is read without this one's rows beside it
            del out
        release()

    return run


def _keys(spark, parts: int) -> list[int]:
    """For each of ``parts`` hash partitions an integer that lands in it, so that ranges are dealt evenly."""
    n = F.lit(parts)
    rows = spark.range(40 * parts).select(F.col("id").cast("int").alias("k"))
    rows = rows.groupBy(F.pmod(F.hash("k"), n).alias("p")).agg(F.min("k").alias("k")).collect()
    return sorted(r["k"] for r in rows)


_SHARED = "node long, size int, low int, shared long, names binary, holders binary"


def _slices(values: np.ndarray, width: int, counts: np.ndarray) -> pa.Array:
    """A binary array whose i-th value holds the next ``counts[i]`` numbers."""
    offsets = np.concatenate([[0], np.cumsum(counts * width)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def _shared_rows(node, name, holders) -> pa.RecordBatch:
    order = np.argsort(node, kind="stable")
    node, name, holders = node[order], name[order], holders[order]
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    n = np.diff(np.append(first, len(node)))
    none = pa.nulls(len(first), pa.int32())
    return pa.RecordBatch.from_arrays([_signed(node[first]), none, none, pa.array(n), _slices(name, 8, n), _slices(holders.astype(np.uint32), 4, n)], [c.split()[0] for c in _SHARED.split(", ")])


def _count(keys: list[int]):
    """For each set the shingles of a hash range that other sets hold too, with the number of holders."""
    place = {k: i for i, k in enumerate(keys)}

    def run(batches):
        names, nodes, hot = [], [], []
        for b in batches:
            for key, kind, node, number, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), *[b.column(i) for i in (2, 3, 4)], strict=True):
                node, number, raw = np.frombuffer(node.as_py(), np.uint64), np.frombuffer(number.as_py(), np.uint32), raw.as_py()
                at = np.uint64(place[key] << NAME_BITS)
                if kind == 0:
                    names.append(_unpacked(raw) & MASK | at)
                    nodes.append(np.repeat(node, number))
                elif kind == 1:
                    n = number.reshape(-1, 2).astype(np.int32)
                    none = pa.nulls(len(node), pa.binary())
                    yield pa.RecordBatch.from_arrays([_signed(node), pa.array(n[:, 0]), pa.array(n[:, 1]), pa.array(np.zeros(len(node), np.int64)), none, none], [c.split()[0] for c in _SHARED.split(", ")])
                elif kind == 2:
                    yield _shared_rows(node, np.frombuffer(raw, np.uint64), np.full(len(node), MANY))
                else:
                    hot.append(_unpacked(raw) & MASK | at)
        if not names:
            return
        name = np.concatenate(names)
        del names
        node = np.concatenate(nodes)
        del nodes
        order = np.lexsort((node, name))
        name, node = name[order], node[order]
        del order
        keep = np.concatenate([[True], (name[1:] != name[:-1]) | (node[1:] != node[:-1])])
        name, node = name[keep], node[keep]
        first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        times = np.diff(np.append(first, len(name)))
        holders = np.minimum(times, MANY - 1)
        if hot:
            hot = np.unique(np.concatenate(hot))
            at = np.minimum(np.searchsorted(hot, name[first]), len(hot) - 1)
            holders = np.where(hot[at] == name[first], MANY, holders)
        holders = np.repeat(holders.astype(np.uint32), times)
        shared = holders > 1
        node, name, holders = node[shared], name[shared], holders[shared]
        del keep, first, times, shared
        if len(node):
            yield _shared_rows(node, name, holders)
        del name, node, holders
        release()

    return run


# -- step 2

_MEET = "shingle long, node long, other long"


def _prefix(size: int, low: int, name: np.ndarray, holders: np.ndarray, is_low: np.ndarray) -> np.ndarray:
    """Shared shingles among the first n - T + 1 in the order: low ones by holders, then the others."""
    most = size - least_overlap(size) + 1
    own = np.flatnonzero(is_low)
    own = own[np.lexsort((name[own], holders[own]))]
    alone = low - len(own)
    picked = own[: max(0, most - alone)]
    if most > low:
        picked = np.concatenate([picked, np.flatnonzero(~is_low)])
    return name[picked]


def _meet(low_buckets: int):
    """Prefixes of the sets that share enough: (shingle, node) rows, sets of a batch that meet as the least of them."""

    def run(batches):
        for b in batches:
            nodes, heads = [], []
            cols = [b.column(i).to_pylist() for i in range(4)]
            for node, size, low, shared, raw, count in zip(*cols, b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
                if size is None or shared < _least_need(size):
                    continue
                name = np.frombuffer(b"".join(raw), np.uint64)
                holders = np.frombuffer(b"".join(count), np.uint32)
                is_low = (name >> np.uint64(NAME_BITS)).astype(np.int64) < low_buckets
                nodes.append(node)
                heads.append(_prefix(size, low, name, holders, is_low))
            if not nodes:
                continue
            token = np.concatenate(heads)
            if not len(token):
                continue
            node, at = np.unique(np.repeat(np.array(nodes, np.int64), [len(h) for h in heads]), return_inverse=True)
            order = np.argsort(token, kind="stable")
            token, at = token[order], at[order]
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            place = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(token))))
            # least set of each local component: spread over shared shingles until nothing changes
            label, before = np.arange(len(node)), None
            while before is None or (label != before).any():
                before = label.copy()
                least = np.minimum.reduceat(label[at], first)
                np.minimum.at(label, at, least[place])
                label = label[label]
            pairs = np.unique(np.stack([place, label[at]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([_signed(token[first][pairs[:, 0]]), pa.array(node[pairs[:, 1]]), pa.nulls(len(pairs), pa.int64())], ["shingle", "node", "other"])
            down = np.flatnonzero(label != np.arange(len(node)))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(down), pa.int64()), pa.array(node[down]), pa.array(node[label[down]])], ["shingle", "node", "other"])

    return run


def _groups(met: DataFrame) -> DataFrame:
    """(``node``, ``component``) of all sets that meet others, from (shingle, node) and (node, other) rows.

    Every set first takes the least set it meets at a shingle as its parent, and the rows are
    rewritten with the parents, which leaves most shingles with one set; the others give edges to the
    least set at each. Components of the parent and these edges are then found in rounds.
    """
    at = met.where("shingle is not null").select("shingle", "node")
    edges = met.where("shingle is null").select("node", "other")
    # a shingle has a row for each batch of sets at most, so a window over it stays small
    met_at = Window.partitionBy("shingle")
    both = {"low": F.min("node").over(met_at), "high": F.max("node").over(met_at)}
    here = materialize(at.withColumns(both).where("low <> high").drop("high"), "clash")
    up = materialize(here.groupBy("node").agg(F.min("low").alias("other")), "parents")
    at = here.select("shingle", "node").join(up, "node").select("shingle", F.col("other").alias("node")).distinct()
    at = materialize(at, "contracted")
    forget(here)
    rest = at.withColumn("other", F.min("node").over(met_at)).where("node <> other").select("node", "other")
    return components(edges.unionByName(up.where("node <> other")).unionByName(rest), "node", "other")


_SETS = "doc_id long, text_key long, digest binary, node long, n_shingles long, task int, shingles binary"


def _sets(bloom):
    """Every document with its digest; the shingles only of sets whose node may be in a group, once in a task."""

    def run(batches):
        _hold()
        has = np.frombuffer(bloom.value, np.uint8)
        bits, task = 8 * len(has), TaskContext.get().partitionId()
        known: set[bytes] = set()
        for b in batches:
            digests, nodes, sizes, sent = [], [], [], []
            for text in b.column(1):
                s = shingles(text.as_py())
                d = digest(s)
                node = _node(d)
                at = node % bits
                keep = len(s) and (has[at >> 3] >> (at & 7)) & 1 and d not in known
                if keep:
                    if len(known) > 200_000:
                        known.clear()
                    known.add(d)
                digests.append(d if len(s) else None)
                nodes.append(node if len(s) else 0)
                sizes.append(len(s))
                sent.append(s.tobytes() if keep else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(digests, pa.binary()), _signed(np.array(nodes, np.uint64)), pa.array(sizes, pa.int64()), pa.array([task] * b.num_rows, pa.int32()), pa.array(sent, pa.binary())], [c.split()[0] for c in _SETS.split(", ")])
        _WORDS.clear()
        release()

    return run


# -- step 3


def _forest(batches):
    """Stars (node, least node of its tree) in place of the edges of a task, at most ``FOREST_NODES`` nodes at a time."""
    up: dict = {}

    def top(x):
        while (y := up[x]) != x:
            up[x] = x = up[y]
        return x

    def stars(schema):
        pairs = [(x, r) for x in up if (r := top(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*pairs, strict=True) if pairs else ((), ()), schema, strict=True)], ["u", "v"])

    schema = None
    for batch in batches:
        schema = batch.schema
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            up.setdefault(x, x)
            up.setdefault(y, y)
            x, y = top(x), top(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        if len(up) > FOREST_NODES:
            yield stars(schema)
            up.clear()
    if up:
        yield stars(schema)


def components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """(``node``, ``component``): the least node reachable, for all ends of the undirected edges.

    Each task makes stars of the edges it holds. If these have no more than ``FOREST_NODES`` ends in all, which
    a task may hold, one more pass makes them the stars of the whole graph. More of them take rounds of
    large-star and small-star until nothing changes, each written to the shared folder (and each taking
    some of the driver's memory, for good). Works on any type with an order.
    """
    a, b = F.col("u"), F.col("v")
    starred = lambda df: materialize(df.mapInArrow(_forest, df.schema), "edges")
    marked = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
    tasks = FOREST_TASKS * edges.sparkSession.sparkContext.defaultParallelism
    now = starred(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where(a != b).coalesce(tasks))
    mark = marked(now)
    few = 2 * mark[0] <= FOREST_NODES
    if few and mark[0]:
        parts, now = now, starred(now.coalesce(1))
        forget(parts)
    while mark[0] and not few:
        both = now.unionByName(now.select(b.alias("u"), a.alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: all larger neighbours of u are linked to u's least neighbour
        large = both.join(low, "u").where("v > u and v <> m").select(b.alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours are linked to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(b.alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after = starred(small)
        seen = marked(after)
        forget(now)
        now = after
        if seen == mark:
            break
        mark = seen
    tops = now.select(b.alias("node"), b.alias("component")).distinct()
    return now.select(a.alias("node"), b.alias("component")).unionByName(tops)


# -- step 4


class Index:
    """Inverted lists of a group's sets over the shingles that ``least`` of them or more hold."""

    def __init__(self, sets: list[np.ndarray], least: int = 1):
        self.size = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.size)
        at = np.argsort(flat, kind="stable")
        flat, owner = flat[at], owner[at]
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        times = np.diff(np.append(first, len(flat)))
        keep = times >= least
        self.token, self.begin, self.length = flat[first][keep], first[keep], times[keep]
        self.owner = owner

    def lists(self, s: np.ndarray) -> list[np.ndarray]:
        if not len(self.token):
            return []
        at = np.minimum(np.searchsorted(self.token, s), len(self.token) - 1)
        at = at[self.token[at] == s]
        return [self.owner[b : b + n] for b, n in zip(self.begin[at].tolist(), self.length[at].tolist(), strict=True)]

    def search(self, s: np.ndarray, alive: np.ndarray) -> np.ndarray:
        """Numbers of the live sets linked to the set ``s``, by DivideSkip."""
        need = least_overlap(len(s))
        lists = sorted(self.lists(s), key=len)
        if len(lists) < need:
            return np.zeros(0, np.int64)
        longest = len(lists[-1])
        skip = min(need - 1, int(need / (0.01 * np.log2(longest + 1) + 1)))
        short, long = lists[: len(lists) - skip], lists[len(lists) - skip :]
        # the sorted short lists go through a heap, equal numbers are counted
        heads = [run for r in short if len(run := r[alive[r]])]
        if not heads:
            return np.zeros(0, np.int64)
        merged = np.fromiter(merge(*[r.tolist() for r in heads]), np.int64, sum(map(len, heads)))
        new = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]]))
        found, count = merged[new], np.diff(np.append(new, len(merged)))
        fit = (count >= need - skip) & (DEN * self.size[found] >= NUM * len(s)) & (NUM * self.size[found] <= DEN * len(s))
        found, count = found[fit], count[fit]
        for i, run in enumerate(long):
            if not len(found):
                break
            at = np.minimum(np.searchsorted(run, found), len(run) - 1)
            count = count + (run[at] == found)
            # what can't reach the overlap any more with the lists left goes
            may = count + (len(long) - 1 - i) >= need
            found, count = found[may], count[may]
        return found[DEN * count >= NUM * (len(s) + self.size[found] - count)]


def classes(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the number of the first set of its class; each set is a query once."""
    label = np.full(len(sets), -1)
    index, alive = Index(sets, 2), np.ones(len(sets), bool)
    left, built = len(sets), len(sets)
    names = np.arange(len(sets))
    for i in range(len(sets)):
        if label[i] >= 0:
            continue
        label[i] = i
        front = [i]
        alive[np.searchsorted(names, i)] = False
        left -= 1
        while front and left:
            hit = index.search(sets[front.pop()], alive)
            if len(hit):
                alive[hit] = False
                left -= len(hit)
                label[names[hit]] = i
                front += names[hit].tolist()
            if left and left < built // 2:
                names = names[alive]
                index, alive, built = Index([sets[k] for k in names]), np.ones(len(names), bool), len(names)
    return label


_EDGE = "digest binary, root binary"


def _search_groups(batches):
    """Star edges (member, first of its class) of groups whose rows come one group after another."""
    group, members = None, {}

    def solve():
        if len(members) < 2:
            return None
        names = sorted(members)
        label = classes([members[d] for d in names])
        out = [(d, names[k]) for d, k in zip(names, label.tolist(), strict=True) if names[k] != d]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], ["digest", "root"]) if out else None

    for b in batches:
        for g, d, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            if g != group:
                if (rb := solve()) is not None:
                    yield rb
                group, members = g, {}
            members[d] = np.frombuffer(s.as_py(), np.uint64)
    if (rb := solve()) is not None:
        yield rb


_NEAR = "component long, digest binary, shingles binary, overlap long, leader_size long, leader binary"


def _to_leader(batches):
    """Overlap of each set with its group's leader."""
    for b in batches:
        over, size = [], []
        for s, p in zip(b.column(2), b.column(3), strict=True):
            s, p = np.frombuffer(s.as_py(), np.uint64), np.frombuffer(p.as_py(), np.uint64)
            over.append(len(np.intersect1d(s, p, assume_unique=True)))
            size.append(len(p))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(over, pa.int64()), pa.array(size, pa.int64()), b.column(4)], ["component", "digest", "shingles", "overlap", "leader_size", "leader"])


def _thin(rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """One leader round over large groups: links to the leaders, the rows that may have more links, the number of rows before.

    With d = 1 - J to the leader, sets within 0.25 are linked to it and need not be compared with each
    other. A set further off at distance d can only be linked to sets at distances from d - 0.25 on, so
    of the linked ones only those that near are kept.
    """
    lead = rows.groupBy("component").agg(F.min("digest").alias("leader"))
    first = rows.join(lead, (rows["component"] == lead["component"]) & (rows["digest"] == lead["leader"]), "left_semi")
    first = first.select("component", F.col("digest").alias("leader"), F.col("shingles").alias("leader_shingles"))
    near = rows.join(first, "component").select("component", "digest", "shingles", "leader_shingles", "leader")
    stored = near = materialize(near.mapInArrow(_to_leader, _NEAR), "leader")
    size = F.octet_length("shingles") / 8
    near = near.withColumn("d", 1 - F.col("overlap") / (size + F.col("leader_size") - F.col("overlap")))
    is_linked = F.col("overlap") * DEN >= NUM * (size + F.col("leader_size") - F.col("overlap"))
    links = near.where(is_linked & (F.col("digest") != F.col("leader"))).select("digest", F.col("leader").alias("root"))
    far = near.where(~is_linked).groupBy("component").agg(F.min("d").alias("least"))
    rest = near.join(far, "component").where(~is_linked | (F.col("d") >= F.col("least") - 0.25 - 1e-9))
    # the leader itself has been compared with all; the rest goes on without it
    rest = rest.where(F.col("digest") != F.col("leader")).select("component", "digest", "shingles")
    return links, rest, stored.count()


def _search_block(batches):
    """Spanning forest of the links between the queries and the indexed sets of a block; index rows come first."""
    key, names, sets, index, above = None, [], [], None, {}
    out: list[tuple[bytes, bytes]] = []

    def top(d: bytes) -> bytes:
        while (up := above.get(d, d)) != d:
            above[d] = above.get(up, up)
            d = up
        return d

    for b in batches:
        for *block, query, d, s in zip(*[b.column(i).to_pylist() for i in range(7)], b.column(7), strict=True):
            s = np.frombuffer(s.as_py(), np.uint64)
            if block != key:
                key, names, sets, index, above = block, [], [], None, {}
            if not query:
                names.append(d)
                sets.append(s)
                continue
            if index is None and sets:
                index, alive = Index(sets), np.ones(len(sets), bool)
            if index is not None:
                for i in index.search(s, alive).tolist():
                    x, y = top(d), top(names[i])
                    if x != y:
                        above[max(x, y)] = min(x, y)
                        out.append((d, names[i]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], ["digest", "root"])
            out = []


def _blocks_of(rows: DataFrame, most: int, k: str, block: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the block of their group and size class they are dealt to, and the number of blocks of each."""
    sizes = rows.groupBy("component", "size_class").agg(F.ceil(F.sum(F.octet_length("shingles")) / 8 / most).cast("int").alias(k))
    sizes = materialize(sizes, "blocks")
    deal = F.pmod(F.xxhash64("digest"), F.col(k)).cast("int")
    return rows.join(sizes, ["component", "size_class"]).withColumn(block, deal).drop(k), sizes


def _grown(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Links that a few rounds of random blocks find inside large groups, and the sets outside their group's largest tree.

    In a round each set is searched for among the sets of one block of its group, other ones each time. So
    the trees of near copies soon grow together, at a cost that follows their number.
    """
    blocks = rows.groupBy("component").agg(F.ceil(F.sum(F.octet_length("shingles")) / 8 / most).cast("int").alias("k"))
    blocks, edges = materialize(blocks, "blocks"), None
    for number in range(DEAL_ROUNDS):
        block = F.xxhash64("component", F.pmod(F.xxhash64("digest", F.lit(number)), F.col("k")))
        dealt = rows.join(blocks, "component").select(block.alias("component"), "digest", "shingles")
        dealt = dealt.repartition("component").sortWithinPartitions("component")
        found = materialize(dealt.mapInArrow(_search_groups, _EDGE), "met")
        edges = found if edges is None else edges.unionByName(found)
    named = components(edges, "digest", "root").select(F.col("node").alias("digest"), F.col("component").alias("tree"))
    labelled = rows.select("component", "digest").join(named, "digest", "left").withColumn("tree", F.coalesce("tree", "digest"))
    labelled = materialize(labelled, "trees")
    sizes = labelled.groupBy("component", "tree").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("component").agg(F.max_by("tree", F.struct("n", "tree")).alias("tree"))
    outside = materialize(labelled.join(largest, ["component", "tree"], "left_anti").select("digest"), "outside")
    forget(labelled)
    return edges, rows.join(outside, "digest", "left_semi").select(rows.columns)


def _blocks(rows: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """All links between the ``queries`` and the sets of their group. The sets of a size class, and the queries
    of one, are dealt to blocks of about ``most`` shingles; a task searches one block of sets by one of queries of
    the same size class or a neighbouring one, the only ones with partners."""
    classed = lambda df: df.withColumn("size_class", F.floor(F.log(F.octet_length("shingles") / 8) / float(np.log(SIZE_CLASS))).cast("int"))
    held, sizes = _blocks_of(classed(rows), most, "k", "block")
    asked, query_sizes = _blocks_of(classed(queries), most, "query_k", "query_block")
    near = lambda name: F.explode(F.array(*[F.col("size_class") + i for i in (-1, 0, 1)])).alias(name)
    # the other side of a search: all of its blocks in the class
    to = sizes.select("component", F.col("size_class").alias("other"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("block"))
    by = query_sizes.select("component", F.col("size_class").alias("other"), F.explode(F.sequence(F.lit(0), F.col("query_k") - 1)).alias("query_block"))
    asked = asked.select("component", F.col("size_class").alias("query_class"), "query_block", near("other"), F.lit(True).alias("query"), "digest", "shingles").join(to, ["component", "other"])
    held = held.select("component", "size_class", "block", near("other"), F.lit(False).alias("query"), "digest", "shingles").join(by, ["component", "other"])
    asked = asked.withColumnRenamed("other", "size_class")
    held = held.withColumnRenamed("other", "query_class")
    cols = ["component", "query_class", "query_block", "size_class", "block", "query", "digest", "shingles"]
    both = held.select(cols).unionByName(asked.select(cols))
    both = both.repartition(*cols[:5]).sortWithinPartitions(*cols[:6])
    return both.mapInArrow(_search_block, _EDGE)


def _links(wide: DataFrame, large: bool, most: int) -> tuple[DataFrame | None, DataFrame]:
    """Verified star edges (digest, root) of small groups, and edges of the large ones (None without such).

    ``wide`` has (component, total, digest, shingles), each set once, and ``total`` shingles of its group.
    """
    edges = None
    cols = ["component", "digest", "shingles"]
    if large:
        rows, parts, last, left = wide.where(F.col("total") > most).select(cols), [], None, True
        for _ in range(LEADER_ROUNDS):
            links, rows, before = _thin(rows)
            parts.append(links)
            rows = materialize(rows, "thinned")
            if last is not None:
                forget(last)
            last, left = rows, rows.count()
            if left > THINNED_SHARE * before or not left:
                break
        if left:
            grown, outside = _grown(rows, most)
            parts += [grown, _blocks(rows, outside, most)]
        edges = parts[0]
        for p in parts[1:]:
            edges = edges.unionByName(p)
    small = wide.where(F.col("total") <= most).select(cols).repartition("component").sortWithinPartitions("component")
    return edges, small.mapInArrow(_search_groups, _EDGE)


def text_key(text: Column) -> Column:
    """Tells rows of one ``doc_id`` with different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def join_classes(docs: DataFrame, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id`` (least id reachable by links), ``class_size``, ``text_key``."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("text_key"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // TEXT_PER_DEALT // RANGE_BYTES)

    keys = _keys(spark, buckets)
    low_buckets = max(1, round(LOW_SHARE * len(keys)))
    limit = (low_buckets << 64) // len(keys)
    dealt = texts.select("text").mapInArrow(_deal(keys, limit), _DEALT)
    shared = dealt.repartition(buckets, "bucket").mapInArrow(_count(keys), _SHARED)
    each = shared.groupBy("node").agg(F.max("size").alias("size"), F.max("low").alias("low"), F.sum("shared").alias("shared"), F.collect_list("names").alias("names"), F.collect_list("holders").alias("holders"))
    met = materialize(each.where("shared > 0").mapInArrow(_meet(low_buckets), _MEET), "met")
    groups = materialize(_groups(met), "groups")
    forget(met)

    bits = 1 << min(MOST_BLOOM, max(LEAST_BLOOM, (BLOOM_EACH * groups.count()).bit_length()))
    part = F.expr(f"pmod(node, {bits}) div 32768").alias("part")
    maps = groups.groupBy(part).agg(F.expr(f"bitmap_construct_agg(pmod(node, {bits}) % 32768)").alias("bits"))
    bloom = bytearray(bits // 8)
    # a part of the maps is a job: as many as there are MB of the filter, not as there are partitions
    for r in maps.coalesce(1 + (bits >> 23)).toLocalIterator():
        bloom[r["part"] * 4096 : (r["part"] + 1) * 4096] = r["bits"]
    sets = materialize(texts.mapInArrow(_sets(spark.sparkContext.broadcast(bytes(bloom))), _SETS), "sets")
    # one of the tasks that wrote a set is its home, so that each set travels once
    survivors = sets.where("shingles is not null")
    home = survivors.groupBy("node", "digest").agg(F.min("task").alias("task"), F.first("n_shingles").alias("n"))
    home = stored = materialize(home.join(groups, "node").select("digest", "task", "component", "n"), "home")
    totals = home.groupBy("component").agg(F.sum("n").alias("total"))
    grouped, large = home.count(), not totals.where(F.col("total") > group_shingles).isEmpty()
    home = home.join(totals, "component").drop("n")
    if grouped <= BROADCAST_ROWS:
        home = F.broadcast(home)
    wide = survivors.join(home, ["digest", "task"]).select("component", "total", "digest", "shingles")
    extra, star = _links(wide, large, group_shingles)
    star = materialize(star if extra is None else star.unionByName(extra), "links")
    forget(groups)
    forget(stored)
    if extra is not None:
        named = components(star, "digest", "root")
        star = named.select(F.col("node").alias("digest"), F.col("component").alias("root"))
    ids = sets.select("doc_id", "text_key", "n_shingles", "digest")
    known = ids.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    known = known.join(star, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    best = known.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("copies").alias("class_size"))
    named = known.join(best, "root").select("digest", "component_id", "class_size")
    out = ids.join(named, "digest", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), "text_key")
