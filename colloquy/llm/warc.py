"""WARC archives of pages, and an externally merged capture index over them.

Writing: each page becomes a record of a WARC 1.1 archive, a ``response`` with its payload or, when
an equal payload is archived under a smaller page id, a ``revisit`` that refers to it. Archives are
written by Spark's own text writer with the record separator as its line separator, so they land on
whatever file system the shared folder is on, committed like any Spark output.

Indexing: every archive is read back once and parsed by its content lengths; a task sorts the captures of
an archive into a run by (URL key, timestamp, page id) and writes it, each row with its place in the run.
The runs are cut at the same key bounds, which Spark draws for its range partitioning; a range's rows come
back run by run in their places (by Spark's sort, which spills), and its k sorted slices are merged by a loser
tree, which gives globally ordered capture histories (``range_id``, ``position``). The number of ranges follows
the number of captures, about ``RANGE_ROWS`` each, so a task holds that many at any size. The keys hold page
ids and places, so a host or URL with a third of all captures is split like any other range.

Defined cases: a null html is the empty payload; a null url is empty; line breaks in a URL are
percent-encoded; of rows that repeat the smallest page id of a payload each is a response; rows that repeat
an id with other payloads are captures of their own; a page without an id is always a response; page ids are integers; other columns are ignored; an empty table
gives an empty index. No archive file exceeds ``FILE_BYTES`` but for one with a single larger page.
"""

from __future__ import annotations

import base64
import hashlib
import re
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.session import forget, materialize, scratch_path

END = "\r\n\r\n"
#: Rows and bytes an archive file holds at most.
ROWS_PER_FILE, FILE_BYTES = 4000, 1_000_000_000
#: Bytes from which pages are written apart: to files of all ``ROWS_PER_FILE``, of some hundred, of as many as fit.
SIZES = 200_000, 8_000_000
#: Captures a range aims at.
RANGE_ROWS = 50_000
#: Up to this many revisits (16 bytes each) are broadcast to the writer, more are shuffled.
BROADCAST_ROWS = 200_000
#: Captures are dated from this second on, one second for each page id, as pages carry no time.
EPOCH = 1_704_067_200
_LENGTH = re.compile(rb"\r\nContent-Length: (\d+)\r\n")
CDX = "url_key string, captured_at long, page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, archive string, offset long, length long"


def url_key(url: str) -> str:
    """Sort-friendly form of a URL: host labels reversed, then path and query, lower case."""
    try:
        p = urlsplit(url.strip())
        host, port = (p.hostname or ""), p.port
    except ValueError:
        return url.lower()
    host = re.sub(r"^www\d*\.", "", host)
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + (p.path or "/")
    return (key + (f"?{p.query}" if p.query else "")).lower()


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _stamp(seconds: int) -> str:
    import datetime as dt

    return (dt.datetime(1970, 1, 1) + dt.timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record without the separator that follows it."""
    name = "null" if page_id is None else str(page_id)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {_stamp(EPOCH + (page_id or 0) % 10**10)}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest_of(payload)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + END).encode() + block


def parse(data: bytes):
    """(offset, length, headers, block) of every record of an archive, by the content lengths."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record begins at {at}")
        heads = dict(x.split(": ", 1) for x in lines[1:])
        end = stop + 4 + int(heads["Content-Length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} isn't closed")
        yield at, end - at, heads, data[stop + 4 : end]
        at = end + 4


def _payload() -> Column:
    return F.encode(F.coalesce("html", F.lit("")), "UTF-8")


def originals(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, h, n, refers_to) of pages whose payload, of SHA-1 ``h`` and ``n`` bytes, is archived under a smaller page id."""
    rows = pages.select("page_id", F.unhex(F.sha1(_payload())).alias("h"), F.octet_length(_payload()).alias("n")).where(F.col("n") >= min_bytes)
    first = rows.groupBy("h", "n").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    hits = rows.join(first, ["h", "n"]).where("page_id > first")
    return hits.select("page_id", "h", "n", F.col("first").alias("refers_to")).distinct()


def write(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Archive all pages under ``path``, one folder for each class of page sizes."""

    def records(batches):
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(4)]
            out = [record(p, u or "", (h or "").encode(), r).decode() for p, u, h, r in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    refs = kept = materialize(originals(pages, min_bytes).withColumnsRenamed({"page_id": "_p", "h": "_h", "n": "_n"}), "refs")
    if refs.count() <= BROADCAST_ROWS:
        refs = F.broadcast(refs)
    # rows may repeat an id with other payloads: a page is known by both
    known = pages.select(F.col("page_id").cast("long"), "url", "html", F.octet_length(_payload()).alias("_size"))
    same = (F.col("page_id") == F.col("_p")) & (F.col("_size") == F.col("_n")) & (F.unhex(F.sha1(_payload())) == F.col("_h"))
    rows = known.join(refs, same, "left")
    # so that a long page bounds the files of pages like it, not of all
    size_class = F.when(F.col("_size") < SIZES[0], 0).when(F.col("_size") < SIZES[1], 1).otherwise(2)
    longest = known.groupBy(size_class.alias("k")).agg(F.max("_size").alias("longest")).collect()
    for k, most in longest or [(0, 0)]:
        in_file = max(1, min(ROWS_PER_FILE, FILE_BYTES // (most + 4096)))
        own = rows.where(size_class == k).select("page_id", "url", "html", "refers_to")
        own.mapInArrow(records, "value string").write.option("lineSep", END).option("maxRecordsPerFile", in_file).text(f"{path}/{k}")
    forget(kept)


def captures(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of all archives under ``path``, each archive's entries sorted into a run (``run``, ``rank``).

    A revisit has no payload; its size is stated by the HTTP header that it keeps.
    """

    def read(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = []
                for offset, length, heads, block in parse(data.as_py()):
                    pid = heads["WARC-Record-ID"][len("<urn:page:") : -1]
                    ref = heads.get("WARC-Refers-To")
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    whole = ref is None
                    stated = heads["WARC-Payload-Digest"].removeprefix("sha1:")
                    if whole and digest_of(payload) != stated:
                        raise ValueError(f"the payload of page {pid} in {name} is damaged")
                    page = None if pid == "null" else int(pid)
                    rows.append((url_key(heads["WARC-Target-URI"]), EPOCH + (page or 0) % 10**10, page, heads["WARC-Type"], stated, len(payload) if whole else int(_LENGTH.search(block)[1]), int(ref[len("<urn:page:") : -1]) if ref else None, name, offset, length))
                rows.sort(key=lambda r: (r[0], r[1], r[2] is None, r[2] or 0))
                yield _batch(rows, name)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(read, CDX + ", run string, rank long")


_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
_NAMES = [c.split()[0] for c in CDX.split(", ")]


def _batch(rows: list[tuple], run: str | None = None) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(_NAMES)
    arrays = [pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)]
    if run is not None:
        return pa.RecordBatch.from_arrays([*arrays, pa.array([run] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64())], [*_NAMES, "run", "rank"])
    return pa.RecordBatch.from_arrays(arrays, _NAMES)


class LoserTree:
    """k-way merge of sorted iterators: each inner node keeps the loser of its match."""

    def __init__(self, runs: list, key):
        self.key, self.runs = key, [iter(r) for r in runs]
        self.k = max(1, len(self.runs))
        self.heads = [next(r, None) for r in self.runs] or [None]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._replay(i)

    def _beats(self, a: int, b: int) -> bool:
        """Whether run ``a`` comes before run ``b``; an empty run comes last, ties go to the lower run."""
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and (self.keys[a] is not None or a < b)
        return (self.keys[a], a) < (self.keys[b], b)

    def _replay(self, i: int) -> None:
        winner, node = i, (i + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other == -1:
                self.tree[node] = winner
                return
            if self._beats(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        while self.heads[w := self.tree[0]] is not None:
            yield self.heads[w]
            self.heads[w] = next(self.runs[w], None)
            self.keys[w] = None if self.heads[w] is None else self.key(self.heads[w])
            self._replay(w)


def merge_index(entries: DataFrame, ranges: int = 0) -> DataFrame:
    """All entries in global order of (URL key, time, page id): ``CDX`` columns, ``range_id`` and ``position`` in it."""
    total = entries.count()
    ranges = ranges or total // RANGE_ROWS + 1
    dealt = entries.repartitionByRange(ranges, "url_key", "captured_at", F.asc_nulls_last("page_id"), "archive", "offset").sortWithinPartitions("run", "rank")
    order = lambda r: (r[0], r[1], r[2] is None, r[2] or 0)

    def merged(number: int, slices: list[list[tuple]]):
        rows, at = [], 0
        for r in LoserTree(slices, order):
            rows.append((*r[:10], number, at))
            at += 1
            if len(rows) == 5000:
                yield _positions(rows)
                rows = []
        yield _positions(rows)

    def merge(batches):
        number, run, slices = TaskContext.get().partitionId(), None, []
        for b in batches:
            for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if r[10] != run:
                    run = r[10]
                    slices.append([])
                slices[-1].append(r)
        if slices:
            yield from merged(number, slices)

    return dealt.mapInArrow(merge, CDX + ", range_id long, position long")


def _positions(rows: list[tuple]) -> pa.RecordBatch:
    base = _batch([r[:10] for r in rows])
    return pa.RecordBatch.from_arrays([*base.columns, pa.array([r[10] for r in rows], pa.int64()), pa.array([r[11] for r in rows], pa.int64())], [*_NAMES, "range_id", "position"])


def archive_and_index(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages to archives in the shared folder, read them back once, and index them in order."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(pages, path, min_bytes)
    return merge_index(materialize(captures(spark, path), "captures"))
