"""Integrity, growth and archive reports, and federated search."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.session import materialize

#: Peers asked for ``all``, asked at once, and how long one may take.
MOST_PEERS, AT_ONCE, PEER_SECONDS = 8, 4, 5.0


def integrity(sessions: DataFrame, turns: DataFrame, indexed: DataFrame) -> DataFrame:
    """Sessions with a wrong count, turns without a session, turns that aren't indexed: one aggregate by session."""
    turn = turns.select("session_id", "seq", F.lit(1).alias("t"), F.lit(0).alias("i")).unionByName(indexed.select("session_id", "seq", F.lit(0).alias("t"), F.lit(1).alias("i")))
    each = turn.groupBy("session_id", "seq").agg(F.sum("t").alias("t"), F.sum("i").alias("i"))
    each = each.groupBy("session_id").agg(F.sum("t").alias("n"), F.sum(F.when(F.col("i") == 0, F.col("t")).otherwise(0)).alias("missing"))
    rows = sessions.select("session_id", "turn_count").withColumn("known", F.lit(True)).join(each, "session_id", "full_outer")
    n = F.coalesce("n", F.lit(0))
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.agg(F.count_if(F.col("known") & (F.col("turn_count") != n)).alias("miscounted"), whole(F.when(F.col("known").isNull(), n)).alias("orphans"), whole("missing").alias("unindexed"))


def growth(turns: DataFrame, now: int, bytes_stored: int) -> DataFrame:
    """Turns of the last 7 and 30 days, the larger daily rate, and gigabytes a year at it."""
    day = 86_400_000
    recent = lambda d: F.count_if(F.col("ts") >= now - d * day)
    rows = turns.agg(F.count(F.lit(1)).alias("turns"), recent(7).alias("last_7d"), recent(30).alias("last_30d"), F.min(F.when(F.col("ts") > 0, F.col("ts"))).alias("first_ts"))
    rate = F.greatest(F.col("last_7d") / 7, F.col("last_30d") / 30)
    each = F.lit(float(bytes_stored)) / F.greatest("turns", F.lit(1))
    return rows.withColumns({"per_day": rate, "bytes_per_turn": each, "gb_per_year": rate * 365 * each / 1e9})


def irreplaceable(sessions: DataFrame, files: DataFrame) -> DataFrame:
    """Sessions and turns whose file is gone, and those that never had one."""
    s = sessions.join(files.select(F.col("path").alias("source_path"), F.lit(True).alias("there")), "source_path", "left")
    gone = F.col("source_path").isNotNull() & F.col("there").isNull()
    never = F.col("source_path").isNull()
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("turn_count"))), F.lit(0))
    return s.agg(F.count_if(gone).alias("gone_sessions"), total(gone).alias("gone_turns"), F.count_if(never).alias("pathless_sessions"), total(never).alias("pathless_turns"))


def select_peers(peers: DataFrame, wanted: list[str]) -> tuple[str, list[str]]:
    """Outcome (Ready, NothingReachable, NoneUsable, Ambiguous, TooMany) and the ids chosen.

    A name wanted may be an exact peer name or a prefix of its id; ``all`` takes every trusted peer.
    """
    rows = peers.where(F.col("trust") == "trusted").select("device_id", "name", "addr").collect()
    if wanted in ([], ["all"]):
        ready = [r["device_id"] for r in rows if r["addr"]]
        if len(ready) > MOST_PEERS:
            return "TooMany", ready
        return ("Ready" if ready else "NothingReachable"), ready
    chosen = []
    for want in wanted:
        hits = [r for r in rows if r["name"] == want or r["device_id"].startswith(want)]
        if len(hits) > 1:
            return "Ambiguous", [r["device_id"] for r in hits]
        chosen += hits
    ready = [r["device_id"] for r in chosen if r["addr"]]
    return ("Ready" if ready else "NoneUsable"), ready


def ask_peers(peers: dict[str, Callable[[], DataFrame]], at_once: int = AT_ONCE, seconds: float = PEER_SECONDS) -> dict[str, DataFrame | Exception]:
    """The answers of all peers, a few at a time; a peer that fails or is late is an exception, not zero hits.

    One deadline holds for all. An answer is worked out while it is waited for and kept in the shared
    folder, so nothing of it is left to run later; the Spark jobs of a late peer are cancelled by their tag.
    """
    spark = SparkSession.active()
    sc, pool, out = spark.sparkContext, ThreadPoolExecutor(at_once), {}
    tags = {name: f"peer-{uuid.uuid4().hex}" for name in peers}
    late = threading.Event()

    def ask(name: str, f: Callable[[], DataFrame]) -> DataFrame:
        sc.addJobTag(tags[name])
        try:
            hits = f()
            if hits is None:
                raise ValueError("the answer has no hits")
            if late.is_set():
                raise TimeoutError
            return materialize(hits, "peer")
        finally:
            sc.removeJobTag(tags[name])

    deadline = time.monotonic() + seconds
    jobs = {name: pool.submit(inheritable_thread_target(spark)(ask), name, f) for name, f in peers.items()}
    for name, job in jobs.items():
        try:
            out[name] = job.result(timeout=max(0.0, deadline - time.monotonic()))
        except Exception as e:
            out[name] = e if str(e) else TimeoutError(f"no answer within {seconds} seconds")
    late.set()
    pool.shutdown(wait=False, cancel_futures=True)
    for name, job in jobs.items():
        if not job.done():
            sc.cancelJobsWithTag(tags[name])
    return out


def merge_hits(local: DataFrame, peers: dict[str, DataFrame | Exception], limit: int, with_local: bool = True) -> tuple[DataFrame, dict[str, str]]:
    """Hits of all machines, newest first, unknown times last; and what failed, by peer, never as zero hits.

    Local hits take part in the order and the limit; without ``with_local`` they go afterwards.
    """
    out, failed = local.withColumn("_here", F.lit(True)), {}
    for name, hits in peers.items():
        if isinstance(hits, Exception):
            failed[name] = str(hits)
        else:
            out = out.unionByName(hits.withColumns({"machine_id": F.lit(name), "_here": F.lit(False)}))
    out = out.orderBy(F.coalesce("ts", F.lit(0)).desc(), "machine_id", "session_id", "seq").limit(limit)
    return (out if with_local else out.where(~F.col("_here"))).drop("_here"), failed
