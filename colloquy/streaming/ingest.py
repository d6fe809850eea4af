"""Streams of transcript lines into a stored library, every line once.

A batch is one commit of the library, and the commit carries the batch's number: a batch that Spark runs
again, because it was stopped between the commit and its own checkpoint, finds itself in the ledger and
writes nothing. Turn numbers go on from the library's session rows. A session whose file starts anew (its
first byte comes again) loses what it had in the same commit. Compaction marks are stored as they come, and
reach back to earlier turns when the library is read (``Snapshot.surfaced``).

One stream writes the sessions of a folder at a time; several streams may share a library.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from colloquy.operators.store import Library
from colloquy.session import forget, materialize
from colloquy.sources import transcripts
from colloquy.sources.descriptors import Descriptor

#: The first pause before a failed stream is started again, the longest, and how often all files are compared.
FIRST_PAUSE, LONGEST_PAUSE, RECONCILE_SECONDS = 0.25, 30.0, 30.0


def writer(library: Library, d: Descriptor, machine_id: str, stream: str) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` takes: lines (``path``, ``mtime``, ``pos``, ``value``) into the library, under the stream's name."""

    def write(rows: DataFrame, number: int) -> None:
        now = library.snapshot()
        if now.ledger.get(stream, -1) >= number:
            return
        parsed = materialize(transcripts.parse(rows, d, machine_id), "batch")
        if not parsed.isEmpty():
            here = parsed.groupBy("session_id").agg(F.min("pos").alias("first"))
            held = now.sessions()
            known = anew = None
            if held is not None:
                held = held.select("session_id", F.col("turn_count").alias("seq")).join(here, "session_id")
                known, anew = held.where("first > 0").select("session_id", "seq"), held.where("first = 0").select("session_id")
            turns, sessions, marks = transcripts.chunk(parsed, d, known)
            library.write(turns, sessions, marks, replace=False if anew is None or anew.isEmpty() else anew, batch=(stream, number))
        forget(parsed)

    return write


def reconcile(library: Library, files: DataFrame, read: Callable[[DataFrame], DataFrame], d: Descriptor, machine_id: str) -> int:
    """Read again, whole, the files (``path``, ``mtime``, ``size``) that the library has not as they are now; how many.

    Whatever a stream has missed (a folder that was away, a file that changed while nobody looked) is found
    by the times of the session rows. Sessions that came back without a turn fail the commit.
    """
    held, native = library.snapshot().sessions(), transcripts.native_id(F.col("path"), d.native_id)
    files = files.withColumn("session_id", F.concat_ws("/", F.lit(machine_id), F.lit(d.id), native))
    if held is not None:
        seen = held.select("session_id", F.col("mtime").alias("seen"))
        files = files.join(seen, "session_id", "left").where(F.col("seen").isNull() | (F.col("seen") < F.col("mtime"))).drop("seen")
    late = materialize(files, "late")
    n = late.count()
    if n:
        parsed = materialize(transcripts.parse(read(late.drop("session_id")), d, machine_id), "reread")
        turns, sessions, marks = transcripts.chunk(parsed, d)
        library.write(turns, sessions, marks, reread=late.select("session_id"))
        forget(parsed)
    forget(late)
    return n


class Watch:
    """Keeps a stream running: starts it again after a failure, after growing pauses, and reconciles now and then.

    What failed is kept in ``failures``, never dropped; a reconcile that fails is tried again at its next time.
    """

    def __init__(self, start: Callable[[], StreamingQuery], reconcile: Callable[[], int] | None = None, every: float = RECONCILE_SECONDS, first_pause: float = FIRST_PAUSE):
        self.start, self.reconcile, self.every, self.first_pause = start, reconcile, every, first_pause
        self.failures: list[str] = []

    def run(self, until: Callable[[], bool], poll: float = 0.2) -> None:
        """Watch until ``until`` says so or the stream ends by itself."""
        failed, looked = 0, time.monotonic()
        while not until():
            query = None
            try:
                query = self.start()
                while not until():
                    if query.awaitTermination(poll):
                        return
                    if query.lastProgress is not None:
                        failed = 0  # batches go through
                    if self.reconcile is not None and time.monotonic() - looked >= self.every:
                        looked = time.monotonic()
                        self._reconciled()
            except Exception as e:
                failed += 1
                self.failures.append(str(e))
                time.sleep(min(LONGEST_PAUSE, self.first_pause * 2 ** (failed - 1)))
            finally:
                if query is not None:
                    query.stop()

    def _reconciled(self) -> None:
        try:
            self.reconcile()
        except Exception as e:
            self.failures.append(str(e))
