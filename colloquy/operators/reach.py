"""Presence, conversations and mailbox as folds over event rows."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.session import materialize

STALE_MS, EVICT_MS, GRACE_MS = 90_000, 600_000, 300_000
WAKE_GAP_MS, MOST_ATTEMPTS, MOST_PENDING = 10_000, 5, 32
CHALLENGE_MS, MOST_LEVELS = 60_000, 16
#: Of the limiter: a burst, how much of it comes back in a minute, and the keys that one lane holds.
BURST, PER_MINUTE, MOST_KEYS = 5, 5, 4096
#: Parts in which a pane's messages are dealt to its sessions, so that no task has all pairs of one pane; fewer readers take fewer.
PARTS = 64
#: Readers of a pane that lie in one array, so that a message is repeated for them in one loop.
GROUP = 200


def presence_state(last_seen: Column, registered: Column, presence: Column, now: int) -> Column:
    """``live``, ``stale`` or ``evicted`` of a declared session, as a function of (row, now)."""
    quiet = F.greatest(last_seen, registered)
    state = F.when(quiet < now - STALE_MS - EVICT_MS, "evicted").when(quiet < now - STALE_MS, "stale").otherwise("live")
    return F.when(presence == "declared", state).otherwise("live")


def registered(events: DataFrame) -> DataFrame:
    """Presence rows folded from events (``session_id``, ``kind``, ``pid``, ``cwd``, ``presence``, ``at``, ``event_id``).

    ``register`` states all of a row, clears its stale mark and makes it the session's own word
    (``hook``); ``scan`` adds a row or moves an existing one, whose source and presence it keeps;
    ``beat`` renews one; ``stale`` marks one; ``leave`` drops the row if it still belongs to that
    process. Beats and marks of unknown sessions do nothing. Rows live from the last dropping leave on.
    """
    when = F.struct("at", "event_id")
    w = Window.partitionBy("session_id").orderBy("at", "event_id")
    places = F.when(F.col("kind").isin("register", "scan"), F.col("pid"))
    holder = F.last(places, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = events.withColumns({"ends": F.coalesce((F.col("kind") == "leave") & (F.col("pid") == holder), F.lit(False)), "when": when})
    life = F.sum(F.col("ends").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    drops = F.sum(F.col("ends").cast("long")).over(Window.partitionBy("session_id"))
    rows = rows.withColumns({"life": F.coalesce(life, F.lit(0)), "drops": drops}).where((F.col("life") == F.col("drops")) & ~F.col("ends"))
    return _current(rows)


def _current(rows: DataFrame) -> DataFrame:
    """The presence row of each session's events, all of one life of it."""
    is_kind = lambda *k: F.col("kind").isin(*k)
    last = lambda c, *k: F.max_by(F.when(is_kind(*k), F.col(c)), F.when(is_kind(*k), F.col("when")))
    first = F.min(F.when(is_kind("register", "scan"), F.col("when")))
    out = rows.groupBy("session_id").agg(
        last("pid", "register", "scan").alias("pid"),
        last("cwd", "register", "scan").alias("cwd"),
        F.max(F.when(is_kind("register"), F.lit("hook"))).alias("hooked"),
        last("presence", "register").alias("presence"),
        first["at"].alias("registered_at"),
        F.max(F.when(is_kind("register", "scan", "beat"), F.col("when"))).alias("seen"),
        F.max(F.when(is_kind("register", "beat"), F.col("when"))).alias("fresh"),
        F.max(F.when(is_kind("stale"), F.col("when"))).alias("marked"),
        first.alias("born"),
    )
    stale = F.when(F.col("marked").isNotNull() & (F.col("marked") > F.col("born")) & (F.col("fresh").isNull() | (F.col("marked") > F.col("fresh"))), F.col("marked")["at"])
    out = out.where("born is not null").withColumn("stale_at", stale)
    return out.select("session_id", "pid", "cwd", F.coalesce("hooked", F.lit("scan")).alias("source"), F.coalesce("presence", F.lit("scan")).alias("presence"), "registered_at", F.greatest(F.col("seen")["at"], "registered_at").alias("last_seen_at"), "stale_at")


def heartbeats(beats: DataFrame, live: DataFrame) -> DataFrame:
    """For each beat (``session_id``, ``at``) whether its row exists; one that doesn't must register again."""
    known = live.select("session_id", F.lit(True).alias("known"))
    return beats.join(known, "session_id", "left").select("session_id", "at", F.coalesce("known", F.lit(False)).alias("known"))


def leave(live: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows left when sessions leave; a row goes only if it still belongs to the process that leaves."""
    return live.join(gone.select("session_id", "pid").distinct(), ["session_id", "pid"], "left_anti").select(live.columns)


def reconcile(live: DataFrame) -> DataFrame:
    """One session per process: hook rows before scanned ones, then the newest registration."""
    w = Window.partitionBy("pid").orderBy((F.col("source") != "hook").cast("int"), F.col("registered_at").desc(), "session_id")
    return live.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def prune(live: DataFrame, pids: DataFrame) -> DataFrame:
    """Rows left after a scan: scanned, undeclared rows whose process is gone drop out."""
    alive = pids.select("pid", F.lit(True).alias("_alive")).distinct()
    owned = (F.col("source") == "scan") & (F.col("presence") != "declared")
    return live.join(alive, "pid", "left").where(~owned | F.col("_alive").isNotNull()).select(live.columns)


def discover(live: DataFrame, processes: DataFrame, now: int) -> DataFrame:
    """One discovery cycle: sessions found by their process are added or moved, dead ones pruned, the rest reconciled.

    ``processes`` has ``session_id``, ``pid`` and ``cwd``; an existing row keeps its source and presence.
    """
    seen = processes.select("session_id", F.col("pid").alias("_pid"), F.col("cwd").alias("_cwd"), F.lit(now).alias("_at"))
    both = live.join(seen, "session_id", "full_outer")
    new = F.col("registered_at").isNull()
    merged = both.select(
        "session_id",
        F.coalesce("_pid", "pid").alias("pid"),
        F.when(F.col("_at").isNotNull(), F.col("_cwd")).otherwise(F.col("cwd")).alias("cwd"),
        F.when(new, "scan").otherwise(F.col("source")).alias("source"),
        F.when(new, "scan").otherwise(F.col("presence")).alias("presence"),
        F.coalesce("registered_at", "_at").alias("registered_at"),
        F.coalesce("_at", "last_seen_at").alias("last_seen_at"),
    )
    return reconcile(prune(merged, processes))


def conversations(touches: DataFrame) -> DataFrame:
    """Conversation of every touch (``session_id``, ``runtime_id``, ``pid``, ``pid_start``, ``cwd``, ``at``).

    With a known process start the key alone decides, whatever the gap. Without one, touches of the
    same process and place belong together while the gap stays within the grace period (inclusive).
    """
    key = ["runtime_id", "pid", "pid_start", "cwd"]
    w = Window.partitionBy(*key).orderBy("at", "session_id")
    gap = F.col("at") - F.lag("at").over(w)
    new = (F.col("pid_start").isNull() & (gap > GRACE_MS)) | gap.isNull()
    part = F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return touches.withColumn("part", part.cast("long"))


def panes(members: DataFrame) -> DataFrame:
    """For each session the conversations of its process incarnation; at least its own."""
    me, other = members.alias("me"), members.select("conversation_id", "pid", "pid_start").distinct().alias("c")
    same = (F.col("c.pid") == F.col("me.pid")) & F.col("c.pid_start").eqNullSafe(F.col("me.pid_start"))
    return me.join(other, same).select("me.session_id", "c.conversation_id").distinct()


def current_session(members: DataFrame, live: DataFrame) -> DataFrame:
    """The session that now stands for a conversation: its newest live member, else its newest member."""
    alive = live.select("session_id", F.lit(True).alias("alive"))
    rows = members.join(alive, "session_id", "left")
    best = F.max_by("session_id", F.struct(F.coalesce("alive", F.lit(False)), "joined_at", "session_id"))
    return rows.groupBy("conversation_id").agg(best.alias("session_id"))


def addressability(asked: DataFrame, live: DataFrame, members: DataFrame, sessions: DataFrame) -> DataFrame:
    """Each address as Registered, DormantConversation, Dormant or Unknown; the first that holds."""
    flag = lambda df, name: df.select("session_id").distinct().withColumn(name, F.lit(True))
    rows = asked.join(flag(live, "l"), "session_id", "left").join(flag(members, "m"), "session_id", "left").join(flag(sessions, "s"), "session_id", "left")
    return rows.select("session_id", F.when(F.col("l"), "Registered").when(F.col("m"), "DormantConversation").when(F.col("s"), "Dormant").otherwise("Unknown").alias("state"))


def find_conversation(asked: DataFrame, members: DataFrame) -> DataFrame:
    """The conversation a new session (``pid``, ``pid_start``, ``cwd``, ``now``) joins, null if none.

    The exact incarnation comes first, else one of unknown start seen within the grace period.
    """
    a, m = asked.alias("a"), members.alias("m")
    place = (F.col("a.pid") == F.col("m.pid")) & F.col("a.cwd").eqNullSafe(F.col("m.cwd"))
    exact = F.col("a.pid_start").isNotNull() & (F.col("a.pid_start") == F.col("m.pid_start"))
    recent = F.col("m.pid_start").isNull() & (F.col("m.last_seen_at") >= F.col("a.now") - GRACE_MS)
    hits = a.join(m, place & (exact | recent)).withColumn("exact", exact)
    best = F.max_by("m.conversation_id", F.struct("exact", "m.last_seen_at", "m.conversation_id"))
    found = hits.groupBy("a.ask").agg(best.alias("conversation_id"))
    return asked.join(found, "ask", "left").select("ask", "conversation_id")


def inbox(messages: DataFrame, kind: str, since: int = 0) -> DataFrame:
    """``unread``, ``wakeable``, ``pending_ack`` or ``acked`` messages."""
    read, acked = F.col("read_at").isNotNull(), F.col("acked_at").isNotNull()
    return messages.where({"unread": ~read, "wakeable": ~read & (F.col("attempts") < MOST_ATTEMPTS), "pending_ack": read & ~acked, "acked": acked & (F.col("acked_at") >= since)}[kind])


def inbox_summary(messages: DataFrame, since: int = 0) -> DataFrame:
    """How many messages of each kind the four inbox views hold, in one pass."""
    read, acked = F.col("read_at").isNotNull(), F.col("acked_at").isNotNull()
    return messages.groupBy("kind").agg(F.count_if(~read).alias("unread"), F.count_if(~read & (F.col("attempts") < MOST_ATTEMPTS)).alias("wakeable"), F.count_if(read & ~acked).alias("pending_ack"), F.count_if(acked & (F.col("acked_at") >= since)).alias("acked"))


def for_conversation(messages: DataFrame, members: DataFrame, conversation_id: str) -> DataFrame:
    """Messages to any member of a conversation, oldest first."""
    own = members.where(F.col("conversation_id") == conversation_id).select(F.col("session_id").alias("to_session"))
    return messages.join(own, "to_session", "left_semi").orderBy("created_at", "id")


def pane_mail(messages: DataFrame, members: DataFrame, asking: DataFrame, kind: str, since: int = 0) -> DataFrame:
    """Messages of each asking session (``session_id``): those to any member of any conversation of its pane.

    A session without a conversation reads its own mailbox alone. Ordered by ``place``: oldest first,
    but the acknowledged ones of a session without conversation newest first.

    Sessions of the same pane read the same messages, so these are put in order once for all of them; the
    numbered rows are then dealt to arrays of readers, each of which is gone through in one loop, with no
    shuffle after that.
    """
    spark = messages.sparkSession
    asked = asking.select("session_id").distinct()
    pane = F.sort_array(F.collect_set(F.when(F.col("pid").isNotNull(), F.struct("pid", "pid_start"))))
    own = members.groupBy("session_id").agg(pane.alias("pane")).join(asked, "session_id", "left_semi")
    # a pane's box has the name of the first of its readers, a session's own box that of the session
    same = Window.partitionBy("pane")
    own = own.select("session_id", "pane", F.min("session_id").over(same).alias("box"), F.count(F.lit(1)).over(same).alias("readers"), F.row_number().over(same.orderBy("session_id")).alias("n"))
    group = F.floor((F.col("n") - 1) / GROUP)
    groups = own.groupBy("box", "readers", group.alias("group")).agg(F.collect_list("session_id").alias("sessions")).drop("group")
    alone = asked.join(members.select("session_id"), "session_id", "left_anti").select(F.col("session_id").alias("box"), F.lit(1).cast("long").alias("readers"))
    # a null in a struct equals a null
    each = own.where("n = 1").select("box", "readers", F.explode("pane").alias("at"))
    inside = members.where(F.col("pid").isNotNull()).select(F.struct("pid", "pid_start").alias("at"), "conversation_id").distinct()
    mates = members.select("conversation_id", F.col("session_id").alias("to_session")).distinct()
    shared = each.join(inside, "at").join(mates, "conversation_id").select("box", "readers", "to_session", F.lit(False).alias("alone")).distinct()
    boxes = shared.unionByName(alone.select("box", "readers", F.col("box").alias("to_session"), F.lit(True).alias("alone")))
    rows = boxes.join(inbox(messages, kind, since), "to_session")
    order = F.when(F.col("alone") & F.lit(kind == "acked"), -F.col("acked_at")).otherwise(F.col("created_at"))
    place = F.row_number().over(Window.partitionBy("box").orderBy(order, "id")).cast("long")
    parts = F.least("readers", F.lit(PARTS))
    rows = rows.withColumn("place", place).withColumn("part", F.col("place") % parts)
    # the size of the rows says nothing of that of the pairs, so adaptive execution must not choose the number of tasks
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    groups = groups.unionByName(alone.select("box", "readers", F.array("box").alias("sessions")))
    groups = groups.select("box", "sessions", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    kept = [c for c in messages.columns if c != "to_session"]
    pairs = rows.drop("readers").repartition(tasks, "box", "part").join(groups, ["box", "part"])
    return pairs.select("to_session", F.explode("sessions").alias("session_id"), "alone", *kept, "place")


def history(messages: DataFrame, members: DataFrame, since: int) -> DataFrame:
    """Acknowledged messages of every conversation, newest acknowledgement first (``place``)."""
    rows = inbox(messages, "acked", since).join(members.select("conversation_id", F.col("session_id").alias("to_session")).distinct(), "to_session")
    place = F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.col("acked_at").desc(), "id"))
    return rows.withColumn("place", place.cast("long"))


def resolve(addresses: DataFrame, members: DataFrame, live: DataFrame) -> DataFrame:
    """The session that now answers each address (``address``): a conversation's current one, or that of a
    session's conversation; any other address stands for itself."""
    now = current_session(members, live).withColumnRenamed("session_id", "current")
    of = members.groupBy(F.col("session_id").alias("address")).agg(F.max_by("conversation_id", F.struct("joined_at", "conversation_id")).alias("of"))
    rows = addresses.join(of, "address", "left").withColumn("conversation_id", F.coalesce("of", "address"))
    rows = rows.join(now, "conversation_id", "left")
    return rows.select(*addresses.columns, F.coalesce("current", "address").alias("target"))


def send(messages: DataFrame, members: DataFrame, live: DataFrame) -> DataFrame:
    """Replies with the session they go to now: the sender of what they answer, followed to its current session."""
    rows = replies(messages).withColumnRenamed("to_session", "address")
    return resolve(rows, members, live).withColumn("target", F.when(F.col("outcome") == "Sent", F.col("target")))


def own_sessions(asking: DataFrame, processes: DataFrame, live: DataFrame, levels: int = MOST_LEVELS) -> DataFrame:
    """Which session each process (``pid``) belongs to: the nearest of its ancestors that owns one.

    Rows of a scan are a process's own session and come before declared ones, which may share it.
    ``state`` is Resolved, Ambiguous or Unknown; ambiguous ones name no session. Each level is one join
    of the processes that are still unresolved.
    """
    own = F.col("presence") == "scan"
    owners = live.groupBy("pid").agg(F.sum(own.cast("int")).alias("scans"), F.count(F.lit(1)).alias("rows"), F.min(F.when(own, F.col("session_id"))).alias("scan"), F.min("session_id").alias("any"))
    one = F.when(F.col("scans") == 1, F.col("scan")).when((F.col("scans") == 0) & (F.col("rows") == 1), F.col("any"))
    owners = owners.select(F.col("pid").alias("at"), one.alias("session_id"), F.lit(True).alias("owned"))
    step = processes.where("ppid > 0 and ppid <> pid").select(F.col("pid").alias("at"), F.col("ppid").alias("next"))
    climb, out = asking.select("pid").distinct().withColumn("at", F.col("pid")), None
    for _ in range(levels):
        met = climb.join(owners, "at", "left")
        done = met.where("owned").select("pid", "session_id", F.when(F.col("session_id").isNull(), "Ambiguous").otherwise("Resolved").alias("state"))
        out = done if out is None else out.unionByName(done)
        climb = materialize(met.where("owned is null").join(step, "at").select("pid", F.col("next").alias("at")), "climb")
        if climb.isEmpty():
            break
    return asking.join(out, "pid", "left").select("pid", "session_id", F.coalesce("state", F.lit("Unknown")).alias("state"))


def replies(messages: DataFrame) -> DataFrame:
    """Replies with the message they answer; the reply goes to the original's sender, without one it is refused."""
    r, o = messages.where("reply_to is not null").alias("r"), messages.alias("o")
    rows = r.join(o, F.col("r.reply_to") == F.col("o.id"), "left")
    state = F.when(F.col("o.id").isNull(), "NoSuchMessage").when(F.col("o.from_session").isNull(), "NoSender").otherwise("Sent")
    return rows.select(F.col("r.id").alias("id"), F.col("r.reply_to").alias("reply_to"), F.col("o.from_session").alias("to_session"), state.alias("outcome"))


def by_prefix(messages: DataFrame, prefix: str) -> DataFrame:
    """At most two messages with the prefix: none, one and several are different answers."""
    return messages.where(F.startswith("id", F.lit(prefix))).orderBy("id").limit(2)


def receipts(events: DataFrame) -> DataFrame:
    """Read and acknowledgement times by message: the first read; the first acknowledgement not before it."""
    read = events.groupBy("id").agg(F.min(F.when(F.col("kind") == "read", F.col("at"))).alias("read_at"))
    acks = events.where(F.col("kind") == "ack").select("id", F.col("at").alias("_ack"))
    first = acks.join(read, "id").where(F.col("_ack") >= F.col("read_at")).groupBy("id").agg(F.min("_ack").alias("acked_at"))
    return read.join(first, "id", "left")


def dead_letters(wakes: DataFrame) -> DataFrame:
    """Messages whose fifth attempt is made, and when."""
    w = Window.partitionBy("id").orderBy("at")
    return wakes.withColumn("rn", F.row_number().over(w)).where(F.col("rn") == MOST_ATTEMPTS).select("id", F.col("at").alias("dead_at"))


def _folded(rows: DataFrame, key: str, kind: str, flag: str, start, step) -> DataFrame:
    """A fold over each key's rows in order of time, with a state of a few numbers.

    Rows come sorted by key and time in batches, so a key of any size is folded in constant memory.
    """

    def run(batches):
        now, state = None, None
        for pdf in batches:
            flags = []
            for k, at in zip(pdf[key], pdf["at"], strict=True):
                if k != now or state is None:
                    now, state = k, start()
                state, passed = step(state, at)
                flags.append(passed)
            yield pdf.assign(**{flag: flags})

    rows = rows.select(key, "at").repartition(key).sortWithinPartitions(key, "at")
    return rows.mapInPandas(run, f"{key} {kind}, at long, {flag} boolean")


def wakes_sent(requests: DataFrame) -> DataFrame:
    """Requests that lead to a wake: one within the gap after the last *sent* wake is skipped.

    A skipped request doesn't restart the clock, so it is a sequential fold per session.
    """

    def step(last, at):
        sent = last[0] is None or at - last[0] >= WAKE_GAP_MS
        return ((at,) if sent else last), sent

    return _folded(requests, "session_id", "string", "sent", lambda: (None,), step)


def rate_limited(requests: DataFrame, capacity: int = 5, per_minute: int = 5) -> DataFrame:
    """Token bucket per key: whether each request (``key``, ``at``) passes."""

    def step(state, at):
        level, last = state
        if last is not None:
            level = min(float(capacity), level + (at - last) * per_minute / 60_000)
        passed = level >= 1
        return (level - passed, at), passed

    return _folded(requests, "key", "string", "passed", lambda: (float(capacity), None), step)


class Buckets:
    """Token buckets of at most ``most`` keys.

    A bucket that has filled up again says what none says and is let go; while all are in use a new key is
    refused, never an old one displaced. A clock that steps back neither fills nor drains. An entry is (level,
    last time), and buckets are let go in the order in which they will be full.
    """

    def __init__(self, entries: dict[str, tuple[float, int]] | None = None, most: int = MOST_KEYS, burst: float = BURST, per_minute: float = PER_MINUTE):
        self.entries, self.most, self.burst, self.per_minute = dict(entries or {}), most, float(burst), per_minute
        self._full = [(self._full_at(k), k) for k in self.entries]
        heapq.heapify(self._full)

    def _level(self, key: str, now: int) -> float:
        """What a bucket holds; the same arithmetic as of ``rate_limited``, as whole tokens are told by the last digit."""
        level, last = self.entries[key]
        return min(self.burst, level + max(0, now - last) * self.per_minute / 60_000)

    def _full_at(self, key: str) -> int:
        """A time shortly before which the bucket can't be full."""
        level, last = self.entries[key]
        return math.floor(last + (self.burst - level) * 60_000 / self.per_minute) - 1

    def _let_go(self, now: int) -> None:
        while self._full and self._full[0][0] <= now:
            _, key = heapq.heappop(self._full)
            if key in self.entries:
                if self._level(key, now) >= self.burst:
                    del self.entries[key]
                else:  # used since, or full a moment later
                    heapq.heappush(self._full, (max(self._full_at(key), now + 1), key))

    def allow(self, key: str, now: int) -> bool:
        self._let_go(now)
        new = key not in self.entries
        if new and len(self.entries) >= self.most:
            return False
        level, last = (self.burst, now) if new else (self._level(key, now), self.entries[key][1])
        passed = level >= 1
        self.entries[key] = (level - passed, max(now, last))
        if new:
            heapq.heappush(self._full, (self._full_at(key), key))
        return passed


def lane(key: Column, lanes: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(lanes)).cast("int")


def rate_limited_within(requests: DataFrame, lanes: int = 1, most: int = MOST_KEYS) -> DataFrame:
    """Token buckets (``key``, ``at``) where each lane of keys holds at most ``most`` at a time: ``lane`` and whether each passes.

    A lane is one server's table, so its requests go in order through one task, in batches and bounded memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, buckets = None, None
        for pdf in batches:
            passed = []
            for k, key, at in zip(pdf["lane"], pdf["key"], pdf["at"], strict=True):
                if k != now:
                    now, buckets = k, Buckets(most=most)
                passed.append(buckets.allow(key, at))
            yield pdf.assign(passed=passed)

    rows = requests.select(lane(F.col("key"), lanes).alias("lane"), "key", "at").repartition("lane").sortWithinPartitions("lane", "at", "key")
    return rows.mapInPandas(run, "lane int, key string, at long, passed boolean")


def challenges(events: DataFrame) -> DataFrame:
    """Whether each answer to a challenge counts: events ``issue`` and ``consume`` (``nonce``, ``kind``, ``at``, ``event_id``).

    A challenge is good once and for its lifetime; it is spent by any answer, in time or not. A table of
    events needs no cap on open challenges, which only bounds a server's memory.
    """
    issued = events.where(F.col("kind") == "issue").groupBy("nonce").agg(F.min("at").alias("issued_at"))
    answers = events.where(F.col("kind") == "consume")
    first = Window.partitionBy("nonce").orderBy("at", "event_id")
    rows = answers.withColumn("rn", F.row_number().over(first)).join(issued, "nonce", "left")
    in_time = (F.col("at") >= F.col("issued_at")) & (F.col("at") - F.col("issued_at") <= CHALLENGE_MS)
    return rows.select("nonce", "at", F.coalesce((F.col("rn") == 1) & in_time, F.lit(False)).alias("accepted"))


def pending_requests(peers: DataFrame) -> DataFrame:
    """Incoming pairing requests that wait, and whether the list is full; outgoing ones don't count."""
    waiting = F.count_if(F.col("trust") == "pending_in")
    return peers.agg(waiting.alias("waiting"), (waiting >= MOST_PENDING).alias("full"))


def admit(asked: DataFrame, peers: DataFrame) -> DataFrame:
    """Outcome of incoming requests (``device_id``, ``at``), in order of time: Recorded, Inert or ListFull.

    A known device only renews its row (a trusted one stays as it is); a new one is refused when as many
    wait as the list holds, those admitted before it included.
    """
    known = asked.join(peers.select("device_id", "trust"), "device_id", "left")
    room = peers.agg((F.lit(MOST_PENDING) - F.count_if(F.col("trust") == "pending_in")).alias("room"))
    first = Window.partitionBy("device_id").orderBy("at")
    rows = known.withColumn("rn", F.row_number().over(first))
    new = rows.where("trust is null and rn = 1").orderBy("at", "device_id").limit(MOST_PENDING)
    order = Window.orderBy("at", "device_id")
    taken = new.withColumn("n", F.row_number().over(order)).join(F.broadcast(room), F.col("n") <= F.col("room")).select("device_id", F.lit(True).alias("taken"))
    rows = rows.join(F.broadcast(taken), "device_id", "left")
    state = F.when(F.col("trust") == "trusted", "Inert").when(F.col("trust").isNotNull() | F.col("taken"), "Recorded").otherwise("ListFull")
    return rows.select("device_id", "at", state.alias("outcome"))


def trust_step(state: Column, action: Column) -> Column:
    """Peer trust after an action; an upsert never touches a trusted peer, unknown steps change nothing."""
    return (
        F.when((action == "request") & (state.isNull() | (state != "trusted")), "pending_in")
        .when((action == "approve") & (state == "pending_in"), "trusted")
        .when((action == "reject") & (state == "pending_in"), F.lit(None))
        .when((action == "revoke") & (state == "trusted"), "revoked")
        .otherwise(state)
    )
