"""Session rules on an event log (T1 idle expiry, T2 maximum age).

T1: a session ends when the gap to the user's previous event is strictly
more than 30 minutes (exactly 30 minutes stays in the session).

T2: additionally a session ends when an event comes strictly more than 8
hours after the session's first event; that event starts the next session.
The age rule is checked before the idle rule; both start a new session at
the offending event.

T1 orders the log by (user, time) in ranges, so a user, or a single hour of one,
that holds a third of all events lies in as many tasks as its size asks for. Each
task streams its range once and marks the events whose predecessor lies in it.
What a range cannot know, whether its first event goes on with a session and how
many sessions its first user had before, comes from the rows of one small table:
first and last user of each range, with their first and last event and number of
sessions (two rows per range).

T2 is exact and distributed as well (no group is gathered in one task):
see ``mark_sessions``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recurra.functions.constants import SESSION_IDLE_SECONDS, SESSION_MAX_AGE_SECONDS
from recurra.session import materialize

MICROS = 1_000_000


def _events(events: DataFrame, user: str, ts: str, eid: str) -> DataFrame:
    return events.select(F.col(user).alias("user_id"), F.col(ts).alias("ts"), F.col(eid).alias("event_id"),
                         F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))


def _mark_range(idle_us: int):
    """Streams one range in order: adds range, local (session number of the user within the range) and edge.

    edge: 1 on rows of the range's first user. The first event counts as a start here.
    """
    def run(batches):
        at = TaskContext.get().partitionId()
        user, last, number, first = None, None, 0, True
        for b in batches:
            if not b.num_rows:
                continue
            t = b.column("t").to_numpy()
            who = b.column("user_id").dictionary_encode(null_encoding="encode")
            code = who.indices.to_numpy()
            changes = np.append(True, code[1:] != code[:-1])
            head = b.column("user_id")[0].as_py()
            goes_on = last is not None and head == user
            changes[0] = not goes_on
            gap = np.diff(t, prepend=last if goes_on else t[0])
            starts = changes | (gap > idle_us)
            total = np.cumsum(starts)
            # Numbers begin anew with each user; those of the user that goes on follow the last batch's.
            begin = np.maximum.accumulate(np.where(changes, np.arange(len(t)), -1))
            local = np.where(begin >= 0, total - total[np.maximum(begin, 0)] + 1, total + number)
            same = (begin < 0) & first if goes_on else np.zeros(len(t), bool)
            if last is None:
                after = np.flatnonzero(changes[1:])
                same[:after[0] + 1 if len(after) else len(t)] = True
            first = bool(same[-1])
            user, last, number = b.column("user_id")[b.num_rows - 1].as_py(), int(t[-1]), int(local[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(t), at), pa.int32()), pa.array(local, pa.int64()), pa.array(same)],
                                             [*b.schema.names, "range", "local", "edge"])
    return run


def mark_idle_sessions(events: DataFrame, idle_seconds: int = SESSION_IDLE_SECONDS, user: str = "user_id", ts: str = "ts",
                       eid: str = "event_id", ranges: int | None = None) -> DataFrame:
    """Every event with ``session_idx`` (1-based per user) under the idle rule; the marked ranges are stored."""
    spark = events.sparkSession
    ev = _events(events, user, ts, eid)
    order = ["user_id", "t", "event_id"]
    schema = T.StructType(ev.schema.fields + [T.StructField("range", T.IntegerType()), T.StructField("local", T.LongType()), T.StructField("edge", T.BooleanType())])
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    marked = materialize(spark, ev.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_mark_range(idle_seconds * MICROS), schema), "idle-ranges")

    # A range's last user is the only one the next range can go on with; users within a range are whole.
    ends = marked.groupBy("range", "user_id").agg(F.bool_or("edge").alias("edge"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.max("local").alias("n"))
    ends = ends.withColumn("is_last", F.col("user_id").eqNullSafe(F.max_by("user_id", F.struct(F.col("user_id").isNotNull(), "user_id")).over(Window.partitionBy("range"))))
    ends = ends.where(F.col("edge") | F.col("is_last"))
    by_user = Window.partitionBy("user_id").orderBy("range")
    goes_on = F.coalesce(F.col("first_t") - F.lag("last_t").over(by_user) <= idle_seconds * MICROS, F.lit(False)).cast("int")
    ends = ends.withColumn("goes_on", goes_on).withColumn("before", F.coalesce(F.sum(F.col("n") - F.col("goes_on")).over(
        by_user.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("goes_on"))
    shift = ends.where("edge").select(F.col("range").alias("_range"), "before")
    # At most one row per range.
    met = marked.join(F.broadcast(shift), F.col("edge") & (F.col("range") == F.col("_range")), "left")
    return met.select("user_id", "event_id", "ts", "t", (F.col("local") + F.coalesce("before", F.lit(0))).cast("long").alias("session_idx"))


def summarize(marked: DataFrame) -> DataFrame:
    return (marked.groupBy("user_id", "session_idx")
                  .agg(F.min("ts").alias("session_start"), F.max("ts").alias("session_end"),
                       F.count(F.lit(1)).alias("n_events"),
                       ((F.max("t") - F.min("t")) / MICROS).alias("duration_seconds")))


def idle_sessions(events: DataFrame, **kw) -> DataFrame:
    """One row per session."""
    return summarize(mark_idle_sessions(events, **kw))


def _successor_after(ev: DataFrame, delta_us: int, chunk_us: int) -> DataFrame:
    """For every event e of ``ev`` (user_id, idle_idx, event_id, t): the first
    event of the same idle session strictly later than t_e + delta, in
    (t, event_id) order, or NULL.

    Probes (t_e + delta) and events are merged and ordered inside
    (user, session, chunk) windows (a running frame in descending order, so
    linear); a probe with no later event in its chunk takes the first event
    of the next chunk that has events, from a chunk-level table.
    """
    keys = ["user_id", "idle_idx"]
    evs = ev.select(*keys, F.col("t").alias("time"), F.lit(0).alias("kind"), F.col("event_id").alias("id"))
    probes = ev.select(*keys, (F.col("t") + delta_us).alias("time"), F.lit(1).alias("kind"),
                       F.col("event_id").alias("id"))
    u = evs.unionByName(probes).withColumn("chunk", F.floor(F.col("time") / chunk_us))
    later_first = (Window.partitionBy(*keys, "chunk")
                         .orderBy(F.col("time").desc(), F.col("kind").desc(), F.col("id").desc())
                         .rowsBetween(Window.unboundedPreceding, -1))
    as_event = F.when(F.col("kind") == 0, F.struct(F.col("time").alias("t"), F.col("id").alias("id")))
    u = u.withColumn("cand", F.last(as_event, ignorenulls=True).over(later_first))
    chunk_first = (u.groupBy(*keys, "chunk")
                    .agg(F.min(as_event).alias("first_ev"))
                    .withColumn("next_chunk_first", F.last("first_ev", ignorenulls=True).over(
                        Window.partitionBy(*keys).orderBy(F.col("chunk").desc())
                              .rowsBetween(Window.unboundedPreceding, -1))))
    pr = u.where(F.col("kind") == 1).join(chunk_first.select(*keys, "chunk", "next_chunk_first"), [*keys, "chunk"])
    nxt = F.coalesce(F.col("cand"), F.col("next_chunk_first"))
    return pr.select(*keys, F.col("id").alias("e"), nxt["id"].alias("p"))


def _age_starts(long_ev: DataFrame, first_ev: DataFrame, levels: int, max_age_us: int,
                chunk_us: int) -> DataFrame:
    """Session starts inside long idle sessions: the orbit of each idle
    session's first event under "next start" (first event more than
    max_age later), found by pointer doubling: jump tables J_k = next^(2^k),
    and orbit sets S_{k+1} = S_k + J_k(S_k), so 2^levels starts are covered
    after ``levels`` joins."""
    spark = long_ev.sparkSession
    keys = ["user_id", "idle_idx"]
    jump = materialize(spark, _successor_after(long_ev, max_age_us, chunk_us), "session-jump-0")
    orbit = first_ev.select(*keys, F.col("event_id").alias("node"))
    for k in range(levels):
        step = (orbit.join(jump.withColumnRenamed("e", "node"), [*keys, "node"])
                     .where(F.col("p").isNotNull()).select(*keys, F.col("p").alias("node")))
        orbit = orbit.unionByName(step).distinct()
        if k + 1 < levels:
            a, b = jump.alias("a"), jump.alias("b")
            nxt = (a.join(b, (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.idle_idx") == F.col("b.idle_idx"))
                          & (F.col("a.p") == F.col("b.e")), "left")
                    .select(F.col("a.user_id").alias("user_id"), F.col("a.idle_idx").alias("idle_idx"),
                            F.col("a.e").alias("e"), F.col("b.p").alias("p")))
            jump = materialize(spark, nxt, f"session-jump-{k + 1}")
            orbit = materialize(spark, orbit, f"session-orbit-{k + 1}")
    return orbit.withColumnRenamed("node", "event_id")


def mark_sessions(events: DataFrame, idle_seconds: int = SESSION_IDLE_SECONDS,
                  max_age_seconds: int = SESSION_MAX_AGE_SECONDS, chunk_seconds: int = 3600,
                  idle_marked: DataFrame | None = None, **kw) -> DataFrame:
    """T1 + T2: every event with its final ``session_idx`` (1-based per user).

    ``idle_marked`` may pass an already materialized T1 marking (the output
    of ``mark_idle_sessions`` for the same events and idle limit).

    The age restart is recursive (each restart moves the session start). It
    only matters inside idle sessions longer than max_age; there, starts are
    found by pointer doubling (see ``_age_starts``) and each event is given
    the latest start not after it. Starts are more than max_age apart and an
    event is at most max_age after its start, so with max_age-wide time
    buckets an event meets at most two candidate starts (an equi-join, no
    pairs within a session).
    """
    import math

    spark = events.sparkSession
    max_age_us, chunk_us = max_age_seconds * MICROS, chunk_seconds * MICROS
    idle = idle_marked if idle_marked is not None else materialize(
        spark, mark_idle_sessions(events, idle_seconds=idle_seconds, **kw), "idle_sessions")
    keys = ["user_id", "idle_idx"]
    idle = idle.withColumnRenamed("session_idx", "idle_idx")
    spans = (idle.groupBy(*keys)
                 .agg((F.max("t") - F.min("t")).alias("span"),
                      F.min(F.struct("t", "event_id")).alias("first")))
    long_sessions = spans.where(F.col("span") > max_age_us)
    longest = long_sessions.agg(F.max("span")).first()[0]
    if longest is None:
        return idle.select("user_id", "event_id", "ts", "t", F.col("idle_idx").alias("session_idx"))
    # At most span / max_age + 1 starts per long idle session.
    levels = max(1, math.ceil(math.log2(longest // max_age_us + 2)))
    long_ev = idle.join(long_sessions.select(*keys), keys).select(*keys, "event_id", "t")
    first_ev = long_sessions.select(*keys, F.col("first.event_id").alias("event_id"))
    starts = _age_starts(long_ev, first_ev, levels, max_age_us, chunk_us)
    starts = (starts.join(long_ev, [*keys, "event_id"])
                    .withColumn("sub_idx", F.row_number().over(Window.partitionBy(*keys).orderBy("t", "event_id")) - 1)
                    .select(*keys, F.col("t").alias("start_t"), F.col("event_id").alias("start_id"), "sub_idx",
                            F.floor(F.col("t") / max_age_us).alias("bucket")))
    cand = (long_ev.withColumn("bucket", F.explode(F.array(F.floor(F.col("t") / max_age_us),
                                                           F.floor(F.col("t") / max_age_us) - 1)))
                   .join(starts, [*keys, "bucket"])
                   .where(F.struct(F.col("start_t"), F.col("start_id")) <= F.struct(F.col("t"), F.col("event_id"))))
    sub = cand.groupBy(*keys, "event_id").agg(F.max_by("sub_idx", F.struct("start_t", "start_id")).alias("sub_idx"))
    n_sub = starts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_sub"))
    per_idle = (spans.select(*keys).join(n_sub, keys, "left")
                     .withColumn("n_sub", F.coalesce("n_sub", F.lit(1)))
                     .withColumn("offset", F.coalesce(F.sum("n_sub").over(
                         Window.partitionBy("user_id").orderBy("idle_idx")
                               .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    ev = (idle.join(sub, [*keys, "event_id"], "left")
              .join(per_idle.select(*keys, "offset"), keys))
    return ev.select("user_id", "event_id", "ts", "t",
                     (F.col("offset") + F.coalesce("sub_idx", F.lit(0)) + 1).cast("long").alias("session_idx"))


def sessions(events: DataFrame, **kw) -> DataFrame:
    """T1 + T2: one row per session."""
    return summarize(mark_sessions(events, **kw))
