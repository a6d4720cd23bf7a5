"""The session state machine, in batch and as a stream, and streaming forms of statistics and merges."""
from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators import delivery
from .ledger import Ledger

# Which states may follow each state.
TRANSITIONS = {
    "idle": {"awaiting_contact"}, "awaiting_contact": {"processing", "idle"}, "processing": {"awaiting_confirm", "idle"},
    "awaiting_confirm": {"sending", "editing", "idle"}, "editing": {"awaiting_confirm", "idle"}, "sending": {"idle"},
}
TIMEOUT = pd.Timedelta(minutes=30)
TIMEOUT_US = 30 * 60 * 1_000_000
KEPT = pd.Timedelta(hours=1)  # how long a finished task is remembered
FINAL = ("completed", "failed")
OUTPUT = "event_id long, user_id long, accepted boolean, state string"


def advance(state: str, updated, ts, target: str, timeout=TIMEOUT) -> tuple[str, object, bool]:
    """One event: a session idle for more than 30 minutes starts anew; then the transition, if it is allowed."""
    if state != "idle" and updated is not None and ts - updated > timeout:
        state = "idle"
    if target in TRANSITIONS[state]:
        return target, ts, True
    return state, updated, False


def fold(events: DataFrame) -> DataFrame:
    """All events with acceptance and state. Users are dealt out and sorted; a task keeps one user's state at a time."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, state, updated = None, "idle", None
        for pdf in parts:
            out = []
            for r in pdf.itertuples(index=False):
                if r.user_id != user:
                    user, state, updated = r.user_id, "idle", None
                state, updated, ok = advance(state, updated, r.ts, r.target_state)
                out.append((r.event_id, r.user_id, ok, state))
            yield pd.DataFrame(out, columns=["event_id", "user_id", "accepted", "state"])

    own = events.select("event_id", "user_id", "ts", "target_state").repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id")
    return own.mapInPandas(run, OUTPUT)


def fold_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The same machine over a stream: state per user, events of a batch in order of time.

    A session's state is dropped once the watermark has passed its time-out.
    """

    def run(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        name, updated = state.get if state.exists else ("idle", None)
        updated = None if updated is None or pd.isna(updated) else pd.Timestamp(updated, unit="us")
        pdf = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        out = []
        for r in pdf.itertuples(index=False):
            name, updated, ok = advance(name, updated, r.ts, r.target_state)
            out.append((r.event_id, r.user_id, ok, name))
        if name == "idle":  # as good as no session
            if state.exists:
                state.remove()
        else:
            state.update((name, updated.value // 1000))
            state.setTimeoutTimestamp(max(int((updated + TIMEOUT).timestamp() * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["event_id", "user_id", "accepted", "state"])

    return events.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(run, OUTPUT, "name string, updated long", "append", "EventTimeTimeout")


def activity(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    w = F.session_window("ts", gap)
    out = events.groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def first_events(events: DataFrame) -> DataFrame:
    """The first event of each user creates its session; repeats change nothing."""
    return events.groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("f")).select("user_id", F.col("f.event_id").alias("event_id"))


def distinct_events(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Stream form: a re-delivered event id is dropped within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def source(spark: SparkSession, sf_dir: str, table: str, schema) -> DataFrame:
    """A table's files as a stream."""
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}.parquet*")


@contextlib.contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that start in here keep their state in RocksDB, outside the JVM's heap."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def run_to_table(stream: DataFrame, folder: str, timers: bool = False) -> DataFrame:
    """Runs an append stream over all there is and returns what it wrote; restarts go on from its checkpoint."""
    spark = stream.sparkSession
    with _state_store(spark) if timers else contextlib.nullcontext():
        q = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/rows").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def run_batches(stream: DataFrame, put: Callable[[DataFrame, int], None], folder: str, mode: str = "append") -> None:
    """Hands all there is to `put`, batch by batch; restarts go on from the folder's checkpoint."""
    stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def merge_counts(stream: DataFrame, key: str, folder: str) -> DataFrame:
    """Counts per key, kept as one small table per batch, folded from time to time, and added up when read.

    A repeated batch counts once, so restarts count nothing twice; an empty stream
    or a restart without new rows leaves the counts as they are.
    """
    schema = StructType([StructField(key, stream.schema[key].dataType), StructField("n", LongType())])
    total = lambda df: df.groupBy(key).agg(F.sum("n").alias("n"))
    ledger = Ledger(f"{folder}/counts", schema, total)
    run_batches(stream, lambda batch, number: ledger.put(batch.groupBy(key).agg(F.count("*").alias("n")), number), folder)
    return total(ledger.read(stream.sparkSession))


def with_late_rows(stream: DataFrame, folder: str, ts: str = "ts", delay: str = "10 minutes") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs a source over all there is: (rows on time, late rows, one row of counts on_time, late and the mark).

    The mark is the latest time of the batches before, less the delay, as for
    Spark's own watermark; a row before it, or without a time, is late. It goes to
    a table of its own and is counted, so that no row vanishes unseen. Restarts
    go on from the mark that was reached; a repeated batch counts once.
    """
    spark = stream.sparkSession
    counts = lambda df: df.agg(F.max("mark").alias("mark"), F.coalesce(F.sum("on_time"), F.lit(0)).alias("on_time"), F.coalesce(F.sum("late"), F.lit(0)).alias("late"))
    on_time, late = Ledger(f"{folder}/on-time", stream.schema), Ledger(f"{folder}/late", stream.schema)
    marks = Ledger(f"{folder}/marks", StructType.fromDDL("mark timestamp, on_time long, late long"), counts)

    def put(batch: DataFrame, number: int) -> None:
        if marks.holds(batch.sparkSession, number):
            return
        mark = marks.read(batch.sparkSession, before=number).agg(F.max("mark")).first()[0]
        ok = F.col(ts).isNotNull() if mark is None else F.coalesce(F.col(ts) >= F.lit(mark), F.lit(False))
        batch = batch.persist()
        try:
            on_time.put(batch.filter(ok), number)
            late.put(batch.filter(~ok), number)
            marks.put(batch.agg((F.max(ts) - F.expr(f"INTERVAL {delay}")).alias("mark"), F.count_if(ok).alias("on_time"), F.count_if(~ok).alias("late")), number)
        finally:
            batch.unpersist()

    run_batches(stream, put, folder)
    return on_time.read(spark), late.read(spark), counts(marks.read(spark))


def progress_stream(updates: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A task's changes of progress as they come, up to its first final status (task_id, seq, progress, status).

    As delivery.progress_feed: a row comes out if its progress differs from the
    row before, or if it ends the task; null differs from any number. Updates of a
    batch go in order of seq; a finished task's later updates are dropped, and
    its state too once the watermark has passed an hour beyond.
    """
    schema = "task_id long, seq long, progress long, status string"

    def run(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        any_row, last, ended = state.get if state.exists else (False, None, False)
        pdf = pd.concat(list(parts)).sort_values("seq")
        out = []
        for task, seq, progress, status in zip(pdf.task_id, pdf.seq, pdf.progress, pdf.status, strict=True):
            if ended:
                break
            now = None if pd.isna(progress) else int(progress)
            ended = status in FINAL
            if ended or not any_row or now != last:
                out.append((task, seq, now, status))
            any_row, last = True, now
        state.update((any_row, last, ended))
        state.setTimeoutTimestamp(max(int((pdf.ts.max() + KEPT).timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["task_id", "seq", "progress", "status"]).astype({"progress": "Int64"})

    own = updates.select(F.col("task_id").cast("long").alias("task_id"), F.col("seq").cast("long").alias("seq"), delivery.progress(F.col("progress").cast("long")).alias("progress"), "status", "ts")
    return own.withWatermark("ts", late).groupBy("task_id").applyInPandasWithState(run, schema, "some boolean, progress long, ended boolean", "update", "EventTimeTimeout")


def push_progress(updates: DataFrame, folder: str) -> DataFrame:
    """Runs progress_stream into a sink that takes each batch's changes once, whatever is repeated; returns all so far."""
    changes = progress_stream(updates)
    ledger = Ledger(f"{folder}/changes", changes.schema)
    run_batches(changes, ledger.put, folder, "update")
    return ledger.read(updates.sparkSession)


#: A session's payload, what a reset makes of it, and its types.
CLEARED = {"image_media_type": "image/jpeg", "selected_contact_id": None, "ai_result": None, "edit_field": None}
RESET = {"image_media_type": "string", "selected_contact_id": "long", "ai_result": "string", "edit_field": "string"}


NAMES = tuple(TRANSITIONS)
NEVER = np.iinfo(np.int64).min  # of a session without a time


def _packed(sessions: dict) -> tuple[bytes, bytes, bytes]:
    """Open sessions (user: (state, time)) as state of a group."""
    names, times = zip(*sessions.values(), strict=True)
    return np.array(list(sessions), np.int64).tobytes(), bytes(map(NAMES.index, names)), np.array(times, np.int64).tobytes()


def _unpacked(users: bytes, names: bytes, times: bytes) -> dict:
    rows = zip(np.frombuffer(users, np.int64).tolist(), names, np.frombuffer(times, np.int64).tolist(), strict=True)
    return {user: (NAMES[name], updated) for user, name, updated in rows}


def expiries(events: DataFrame, late: str = "10 minutes", groups: int = 1024) -> DataFrame:
    """A reset record for each session that nothing moved for more than 30 minutes, once the watermark has passed that time.

    It is the same whether the user's next event or the time-out ends the session.
    Users are dealt into `groups`, so that a batch costs calls for groups, not for
    users; a group's state is its open sessions, its time-out the first of theirs.
    Times are in microseconds. An event without a time starts no time-out.
    """

    def run(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        sessions = _unpacked(*state.get) if state.exists else {}
        out, mark = [], state.getCurrentWatermarkMs()
        parts = [] if state.hasTimedOut else list(parts)
        if parts:
            pdf = pd.concat(parts)
            order = np.lexsort((pdf["event_id"].to_numpy(), pdf["us"].to_numpy()))
            for user, ts, target in zip(*(pdf[c].to_numpy()[order].tolist() for c in ("user", "us", "target_state")), strict=True):
                before, since = sessions.get(user, ("idle", None))
                since = None if since == NEVER else since
                if before != "idle" and since is not None and ts - since > TIMEOUT_US:
                    out.append((user, before, since + TIMEOUT_US))
                name, updated, _ = advance(before, since, ts, target, TIMEOUT_US)
                if name == "idle":
                    sessions.pop(user, None)
                else:
                    sessions[user] = (name, int(updated) if updated is not None and updated == updated else NEVER)
        due = lambda updated: (updated + TIMEOUT_US) // 1000
        for user in [u for u, (_, updated) in sessions.items() if updated != NEVER and due(updated) < mark]:
            name, updated = sessions.pop(user)
            out.append((user, name, updated + TIMEOUT_US))
        if sessions:
            state.update(_packed(sessions))
            timed = [updated for _, updated in sessions.values() if updated != NEVER]
            if timed:
                state.setTimeoutTimestamp(due(min(timed)))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["user", "was", "us"]).assign(known=key[0] >= 0)

    user = F.col("user_id").cast("long")
    group = F.when(user.isNull(), -1).otherwise(F.pmod(F.xxhash64(user), F.lit(groups))).cast("long")  # rows without a user: a group of their own
    own = events.select(group.alias("group"), F.coalesce(user, F.lit(0)).alias("user"), "event_id", "ts", F.unix_micros("ts").alias("us"), "target_state")
    kept = "users binary, names binary, times binary"
    out = own.withWatermark("ts", late).groupBy("group").applyInPandasWithState(run, "user long, was string, us long, known boolean", kept, "append", "EventTimeTimeout")
    cleared = [F.lit(v).cast(RESET[c]).alias(c) for c, v in CLEARED.items()]
    return out.select(F.when(F.col("known"), F.col("user")).alias("user_id"), "was", F.lit("idle").alias("state"), *cleared, F.timestamp_micros("us").alias("reset_at"))


def expire(sessions: DataFrame, as_of: Column) -> DataFrame:
    """The sweep in batch: sessions (user_id, state, updated_at and payload) that are idle too long are fully reset."""
    old = F.coalesce((F.col("state") != "idle") & (as_of - F.col("updated_at") > F.expr("INTERVAL 30 MINUTES")), F.lit(False))
    cleared = {c: F.when(old, F.lit(v)).otherwise(F.col(c)) for c, v in CLEARED.items() if c in sessions.columns}
    return sessions.withColumns({**cleared, "state": F.when(old, "idle").otherwise(F.col("state")), "updated_at": F.when(old, as_of).otherwise(F.col("updated_at")), "expired": old})
