"""Jobs as state: live status, feeds in event-time order, and rates whose windows close.

State lives in RocksDB; timers on the watermark bound it. Sinks keep a folder a batch, so that a replayed batch overwrites.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from captionloom.operators.jobs import rate

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TERMINAL = ("done", "error")


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB, as arbitrary state needs; a stream has its settings from
    its start, so the session's are put back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def _batches_to(df: DataFrame, out: str, checkpoint: str, mode: str, trigger: dict | None) -> StreamingQuery:
    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with rocksdb(df.sparkSession):
        return df.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _micros(event: str = "ts") -> Column:
    return F.unix_micros(F.col(event).cast("timestamp"))


class Status(StatefulProcessor):
    """A job's state, detail and error, each with the time and number of the event that set it; see job_status_stream()."""

    FIELDS = ("state", "detail", "error")
    SCHEMA = "known boolean, timer long, " + ", ".join(f"{f} string, {f}_at long, {f}_id long" for f in FIELDS)

    def __init__(self, keep_ms: int, only_known: bool):
        self.keep_ms, self.only_known = keep_ms, only_known

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("status", self.SCHEMA)

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803  Spark's names
        self.held.update((True, None, *[None] * 9))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = list(self.held.get() or (False, None, *[None] * 9))
        before, events = list(held), list(rows)
        held[0] |= not self.only_known or any(e["type"] == "job" for e in events)
        if not held[0]:
            return
        for e in events:
            if e["type"] != "state":
                continue
            for k, name in enumerate(self.FIELDS):
                value, at = e[name], 2 + 3 * k
                if value is not None and (held[at] is None or (e["at"], e["event_id"]) > (held[at + 1], held[at + 2])):
                    held[at : at + 3] = value, e["at"], e["event_id"]
        if held == before:
            return
        due = held[3] // 1000 + self.keep_ms if held[2] in TERMINAL else None
        if due != held[1]:
            if held[1] is not None:
                self.handle.deleteTimer(held[1])
            if due is not None:
                self.handle.registerTimer(due)
            held[1] = due
        self.held.update(tuple(held))
        if held[2:] != before[2:]:
            yield Row(job_id=key[0], state=held[2], detail=held[5], error=held[8])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def job_status_stream(events: DataFrame, out: str, checkpoint: str, jobs: DataFrame | None = None, late: str = "10 minutes", keep_seconds: int = 3600, trigger: dict | None = None) -> StreamingQuery:
    """Live (job_id, state, detail, error): what changed in a trigger goes to out, a folder a batch; live_status() reads it.

    The latest event counts by (ts, event_id), however events arrive. jobs (job_id), if given, are the jobs known at the
    start, kept as state; a row of type 'job' in the stream makes another one known; events of others are ignored and leave
    nothing behind. Without jobs every job is known. A job that stays done or failed for keep_seconds of event time is
    evicted; what comes after that for it is an event of an unknown job (where all are known, of a new one). Events older
    than the watermark, and those without time or number, are dropped.
    """
    data = F.from_json("data", "struct<state:string,detail:string,error:string>")
    state = F.when(F.col("d.error").isNotNull(), "error").otherwise(F.col("d.state"))
    wanted = events.where("job_id IS NOT NULL AND type IN ('state', 'job')").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    typed = wanted.select("job_id", "ts", "event_id", "type", _micros().alias("at"), data.alias("d")).where("type = 'job' OR (at IS NOT NULL AND event_id IS NOT NULL)").select("job_id", "ts", "event_id", "type", "at", state.alias("state"), "d.detail", "d.error")
    known = jobs.select("job_id").distinct().groupBy("job_id") if jobs is not None else None
    told = typed.groupBy("job_id").transformWithState(Status(1000 * keep_seconds, jobs is not None), "job_id string, state string, detail string, error string", "update", "eventTime", initialState=known)
    return _batches_to(told, out, checkpoint, "update", trigger)


def live_status(spark: SparkSession, out: str) -> DataFrame:
    """The last told status of every job."""
    rows = spark.read.parquet(out)
    return rows.groupBy("job_id").agg(F.max_by(F.struct("state", "detail", "error"), "batch").alias("s")).select("job_id", "s.*")


class Feed(StatefulProcessor):
    """Events of a job that wait for the watermark, and how many went out; see job_events_stream()."""

    OUT = Row("job_id", "pos", "seq", "type", "data", "at")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sent = handle.getValueState("sent", "n long, snapshot string, timer long")
        self.waiting = handle.getListState("waiting", "at long, seq long, type string, data string")

    def _wake(self, sent: tuple, due: int | None, known: bool = False) -> None:
        """sent as state, with a timer at due if none comes before it; nothing is written where the state is known to be that."""
        if due is not None and (sent[2] is None or due < sent[2]):
            if sent[2] is not None:
                self.handle.deleteTimer(sent[2])
            self.handle.registerTimer(due)
            sent, known = (*sent[:2], due), False
        if not known:
            self.sent.update(sent)

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        self._wake((0, initialState["snapshot"], None), 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        more = [(r["at"], r["seq"], r["type"], r["data"]) for r in rows]
        self.waiting.appendList(more)
        sent = self.sent.get()
        self._wake(sent or (0, None, None), min(m[0] for m in more) // 1000 + 1, sent is not None)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        n, snapshot, _ = self.sent.get()
        passed = 1000 * timerValues.getCurrentWatermarkInMs()
        held = sorted(self.waiting.get(), key=lambda x: x[:2])
        ready = [x for x in held if x[0] <= passed]
        out = [self.OUT(key[0], 0, 0, "state", snapshot, None)] if snapshot is not None else []
        out += [self.OUT(key[0], n + k, seq, kind, data, at) for k, (at, seq, kind, data) in enumerate(ready, 1)]
        self.waiting.clear() if len(ready) == len(held) else self.waiting.put(held[len(ready) :])
        self._wake((n + len(ready), None, None), held[len(ready)][0] // 1000 + 1 if len(ready) < len(held) else None)
        yield from out

    def close(self) -> None:
        pass


def job_events_stream(events: DataFrame, snapshot: DataFrame, out: str, checkpoint: str, late: str = "10 minutes", trigger: dict | None = None) -> StreamingQuery:
    """Every job's feed (job_id, pos, seq, type, data, ts) to out, a folder a batch: its status once, then its events.

    snapshot is the status of jobs at the start, as job_status() gives it; it goes out first (pos 0, seq 0, no time), also
    for jobs that have no event. Events wait in state until the watermark has passed them and go out by time and number,
    numbered on by pos, so that a job's feed is in order across triggers however its events arrive; those older than the
    watermark are dropped. Events without time, number or
    job are none. State holds what waits, and a counter a job.
    """
    start = snapshot.select("job_id", F.to_json(F.struct("state", "detail", "error")).alias("snapshot"))
    timed = events.where("job_id IS NOT NULL AND ts IS NOT NULL AND event_id IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = timed.select("job_id", "ts", _micros().alias("at"), F.col("event_id").cast("long").alias("seq"), "type", "data")
    fed = rows.groupBy("job_id").transformWithState(Feed(), "job_id string, pos long, seq long, type string, data string, at long", "append", "eventTime", initialState=start.groupBy("job_id"))
    return _batches_to(fed.select("job_id", "pos", "seq", "type", "data", F.timestamp_micros("at").alias("ts")), out, checkpoint, "append", trigger)


def throughput_stream(events: DataFrame, out: str, checkpoint: str, seconds: int, failed: Column, late: str = "10 minutes", key: str = "event_id", trigger: dict | None = None) -> StreamingQuery:
    """rate() in append mode: a window (start, processed, failed, per_second) goes to out once, when the watermark closes it.

    An event that comes again within the watermark's delay counts once. Events older than the watermark (late
    rows are told by that of the trigger before) change nothing;
    counted() tells how many arrived, how many were taken, and how many were late.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).observe("arrived", F.count(F.lit(1)).alias("n")).withWatermark("ts", late)
    once = timed.dropDuplicatesWithinWatermark([key]).observe("taken", F.count(F.lit(1)).alias("n"))
    return _batches_to(rate(once, seconds, failed), out, checkpoint, "append", trigger)


def counted(query: StreamingQuery) -> dict[str, int]:
    """Events of a throughput_stream() so far: arrived, taken (each event once, in time), late, doubled."""
    arrived = taken = late = 0
    for p in query.recentProgress:
        seen = p["observedMetrics"]
        arrived, taken = arrived + seen["arrived"]["n"], taken + seen["taken"]["n"]
        late += sum(s["numRowsDroppedByWatermark"] for s in p["stateOperators"] if s["operatorName"] == "dedupeWithinWatermark")
    return {"arrived": arrived, "taken": taken, "late": late, "doubled": arrived - taken - late}
