"""Streams that keep jobs as state: against the batch forms, under disorder, replays, late events and many triggers."""

import datetime
import json
import random

from pyspark.sql import functions as F

from captionloom.operators import jobs
from captionloom.streaming import job_streams

SCHEMA = "event_id long, ts timestamp, job_id string, type string, data string"
START = datetime.datetime(2025, 1, 1)


def event(number, minute, job, kind, **data):
    return (number, START + datetime.timedelta(minutes=minute), job, kind, json.dumps(data))


def stream(spark, folder, *triggers):
    """One file a trigger, read in this order."""
    for rows in triggers:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def some_events(n, jobs_):
    r = random.Random(4)
    out = []
    for k in range(n):
        kind = r.choice(["state", "state", "progress", "log"])
        data = r.choice([{"state": "running"}, {"state": "done", "detail": f"d{k}"}, {"error": f"e{k}"}, {"detail": f"x{k}"}, {"state": None}]) if kind == "state" else {"n": k}
        out.append(event(k, r.randrange(600), f"j{r.randrange(jobs_)}", kind, **data))
    return out


def test_status_equals_batch(spark, tmp_path):
    rows = some_events(300, 9)
    random.Random(1).shuffle(rows)
    rows.append((900, None, "j0", "state", '{"state":"lost"}'))
    s = stream(spark, tmp_path / "in", rows[:100], rows[100:150], rows[150:] + [event(901, 5, None, "state", state="done"), event(902, 5, "j1", "state") [:4] + ("{broken",)])
    job_streams.job_status_stream(s, str(tmp_path / "out"), str(tmp_path / "log"), late="1 day", keep_seconds=10**6).awaitTermination()
    batch = jobs.job_status(spark.createDataFrame([e for e in rows if e[1]], SCHEMA))
    told = lambda df: sorted(map(repr, df.select("job_id", "state", "detail", "error").collect()))
    assert told(job_streams.live_status(spark, str(tmp_path / "out"))) == told(batch)


def test_unknown_jobs_are_ignored_until_they_are_made_known(spark, tmp_path):
    known = spark.createDataFrame([("a",), ("b",), ("a",)], "job_id string")
    s = stream(spark, tmp_path / "in", [event(1, 0, "a", "state", state="running"), event(2, 0, "c", "state", state="running")], [event(3, 1, "c", "job"), event(4, 2, "d", "state", state="done")], [event(5, 3, "c", "state", state="done"), event(6, 1, "a", "state", state="late but in time")])
    q = job_streams.job_status_stream(s, str(tmp_path / "out"), str(tmp_path / "log"), known)
    q.awaitTermination()
    assert {r.job_id: r.state for r in job_streams.live_status(spark, str(tmp_path / "out")).collect()} == {"a": "late but in time", "c": "done"}
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4  # a, b, c, and c's timer


def test_state_stays_bounded(spark, tmp_path):
    """A hundred jobs an hour for eight hours: those done an hour ago are gone."""
    hours = []
    for h in range(8):
        hours.append([event(1000 * h + k, 60 * h + k // 4, f"h{h}-{k}", "state", state="running") for k in range(100)] + [event(1000 * h + 500 + k, 60 * h + 30 + k // 5, f"h{h}-{k}", "state", state="done") for k in range(100)])
    q = job_streams.job_status_stream(stream(spark, tmp_path / "in", *hours), str(tmp_path / "out"), str(tmp_path / "log"), late="5 minutes", keep_seconds=1800)
    q.awaitTermination()
    held = [p["stateOperators"][0]["customMetrics"].get("rocksdbNumInternalColFamiliesKeys", 0) or p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress]
    assert max(held) <= 900 and held[-1] <= 450
    out = job_streams.live_status(spark, str(tmp_path / "out"))
    assert out.count() == 800 and out.where("state = 'done'").count() == 800


def test_feeds_are_in_order_across_triggers(spark, tmp_path):
    rows = sorted(some_events(240, 5), key=lambda e: e[1])
    history = spark.createDataFrame([*rows, event(9999, 1, "quiet", "state", state="done")], SCHEMA)
    arriving = sorted(rows, key=lambda e: (e[1] + datetime.timedelta(minutes=(e[0] * 37) % 50)))
    tick = event(10**6, 3000, "tick", "log")
    s = stream(spark, tmp_path / "in", arriving[:80], arriving[80:160], arriving[160:], [tick])
    job_streams.job_events_stream(s, jobs.job_status(history), str(tmp_path / "out"), str(tmp_path / "log"), late="1 hour").awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    want = jobs.job_events(history).where("seq <> 9999").collect()
    for job in {r.job_id for r in want}:
        mine = sorted((r for r in got if r.job_id == job), key=lambda r: r.pos)
        assert [r.pos for r in mine] == list(range(1 - any(r.seq == 0 for r in mine), len(mine) + 1 - any(r.seq == 0 for r in mine)))
        assert [(r.seq, r.type, r.data, r.ts) for r in mine] == [(r.seq, r.type, r.data, r.ts) for r in want if r.job_id == job]
        assert [r.batch for r in mine] == sorted(r.batch for r in mine)
    assert len({r.batch for r in got}) >= 3 and "quiet" in {r.job_id for r in got}


def test_windows_close_once_without_late_and_doubled_events(spark, tmp_path):
    rows = [event(k, k, "a", "log") for k in range(240)]
    late = [event(1000, 3, "a", "log"), event(1001, 20, "a", "log")]
    s = stream(spark, tmp_path / "in", rows[:120], rows[100:200], rows[190:] + late, [event(5000, 5000, "a", "log")])
    q = job_streams.throughput_stream(s, str(tmp_path / "out"), str(tmp_path / "log"), 3600, F.col("event_id") % 2 == 1, "30 minutes")
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.start, r.processed, r.failed) for r in got) == [(START + datetime.timedelta(hours=h), 60, 30) for h in range(4)]
    assert job_streams.counted(q) == {"arrived": 240 + 20 + 10 + 2 + 1, "taken": 241, "late": 2, "doubled": 30}


def test_parts_of_equal_files(spark, tmp_path):
    """Each part of arriving events has the same number of files, written by all cores, and every event lies in its part."""
    from captionloom.plans import stream_queries

    rows = [event(k, k, f"j{k % 7}", "log") for k in range(300)]
    events = spark.createDataFrame(rows, SCHEMA).coalesce(2)
    s = stream_queries._arriving(spark, events, str(tmp_path / "in"), F.unix_seconds("ts"))
    files = sorted((p.stat().st_mtime_ns, str(p)) for p in (tmp_path / "in").glob("*.parquet"))
    assert s.isStreaming and len(files) == 3 * 4 + 1
    for k in range(3):
        held = spark.read.parquet(*[p for _, p in files[4 * k : 4 * k + 4]])
        assert held.count() == held.where(F.floor(F.col("event_id") * 3 / 299) == k).count() + (k == 2)


class Kept:
    """A state and a handle that count what is written."""

    def __init__(self, value=None):
        self.value, self.writes, self.items, self.timers = value, 0, [], []

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.writes = value, self.writes + 1

    def appendList(self, items):  # noqa: N802
        self.items += items

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)


def test_feed_takes_rows():
    """Events come as rows, not as a pandas frame a job; a state that stays as it is is not written again."""
    feed = job_streams.Feed()
    feed.sent, feed.waiting, feed.handle = Kept(), Kept(), Kept()
    row = job_streams.Row("at", "seq", "type", "data")
    assert not list(feed.handleInputRows(("j",), iter([row(5000, 1, "log", "{}")]), None))
    assert not list(feed.handleInputRows(("j",), iter([row(9000, 2, "log", None), row(7000, 3, "log", "{}")]), None))
    assert feed.sent.writes == 1 and feed.handle.timers == [6] and feed.waiting.items == [(5000, 1, "log", "{}"), (9000, 2, "log", None), (7000, 3, "log", "{}")]


def test_status_takes_rows():
    status = job_streams.Status(1000, False)
    status.held, status.handle = Kept(), Kept()
    row = job_streams.Row("type", "at", "event_id", "state", "detail", "error")
    rows = [row("state", 5, 1, "running", None, None), row("log", 9, 9, "lost", None, None), row("state", 4, 2, "queued", "d", None)]
    assert [tuple(r) for r in status.handleInputRows(("j",), iter(rows), None)] == [("j", "running", "d", None)]
