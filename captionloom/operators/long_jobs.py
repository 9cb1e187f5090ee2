"""Chunks of jobs of any length: the greedy fold is started at several places of a job and joined where the folds agree."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from captionloom.functions import batches
from captionloom.functions.text import normalize_text
from captionloom.operators.chunks import trimmed_overlap
from captionloom.operators.stored import folder, stored

#: Cues of a segment: a row of what is kept of a job that a range may have begun in the middle of.
SEGMENT = 20_000

STATE = "struct<held:string,begin:double,end:double,last:string>"
#: Rows of one table: a chunk (its number in the run, text, times), a segment (its number, cues), or a run's end (its chunks, open, state).
RUNS = f"range long, lead boolean, job_id string, no int, text string, time_from double, time_to double, cues array<struct<start:double,end:double,text:string>>, open boolean, state {STATE}"
#: The same of a run that is taken up again: a chunk, or the run's end (agreed: the first fold's chunks but `skip` follow).
AGAIN = f"attempt int, range long, no int, text string, time_from double, time_to double, agreed boolean, skip int, state {STATE}"
#: The same as Arrow has them.
STATE_TYPE = pa.struct([("held", pa.string()), ("begin", pa.float64()), ("end", pa.float64()), ("last", pa.string())])
CUES_TYPE = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64()), ("text", pa.string())]))
CHUNK_TYPES = [("no", pa.int32()), ("text", pa.string()), ("time_from", pa.float64()), ("time_to", pa.float64())]
RUN_TYPES = pa.schema([("range", pa.int64()), ("lead", pa.bool_()), ("job_id", pa.string()), *CHUNK_TYPES, ("cues", CUES_TYPE), ("open", pa.bool_()), ("state", STATE_TYPE)])
AGAIN_TYPES = pa.schema([("attempt", pa.int32()), ("range", pa.int64()), *CHUNK_TYPES, ("agreed", pa.bool_()), ("skip", pa.int32()), ("state", STATE_TYPE)])


class Fold:
    """pack() that can be left and taken up again: what is held back, since when and until when, and the text last added."""

    def __init__(self, max_len: int, overlap: bool, compare_first: bool, state: dict | None = None):
        self.max_len, self.overlap, self.compare_first = max_len, overlap, compare_first
        s = state or {"held": "", "begin": 0.0, "end": 0.0, "last": None}
        self.parts, self.begin, self.end, self.last = [s["held"]] if s["held"] else [], s["begin"], s["end"], s["last"]
        self.size = len(s["held"])

    def state(self) -> dict:
        return {"held": " ".join(self.parts), "begin": self.begin, "end": self.end, "last": self.last}

    def rest(self) -> list[tuple[str, float, float]]:
        return [(" ".join(self.parts), self.begin, self.end)] if self.parts else []

    def add(self, start: float, stop: float, raw: str) -> list[tuple[str, float, float]]:
        """The chunks that this cue completes."""
        text = trimmed_overlap(self.last, raw) if self.overlap else raw
        if not text:
            return []
        if self.parts and self.size + 1 + len(text) <= self.max_len:
            self.parts.append(text)
            self.size, self.end, self.last = self.size + 1 + len(text), stop, text
            return []
        opening, out = not self.parts, self.rest()
        self.parts, self.size = [], 0
        if len(text) >= self.max_len:
            self.last = None if opening and not self.compare_first else text
            return [*out, (text, start, stop)]
        self.parts, self.size, self.begin, self.end = [text], len(text), start, stop
        if not opening or self.compare_first:
            self.last = text
        return out

    def joint(self) -> tuple | None:
        """What tells the state where at most one text is held: folds that agree in it at a cue agree from there on."""
        return (" ".join(self.parts), self.begin if self.parts else None, self.end if self.parts else None, self.last) if len(self.parts) <= 1 else None


def _agree(a: Fold, b: Fold) -> bool:
    return (at := a.joint()) is not None and at == b.joint()


def alongside(cues: Iterable[tuple[float, float, str]], mine: Fold, other: Fold) -> tuple[list[tuple[str, float, float]], int]:
    """(mine's chunks, how many the other one has made) over cues until both folds agree."""
    out, n = [], 0
    for c in cues:
        if _agree(mine, other):
            break
        out += mine.add(*c)
        n += len(other.add(*c))
    return out, n


def caught_up(cues: list[dict], options: tuple[int, bool, bool], start: dict) -> tuple[list[dict], int | None, dict | None]:
    """(chunks, skip, state): the fold from `start`, beside one that starts empty, until both agree. Then the empty one's
    chunks but the first `skip` follow; where they never agree, skip is None and all chunks and the end state are given."""
    mine, empty = Fold(*options, start), Fold(*options)
    out, n = alongside(((c["start"], c["end"], c["text"]) for c in cues), mine, empty)
    chunks = [{"text": t, "time_from": a, "time_to": b} for t, a, b in out]
    return (chunks, n, None) if _agree(mine, empty) else (chunks, None, mine.state())


def _batch(rows: list[tuple], types: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.types, strict=True)], schema=types)


def _folded(given: Iterator[pa.RecordBatch], options: tuple[int, bool, bool], segment: int) -> Iterator[pa.RecordBatch]:
    """RUNS of one range, whose cues come in order. A run is a job's cues in the range; the first one (lead) may have begun
    in the range before, so its cues are kept; the last one may go on in the next range, so what it holds is its end's."""
    at, job, lead, fold, n, kept, segments = 0, None, True, None, 0, [], 0

    def chunks(found: list) -> list[tuple]:
        nonlocal n
        n += len(found)
        return [(at, lead, job, n - len(found) + k, *c, None, None, None) for k, c in enumerate(found)]

    def segment_of_cues() -> list[tuple]:
        nonlocal kept, segments
        row = (at, lead, job, segments, None, None, None, kept, None, None)
        kept, segments = [], segments + 1
        return [row]

    def end(opened: bool) -> list[tuple]:
        out = segment_of_cues() if kept else []
        if not opened:
            out += chunks(fold.rest())
        return [*out, (at, lead, job, n, None, None, None, None, opened, fold.state() if opened else None)] if lead or opened else out

    for batch in given:
        out = []
        at = batch.column("range")[0].as_py() if batch.num_rows else at
        for name, run in groupby(zip(*(batch.column(c).to_pylist() for c in ("job_id", "start", "end", "text")), strict=True), itemgetter(0)):
            if fold is None or name != job:
                if fold is not None:
                    out += end(False)
                    lead = False
                job, fold, n = name, Fold(*options), 0
            for _, start, stop, text in run:
                if found := fold.add(start, stop, text):
                    out += chunks(found)
                if lead and at:
                    kept.append({"start": start, "end": stop, "text": text})
                    if len(kept) == segment:
                        out += segment_of_cues()
        if out:
            yield _batch(out, RUN_TYPES)
    if fold is not None:
        yield _batch(end(True), RUN_TYPES)


def _again(given: Iterator[pa.RecordBatch], options: tuple[int, bool, bool], attempt: int) -> Iterator[pa.RecordBatch]:
    """AGAIN of runs (range, cues, open, due: where the run before ended), whose segments come in order: folded from there,
    beside the first fold, until both agree."""
    at, opened, mine, first, n, skip = None, True, None, None, 0, 0

    def chunks(found: list) -> list[tuple]:
        nonlocal n
        n += len(found)
        return [(attempt, at, n - len(found) + k, *c, None, None, None) for k, c in enumerate(found)]

    def end() -> list[tuple]:
        if agreed := _agree(mine, first):
            return [(attempt, at, n, None, None, None, agreed, skip, None)]
        out = [] if opened else chunks(mine.rest())
        return [*out, (attempt, at, n, None, None, None, agreed, None, mine.state() if opened else None)]

    for part in (p for batch in given for p in batches.parts(batch, "cues", batches.CUES)):
        out = []
        for where, goes_on, due, cues in zip(*(part.column(c).to_pylist() for c in ("range", "open", "due")), batches.cues_of(part.column("cues")), strict=True):
            if where != at:
                out += end() if mine else []
                at, opened, mine, first, n, skip = where, goes_on, Fold(*options, due), Fold(*options), 0, 0
            found, theirs = alongside(cues, mine, first)
            out += chunks(found)
            skip += theirs
        if out:
            yield _batch(out, AGAIN_TYPES)
    if mine:
        yield _batch(end(), AGAIN_TYPES)


def pack_long_jobs(cues: DataFrame, max_len: int = 500, overlap: bool = True, compare_first: bool = False, normalized: bool = False, segment: int = SEGMENT, ranges: int | None = None) -> DataFrame:
    """pack_chunks() for jobs of any length: (job_id, chunk_no, text, time_from, time_to) from cues (job_id, cue_no, ...).

    Cues are sorted into ranges of (job_id, cue_no), and a task folds a range as it reads it, as if its first job began with
    it; so cues are moved once, and chunks are written once. Only of a range's first job, which may have begun in the range
    before, are the cues kept too, in segments of `segment` cues. Each such job is folded again from where the range before
    ended, only until that fold and the first agree (mostly at the next flush or the one after): over its first segment, and
    where they don't agree there, over all it has in the range, a job's ranges one after the other. A range in which they
    never agree ends otherwise than it was taken to, so the next one is taken up again, until nothing changes: as many rounds
    as there are such ranges of a job in a row. No task holds more than 20,000 cues or a segment; what ranges hand on is a
    row each. Results are those of the fold from beginning to end. `ranges`: their number, else the session's partitions.
    """
    if max_len < 1 or segment < 1:
        raise ValueError("max_len and segment must be 1 or more")
    options, spark = (max_len, overlap, compare_first), cues.sparkSession
    text = F.col("text") if normalized else normalize_text(F.col("text"))
    rows = cues.select(F.col("job_id").cast("string").alias("job_id"), "cue_no", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), text.alias("text")).where("text <> ''")
    cut = rows.repartitionByRange(*([ranges] if ranges else []), "job_id", "cue_no").sortWithinPartitions("job_id", "cue_no", "start", "end", "text")
    given = cut.select(F.spark_partition_id().cast("long").alias("range"), "job_id", "start", "end", "text")
    runs = stored(given.mapInArrow(lambda b: _folded(b, options, segment), RUNS))
    segments = runs.where("cues IS NOT NULL").select("range", "no", "cues")
    along = Window.partitionBy("job_id").orderBy("range")  # two rows a range at most
    ends = runs.where("open IS NOT NULL").select("range", "lead", "job_id", "open", F.col("no").alias("own"), F.col("state").alias("own_state"))
    now = stored(ends.select("*", F.lit(None).cast(STATE).alias("start"), F.lit(None).cast("int").alias("attempt"), F.lit(0).alias("more"), F.lit(0).alias("skip"), F.col("own_state").alias("state")))
    at, attempts = folder(spark), []

    def taken_up(held: DataFrame) -> DataFrame:
        attempt = len(attempts)
        attempts.append(f"{at}/{attempt}")
        again = stored(held.select("range", "cues", "open", "due").mapInArrow(lambda b: _again(b, options, attempt), AGAIN), attempts[-1])
        return again.where("agreed IS NOT NULL").select("range", F.lit(True).alias("lead"), "attempt", F.col("no").alias("more"), "agreed", "skip", "state")

    while True:
        due = now.select("range", "job_id", "open", "start", F.lag("state").over(along).alias("due")).where("due IS NOT NULL AND NOT (due <=> start)")
        due = stored(due.select("range", "open", "due", (F.row_number().over(along) == 1).alias("sure")))  # a job's first: all before it is settled
        if due.isEmpty():
            break
        done = taken_up(segments.where("no = 0").join(F.broadcast(due), "range")).where("agreed")
        left = due.where("sure").join(done.select("range"), "range", "left_anti")
        if not left.isEmpty():
            done = done.unionByName(taken_up(segments.join(F.broadcast(left), "range").repartition("range").sortWithinPartitions("range", "no")))
        done = done.join(due.select("range", F.col("due").alias("start")), "range")
        new = ends.join(done, ["range", "lead"]).select(*ends.columns, "start", "attempt", "more", "skip", F.when(F.col("agreed"), F.col("own_state")).otherwise(F.col("state")).alias("state"))
        now = stored(now.join(done, ["range", "lead"], "left_anti").unionByName(new))
    n = F.col("more") + F.coalesce(F.col("own") - F.col("skip"), F.lit(0))
    ahead = F.coalesce(F.sum(n).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marks = stored(now.select("range", "lead", "job_id", "open", "attempt", "more", "skip", "state", ahead.alias("ahead"), n.alias("n"), F.lead("range").over(along).isNull().alias("last")))
    piece = ["text", "time_from", "time_to"]
    leads = F.broadcast(marks.where("lead").select("range", "lead", "skip", (F.col("ahead") + F.col("more") - F.col("skip")).alias("before")))
    first = runs.where("text IS NOT NULL").join(leads, ["range", "lead"], "left").where("NOT lead OR no >= skip").select("job_id", (F.coalesce("before", F.lit(0)) + F.col("no")).cast("int").alias("chunk_no"), *piece)
    rest = marks.where("open AND last AND state.held <> ''").select("job_id", (F.col("ahead") + F.col("n")).cast("int").alias("chunk_no"), F.col("state.held").alias("text"), F.col("state.begin").alias("time_from"), F.col("state.end").alias("time_to"))
    out = first.unionByName(rest)
    if attempts:
        again = spark.read.schema(AGAIN).parquet(*attempts).where("text IS NOT NULL")
        again = again.join(F.broadcast(marks.where("lead").select("range", "attempt", "job_id", "ahead")), ["range", "attempt"])
        out = out.unionByName(again.select("job_id", (F.col("ahead") + F.col("no")).cast("int").alias("chunk_no"), *piece))
    return out
