"""Cues to bounded text chunks, and chunks to messages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captionloom.functions import batches
from captionloom.functions.ids import chunk_id, coerce_source_id
from captionloom.functions.schemas import CHUNK
from captionloom.functions.text import normalize_text


def drop_adjacent_duplicates(lines: DataFrame, keys: list[str], order: str, text: str = "text") -> DataFrame:
    """Rows whose text differs from the row before in the same group."""
    before = F.lag(text).over(Window.partitionBy(*keys).orderBy(order))
    held = lines.select(F.struct("*").alias("row"), before.alias("before"))
    return held.where(F.col("before").isNull() | (F.col("before") != F.col("row")[text])).select("row.*")


def trimmed_overlap(prev: str | None, cur: str, least: int = 3, most: int = 30) -> str:
    """cur without the longest run of opening tokens that prev ends with: `most` down to `least` tokens, else two."""
    if not prev:
        return cur
    a, b = prev.split(), cur.split()
    for n in [*range(min(len(a), len(b), most), least - 1, -1), *([2] if least > 2 and min(len(a), len(b)) >= 2 else [])]:
        if n > 0 and a[-n:] == b[:n]:
            return " ".join(b[n:])
    return cur


def pack(cues: list[tuple[float, float, str]], max_len: int, overlap: bool = True, compare_first: bool = False) -> Iterator[tuple[str, float, float]]:
    """Chunks (text, from, to) of one job's normalized cues in order: one greedy pass with a running length.

    A text of max_len or more is a chunk of its own and never split. Each cue loses what it repeats of the last cue
    added. By default the cue after one that opened an empty buffer is compared with what was added before that one
    (compare_first=True compares with the opener): results then match those recorded for existing runs.
    """
    held: list[str] = []
    size, begin, end = 0, 0.0, 0.0
    last: str | None = None
    for start, stop, raw in cues:
        text = trimmed_overlap(last, raw) if overlap else raw
        if not text:
            continue
        if held and size + 1 + len(text) <= max_len:
            held.append(text)
            size, end, last = size + 1 + len(text), stop, text
            continue
        opening = not held
        if held:
            yield " ".join(held), begin, end
            held = []
        if len(text) >= max_len:
            yield text, start, stop
            last = None if opening and not compare_first else text
            continue
        held, size, begin, end = [text], len(text), start, stop
        if not opening or compare_first:
            last = text
    if held:
        yield " ".join(held), begin, end


def pack_chunks(cues: DataFrame, max_len: int = 500, overlap: bool = True, compare_first: bool = False, normalized: bool = False) -> DataFrame:
    """(job_id, chunk_no, text, time_from, time_to) from cues (job_id, cue_no, start, end, text).

    Cleaning runs in the JVM; the fold is sequential in a job, so jobs are the unit of parallel work: cues meet by job
    once, as one sorted array in a row, and Arrow batches of such rows are folded, some 20,000 cues at a time.
    """
    if max_len < 1:
        raise ValueError("max_len must be 1 or more")
    text = F.col("text") if normalized else normalize_text(F.col("text"))
    rows = cues.select("job_id", F.struct("cue_no", "start", "end", text.alias("text")).alias("cue"))
    jobs = rows.groupBy("job_id").agg(F.array_sort(F.collect_list("cue")).alias("cues"))
    return pack_job_arrays(jobs, max_len, overlap, compare_first)


CHUNK_TYPES = {"job_id": pa.string(), "chunk_no": pa.int32(), "text": pa.string(), "time_from": pa.float64(), "time_to": pa.float64()}


def pack_job_arrays(jobs: DataFrame, max_len: int = 500, overlap: bool = True, compare_first: bool = False) -> DataFrame:
    """pack_chunks() for jobs whose cues are an array in their row already (as parsers give them): no shuffle at all."""

    def run(held: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in held for p in batches.parts(batch, "cues", batches.CUES)):
            out = []
            for job, cues in zip(part.column("job_id").to_pylist(), batches.cues_of(part.column("cues")), strict=True):
                out += [(job, k, *chunk) for k, chunk in enumerate(pack([c for c in cues if c[2]], max_len, overlap, compare_first))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), CHUNK_TYPES.values(), strict=True)], list(CHUNK_TYPES))

    return jobs.select(F.col("job_id").cast("string").alias("job_id"), "cues").mapInArrow(run, CHUNK)


def build_chunk_messages(chunks: DataFrame, jobs: DataFrame, default_user: str, created_at: Column | None = None, random_ids: bool = False) -> DataFrame:
    """One message a chunk: joined with its job's record (job_id, source_url, video_id, video_title, lang, user_id, created_at).

    One created_at a job: the record's, or the given column. Ids are made from source id and chunk number.
    """
    filled = lambda c, other: F.coalesce(F.nullif(F.trim(c), F.lit("")), other)
    both = chunks.join(jobs, "job_id")
    source_id = coerce_source_id(F.col("video_id"), F.col("source_url"))
    return both.select(
        chunk_id(source_id, F.col("chunk_no"), random_ids).alias("doc_chunk_id"),
        "text",
        filled("user_id", F.lit(default_user)).alias("user_id"),
        F.col("source_url").alias("source"),
        filled("video_title", F.col("video_id")).alias("title"),
        filled("lang", F.lit("UNKNOWN")).alias("lang"),
        (created_at if created_at is not None else F.col("created_at")).alias("created_at"),
        "source_url",
        source_id.alias("source_id"),
        F.struct("time_from", "time_to").alias("video_timestamp"),
    )
