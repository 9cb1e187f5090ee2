"""Speech parts: the transcriber contract, merging by offset, language vote, subtitle files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captionloom.functions.schemas import PART
from captionloom.functions.text import format_timecode


def transcribe(segments: DataFrame, fn: Callable[[dict], tuple[list[dict], str | None]], tasks: int | None = None) -> DataFrame:
    """Parts (job_id, idx, cues, lang, error) of segments (job_id, seg_no, ...): fn gets a row and returns (cues, language).

    Segments, not jobs, are the unit of work. A segment whose call raises becomes an error row and stops nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                try:
                    cues, lang = fn(r)
                    rows.append((r["job_id"], r["seg_no"], [{k: c[k] for k in ("start", "end", "text")} for c in cues], lang, None))
                except Exception as e:  # noqa: BLE001  whatever the caller's function raises belongs to its row
                    rows.append((r["job_id"], r["seg_no"], None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["job_id", "idx", "cues", "lang", "error"])

    dealt = segments.repartition(tasks, "job_id", "seg_no") if tasks else segments.repartition("job_id", "seg_no")
    return dealt.mapInPandas(run, PART)


def merge_transcripts(parts: DataFrame, offsets: DataFrame, chunk_seconds: float) -> DataFrame:
    """Cues (job_id, cue_no, start, end, text) of all parts in idx order; a part without an offset starts at idx * chunk_seconds.

    offsets: (job_id, idx, offset). Error parts give nothing.
    """
    good = parts.where("error IS NULL").join(offsets.select("job_id", "idx", "offset"), ["job_id", "idx"], "left")
    at = F.coalesce("offset", F.col("idx") * F.lit(float(chunk_seconds)))
    rows = good.select("job_id", "idx", at.alias("at"), F.posexplode("cues").alias("pos", "cue"))
    place = F.row_number().over(Window.partitionBy("job_id").orderBy("idx", "pos")) - 1
    return rows.select("job_id", place.alias("cue_no"), (F.col("cue.start") + F.col("at")).alias("start"), (F.col("cue.end") + F.col("at")).alias("end"), F.col("cue.text").alias("text"))


def majority_language(parts: DataFrame) -> DataFrame:
    """(job_id, lang): what most parts of a job have; of equals, the one heard first."""
    votes = parts.where("lang IS NOT NULL").groupBy("job_id", "lang").agg(F.count("*").alias("n"), F.min("idx").alias("first"))
    return votes.groupBy("job_id").agg(F.max_by("lang", F.struct("n", -F.col("first"))).alias("lang"))


def _rendered(cues: DataFrame, head: str, block: Callable[[Column, Column], Column]) -> DataFrame:
    jobs = cues.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("cue_no", "start", "end", "text"))).alias("held"))
    return jobs.select("job_id", F.concat(F.lit(head), F.array_join(F.transform("held", block), "\n")).alias("value"))


def render_vtt(cues: DataFrame) -> DataFrame:
    """(job_id, value): one WebVTT document a job."""
    return _rendered(cues, "WEBVTT\n\n", lambda c, _: F.concat(format_timecode(c["start"]), F.lit(" --> "), format_timecode(c["end"]), F.lit("\n"), c["text"], F.lit("\n")))


def render_srt(cues: DataFrame) -> DataFrame:
    """(job_id, value): one SRT document a job, cues numbered from 1."""
    return _rendered(cues, "", lambda c, k: F.concat((k + 1).cast("string"), F.lit("\n"), format_timecode(c["start"], True), F.lit(" --> "), format_timecode(c["end"], True), F.lit("\n"), c["text"], F.lit("\n")))


def write_subtitles(documents: DataFrame, path: str) -> None:
    """One file per job, in a folder named after it."""
    documents.write.mode("overwrite").partitionBy("job_id").option("lineSep", "\n").text(path)
