"""Choice of caption tracks and files: priorities are columns, one shuffle ranks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captionloom.functions.text import format_chain


def _place(listed: Column, value: Column) -> Column:
    """Position of value in an array that may be null, or null."""
    return F.nullif(F.coalesce(F.array_position(listed, value), F.lit(0)), F.lit(0))


def choose_track(tracks: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """(video_id, lang, format, chain) of tracks (video_id, lang, lang_pos, formats).

    Languages in order: the request's, any '*-orig' as listed, 'en', then as listed. Format: the first wanted one, vtt, or
    the first there is. requests (video_id, languages, preferred_sub_formats) is optional; videos without tracks that
    have a request come with nulls.
    """
    wish = requests if requests is not None else tracks.select("video_id", F.lit(None).cast("array<string>").alias("languages"), F.lit(None).cast("array<string>").alias("preferred_sub_formats")).distinct()
    both = wish.join(tracks, "video_id", "left")
    asked = _place(F.col("languages"), F.col("lang"))
    grade = F.when(asked.isNotNull(), 0).when(F.col("lang").endswith("-orig"), 1).when(F.col("lang") == "en", 2).otherwise(3)
    order = Window.partitionBy("video_id").orderBy(grade, F.coalesce(asked, F.lit(0)), F.col("lang_pos").asc_nulls_last(), F.col("lang"))
    best = both.withColumn("nth", F.row_number().over(order)).where("nth = 1")
    wanted = F.concat(F.coalesce("preferred_sub_formats", F.array().cast("array<string>")), F.array(F.lit("vtt")))
    fmt = F.coalesce(F.get(F.array_intersect(wanted, F.col("formats")), F.lit(0)), F.get("formats", F.lit(0)))
    return best.select("video_id", "lang", fmt.alias("format")).withColumn("chain", F.when(F.col("format").isNotNull(), format_chain(F.col("format"))))


def pick_caption_file(files: DataFrame, langs: DataFrame) -> DataFrame:
    """(job_id, path): of each job's files, one named after its language if there is any, then .vtt, .srt, any; by path.

    Works on paths alone, so contents of files that aren't picked are never read. The language is a preference only.
    """
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    both = files.select("job_id", "path").join(langs.select("job_id", "lang"), "job_id", "left")
    named = F.coalesce(name.startswith(F.concat("lang", F.lit("."))), F.lit(False))
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.when(ext == "vtt", 0).when(ext == "srt", 1).otherwise(2)
    order = Window.partitionBy("job_id").orderBy(F.when(named, 0).otherwise(1), kind, "path")
    return both.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("job_id", "path")


def with_captions(jobs: DataFrame, files: DataFrame) -> DataFrame:
    return jobs.join(files.select("job_id"), "job_id", "left_semi")


def without_captions(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Jobs for the speech branch."""
    return jobs.join(files.select("job_id"), "job_id", "left_anti")
