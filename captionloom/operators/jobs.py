"""Job records and reports from events and metadata documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def job_status(events: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """(job_id, state, detail, error) from events (event_id, ts, job_id, type, data as JSON); the latest counts.

    A state event sets state and, where it has one, detail. An error in its data sets state to error. jobs, if given, are
    the known jobs: events of others are ignored, and jobs without events are queued. Works on streams in update or
    complete mode (without jobs).
    """
    data = F.from_json("data", "struct<state:string,detail:string,error:string>")
    e = events.where("type = 'state'").select("job_id", F.struct("ts", "event_id").alias("at"), data.alias("d"))
    state = F.when(F.col("d.error").isNotNull(), "error").otherwise(F.col("d.state"))
    out = e.groupBy("job_id").agg(
        F.max_by(state, F.when(state.isNotNull(), F.col("at"))).alias("state"),
        F.max_by("d.detail", F.when(F.col("d.detail").isNotNull(), F.col("at"))).alias("detail"),
        F.max_by("d.error", F.when(F.col("d.error").isNotNull(), F.col("at"))).alias("error"),
    )
    if jobs is None:
        return out
    return jobs.select("job_id").distinct().join(out, "job_id", "left").withColumn("state", F.coalesce("state", F.lit("queued")))


def job_progress(events: DataFrame) -> DataFrame:
    """(job_id, received, total) of the latest progress event."""
    data = F.from_json("data", "struct<received:long,total:long>")
    e = events.where("type = 'progress'").select("job_id", F.struct("ts", "event_id").alias("at"), data.alias("d"))
    return e.groupBy("job_id").agg(F.max_by("d.received", "at").alias("received"), F.max_by("d.total", "at").alias("total"))


def job_events(events: DataFrame, job_id: str | None = None) -> DataFrame:
    """A job's feed (job_id, seq, type, data, ts), or that of every job: its status first (seq 0, no time), then its events.

    Sorted by job, time and seq. A job without state events has no status row.
    """
    own = events.where(F.col("job_id") == job_id) if job_id is not None else events
    status = job_status(own).select("job_id", F.lit(0).cast("long").alias("seq"), F.lit("state").alias("type"), F.to_json(F.struct("state", "detail", "error")).alias("data"), F.lit(None).cast("timestamp").alias("ts"))
    rest = own.select("job_id", F.col("event_id").cast("long").alias("seq"), "type", "data", F.col("ts").cast("timestamp").alias("ts"))
    return status.unionByName(rest).orderBy("job_id", F.col("ts").asc_nulls_first(), "seq")


def artifacts(events: DataFrame) -> DataFrame:
    """(job_id, artifacts): map from key to its values in order of arrival."""
    data = F.from_json("data", "struct<key:string,value:string>")
    e = events.where("type = 'artifact'").select("job_id", "ts", "event_id", data.alias("d")).where("d.key IS NOT NULL")
    by_key = e.groupBy("job_id", F.col("d.key").alias("key")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", F.col("d.value").alias("value")))).alias("held"))
    return by_key.groupBy("job_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", F.col("held.value").alias("values"))))).alias("artifacts"))


def text_stats(messages: DataFrame, jobs: DataFrame, queue: str, max_len: int) -> DataFrame:
    """(job_id, text_processing): chunk counts per job with method, languages and files of its record.

    messages: (job_id, reason); jobs: (job_id, method, selected_lang, captions_file, lang, srt_file).
    """
    made = messages.groupBy("job_id").agg(F.count("*").cast("int").alias("chunks"), F.count_if(F.col("reason").isNull()).cast("int").alias("enqueued"), F.array_sort(F.collect_set("reason")).alias("errors"))
    both = jobs.join(made, "job_id", "left")
    none = F.array().cast("array<string>")
    fields = F.struct("method", "selected_lang", "captions_file", "lang", "srt_file", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("enqueued", F.lit(0)).alias("enqueued"), F.lit(queue).alias("queue"), F.lit(max_len).alias("max_text_length"), F.coalesce("errors", none).alias("errors"))
    return both.select("job_id", fields.alias("text_processing"))


def job_metadata(jobs: DataFrame, stats: DataFrame, stages: DataFrame) -> DataFrame:
    """Metadata documents: jobs (job_id, video_id, video_title, source_url), stats of text_stats(), stages (job_id, stages, total_seconds, error).

    A job with an error has the failure form: success false, the error, and no text part.
    """
    both = jobs.join(stages, "job_id").join(stats, "job_id", "left")
    failed = F.col("error").isNotNull()
    return both.select("job_id", "video_id", "video_title", "source_url", "stages", F.when(~failed, F.col("text_processing")).alias("text_processing"), (~failed).alias("success"), "total_seconds", "error")


def run_summary(documents: DataFrame) -> DataFrame:
    """Per method and language: jobs, share of successes, mean and 90th percentile of seconds, chunks."""
    by = [F.coalesce("text_processing.method", F.lit("none")).alias("method"), F.coalesce("text_processing.lang", "stages.captions.selected.lang", F.lit("none")).alias("lang")]
    return documents.groupBy(*by).agg(
        F.count("*").alias("jobs"), F.avg(F.col("success").cast("double")).alias("success_share"), F.avg("stages.captions.seconds").alias("captions_seconds"), F.avg("stages.whisper.seconds").alias("whisper_seconds"),
        F.avg("total_seconds").alias("total_seconds"), F.percentile_approx("total_seconds", 0.9).alias("total_p90"), F.coalesce(F.sum("text_processing.chunks"), F.lit(0)).alias("chunks"),
    )


def rate(events: DataFrame, seconds: int, failed: Column, time: str = "ts") -> DataFrame:
    """(start, processed, failed, per_second) per tumbling window."""
    w = F.window(time, f"{seconds} seconds")
    out = events.groupBy(w.alias("w")).agg(F.count("*").alias("processed"), F.count_if(failed).alias("failed"))
    return out.select(F.col("w.start").alias("start"), "processed", "failed", (F.col("processed") / seconds).alias("per_second"))
