"""The jobs' input tables, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captionloom.functions.ids import dashed, url_uuid
from captionloom.operators import stored


def folder(spark: SparkSession) -> str:
    return stored.folder(spark, "queries")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files give fewer splits than there are cores, for work that costs far more than the scan.
    A table of more splits passes as it is, so large ones are never shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues: every sentence or line of a document, a second each."""
    docs = spread(table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text"))
    rows = docs.select(F.col("doc_id").cast("string").alias("job_id"), F.posexplode(F.split("text", r"\. |\n")).alias("cue_no", "text"))
    return rows.select("job_id", "cue_no", F.col("cue_no").cast("double").alias("start"), (F.col("cue_no") + 1).cast("double").alias("end"), "text")


def job_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    url = F.concat(F.lit("https://videos.example/"), F.col("source"), F.lit("/"), F.col("doc_id"))
    return docs.select(
        F.col("doc_id").cast("string").alias("job_id"), url.alias("source_url"), F.concat(F.lit("video-"), "doc_id").alias("video_id"), F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("Title "), "doc_id")).alias("video_title"),
        F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 3 != 0, dashed(url_uuid(F.col("source")))).alias("user_id"), F.lit("2025-01-02T03:04:05Z").alias("created_at"),
    )


DEFAULT_USER = "00000000-0000-4000-8000-000000000001"


def faulty_messages(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """One message a document, with a fault in some by rule; and more of its columns."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    n = F.col("doc_id")
    uuid = dashed(url_uuid(n.cast("string")))
    times = F.when(n % 11 != 0, F.struct(F.when(n % 26 == 7, "x").otherwise((n % 50).cast("string")).alias("time_from"), (n % 50 + F.when(n % 22 == 3, -1).otherwise(1)).cast("string").alias("time_to")))
    return d.select(
        F.when(n % 31 == 1, "not-a-uuid").otherwise(uuid).alias("doc_chunk_id"), F.col("text"), F.when(n % 37 == 2, "42").otherwise(uuid).alias("user_id"), F.col("source"),
        F.when(n % 13 == 0, "  ").otherwise(F.concat(F.lit("T"), n)).alias("title"), F.when(F.col("quality") == 0, F.lit(None)).otherwise(F.col("lang")).alias("lang"),
        F.when(n % 41 == 5, "yesterday").otherwise("2025-01-02T03:04:05Z").alias("created_at"), F.lit("https://videos.example/x").alias("source_url"),
        F.when(n % 3 == 0, n.cast("string")).when(n % 43 == 7, "abc").otherwise(uuid).alias("source_id"), times.alias("video_timestamp"), *more,
    )


def loudness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames: a user's events in order, the value as loudness, a second each."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    no = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").cast("string").alias("job_id"), no.alias("frame_no"), no.cast("double").alias("t"), F.col("value").alias("rms_db"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks: a source is a video, its languages are tracks; the first document with a track sets its place."""
    d = table(spark, sf_dir, "documents")
    lang = F.when((F.col("lang") == "en") & (F.col("source") < "src14"), F.concat("lang", F.lit("-orig"))).otherwise(F.col("lang"))
    formats = F.when(F.col("lang") == "de", F.array(F.lit("ttml"), F.lit("srv1"))).otherwise(F.array(F.lit("json3"), F.lit("vtt"), F.lit("srt")))
    return d.groupBy(F.col("source").alias("video_id"), lang.alias("lang")).agg(F.min("doc_id").cast("int").alias("lang_pos"), F.first(formats).alias("formats"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript parts: a conversation is a job, a turn is a part of one cue; every seventh part failed."""
    c = table(spark, sf_dir, "conversations")
    cue = F.struct(F.lit(0.5).alias("start"), F.lit(2.25).alias("end"), F.col("text").alias("text"))
    return c.select(
        F.col("conv_id").cast("string").alias("job_id"), F.col("turn").cast("int").alias("idx"), F.array(cue).alias("cues"),
        F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, "en").otherwise("de").alias("lang"), F.when((F.col("conv_id") + F.col("turn")) % 7 == 6, "failed").alias("error"),
    )


def job_event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job events: a user is a job; the driver's event types stand for ours."""
    e = table(spark, sf_dir, "events")
    k, n = F.get_json_object("props", "$.k").cast("long"), F.col("event_id")
    kind = F.create_map(*[F.lit(x) for x in ("view", "progress", "error", "state", "signup", "state", "purchase", "artifact", "click", "log")])[F.col("event_type")]
    state = F.when(F.col("event_type") == "error", F.when(n % 40 == 3, F.lit('{"error":"broken"}')).otherwise(F.lit('{"state":"running"}'))).otherwise(F.concat(F.lit('{"state":"done","detail":"k'), k, F.lit('"}')))
    data = F.when(kind == "state", state).when(kind == "progress", F.concat(F.lit('{"received":'), k, F.lit(',"total":100}'))).when(kind == "artifact", F.concat(F.lit('{"key":"f'), k % 3, F.lit('","value":"v'), n, F.lit('"}'))).otherwise(F.lit("{}"))
    return e.select("event_id", "ts", F.col("user_id").cast("string").alias("job_id"), kind.alias("type"), data.alias("data"))
