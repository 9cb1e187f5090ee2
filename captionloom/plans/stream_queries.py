"""The streams as queries: each reads its files as a stream until they are used up, and returns what its sink holds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from captionloom.functions.text import to_jsonable
from captionloom.operators import jobs, points, validate, vectors
from captionloom.plans import derived
from captionloom.plans.derived import folder
from captionloom.plans.queries import EVENTS_SQL, LETTERS_SQL, ORACLES, REASON_SQL, millionths, query
from captionloom.streaming import job_streams, streams


def stream_of(spark: SparkSession, df: DataFrame, at: str, triggers: int = 4) -> DataFrame:
    """df as a stream of files, as many as shuffles have partitions, read in a few triggers."""
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(files).write.parquet(at)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", -(-files // triggers)).parquet(at)


def final_state(df: DataFrame, at: str) -> DataFrame:
    """Run an aggregated stream to its end; every trigger replaces the whole result."""

    def each(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out")

    df.writeStream.foreachBatch(each).outputMode("complete").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.parquet(f"{at}/out")


def _over(spark: SparkSession, df: DataFrame, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    at = folder(spark)
    return final_state(f(stream_of(spark, df, f"{at}/in")), at)


@query(ORACLES["hourly_rates"])
def stream_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-time rates per hour; the watermark bounds the state where results are appended."""
    out = _over(spark, derived.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), lambda e: streams.throughput(e, 3600, F.col("event_type") == "error"))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(ORACLES["job_states"])
def stream_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, derived.job_event_table(spark, sf_dir), jobs.job_status)


@query(ORACLES["job_progress"])
def stream_job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, derived.job_event_table(spark, sf_dir), jobs.job_progress)


@query(ORACLES["reject_counts"])
def stream_reject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as JSON lines through the validating stream: its accepted ones and its rejects by reason."""
    at = folder(spark)
    derived.faulty_messages(spark, sf_dir).select(to_jsonable(F.struct("*")).alias("value")).repartition(files := int(spark.conf.get("spark.sql.shuffle.partitions"))).write.text(f"{at}/in")
    streams.stream_validate(spark, f"{at}/in", f"{at}/ok", f"{at}/dlq", f"{at}/log", files_per_trigger=-(-files // 3)).awaitTermination()
    good = spark.read.text(f"{at}/ok").agg(F.count("*").alias("n")).select(F.lit("accepted").alias("reason"), "n")
    bad = spark.read.schema("raw string, reason string").json(f"{at}/dlq").groupBy("reason").agg(F.count("*").alias("n"))
    return good.unionByName(bad)


@query(ORACLES["upserted_points"])
def stream_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads of the point table through the upserting stream: all points, then those whose ids repeat. Buckets are kept
    small, so that they split on the way."""
    at = folder(spark)
    e = derived.table(spark, sf_dir, "embeddings")

    def items(df: DataFrame, id_) -> DataFrame:
        return df.select(id_.cast("string").alias("id"), F.col("embedding").alias("vector"), F.struct(F.lit("").alias("doc_chunk_id"), F.col("vec_id").alias("version")).alias("payload"), F.col("vec_id").alias("order"))

    for k, part in enumerate((items(e, F.col("vec_id")), items(e.where("vec_id % 3 = 0"), F.col("vec_id") % 100))):
        part.repartition("id").write.parquet(f"{at}/in{k}")
        stream = spark.readStream.schema(part.schema).parquet(f"{at}/in{k}")
        streams.stream_upsert(stream, f"{at}/points", f"{at}/log{k}", "order", dim=64, bucket_rows=100).awaitTermination()
    return points.read_points(spark, f"{at}/points").select(F.col("id").cast("long").alias("id"), F.col("payload.version").alias("version"))


@query(f"SELECT lang, count(*) AS n, 26 AS dim, CAST(sum(list_sum(v)) AS BIGINT) AS total FROM ({LETTERS_SQL.format(rows=f'SELECT lang, text FROM ({REASON_SQL}) WHERE reason IS NULL')}) GROUP BY lang")
def stream_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted messages through the embedding stream: items per language, and the sum of all their numbers."""
    at = folder(spark)
    good = validate.accepted(validate.validate_messages(derived.faulty_messages(spark, sf_dir)))
    streams.stream_embed(stream_of(spark, good, f"{at}/in"), f"{at}/items", f"{at}/dlq", f"{at}/log", "letters", vectors.letter_counts, 26).awaitTermination()
    total = F.aggregate(millionths(), F.lit(0).cast("long"), lambda a, x: a + x)
    return spark.read.parquet(f"{at}/items").groupBy("payload.lang").agg(F.count("*").alias("n"), F.min(F.size("vector")).alias("dim"), F.sum(total).alias("total"))


def _arriving(spark: SparkSession, events: DataFrame, at: str, when, thirds: int = 3) -> DataFrame:
    """Events as a stream of equal parts, one a trigger, in the order of `when` (seconds), and behind them a tick far ahead,
    of a job of its own, which moves the watermark over all of them. All parts have the same number of files, so that a
    trigger takes one part, and all cores write and read it."""
    timed = events.withColumns({"ts": F.col("ts").cast("timestamp"), "_when": when.cast("double")})
    low, high = timed.agg(F.min("_when"), F.max("_when")).first()
    part = F.least(F.lit(thirds - 1), F.floor((F.col("_when") - F.lit(low)) * thirds / F.lit(max(1.0, (high or 0) - (low or 0))))).cast("int")
    tick = timed.agg((F.max("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts")).withColumns({"_part": F.lit(thirds), "event_id": F.lit(-1).cast("long"), **({"job_id": F.lit("tick")} if "job_id" in events.columns else {})})
    dealt = timed.withColumn("_part", part).drop("_when").unionByName(tick, allowMissingColumns=True)
    files = _files_a_part(timed, part, thirds)
    for k in range(thirds + 1):  # one after the other: files are read by their age
        dealt.where(F.col("_part") == k).drop("_part").repartition(files if k < thirds else 1).write.mode("append").parquet(at)
    return spark.readStream.schema(dealt.drop("_part").schema).option("maxFilesPerTrigger", files).parquet(at)


def _files_a_part(rows: DataFrame, part: Column, parts: int) -> int:
    """As many files as shuffles have partitions, or as few as no part leaves empty: rows are dealt in turn, so a split with
    as many rows of a part as there are files fills them all."""
    held = {r["part"]: r["n"] for r in rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least = min(held.get(k, 0) for k in range(parts))
    return max(1, min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), least // max(1, rows.rdd.getNumPartitions())))


def _arrival() -> Column:
    """When an event arrives, in seconds: up to twelve hours behind its time, less than the day that the watermark waits."""
    return F.unix_seconds(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(43_200))


@query(f"SELECT * FROM ({ORACLES['job_states']}) WHERE CAST(job_id AS BIGINT) % 5 <> 0")
def stream_live_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of known jobs, told in update mode out of state; events arrive up to twelve hours late, others' are ignored."""
    at = folder(spark)
    events = derived.job_event_table(spark, sf_dir)
    known = events.where("CAST(job_id AS LONG) % 5 <> 0").select("job_id").distinct()
    s = _arriving(spark, events, f"{at}/in", _arrival())
    job_streams.job_status_stream(s, f"{at}/out", f"{at}/log", known, "1 day", 400 * 86_400).awaitTermination()
    return job_streams.live_status(spark, f"{at}/out")


@query(f"""
SELECT f.job_id, f.type, md5(f.data) AS digest, f.seq, row_number() OVER (PARTITION BY f.job_id ORDER BY e.ts, f.seq) AS pos FROM ({EVENTS_SQL}) f JOIN events e ON e.event_id = f.seq UNION ALL
SELECT job_id, 'state', md5('{{' || concat_ws(',', '"state":"' || state || '"', '"detail":"' || detail || '"', '"error":"' || error || '"') || '}}'), 0, 0 FROM ({ORACLES["job_states"]})
""")
def stream_job_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every job's feed out of a stream whose events arrive up to twelve hours late: its status, then its events in order."""
    at = folder(spark)
    events = derived.job_event_table(spark, sf_dir)
    s = _arriving(spark, events, f"{at}/in", _arrival())
    job_streams.job_events_stream(s, jobs.job_status(events), f"{at}/out", f"{at}/log", "1 day").awaitTermination()
    return spark.read.parquet(f"{at}/out").select("job_id", "type", F.md5("data").alias("digest"), "seq", "pos")


@query("""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS processed, count(*) FILTER (event_type = 'error') AS failed, count(*) / 3600.0 AS per_second
FROM (SELECT *, (epoch(ts) - min(epoch(ts)) OVER ()) * 5 / greatest(1.0, max(epoch(ts)) OVER () - min(epoch(ts)) OVER ()) AS fifth FROM events) WHERE NOT (event_id % 97 = 0 AND fifth < 1) GROUP BY 1
""")
def stream_closed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly rates in append mode. Every seventh event comes twice in a trigger; some of the first fifth come at the end,
    too late for the watermark, and change nothing."""
    at = folder(spark)
    e = derived.table(spark, sf_dir, "events")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    low, high = e.agg(F.min(seconds), F.max(seconds)).first()
    late = (F.col("event_id") % 97 == 0) & ((seconds - F.lit(low)) * 5 / F.lit(max(1.0, high - low)) < 1)
    doubled = e.unionByName(e.where("event_id % 7 = 3"))
    s = _arriving(spark, doubled, f"{at}/in", F.when(late, F.lit(high)).otherwise(seconds))
    job_streams.throughput_stream(s, f"{at}/out", f"{at}/log", 3600, F.col("event_type") == "error", "1 day").awaitTermination()
    return spark.read.parquet(f"{at}/out").select(F.col("start").cast("timestamp_ntz").alias("start"), "processed", "failed", "per_second")
