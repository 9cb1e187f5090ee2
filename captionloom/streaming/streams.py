"""The continuous forms: validate, embed, upsert, rates. Each resumes from its checkpoint; sinks tolerate a replayed batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from captionloom.operators import points, validate, vectors
from captionloom.operators.jobs import rate
from captionloom.sources.messages import message_json, stream_chunk_messages


def _start(df: DataFrame, each, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    return df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_validate(spark: SparkSession, source: str, out: str, dlq: str, checkpoint: str, max_len: int = 500, strict: bool = False, files_per_trigger: int = 100, trigger: dict | None = None) -> StreamingQuery:
    """Messages from source: accepted ones to out (JSON lines), rejects with their reason to dlq. A batch has a folder of its own, so a replay overwrites."""
    judged = validate.validate_messages(stream_chunk_messages(spark, source, files_per_trigger), max_len, strict)

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        good = validate.accepted(batch)
        good.select(message_json(*good.columns)).write.mode("overwrite").text(f"{out}/batch={number}")
        validate.rejected(batch).select("raw", "reason").write.mode("overwrite").json(f"{dlq}/batch={number}")
        batch.unpersist()

    return _start(judged, each, checkpoint, trigger)


def stream_embed(messages: DataFrame, out: str, dlq: str, checkpoint: str, model: str, make_encoder=None, dim: int = 64, batch: int = 256, trigger: dict | None = None) -> StreamingQuery:
    """Accepted messages to embedded items (Parquet) in bounded batches; messages whose text failed go to dlq."""
    encoded = vectors.embed(messages, "text", make_encoder, dim, batch)

    def each(part: DataFrame, number: int) -> None:
        part.persist()
        vectors.embedded_items(part, model).write.mode("overwrite").parquet(f"{out}/batch={number}")
        part.where("vector IS NULL").select("doc_chunk_id", F.col("embed_error").alias("reason")).write.mode("overwrite").json(f"{dlq}/batch={number}")
        part.unpersist()

    return _start(encoded, each, checkpoint, trigger)


def stream_upsert(items: DataFrame, table: str, checkpoint: str, order_col: str, dim: int | None = None, named: str | None = None, bucket_rows: int = points.BUCKET_ROWS, trigger: dict | None = None) -> StreamingQuery:
    """Embedded items to the point table; the greatest order_col of an id in a batch wins, later batches over earlier ones.
    A batch is evaluated once; one that is replayed after a crash changes nothing."""

    def each(batch: DataFrame, _: int) -> None:
        good = validate.check_items(batch, dim).where("reason IS NULL")
        vector = F.create_map(F.lit(named), F.col("vector")) if named else F.col("vector")
        points.upsert_points(good.select(F.col("point_id").alias("id"), vector.alias("vector"), "payload", F.col(order_col).alias("order")), table, "order", bucket_rows)

    return _start(items, each, checkpoint, trigger)


def throughput(events: DataFrame, seconds: int, failed: Column, late: str = "10 minutes") -> DataFrame:
    """rate() with a watermark, which bounds the state of a stream; without effect on a batch."""
    return rate(events.withWatermark("ts", late), seconds, failed)
