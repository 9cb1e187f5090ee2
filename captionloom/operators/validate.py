"""Validation: accepted rows, and rejects with the first rule that failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captionloom.functions.ids import is_uuid
from captionloom.functions.schemas import FORMATS, REQUIRED
from captionloom.functions.text import parse_created_at, strip

#: Reasons of rejects, in the order of the rules.
REASONS = ("invalid_json", *(f"missing_{c}" for c in REQUIRED), "text_too_long", "bad_created_at", "bad_source_id", "bad_user_id", "bad_doc_chunk_id", "bad_video_timestamp")


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def reject_reason(max_len: int = 500, strict: bool = False, json_flag: str | None = "bad_json") -> Column:
    """The first broken rule of a message's columns, or null.

    Lengths are in code points and max_len itself passes. A source id may be a UUID or, unless strict, a number. A
    timestamp struct must hold two finite numbers, 0 <= from <= to; a missing one is fine.
    """
    if max_len < 1:
        raise ValueError("max_len must be 1 or more")
    source_id = strip(F.col("source_id"))
    known = is_uuid(source_id) if strict else is_uuid(source_id) | F.coalesce(finite(F.expr("try_cast(trim(source_id) as double)")), F.lit(False))
    a, b = (F.expr(f"try_cast(video_timestamp.{k} as double)") for k in ("time_from", "time_to"))
    good_time = F.coalesce(finite(a) & finite(b) & (a >= 0) & (a <= b), F.lit(False))
    rules = [(F.col(json_flag), "invalid_json")] if json_flag else []
    rules += [(is_blank(F.col(c)), f"missing_{c}") for c in REQUIRED]
    rules += [
        (F.length("text") > max_len, "text_too_long"),
        (parse_created_at(F.col("created_at")).isNull(), "bad_created_at"),
        (~known, "bad_source_id"),
        (~is_uuid(F.col("user_id")), "bad_user_id"),
        (~is_uuid(F.col("doc_chunk_id")), "bad_doc_chunk_id"),
        (F.col("video_timestamp").isNotNull() & ~good_time, "bad_video_timestamp"),
    ]
    return F.coalesce(*[F.when(broken, reason) for broken, reason in rules])


def validate_messages(messages: DataFrame, max_len: int = 500, strict: bool = False) -> DataFrame:
    """messages with `reason` (null: accepted), in one pass."""
    flag = "bad_json" if "bad_json" in messages.columns else None
    return messages.withColumn("reason", reject_reason(max_len, strict, flag))


def accepted(validated: DataFrame) -> DataFrame:
    """Accepted messages in their final types."""
    t = F.col("video_timestamp")
    times = F.when(t.isNotNull(), F.struct(F.expr("try_cast(video_timestamp.time_from as double)").alias("time_from"), F.expr("try_cast(video_timestamp.time_to as double)").alias("time_to")))
    kept = [c for c in validated.columns if c not in ("reason", "raw", "bad_json")]
    return validated.where("reason IS NULL").select(*kept).withColumns({"created_at": parse_created_at(F.col("created_at")), "video_timestamp": times})


def rejected(validated: DataFrame) -> DataFrame:
    return validated.where("reason IS NOT NULL")


def reject_counts(validated: DataFrame) -> DataFrame:
    """(reason, n), 'accepted' for those that pass; combined before the shuffle."""
    return validated.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


def check_items(items: DataFrame, dim: int | None = None) -> DataFrame:
    """Embedded items with point_id (the payload's chunk id, else id, else '') and reason: no vector, or one of another size."""
    point = F.coalesce(F.nullif(F.col("payload.doc_chunk_id"), F.lit("")), F.nullif(F.col("id"), F.lit("")), F.lit(""))
    none = F.col("vector").isNull() | (F.size("vector") <= 0)
    size = (F.size("vector") != dim) if dim else F.lit(False)
    return items.withColumns({"point_id": point, "reason": F.when(none, "no_vector").when(size, "wrong_dimension")})


def check_requests(requests: DataFrame) -> DataFrame:
    """Extract requests with reason: the URL must be http(s), formats must be known ones (null: no preference)."""
    http = F.coalesce(F.col("url").rlike(r"(?i)^https?://[^/?#\s]+"), F.lit(False))
    known = F.coalesce(F.forall("preferred_sub_formats", lambda f: f.isin(*FORMATS)), F.lit(True))
    return requests.withColumn("reason", F.when(~http, "bad_url").when(~known, "unknown_format"))


def check_search_text(queries: DataFrame, text_col: str = "text", max_len: int = 500) -> DataFrame:
    c = F.col(text_col)
    return queries.withColumn("reason", F.when(is_blank(c), "empty_text").when(F.length(c) > max_len, "text_too_long"))
