"""An index of the point table's payloads: which buckets hold a keyword, a title's word, or a time, so that a filtered search
reads only the buckets that can match."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captionloom.operators import points, vectors

#: Payload fields that are compared as a whole.
KEYWORDS = ("user_id", "source", "lang", "model", "source_url", "source_id")
ENTRY = "field string, value string, depth int, bucket long, batch long"


def _entries(rows: DataFrame) -> DataFrame:
    """(field, value, batch, depth, bucket) of points: keywords, title words, and a bucket's first and last time."""
    have = [f.name for f in rows.schema["payload"].dataType.fields]
    places = [F.col(k) for k in points.KEY]
    pairs = [F.struct(F.lit(k).alias("field"), F.col(f"payload.{k}").cast("string").alias("value")) for k in KEYWORDS if k in have]
    held = F.array(*pairs) if pairs else F.array().cast("array<struct<field:string,value:string>>")
    if "title" in have:
        words = F.transform(vectors.title_words(F.col("payload.title")), lambda w: F.struct(F.lit("title").alias("field"), w.alias("value")))
        held = F.concat(held, F.coalesce(words, F.array().cast("array<struct<field:string,value:string>>")))
    said = rows.select(F.explode(held).alias("e"), *places).where("e.value IS NOT NULL").select("e.*", *places).distinct()
    if "created_at" not in have:
        return said
    at = F.unix_micros("payload.created_at")
    times = rows.groupBy(*places).agg(F.min(at).cast("string").alias("first"), F.max(at).cast("string").alias("last")).where("first IS NOT NULL")
    for name in ("first", "last"):
        said = said.unionByName(times.select(F.lit(name).alias("field"), F.col(name).alias("value"), *places))
    return said


def index_points(spark: SparkSession, path: str) -> int:
    """Bring the index of the table at path up to its last upsert; returns how many buckets were read for it.

    Only buckets that were written since the last call are read: those of each upsert are a part of their own, sorted by
    field and value. Entries of buckets that are no longer live stay until theirs is the only part left of an upsert, and
    are passed over when the index is read.
    """
    path = path.rstrip("/")
    live = points.live_buckets(spark, path)
    known = _parts(spark, path)
    fresh = [b for b in live if b[0] not in known]
    for number in sorted({b[0] for b in fresh}):
        mine = _entries(points._read(spark, path, [b for b in fresh if b[0] == number]))
        rows = mine.select("field", "value", F.col("depth").cast("int").alias("depth"), F.col("bucket").cast("long").alias("bucket"))
        rows.sortWithinPartitions("field", "value").write.mode("overwrite").parquet(f"{path}/index/batch={number}")
    fs, at = points._files(spark, path)
    for gone in known - {b[0] for b in live}:
        fs.delete(at(f"{path}/index/batch={gone}"), True)
    return len(fresh)


def _parts(spark: SparkSession, path: str) -> set[int]:
    fs, at = points._files(spark, path)
    found = fs.globStatus(at(f"{path}/index/batch=*/_SUCCESS")) or []
    return {int(f.getPath().getParent().getName().removeprefix("batch=")) for f in found}


def _micros(when) -> int:
    whole = when if when.tzinfo else when.astimezone()
    return (whole - datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)) // datetime.timedelta(microseconds=1)


def matching_buckets(spark: SparkSession, path: str, title_word: str | None = None, created_from=None, created_to=None, **keywords: str | None) -> list[tuple]:
    """The live buckets that may hold a point under all of these predicates (those of payload_filter(); times as datetimes)."""
    path = path.rstrip("/")
    live = points.live_buckets(spark, path)
    missing = {b[0] for b in live} - _parts(spark, path)
    asked = [(k, v) for k, v in {**keywords, "title": title_word and title_word.lower()}.items() if v is not None]
    bounds = [(f, sign, when) for f, sign, when in (("last", ">=", created_from), ("first", "<=", created_to)) if when is not None]
    if not asked and not bounds:
        return live
    entries = spark.read.schema(ENTRY).parquet(f"{path}/index") if _parts(spark, path) else spark.createDataFrame([], ENTRY)
    fits = [(F.col("field") == f) & (F.col("value") == v) for f, v in asked]
    fits += [(F.col("field") == f) & F.expr(f"cast(value as bigint) {sign} {_micros(when)}") for f, sign, when in bounds]
    one = fits[0]
    for more in fits[1:]:
        one = one | more
    hit = entries.where(one).groupBy(*points.KEY).agg(F.count_distinct("field").alias("n")).where(F.col("n") == len(fits))
    found = {tuple(r) for r in hit.select(*points.KEY).toLocalIterator()}  # a row a bucket at most
    return [b for b in live if b[0] in missing or b[:3] in found]


def read_points_where(spark: SparkSession, path: str, **predicates) -> DataFrame:
    """The table's points that payload_filter(**predicates) lets through; other buckets than matching_buckets() aren't read.
    Buckets that are not indexed yet are."""
    path = path.rstrip("/")
    buckets = matching_buckets(spark, path, **predicates)
    rows = points._read(spark, path, buckets) if buckets else points._read(spark, path, points.live_buckets(spark, path)[:1]).where("false")
    return rows.drop(*points.KEY).where(vectors.payload_filter(**predicates))
