"""The point table: Parquet in id-hash buckets that split as they fill, upserted by rewriting the buckets that a batch touches.

    points/batch=7/depth=3/bucket=5/   rows whose id hash ends in the 3 bits 101, as of upsert 7
    heads/7/                           (batch, depth, bucket, rows) of the live buckets after upsert 7

A head is written last, so that an upsert is seen as a whole or not at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a bucket holds before it is split by one more bit of the hash.
BUCKET_ROWS = 100_000
HEAD = "batch long, depth int, bucket long, rows long"
KEY = ["batch", "depth", "bucket"]


def latest_per_id(batch: DataFrame, order_col: str) -> DataFrame:
    """One row an id: the one with the greatest order_col, ties by the row itself. Combined before the shuffle."""
    rest = [c for c in batch.columns if c not in ("id", order_col)]
    tie = F.xxhash64(*[F.to_json(F.struct(c)) for c in rest]) if rest else F.lit(0)
    last = batch.groupBy("id").agg(F.max_by(F.struct(*batch.columns), F.struct(F.col(order_col), tie)).alias("row"))
    return last.select("row.*")


def merged(existing: DataFrame | None, batch: DataFrame, order_col: str) -> DataFrame:
    """The table after the batch: its winners, and the rows whose ids it doesn't have."""
    fresh = latest_per_id(batch, order_col).drop(order_col)
    return fresh if existing is None else existing.join(fresh.select("id"), "id", "left_anti").select(*fresh.columns).unionByName(fresh)


def _files(spark: SparkSession, path: str):
    """(file system, path of a name) in the JVM: heads are found and dead buckets deleted wherever the table is."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def heads(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the upserts that were finished and are kept, in order."""
    fs, at = _files(spark, path)
    found = fs.globStatus(at(f"{path}/heads/*/_SUCCESS")) or []
    return sorted(int(f.getPath().getParent().getName()) for f in found)


def live_buckets(spark: SparkSession, path: str, number: int | None = None) -> list[tuple[int, int, int, int]]:
    """(batch, depth, bucket, rows) of the table's buckets, one for some BUCKET_ROWS rows of it."""
    kept = heads(spark, path)
    if not kept:
        return []
    head = spark.read.schema(HEAD).parquet(f"{path}/heads/{kept[-1] if number is None else number}")
    return [tuple(r) for r in head.orderBy("depth", "bucket").toLocalIterator()]


def _folder(path: str, bucket: tuple) -> str:
    return f"{path}/points/batch={bucket[0]}/depth={bucket[1]}/bucket={bucket[2]}"


def _read(spark: SparkSession, path: str, buckets: list[tuple]) -> DataFrame:
    """Only these buckets' folders are listed and read."""
    return spark.read.option("basePath", f"{path}/points").parquet(*[_folder(path, b) for b in buckets])


def _place(depth: Column | str) -> Column:
    """The bucket of an id at a depth: the last bits of its hash."""
    return F.xxhash64("id").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col(depth) if isinstance(depth, str) else depth) - 1)


def upsert_points(batch: DataFrame, path: str, order_col: str = "order", bucket_rows: int = BUCKET_ROWS) -> None:
    """Insert or replace the batch's points (id, ..., order_col) in the table at path; applying a batch twice changes nothing.

    The batch is evaluated once, into a staged table of its latest rows. Buckets that none of them belongs to are neither
    read nor written. A bucket that would hold more than bucket_rows is split by as many more bits of the hash as that
    takes, so buckets stay even from ten points to any number. What is live is told by the head, written last: readers see
    all of a batch or nothing, and what a crash leaves is overwritten when the batch is applied again. Buckets that the head
    before the last still holds stay for its readers; older ones are deleted. One writer at a time.
    """
    if bucket_rows < 1:
        raise ValueError("bucket_rows must be 1 or more")
    spark, path = batch.sparkSession, path.rstrip("/")
    live = live_buckets(spark, path)
    number = max(heads(spark, path), default=-1) + 1
    latest_per_id(batch, order_col).drop(order_col).write.mode("overwrite").parquet(f"{path}/staged")
    fresh = spark.read.parquet(f"{path}/staged")
    leaves = live or [(-1, 0, 0, 0)]
    depths = F.explode(F.array(*[F.lit(d) for d in sorted({b[1] for b in leaves})]))
    placed = fresh.select("*", depths.alias("depth")).withColumn("bucket", _place("depth")).join(spark.createDataFrame(leaves, HEAD), ["depth", "bucket"])
    touched = {(r["batch"], r["depth"], r["bucket"]): r["rows"] + r["n"] for r in placed.groupBy(*KEY, "rows").agg(F.count("*").alias("n")).toLocalIterator()}
    if not touched:
        return
    old = _read(spark, path, list(touched)) if live else None
    if old is not None:  # rows that the batch replaces are in both
        for r in old.join(fresh.select("id"), "id", "left_semi").groupBy(*KEY).agg(F.count("*").alias("n")).toLocalIterator():
            touched[r["batch"], r["depth"], r["bucket"]] -= r["n"]
    deeper = [(depth, bucket, depth + max(0, (-(-rows // bucket_rows) - 1).bit_length())) for (_, depth, bucket), rows in touched.items()]
    deeper = spark.createDataFrame(deeper, "depth int, bucket long, goal int")
    rows = placed.drop("batch", "rows")
    if old is not None:
        kept = old.join(fresh.select("id"), "id", "left_anti").withColumn("bucket", F.col("bucket").cast("long"))
        rows = rows.unionByName(kept.select(*rows.columns))
    split = rows.join(deeper, ["depth", "bucket"]).withColumn("depth", F.col("goal")).drop("goal").withColumn("bucket", _place("depth"))
    split.repartition("depth", "bucket").write.mode("overwrite").partitionBy("depth", "bucket").parquet(f"{path}/points/batch={number}")
    written = spark.read.parquet(f"{path}/points/batch={number}").groupBy("depth", "bucket").agg(F.count("*").alias("rows"))
    stay = spark.createDataFrame([b for b in live if b[:3] not in touched], HEAD)
    written = written.select(F.lit(number).cast("long").alias("batch"), F.col("depth").cast("int").alias("depth"), F.col("bucket").cast("long").alias("bucket"), "rows")
    stay.unionByName(written).coalesce(1).write.mode("overwrite").parquet(f"{path}/heads/{number}")
    _clean(spark, path)


def _clean(spark: SparkSession, path: str) -> None:
    """Delete what only heads before the last two hold, and those heads."""
    fs, at = _files(spark, path)
    kept = heads(spark, path)
    for gone, after in zip(kept[:-2], kept[1:], strict=False):
        still = {b[:3] for b in live_buckets(spark, path, after)}
        for b in live_buckets(spark, path, gone):
            if b[:3] not in still:
                fs.delete(at(_folder(path, b)), True)
        fs.delete(at(f"{path}/heads/{gone}"), True)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """The table as of its last finished upsert."""
    path = path.rstrip("/")
    live = live_buckets(spark, path)
    if not live:
        raise ValueError(f"there is no point table at {path}")
    return _read(spark, path, live).drop(*KEY)
