"""Tables that a job writes for itself on its way, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession, under: str = "steps") -> str:
    """A new folder under the session's shared one; a local one only where none is set and everything runs in one process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(at or tempfile.mkdtemp(prefix='spark-shared-')).rstrip('/')}/{under}/{uuid.uuid4().hex}"


def stored(df: DataFrame, at: str | None = None) -> DataFrame:
    """df written as a table (into folder `at`, or a new one) and read back: it is computed once, and a lost executor costs a reread."""
    at = at or folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """df in ranges of its order, with their number as `range`: no key's rows meet in one task, however many they are."""
    return stored(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))


def joined_in_parts(rows: DataFrame, per_key: DataFrame, key: list[str], parts: int = 32) -> DataFrame:
    """rows with their key's row of per_key, joined on key and part, so that a key that most rows have fills no task. Rows
    are dealt to parts in turn as they are read."""
    dealt = rows.withColumn("_part", F.monotonically_increasing_id() % parts)
    return dealt.join(per_key.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))), [*key, "_part"]).drop("_part")
