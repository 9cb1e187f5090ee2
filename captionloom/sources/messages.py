"""Chunk messages and job metadata documents as JSON, in batches and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from captionloom.functions.schemas import JOB_METADATA, MESSAGE_IN
from captionloom.functions.text import to_jsonable


def parse_messages(lines: DataFrame, value: str = "value") -> DataFrame:
    """Typed message columns, `raw` and `bad_json` from a column of JSON texts; what is no JSON object is flagged, not a failure.

    A field of another type than its column's is read as text where that is possible, else as null.
    """
    raw = F.col(value).cast("string")
    broken = F.try_parse_json(raw).isNull() | ~F.trim(raw).startswith("{")
    return lines.select(raw.alias("raw"), F.from_json(raw, MESSAGE_IN).alias("m"), broken.alias("bad_json")).select("raw", "m.*", "bad_json")


def read_chunk_messages(spark: SparkSession, path: str) -> DataFrame:
    return parse_messages(spark.read.text(path))


def stream_chunk_messages(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return parse_messages(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path))


def message_json(*columns: str) -> Column:
    return to_jsonable(F.struct(*columns)).alias("value")


def write_chunk_messages(df: DataFrame, path: str, mode: str = "append") -> int:
    """Write one JSON object a line (characters as they are, nothing escaped to ASCII); returns how many, counted on the way."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).select(message_json(*df.columns)).write.mode(mode).text(path)
    return seen.get["n"]


def read_job_metadata(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Job metadata documents, success and failure forms alike: files named *.meta.json with one each, or, with
    one_per_file=False, lines as write_job_metadata() writes them."""
    reader = spark.read.schema(JOB_METADATA)
    if not one_per_file:
        return reader.json(path)
    return reader.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.meta.json").json(path)


def write_job_metadata(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per job and line."""
    df.select(to_jsonable(F.struct("*")).alias("value")).write.mode(mode).text(path)
