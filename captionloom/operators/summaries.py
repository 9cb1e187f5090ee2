"""Run summaries from sketches that are stored per day and merged per report: documents are read once, on their day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size of the quantile sketch (rank error of about 0.7%) and, as a power of two, of the distinct-count sketch (about 1.6%).
KLL_K, HLL_LG_K = 400, 12


def daily_summaries(documents: DataFrame, day: Column) -> DataFrame:
    """(day, method, lang, jobs, successes, seconds, chunks, seconds_sketch, jobs_sketch) of metadata documents: counts and
    sums, a quantile sketch of total seconds and a sketch of the distinct jobs. A row of some kilobytes a day, method and
    language, combined before the shuffle. Null and NaN seconds are in no sketch and add nothing."""
    method, lang = F.coalesce("text_processing.method", F.lit("none")), F.coalesce("text_processing.lang", "stages.captions.selected.lang", F.lit("none"))
    seconds = F.when(~F.isnan("total_seconds"), F.col("total_seconds").cast("double"))
    return documents.groupBy(day.alias("day"), method.alias("method"), lang.alias("lang")).agg(
        F.count("*").alias("jobs"), F.count_if(F.coalesce("success", F.lit(False))).alias("successes"), F.count(seconds).alias("timed"), F.coalesce(F.sum(seconds), F.lit(0.0)).alias("seconds"),
        F.coalesce(F.sum("text_processing.chunks"), F.lit(0)).alias("chunks"), F.kll_sketch_agg_double(seconds, F.lit(KLL_K)).alias("seconds_sketch"), F.hll_sketch_agg("job_id", F.lit(HLL_LG_K)).alias("jobs_sketch"),
    )


def store_days(documents: DataFrame, day: Column, path: str) -> None:
    """daily_summaries() under path, a folder a day; days that come again are replaced, others stay."""
    daily_summaries(documents, day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def merged_summary(summaries: DataFrame, *by: str, quantiles: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """Per `by` (method and lang, unless given; any of day, method, lang): jobs, distinct_jobs, success_share, mean seconds,
    chunks, and quantiles as total_p50 and so on, from stored rows alone. Counts and means are exact; quantiles are off by
    the sketch's rank error, distinct jobs by its relative error, however many days are merged."""
    keys = list(by) or ["method", "lang"]
    held = summaries.groupBy(*keys).agg(
        F.sum("jobs").alias("jobs"), F.hll_sketch_estimate(F.hll_union_agg("jobs_sketch")).alias("distinct_jobs"), (F.sum("successes") / F.sum("jobs")).alias("success_share"),
        F.try_divide(F.sum("seconds"), F.sum("timed")).alias("total_seconds"), F.sum("chunks").alias("chunks"), F.sum("timed").alias("timed"), F.kll_merge_agg_double("seconds_sketch").alias("sketch"),
    )
    told = {f"total_p{round(100 * q)}": F.when(F.col("timed") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(q))) for q in quantiles}
    return held.withColumns(told).drop("sketch", "timed")


def read_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
