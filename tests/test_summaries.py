import numpy as np
from pyspark.sql import functions as F

from captionloom.operators import summaries


def test_merged_sketches_are_near_the_exact_figures(spark, tmp_path):
    """Thirty days, stored one by one and one of them again: counts exact, quantiles and distinct jobs within their bounds."""
    at, n = str(tmp_path / "days"), 60_000
    seconds = F.exp((F.pmod(F.xxhash64("id"), F.lit(100_000)) / 10_000.0))
    fields = F.struct(F.when(F.col("id") % 3 == 0, "whisper").otherwise("captions").alias("method"), F.lit("en").alias("lang"), F.lit(2).alias("chunks"))
    stage = F.struct(F.struct(F.struct(F.lit("en").alias("lang")).alias("selected")).alias("captions"))
    docs = spark.range(n).select((F.col("id") % 40_000).cast("string").alias("job_id"), (F.col("id") % 30).alias("day"), fields.alias("text_processing"), stage.alias("stages"), (F.col("id") % 10 != 0).alias("success"), F.when(F.col("id") % 1000 != 0, seconds).alias("total_seconds"))
    for k in (range(0, 10), range(10, 30), range(3, 4)):
        summaries.store_days(docs.where(F.col("day").isin(*k)), F.col("day"), at)
    days = summaries.read_days(spark, at)
    assert days.count() == 30  # a day holds one method: ids of a day are all divisible by three or none is
    (got,) = summaries.merged_summary(days.withColumn("all", F.lit(1)), "all").collect()
    x = np.sort(docs.where("total_seconds IS NOT NULL").select("total_seconds").toPandas()["total_seconds"].to_numpy())
    assert got.jobs == n and got.chunks == 2 * n and abs(got.success_share - 0.9) < 1e-9 and abs(got.total_seconds / x.mean() - 1) < 1e-9
    assert abs(got.distinct_jobs / 40_000 - 1) < 0.05
    for q, v in ((0.5, got.total_p50), (0.9, got.total_p90)):
        assert abs(np.searchsorted(x, v) / len(x) - q) < 0.02
    empty = summaries.merged_summary(summaries.daily_summaries(docs.withColumn("total_seconds", F.lit(None).cast("double")), F.col("day"))).collect()
    assert {r.total_p90 for r in empty} == {None} and {r.total_seconds for r in empty} == {None}
