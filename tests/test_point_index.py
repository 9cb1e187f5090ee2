import datetime

from pyspark.sql import functions as F

from captionloom.operators import point_index, points, vectors

UTC = datetime.timezone.utc


def some_points(spark, first, n):
    k = F.col("id")
    payload = F.struct(F.concat(F.lit("u"), k % 3).alias("user_id"), F.when(k % 500 == 7, "rare").otherwise("usual").alias("source"), F.lit("en").alias("lang"), F.concat(F.lit("Part "), k, F.when(k % 900 == 5, ", Zebra!").otherwise("")).alias("title"), F.timestamp_seconds(k * 60).alias("created_at"))
    return spark.range(first, first + n).select(F.concat(F.lit("p"), k).alias("id"), F.array((k % 7).cast("float"), (k % 11).cast("float")).alias("vector"), payload.alias("payload"), F.lit(first).alias("order"))


def test_filters_read_only_buckets_that_match(spark, tmp_path):
    path = str(tmp_path / "points")
    points.upsert_points(some_points(spark, 0, 4000), path, bucket_rows=100)
    assert point_index.index_points(spark, path) == len(points.live_buckets(spark, path)) >= 40
    assert point_index.index_points(spark, path) == 0
    points.upsert_points(some_points(spark, 3990, 20), path, bucket_rows=100)
    rows = points.read_points(spark, path)
    at = lambda m: datetime.datetime.fromtimestamp(60 * m, UTC)
    tests = [{"source": "rare"}, {"title_word": "ZEBRA"}, {"title_word": "zebra", "user_id": "u1"}, {"source": "rare", "lang": "en", "created_from": at(500), "created_to": at(2600)}, {"source": "none"}, {"created_from": at(4005)}, {"title_word": "part"}, {}]

    def check():
        for t in tests:
            got, want = point_index.read_points_where(spark, path, **t), rows.where(vectors.payload_filter(**t))
            assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect()), t
        few = point_index.matching_buckets(spark, path, source="rare")
        return len(few), len(point_index.read_points_where(spark, path, source="rare").inputFiles()), len(points.live_buckets(spark, path))

    assert check()[2] > 40  # what isn't indexed yet is read
    fresh = point_index.index_points(spark, path)
    assert 0 < fresh < 30
    few, files, live = check()
    assert few == files <= 9 and live >= 40
    query = spark.createDataFrame([(1, [1.0, 2.0])], "query_id int, vector array<float>")
    hits = lambda pts: [tuple(r) for r in vectors.search_topk(pts, query, 3).orderBy("rank").collect()]
    assert hits(point_index.read_points_where(spark, path, source="rare")) == hits(rows.where(vectors.payload_filter(source="rare")))
