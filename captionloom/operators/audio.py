"""Planning of audio segments from loudness: noise floor, silences, cuts, segments. All per job, in columns and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captionloom.operators.stored import joined_in_parts, ranged, stored


#: Buckets that a job's values are counted into in a pass of noise_floor(), and how many frames may be left to be sorted.
FLOOR_BUCKETS, FLOOR_ROWS = 1024, 100_000
#: Loudness below or above which a value counts as infinite.
ENDLESS = 1e300


def noise_floor(loudness: DataFrame, offset: float, low: float, high: float, buckets: int = FLOOR_BUCKETS, rows: int = FLOOR_ROWS) -> DataFrame:
    """(job_id, p10, noise_db) of frames (job_id, rms_db): the 10th percentile less offset, within [low, high].

    The percentile is the value of rank ceil(n / 10), exactly, and no task holds a job's values: the frames of a job that has
    more than `rows` are counted into `buckets` parts of their range, combined before the shuffle; the part that holds the
    wanted rank is counted again in the same way, until few enough frames are left or all of them are equal. A pass is a
    scan; jobs of usual length need none. Null and NaN are no values; jobs without a value have nulls.
    """
    within = F.greatest(F.lit(-ENDLESS), F.least(F.lit(ENDLESS), F.col("rms_db").cast("double")))
    known = loudness.where("rms_db IS NOT NULL AND NOT isnan(rms_db)").select("job_id", within.alias("v"))
    state = stored(known.groupBy("job_id").agg(F.expr("(count(*) + 9) div 10").alias("rank"), F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")))
    inside = lambda jobs: joined_in_parts(known, jobs, ["job_id"]).where("v >= a AND v <= b")
    wide = (F.col("n") > rows) & (F.col("a") < F.col("b"))
    while not state.where(wide).isEmpty():
        part = F.least(F.lit(buckets - 1), F.floor((F.col("v") - F.col("a")) / (F.col("b") - F.col("a")) * buckets))
        counts = inside(state.where(wide).drop("n")).groupBy("job_id", "rank", part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b"))
        upto = F.sum("n").over(Window.partitionBy("job_id").orderBy("part"))  # a row a part of the job
        hit = counts.withColumn("upto", upto).where("upto >= rank AND upto - n < rank")
        state = stored(state.where(~wide).unionByName(hit.select("job_id", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "n", "a", "b")))
    few = inside(state.where("a < b").drop("n")).groupBy("job_id", "rank", "v").agg(F.count("*").alias("n"))
    ranked = few.withColumn("upto", F.sum("n").over(Window.partitionBy("job_id").orderBy("v"))).where("upto >= rank")
    p10 = ranked.groupBy("job_id").agg(F.min("v").alias("p10")).unionByName(state.where("a = b").select("job_id", F.col("a").alias("p10")))
    p10 = p10.withColumn("p10", F.when(F.col("p10") <= -ENDLESS, float("-inf")).when(F.col("p10") >= ENDLESS, float("inf")).otherwise(F.col("p10")))
    floor = F.least(F.lit(high), F.greatest(F.lit(low), F.col("p10") - offset))
    return loudness.select("job_id").distinct().join(p10, "job_id", "left").withColumn("noise_db", F.when(F.col("p10").isNotNull(), floor))


def detect_silences(frames: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, start, end, dur, mid) from frames (keys, frame_no, t, rms_db, noise_db, min_d).

    A silence is a maximal run at or below noise_db that a louder frame ends, or one without loudness; it runs to that
    frame's time and must last min_d. A run that the data end in is not reported. Frames are dealt in ranges of (keys,
    frame_no), so that one recording of any length is worked on by all cores; what crosses a range's border is settled by
    one row a range and key.
    """
    keys = keys or ["job_id"]
    quiet = F.coalesce(F.col("rms_db") <= F.col("noise_db"), F.lit(False))
    dealt = ranged(frames.select(*keys, "frame_no", "t", quiet.alias("quiet"), "min_d"), *keys, "frame_no")
    inside = Window.partitionBy("range", *keys).orderBy("frame_no")
    marked = dealt.withColumn("before", F.lag("quiet").over(inside))
    turned = F.col("before").isNotNull() & (F.col("quiet") != F.col("before"))
    at = F.col("frame_no")
    ends = marked.groupBy("range", *keys).agg(F.min_by("quiet", at).alias("first"), F.min_by("t", at).alias("first_t"), F.max_by("quiet", at).alias("last"), F.min_by(F.when(turned, F.col("t")), F.when(turned, at)).alias("turn_t"))
    across = Window.partitionBy(*keys).orderBy("range")  # a row a range of the key
    ends = ends.withColumn("opens", F.coalesce(F.lag("last").over(across) != F.col("first"), F.lit(True)))
    own = F.when(F.col("opens"), F.col("first_t")).otherwise(F.col("turn_t"))
    ends = ends.withColumn("own", own).select("range", *keys, "opens", F.first("own", True).over(across.rowsBetween(1, Window.unboundedFollowing)).alias("next_t"))
    turns = marked.where(turned | F.col("before").isNull()).withColumn("end", F.lead("t").over(inside)).join(ends, ["range", *keys])
    turns = turns.where(F.col("before").isNotNull() | F.col("opens")).withColumn("end", F.coalesce("end", "next_t"))
    runs = turns.where(F.col("quiet") & F.col("end").isNotNull() & (F.col("end") - F.col("t") >= F.col("min_d")))
    dur = F.col("end") - F.col("start")
    return runs.select(*keys, F.col("t").alias("start"), "end").select(*keys, "start", "end", dur.alias("dur"), (F.col("start") + dur / 2).alias("mid"))


def detect_silences_adaptive(loudness: DataFrame, floors: DataFrame, min_d: float, low: float, steps: tuple[float, ...] = (5.0, 10.0, 15.0)) -> DataFrame:
    """detect_silences() with `pass` and `noise_db`; jobs without any are tried again, quieter by each step but half as long.

    The first pass that finds something counts. Later passes run together, and only over the jobs that need them.
    """
    if min_d < 0:
        raise ValueError("min_d must not be negative")
    known = floors.select("job_id", "noise_db")
    frames = loudness.join(known, "job_id")
    first = detect_silences(frames.withColumn("min_d", F.lit(min_d)), ["job_id", "noise_db"]).withColumn("pass", F.lit(1))
    missing = frames.join(first.select("job_id").distinct(), "job_id", "left_anti")
    tries = F.explode(F.array(*[F.struct(F.lit(k).alias("pass"), F.lit(d).alias("lower")) for k, d in enumerate(steps, 2)]))
    again = missing.select("job_id", "frame_no", "t", "rms_db", "noise_db", tries.alias("try")).withColumn("noise_db", F.greatest(F.lit(low), F.col("noise_db") - F.col("try.lower")))
    again = again.withColumns({"pass": F.col("try.pass"), "min_d": F.lit(max(0.05, min_d / 2))})
    found = detect_silences(again, ["job_id", "noise_db", "pass"])
    best = found.withColumn("best", F.min("pass").over(Window.partitionBy("job_id"))).where("pass = best").drop("best")
    columns = ["job_id", "pass", "noise_db", "start", "end", "dur", "mid"]
    return first.select(*columns).unionByName(best.select(*columns))


def nearest(targets: DataFrame, points: DataFrame, limit: float) -> DataFrame:
    """targets (job_id, target) with `point`: the nearest of points (job_id, mid) within limit, the earlier of two; else null.

    Targets and points are merged and sorted by time, forth and back, per job; the neighbours on both sides are the only
    candidates, and either window looks at rows that it has passed already.
    """
    both = targets.select("job_id", F.col("target").alias("at"), F.lit(1).alias("asks")).unionByName(points.select("job_id", F.col("mid").alias("at"), F.lit(0).alias("asks")))
    own = F.when(F.col("asks") == 0, F.col("at"))
    passed = lambda *order: F.last(own, True).over(Window.partitionBy("job_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    near = both.select("job_id", "at", "asks", passed("at", "asks").alias("before"), passed(F.desc("at"), "asks").alias("after"))
    later = F.col("before").isNull() | (F.col("after") - F.col("at") < F.col("at") - F.col("before"))
    point = F.when(F.col("after").isNotNull() & later, F.col("after")).otherwise(F.col("before"))
    return near.where("asks = 1").select("job_id", F.col("at").alias("target"), F.when(F.abs(point - F.col("at")) <= limit, point).alias("point"))


def select_cuts(durations: DataFrame, silences: DataFrame, chunk: float, window: float, global_limit: float, min_seg: float, eps: float = 0.25) -> DataFrame:
    """(job_id, duration, cuts): 0, the silence nearest to every multiple of chunk, and the end, min_seg apart at least.

    A remainder shorter than min_seg is dropped. Cuts closer than eps to the last kept one go.
    """
    numbers = F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.col("duration") / chunk).cast("int")))
    wanted = durations.select("job_id", F.explode(F.transform(numbers, lambda n: n * F.lit(float(chunk)))).alias("target"), "duration").where("target < duration")
    snapped = nearest(wanted.select("job_id", "target"), silences, max(window, global_limit)).where("point IS NOT NULL")
    picked = snapped.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("target", "point"))).alias("held"))
    points = F.coalesce(F.col("held.point"), F.array().cast("array<double>"))
    apart = F.aggregate(points, F.array(F.lit(0.0)), lambda kept, p: F.when(p - F.element_at(kept, -1) >= min_seg, F.concat(kept, F.array(p))).otherwise(kept))
    closed = F.when(F.col("duration") - F.element_at("cuts", -1) >= min_seg, F.concat("cuts", F.array("duration"))).otherwise(F.col("cuts"))
    found = durations.join(picked, "job_id", "left").select("job_id", "duration", apart.alias("cuts")).withColumn("cuts", closed)
    return found.withColumn("cuts", dedup_eps(F.col("cuts"), eps))


def dedup_eps(points: Column, eps: float = 0.25) -> Column:
    """A sorted array without values within eps of the last kept one."""
    return F.aggregate(F.array_sort(points), F.array().cast("array<double>"), lambda kept, p: F.when((F.size(kept) == 0) | (p - F.try_element_at(kept, F.lit(-1)) > eps), F.concat(kept, F.array(p))).otherwise(kept))


def _clamped(a: Column, b: Column, pad: float) -> Column:
    within = lambda x: F.greatest(F.lit(0.0), F.least(F.col("duration"), x))
    return F.struct(within(a + pad).alias("start"), within(b - pad).alias("end"))


def build_segments(cuts: DataFrame, min_seg: float, pad: float) -> DataFrame:
    """cuts with `segments`: neighbouring cuts min_seg apart, shrunk by pad at both ends, inside the recording."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("cuts") - 1)), lambda k: F.struct(F.get("cuts", k - 1).alias("a"), F.get("cuts", k).alias("b")))
    long = F.filter(pairs, lambda p: p["b"].isNotNull() & (p["b"] - p["a"] >= min_seg))
    return cuts.withColumn("segments", F.transform(long, lambda p: _clamped(p["a"], p["b"], pad)))


def uniform(duration: Column, chunk: float, pad: float) -> Column:
    """Equal parts of chunk seconds, each of max(5, 2 pad) seconds at least, padded."""
    starts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(duration / chunk).cast("int")) - 1), lambda k: k * F.lit(float(chunk)))
    parts = F.transform(starts, lambda s: F.struct(s.alias("a"), F.least(duration, s + chunk).alias("b")))
    long = F.filter(parts, lambda p: p["b"] - p["a"] >= max(5.0, 2 * pad))
    return F.transform(long, lambda p: _clamped(p["a"], p["b"], pad))


def plan_segments(durations: DataFrame, silences: DataFrame, chunk: float, window: float, global_limit: float, min_seg: float, pad: float) -> DataFrame:
    """(job_id, duration, cuts, segments, method): by silences, or uniform where those give one segment or none of a long job."""
    built = build_segments(select_cuts(durations, silences, chunk, window, global_limit, min_seg), min_seg, pad)
    poor = (F.size("segments") <= 1) & (F.col("duration") > 1.25 * chunk)
    return built.withColumn("method", F.when(poor, "uniform-fallback").otherwise("silence")).withColumn("segments", F.when(poor, uniform(F.col("duration"), chunk, pad)).otherwise(F.col("segments")))


def segment_rows(plans: DataFrame) -> DataFrame:
    """(job_id, seg_no, start, end), seg_no from 0."""
    return plans.select("job_id", F.posexplode("segments").alias("seg_no", "s")).select("job_id", "seg_no", "s.start", "s.end")


def segmentation_stats(floors: DataFrame, silences: DataFrame, plans: DataFrame) -> DataFrame:
    """One row a job: duration, noise, silences, passes, cuts, segments, method, seconds not covered; names begin with split_."""
    found = silences.groupBy("job_id").agg(F.count("*").alias("silences"), F.max("pass").alias("passes"), F.min("noise_db").alias("noise_db_used"))
    covered = F.aggregate("segments", F.lit(0.0), lambda acc, s: acc + s["end"] - s["start"])
    out = plans.join(floors, "job_id", "left").join(found, "job_id", "left").select(
        "job_id", "duration", "p10", "noise_db", F.coalesce("noise_db_used", "noise_db").alias("noise_db_used"), F.coalesce("silences", F.lit(0)).alias("silences"), F.coalesce("passes", F.lit(4)).alias("passes"),
        F.size("cuts").alias("cuts"), F.size("segments").alias("segments"), "method", (F.col("duration") - covered).alias("uncovered"),
    )
    return out.withColumnsRenamed({c: f"split_{c}" for c in out.columns if c != "job_id"})
