"""Folds started at several places give what the fold from beginning to end gives."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from captionloom.operators import chunks, long_jobs

WORDS = ["a", "b", "no", "yes", "go on", "w" * 30, "x" * 12, "and so on"]


def some_job(r, n, kind):
    if kind == "short":
        texts = [" ".join(r.choices(WORDS, k=r.randrange(1, 5))) for _ in range(n)]
    elif kind == "large":  # every text is a chunk of its own
        texts = ["y" * r.randrange(40, 60) + r.choice(WORDS) for _ in range(n)]
    elif kind == "rolling":  # each repeats the end of the one before
        said = [r.choice(WORDS) + str(k) for k in range(3 * n)]
        texts = [" ".join(said[3 * k : 3 * k + 6]) for k in range(n)]
    else:  # lockstep: pairs that fill a chunk, so that folds one cue apart never agree
        texts = [f"{k:020d}" for k in range(n)]
    return [(float(k), k + 0.5, t) for k, t in enumerate(texts)]


def together(cues, cut, options):
    """The segments' chunks put together as pack_long_jobs() does, in plain Python."""
    parts = [cues[k : k + cut] for k in range(0, len(cues), cut)]
    dicts = [[{"start": a, "end": b, "text": t} for a, b, t in p] for p in parts]
    out, state = [], None
    for p in dicts:
        if state is None:
            pre, skip, end = [], 0, None
        else:
            pre, skip, end = long_jobs.caught_up(p, options, state)
        fold = long_jobs.Fold(*options)
        own = [x for c in p for x in fold.add(c["start"], c["end"], c["text"])]
        out += [(c["text"], c["time_from"], c["time_to"]) for c in pre] + (own[skip:] if skip is not None else [])
        state = fold.state() if skip is not None else end
    return out + long_jobs.Fold(*options, state).rest() if state else out


@pytest.mark.parametrize("kind", ["short", "large", "rolling", "lockstep"])
def test_segments_like_one_fold(kind):
    r = random.Random(kind)
    for k in range(40):
        job = some_job(r, r.randrange(0, 60), kind)
        for options in ((41, True, False), (41, True, True), (60, False, False), (1, True, False)):
            want = list(chunks.pack(job, *options))
            fold = long_jobs.Fold(*options)
            assert [x for c in job for x in fold.add(*c)] + fold.rest() == want
            assert together(job, r.randrange(1, 9), options) == want


def test_jobs_of_many_segments(spark):
    r = random.Random(8)
    jobs = {f"{kind}{k}": some_job(r, n, kind) for kind in ("short", "large", "rolling", "lockstep") for k, n in enumerate((1, 9, 70))}
    rows = [(j, k, *c) for j, job in jobs.items() for k, c in enumerate(job)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "job_id string, cue_no int, start double, end double, text string")
    got = long_jobs.pack_long_jobs(df, 41, normalized=True, segment=6).collect()
    for j, job in jobs.items():
        mine = sorted((x.chunk_no, x.text, x.time_from, x.time_to) for x in got if x.job_id == j)
        assert mine == [(k, *c) for k, c in enumerate(chunks.pack(job, 41))]
    assert long_jobs.pack_long_jobs(df.where("false")).count() == 0


def test_one_long_job(spark):
    """200,000 cues of one job: no task has more than its share, and the chunks are those of the one fold."""
    words = F.concat(F.lit("w"), (F.xxhash64("id") % 97).cast("string"), F.lit(" "), F.repeat(F.lit("v"), (F.abs(F.xxhash64("id")) % 40 + 1).cast("int")))
    df = spark.range(200_000).select(F.lit("j").alias("job_id"), F.col("id").alias("cue_no"), F.col("id").cast("double").alias("start"), (F.col("id") + 1).cast("double").alias("end"), words.alias("text"))
    got = long_jobs.pack_long_jobs(df, normalized=True, segment=5_000).orderBy("chunk_no").collect()
    job = [(r.start, r.end, r.text) for r in df.collect()]
    assert [(r.text, r.time_from, r.time_to) for r in got] == list(chunks.pack(job, 500)) and [r.chunk_no for r in got] == list(range(len(got)))


def spanning_jobs(spark):
    """Jobs of all kinds and more ranges than jobs, so that most ranges begin in the middle of a job; one job has no name."""
    r = random.Random(21)
    jobs = {f"{kind}{n}": some_job(r, n, kind) for kind in ("short", "large", "rolling", "lockstep") for n in (1, 40, 300)} | {None: some_job(r, 60, "short")}
    rows = [(j, k, *c) for j, job in jobs.items() for k, c in enumerate(job)]
    r.shuffle(rows)
    return jobs, spark.createDataFrame(rows, "job_id string, cue_no int, start double, end double, text string").repartition(3)


@pytest.mark.parametrize("options", [(41, True, False), (41, True, True), (60, False, False), (1, True, False)])
@pytest.mark.parametrize("segment", [4, 1_000])
def test_jobs_over_many_ranges(spark, options, segment):
    jobs, df = spanning_jobs(spark)
    got = long_jobs.pack_long_jobs(df, *options, normalized=True, segment=segment, ranges=23).collect()
    for j, job in jobs.items():
        mine = sorted((x.chunk_no, x.text, x.time_from, x.time_to) for x in got if x.job_id == j)
        assert mine == [(k, *c) for k, c in enumerate(chunks.pack(job, *options))], j


def test_disk_of_short_segments(spark):
    """What is written on the way, shuffles and all, is a few times the cues, however short the segments are."""
    words = F.concat_ws(" ", *[F.md5(F.concat(F.col("id").cast("string"), F.lit(str(k)))) for k in range(3)])
    df = spark.range(60_000).select((F.col("id") % 100).cast("string").alias("job_id"), F.col("id").alias("cue_no"), F.col("id").cast("double").alias("start"), (F.col("id") + 1).cast("double").alias("end"), words.alias("text"))
    at = Path(spark.conf.get("spark.checkpoint.dir")).parent
    size = lambda: sum(p.stat().st_size for p in at.rglob("*") if p.is_file())
    before = size()
    n = long_jobs.pack_long_jobs(df, overlap=False, normalized=True, segment=100).count()
    assert n == 12_000 and size() - before < 4 * 60_000 * 98
